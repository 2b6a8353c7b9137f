"""Sequences of a key that are too long for one task: running values in two levels, and medians over the rows before.

A key's rows are cut by time to slices. Windows go over a slice; what lies before it is carried in from totals of slices, of which a key has few. So a busy key is split over tasks, and no
task has to hold or sort more than a slice of it.
"""

from __future__ import annotations

import bisect
from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORDER = ("occurred_at", "event_id")
#: Seconds of a slice. A key of many events an hour may want shorter ones.
SLICE = 86400


def slice_of(seconds: int = SLICE) -> Column:
    return F.floor(F.unix_micros("occurred_at") / (seconds * 1_000_000))


def running(df: DataFrame, keys: list[str], values: dict[str, tuple[str, Column]], order: tuple = ORDER, before: bool = False, seconds: int = SLICE) -> DataFrame:
    """df with running values of each key in order, up to and with each row, or of those before it: values is name -> (sum, max or first, a column); first is that which isn't null.

    order begins with occurred_at, ends in a total order, and has names of columns. Keys that are null see their slice alone. Sums of nothing are 0.
    """
    kind, columns = {n: k for n, (k, _) in values.items()}, df.columns
    df = df.withColumns({"__slice": slice_of(seconds), **{f"__{n}": c for n, (_, c) in values.items()}})
    one = {"sum": lambda c: F.sum(c), "max": lambda c: F.max(c), "first": lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct(*order, F.col(c).alias("v"))))}
    totals = df.groupBy(*keys, "__slice").agg(*(one[k](f"__{n}").alias(f"__c_{n}") for n, k in kind.items()))
    earlier = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    over = {"sum": F.sum, "max": F.max, "first": F.min}
    carried = totals.select(*keys, "__slice", *(over[k](f"__c_{n}").over(earlier).alias(f"__c_{n}") for n, k in kind.items()))
    within = Window.partitionBy(*keys, "__slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    inside = {"sum": lambda c: F.sum(c).over(within), "max": lambda c: F.max(c).over(within), "first": lambda c: F.first(c, ignorenulls=True).over(within)}
    out = df.withColumns({f"__{n}": inside[k](f"__{n}") for n, k in kind.items()}).join(carried, [*keys, "__slice"], "left")
    both = {"sum": lambda n: F.coalesce(f"__c_{n}", F.lit(0)) + F.coalesce(f"__{n}", F.lit(0)), "max": lambda n: F.greatest(f"__c_{n}", f"__{n}"), "first": lambda n: F.coalesce(f"__c_{n}.v", f"__{n}")}
    return out.withColumns({n: both[k](n) for n, k in kind.items()}).select(*columns, *kind)


def following(df: DataFrame, keys: list[str], name: str, value: Column, order: tuple = ORDER, seconds: int = SLICE) -> DataFrame:
    """df with the value of a key's next row; of a slice's last row that is the first of the next slice with any."""
    columns = df.columns
    df = df.withColumns({"__slice": slice_of(seconds), "__v": value})
    firsts = df.groupBy(*keys, "__slice").agg(F.min(F.struct(*order, F.col("__v").alias("v"))).alias("__first"))
    firsts = firsts.select(*keys, "__slice", F.lead("__first.v").over(Window.partitionBy(*keys).orderBy("__slice")).alias("__next"))
    within = Window.partitionBy(*keys, "__slice").orderBy(*order)
    last = F.lead(F.lit(1)).over(within).isNull()
    out = df.withColumns({name: F.lead("__v").over(within), "__last": last}).join(firsts, [*keys, "__slice"], "left")
    return out.withColumn(name, F.when(F.col("__last"), F.col("__next")).otherwise(F.col(name))).select(*columns, name)


class RollingMedian:
    """The values of a key's last `most` rows within `micros` before now, in order; so many values are all it ever holds."""

    def __init__(self, most: int, micros: int, rows=()):
        self.most, self.micros = most, micros
        self.rows: deque = deque()  # (time, value), oldest first; those of the latest instant aren't sorted in yet
        self.values: list = []
        self.sorted_in = 0
        for t, v in rows:
            self.add(t, v)

    def _move(self, now: int) -> None:
        while self.sorted_in < len(self.rows) and self.rows[self.sorted_in][0] < now:
            if (v := self.rows[self.sorted_in][1]) is not None:
                bisect.insort(self.values, v)
            self.sorted_in += 1

    def _drop(self) -> None:
        _, v = self.rows.popleft()
        if self.sorted_in:
            self.sorted_in -= 1
            if v is not None:
                del self.values[bisect.bisect_left(self.values, v)]

    def seen(self, now: int) -> tuple[float | None, int]:
        """(median, how many values) of what a row at `now` sees: rows of its own instant count among the last ones, but aren't seen."""
        self._move(now)
        while self.rows and self.rows[0][0] < now - self.micros:
            self._drop()
        n = len(self.values)
        if not n:
            return None, 0
        return (float(self.values[n // 2]) if n % 2 else (self.values[n // 2 - 1] + self.values[n // 2]) / 2), n

    def add(self, t: int, v) -> None:
        self.rows.append((t, v))
        if len(self.rows) > self.most:
            self._move(self.rows[0][0] + 1)
            self._drop()


def rolling_median(df: DataFrame, key: str, value: str, days: int = 7, most: int = 2000, ties: tuple[str, ...] = ("event_id",), block: int = 50_000) -> DataFrame:
    """The median of a key's values in the days before each row, of those of the last `most` rows, and their number (`prior`). Rows of one instant don't see each other.

    A key's rows are numbered and dealt to tasks by blocks of `block` rows, each with the `most` rows before it; a task goes over them in order and keeps the values of the last ones sorted.
    A null key is a key like others, but numbered by slices.
    """
    order = ("occurred_at", *ties)
    block = max(block, most)
    numbered = running(df.withColumn("__one", F.lit(1)), [key], {"__rn": ("sum", F.col("__one"))}, order)
    own = F.floor((F.col("__rn") - 1) / block)
    later = F.floor((F.col("__rn") - 1 + most) / block)
    dealt = numbered.withColumns({"__own": own, "__block": F.explode(F.array_distinct(F.array(own, later))), "__t": F.unix_micros("occurred_at"), "__value": F.col(value).cast("double")})
    names = df.columns

    def run(batches):
        at, state = None, None
        for batch in batches:
            medians, priors, kept = [], [], []
            for i, (k, block_, own_, t, v) in enumerate(zip(*(batch[c].to_pylist() for c in ("__key", "__block", "__own", "__t", "__value")))):
                if (k, block_) != at:
                    at, state = (k, block_), RollingMedian(most, days * 86_400_000_000)
                if own_ == block_:
                    m, n = state.seen(t)
                    kept.append(i)
                    medians.append(m)
                    priors.append(n)
                state.add(t, v)
            out = batch.take(pa.array(kept, pa.int64())).select(names)
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(medians, pa.float64()), pa.array(priors, pa.int32())], [*names, "median", "prior"])

    near = dealt.withColumn("__key", F.col(key)).repartition("__key", "__block").sortWithinPartitions("__key", "__block", "__rn")
    schema = df.select(*names, F.lit(None).cast("double").alias("median"), F.lit(None).cast("int").alias("prior")).schema
    return near.select(*names, "__key", "__block", "__own", "__t", "__value").mapInArrow(run, schema)
