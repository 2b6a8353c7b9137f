"""Detectors over unordered streams: keyed state that takes a key's events in the order of their time, once the watermark has passed them.

Each gives the rows of its batch form, in whatever order events arrive, if none is later than the watermark allows; later ones are left out and counted (`late_rows`). They need the RocksDB
state store. Input is a stream with event_id, occurred_at and what the detector reads; events behind the last watermark wait in the state.
"""

from __future__ import annotations

import bisect
import pickle
import uuid
from collections import deque
from collections.abc import Callable, Iterator
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from skerry.functions import scalars as X
from skerry.operators.detectors import ANNOUNCED, severity_by_validity
from skerry.operators.scan import RollingMedian

SECOND = 1_000_000
#: Events that a block of a key's buffer holds at most.
BLOCK = 50_000
#: Events that a task gathers before it deals them out by key, and the column that holds a key's.
GATHERED, PACKED = 100_000, "__events"
#: What names of observed metrics that count late rows begin with.
LATE = "late_rows_"


def late_rows(query: StreamingQuery) -> int:
    """ST9: rows that a query's stateful operators have left out because the watermark had passed them, over the progress that it remembers."""
    progress = query.recentProgress
    own = sum(row["rows"] or 0 for p in progress for name, row in (p["observedMetrics"] or {}).items() if name.startswith(LATE))
    return own + sum(op["numRowsDroppedByWatermark"] for p in progress for op in p["stateOperators"])


class InOrder(StatefulProcessor):
    """ST9: a buffer that hands a key's events to `step` in the order of (at, event_id).

    Events wait in the state until the watermark reaches their time; one event-time timer a key, at its earliest waiting event, lets out all that the watermark has passed. What comes out
    later is later, since rows behind the watermark are left out: by Spark, or of packed events here. So a key holds the events of the watermark's delay, in blocks: a micro-batch's events of a key go to the state and come
    back as one value (or one for each BLOCK), since each value costs a call.
    """

    #: What is kept of an event; at (microseconds) and event_id come first.
    fields: tuple[str, ...] = ("at bigint", "event_id bigint")
    #: Columns of what comes out.
    out: str = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.names = [f.split()[0] for f in self.fields]
        self.out_names = [f.split()[0] for f in self.out.split(", ")]
        self.held = handle.getListState("held", "at bigint, events binary")  # the least time in a block, and its events
        self.next = handle.getValueState("next", "ms bigint")
        self.open()

    def open(self) -> None:
        """Declares further state."""

    def step(self, key: tuple, events: list[tuple]) -> Iterator[tuple]:
        """Output rows for the next events of a key, in order, all of one instant together."""
        raise NotImplementedError

    def elapsed(self, key: tuple, ms: int) -> Iterator[tuple]:
        """Output rows when a timer of the detector's own has elapsed."""
        return iter(())

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new, take, packed = [], None, False
        for r in rows:
            if take is None:
                packed = PACKED in r.__fields__
                take = itemgetter(*map(r.__fields__.index, [PACKED] if packed else self.names))
            if packed:
                new += pickle.loads(take(r))
            else:
                new.append(take(r))
        new.sort(key=itemgetter(0, 1))
        late = 0
        if packed and (passed := timerValues.getCurrentWatermarkInMs()) > 0:
            late = bisect.bisect_right(new, passed * 1000, key=itemgetter(0))
            del new[:late]
        if new:
            self.held.appendList(self._blocks(new))
            self._wait(new[0][0])
        return iter([Row(**dict.fromkeys(self.out_names), late=late)] if late else ())

    def _blocks(self, events: list[tuple]) -> list[tuple]:
        """Rows of the buffer for events in order."""
        return [(events[i][0], pickle.dumps(events[i : i + BLOCK], pickle.HIGHEST_PROTOCOL)) for i in range(0, len(events), BLOCK)]

    def _wait(self, at: int) -> None:
        due = -(-at // 1000)
        have = self.next.get()[0] if self.next.exists() else None
        if have is None or due < have:
            if have is not None:
                self.handle.deleteTimer(have)
            self.handle.registerTimer(due)
            self.next.update((due,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        due = self.next.get()[0] if self.next.exists() else None
        if due == expiredTimerInfo.getExpiryTimeInMs():
            passed = timerValues.getCurrentWatermarkInMs() * 1000
            waiting = sorted((e for r in self.held.get() for e in pickle.loads(r[1])), key=itemgetter(0, 1))
            ready = bisect.bisect_right(waiting, passed, key=lambda r: r[0])
            self.next.clear()
            if ready < len(waiting):
                self.held.put(self._blocks(waiting[ready:]))
                self._wait(waiting[ready][0])
            else:
                self.held.clear()
            found = self.step(key, waiting[:ready])
        else:
            found = self.elapsed(key, expiredTimerInfo.getExpiryTimeInMs())
        return (Row(**dict(zip(self.out_names, r)), late=None) for r in list(found))

    def close(self) -> None:
        pass


def by_key(events: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Rows (keys, PACKED) of events: those of a key that a task has gathered as one value, since each row that goes to keyed state costs a call for each of its columns."""

    def run(batches):
        held, n, kinds = {}, 0, []

        def dealt():
            cols = [pa.array([k[i] for k in held], kind) for i, kind in enumerate(kinds)]
            return pa.RecordBatch.from_arrays([*cols, pa.array([pickle.dumps(e, pickle.HIGHEST_PROTOCOL) for e in held.values()], pa.binary())], [*keys, PACKED])

        for batch in batches:
            kinds = [batch.schema.field(k).type for k in keys]
            for k, e in zip(zip(*(batch[c].to_pylist() for c in keys)), zip(*(batch[c].to_pylist() for c in names))):
                held.setdefault(k, []).append(e)
            n += batch.num_rows
            if n >= GATHERED:
                yield dealt()
                held, n = {}, 0
        if held:
            yield dealt()

    return events.select(*dict.fromkeys([*keys, *names])).mapInArrow(run, T.StructType([*(events.schema[k] for k in keys), T.StructField(PACKED, T.BinaryType())]))


def applied(events: DataFrame, keys: list[str], detector: InOrder, late: str, packed: bool = True) -> DataFrame:
    """The detector over a stream with occurred_at, by keys; `late` is how far the watermark stays behind the newest event. Its output's `at` becomes occurred_at.

    Packed events are late if they are behind the watermark that their micro-batch begins with. What another stateful operator puts out may be, and isn't packed."""
    own = events.withColumn("at", F.unix_micros("occurred_at")).withWatermark("occurred_at", late)
    if packed:
        own = by_key(own, keys, [f.split()[0] for f in detector.fields])
    out = own.groupBy(*keys).transformWithState(detector, f"{detector.out}, late bigint", "Append", "EventTime")
    out = out.observe(LATE + uuid.uuid4().hex, F.sum("late").alias("rows")).where("late IS NULL").drop("late")
    return out.withColumn("at", F.timestamp_micros("at")).withColumnRenamed("at", "occurred_at") if "at bigint" in detector.out.split(", ") else out


def announced(routes: DataFrame, *more: str | Column) -> DataFrame:
    return routes.where(ANNOUNCED).select("event_id", "occurred_at", "prefix", "peer_addr", *more)


def _origins(routes: DataFrame) -> DataFrame:
    return announced(routes, X.origin_asn("as_path", "integer").alias("origin")).where("origin IS NOT NULL")


class NewOrigins(InOrder):
    """D1, ST2: a prefix's origins, kept forever."""

    fields = (*InOrder.fields, "peer_addr string", "origin bigint")
    out = "event_id bigint, at bigint, prefix string, peer_addr string, new_origin bigint, old_origin bigint"

    def open(self):
        self.known = self.handle.getMapState("known", "origin bigint", "first_at bigint")

    def step(self, key, events):
        known = [k[0] for k in self.known.keys()]
        for at, event, peer, origin in events:
            if origin not in known:
                for old in known:
                    yield event, at, key[0], peer, origin, old
                known.append(origin)
                self.known.updateValue((origin,), (at,))


def new_origins(routes: DataFrame, late: str = "10 seconds") -> DataFrame:
    """D1 as a stream."""
    return applied(_origins(routes), ["prefix"], NewOrigins(), late)


class OriginChanges(InOrder):
    """A prefix's and peer's last origin and since when."""

    fields = (*InOrder.fields, "origin bigint")
    out = "event_id bigint, at bigint, prefix string, peer_addr string, old_origin bigint, new_origin bigint, stable_s double"

    def __init__(self, grace_s: int = 300):
        self.grace_s = grace_s

    def open(self):
        self.last = self.handle.getValueState("last", "origin bigint, at bigint")

    def step(self, key, events):
        last = tuple(self.last.get()) if self.last.exists() else None
        for at, event, origin in events:
            if last and last[0] != origin and at - last[1] >= self.grace_s * SECOND:
                yield event, at, *key, last[0], origin, round((at - last[1]) / 1e6, 6)
            last = (origin, at)
        if last:
            self.last.update(last)


def origin_changes(routes: DataFrame, grace_s: int = 300, late: str = "10 seconds") -> DataFrame:
    """D4 as a stream, without severity (see judged)."""
    return applied(_origins(routes), ["prefix", "peer_addr"], OriginChanges(grace_s), late)


class ShortenedPaths(InOrder):
    """D2, ST4: the lengths of a prefix's last `size` paths."""

    fields = (*InOrder.fields, "peer_addr string", "as_path_len int")
    out = "event_id bigint, at bigint, prefix string, peer_addr string, as_path_len int, mean_before double"

    def __init__(self, before: int = 5, share: float = 0.5, size: int = 20):
        self.before, self.share, self.size = before, share, size

    def open(self):
        self.ring = self.handle.getValueState("ring", "sizes array<int>")

    def step(self, key, events):
        ring = deque(self.ring.get()[0] if self.ring.exists() else (), maxlen=self.size)
        for at, event, peer, size in events:
            mean = sum(ring) / len(ring) if ring else 0.0
            if len(ring) >= self.before and size < mean * self.share:
                yield event, at, key[0], peer, size, round(mean, 6)
            ring.append(size)
        self.ring.update((list(ring),))


def shortened_paths(routes: DataFrame, before: int = 5, share: float = 0.5, late: str = "10 seconds") -> DataFrame:
    """D2 as a stream."""
    return applied(announced(routes, "as_path_len").where("as_path_len > 0"), ["prefix"], ShortenedPaths(before, share), late)


class Leaks(InOrder):
    """D5, ST2: the shortest path of a prefix and peer."""

    fields = (*InOrder.fields, "as_path_len int", "only_to_customer bigint")
    out = "event_id bigint, at bigint, prefix string, peer_addr string, evidence string"

    def __init__(self, hops: int = 3):
        self.hops = hops

    def open(self):
        self.shortest = self.handle.getValueState("shortest", "len int")

    def step(self, key, events):
        least = self.shortest.get()[0] if self.shortest.exists() else None
        for at, event, size, otc in events:
            if otc is not None:
                yield event, at, *key, "otc"
            elif least is not None and least - size >= self.hops:
                yield event, at, *key, "short"
            least = size if least is None else min(least, size)
        self.shortest.update((least,))


def leaks(routes: DataFrame, hops: int = 3, late: str = "10 seconds") -> DataFrame:
    """D5 as a stream."""
    return applied(announced(routes, "as_path_len", "only_to_customer").where("as_path_len > 0"), ["prefix", "peer_addr"], Leaks(hops), late)


class MedOscillation(InOrder):
    """D6, ST3: the meds of a prefix and peer in the last seconds, with what each turned."""

    fields = (*InOrder.fields, "med bigint")
    out = "event_id bigint, at bigint, prefix string, peer_addr string, observations int, turns int"

    def __init__(self, seconds: int = 60, least: int = 5):
        self.seconds, self.least = seconds, least

    def open(self):
        self.seen = self.handle.getListState("seen", "at bigint, med bigint, rises boolean, turn int")

    def step(self, key, events):
        seen = deque(tuple(r) for r in self.seen.get()) if self.seen.exists() else deque()
        turns = sum(s[3] for s in seen)
        for at, event, med in events:
            rises = med > seen[-1][1] if seen else None
            turn = int(bool(seen) and seen[-1][2] is not None and rises != seen[-1][2])
            seen.append((at, med, rises, turn))
            turns += turn
            while seen[0][0] < at - self.seconds * SECOND:
                turns -= seen.popleft()[3]
            inside = turns - seen[0][3] - (seen[1][3] if len(seen) > 1 else 0)  # a turn takes three events
            if len(seen) >= self.least and inside >= 2:
                yield event, at, *key, len(seen), inside
        self.seen.put(list(seen))


def med_oscillation(routes: DataFrame, seconds: int = 60, least: int = 5, late: str = "10 seconds") -> DataFrame:
    """D6 as a stream."""
    return applied(announced(routes, "med").where("med IS NOT NULL"), ["prefix", "peer_addr"], MedOscillation(seconds, least), late)


class Hijacks(InOrder):
    """D7, ST3: when each of a prefix's origins was last seen, over any peer; a timer drops those of a prefix that fell silent."""

    fields = (*InOrder.fields, "peer_addr string", "origin bigint")
    out = "event_id bigint, at bigint, prefix string, peer_addr string, new_origin bigint, known string"

    def __init__(self, seconds: int = 3600):
        self.seconds = seconds

    def open(self):
        self.origins = self.handle.getMapState("origins", "origin bigint", "at bigint")
        self.evict = self.handle.getValueState("evict", "ms bigint")

    def step(self, key, events):
        seen = {k[0]: v[0] for k, v in self.origins.iterator()}
        before, now, at_once = dict(seen), None, {}
        for at, event, peer, origin in events:
            if at != now:  # events of one instant don't see each other
                seen |= at_once
                now, at_once = at, {}
                seen = {o: t for o, t in seen.items() if t >= at - self.seconds * SECOND}
            if seen and origin not in seen:
                yield event, at, key[0], peer, origin, " ".join(map(str, sorted(seen)))
            at_once[origin] = at
        seen |= at_once
        for o in before.keys() - seen.keys():
            self.origins.removeKey((o,))
        for o, t in seen.items():
            if before.get(o) != t:
                self.origins.updateValue((o,), (t,))
        if self.evict.exists():
            self.handle.deleteTimer(self.evict.get()[0])
        ms = now // 1000 + self.seconds * 1000 + 1
        while self.next.exists() and self.next.get()[0] == ms:
            ms += 1
        self.handle.registerTimer(ms)
        self.evict.update((ms,))

    def elapsed(self, key, ms):
        if self.evict.exists() and self.evict.get()[0] == ms and not self.held.exists():
            self.origins.clear()
            self.evict.clear()
        return iter(())


def hijacks(routes: DataFrame, seconds: int = 3600, late: str = "10 seconds") -> DataFrame:
    """D7 as a stream by prefix, without severity (see judged)."""
    return applied(_origins(routes), ["prefix"], Hijacks(seconds), late)


def route_alerts(routes: DataFrame, seconds: int = 3600, meds: int = 60, late: str = "10 seconds") -> DataFrame:
    """D4 to D7 as one stream of (event_id, occurred_at, prefix, peer_addr, kind), each kept by the key that its detector asks for."""
    found = {"origin_change": origin_changes(routes, late=late), "leak": leaks(routes, late=late), "med_oscillation": med_oscillation(routes, meds, late=late), "hijack": hijacks(routes, seconds, late)}
    out = None
    for kind, df in found.items():
        df = df.select("event_id", "occurred_at", "prefix", "peer_addr", F.lit(kind).alias("kind"))
        out = df if out is None else out.unionByName(df)
    return out


def judged(alerts: DataFrame, vrps: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Alerts (prefix, new_origin) with the severity of their validity, batch by batch; vrps is asked for the authorisations of every batch anew, so a newer dump counts from then on."""

    def each(batch: DataFrame, batch_id: int) -> None:
        write(severity_by_validity(batch.withColumn("origin", F.col("new_origin")), vrps()).drop("origin", "origin_asn", "rpki_validity", "more_specific"), batch_id)

    return alerts.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


class SlowConvergence(InOrder):
    """D11, W6, ST4: a peer's episodes of the last days, `most` at most, and their median."""

    fields = (*InOrder.fields, "convergence_ms double")
    out = "peer_addr string, at bigint, convergence_ms double, median double, ratio double, severity string"

    def __init__(self, days: int = 7, least: int = 3, most: int = 2000):
        self.days, self.least, self.most = days, least, most

    def open(self):
        self.rows = self.handle.getListState("rows", "at bigint, ms double")

    def step(self, key, events):
        seen = RollingMedian(self.most, self.days * 86400 * SECOND, (tuple(r) for r in self.rows.get()) if self.rows.exists() else ())
        for at, _, ms in events:
            median, n = seen.seen(at)
            if n >= self.least and median > 0 and ms / median >= 3:
                yield key[0], at, ms, median, round(ms / median, 6), "critical" if ms / median >= 6 else "warning"
            seen.add(at, ms)
        self.rows.put(list(seen.rows))


def slow_convergence(events: DataFrame, days: int = 7, least: int = 3, late: str = "10 seconds") -> DataFrame:
    """D11 as a stream over (peer_addr, started_at, convergence_ms)."""
    own = events.select("peer_addr", F.col("started_at").alias("occurred_at"), F.round(F.col("convergence_ms") * 1000).cast("bigint").alias("event_id"), F.col("convergence_ms").cast("double").alias("convergence_ms"))
    return applied(own, ["peer_addr"], SlowConvergence(days, least), late, packed=False).withColumnRenamed("occurred_at", "started_at")


class Suppressed(InOrder):
    """When a key's last alert was let through; forgotten by a timer when it suppresses nothing any more."""

    fields = (*InOrder.fields, "severity string")
    out = "at bigint, event_id bigint, kind string, prefix string, peer_addr string, severity string"

    def __init__(self, seconds: int = 300):
        self.seconds = seconds

    def open(self):
        self.sent = self.handle.getValueState("sent", "at bigint, ms bigint")

    def step(self, key, events):
        last, ms = tuple(self.sent.get()) if self.sent.exists() else (None, None)
        first = last
        for at, event, severity in events:
            if last is None or at - last >= self.seconds * SECOND:
                last = at
                yield at, event, *key, severity
        if last != first:
            if ms is not None:
                self.handle.deleteTimer(ms)
            ms = last // 1000 + self.seconds * 1000 + 1
            while self.next.exists() and self.next.get()[0] == ms:
                ms += 1
            self.handle.registerTimer(ms)
            self.sent.update((last, ms))

    def elapsed(self, key, ms):
        if self.sent.exists() and self.sent.get()[1] == ms:
            self.sent.clear()
        return iter(())


def suppress(alerts: DataFrame, seconds: int = 300, late: str = "10 seconds") -> DataFrame:
    """D8 as a stream: of the alerts with one kind, prefix and peer those that come so long after the last one that was let through."""
    return applied(alerts, ["kind", "prefix", "peer_addr"], Suppressed(seconds), late, packed=False)


class Episodes(InOrder):
    """D10, J12, ST5: a peer's open convergence episode, as detectors.convergence_events has them. A timer ends one that has fallen quiet."""

    fields = (*InOrder.fields, "rank int", "kind string", "prefix string")
    out = "speaker_addr string, peer_addr string, started_at bigint, eor_at bigint, convergence_ms double, withdraws bigint, affected_prefixes bigint, recovered_prefixes bigint, unreachable_after bigint, ended_by string"

    def __init__(self, quiet_s: float = 5.0, least: int = 1):
        self.quiet, self.least = int(quiet_s * SECOND), least

    def open(self):
        self.now = self.handle.getValueState("now", "start bigint, last bigint, withdraws bigint, ms bigint")
        self.then = self.handle.getMapState("then", "prefix string", "kind string")

    def _end(self, key, episode, then, at, by):
        start, _, n = episode
        back = sum(k == "announce" for k in then.values())
        return *key, start, at, (at - start) / 1000, n, len(then), back, len(then) - back, by

    def step(self, key, events):
        episode, ms, then = None, None, {}
        if self.now.exists():
            *episode, ms = self.now.get()
            then = {k[0]: v[0] for k, v in self.then.iterator()}
        if ms is not None:
            self.handle.deleteTimer(ms)
        for at, _, _, kind, prefix in sorted(events, key=lambda e: (*e[:3], e[3])):
            if episode and episode[2] >= self.least and at - episode[1] >= self.quiet:
                yield self._end(key, episode, then, episode[1] + self.quiet, "quiet")
                episode = None
            if kind == "peer_down":
                episode, then = [at, at, 0], {}
            elif episode and kind in ("withdraw", "announce"):
                episode[1] = at
                episode[2] += kind == "withdraw"
                then[prefix] = kind
            elif episode and kind in ("peer_up", "stat"):
                yield self._end(key, episode, then, at, kind)
                episode = None
        self.then.clear()
        if episode:
            for prefix, kind in then.items():
                self.then.updateValue((prefix,), (kind,))
            ms = None
            if episode[2] >= self.least:
                ms = -(-(episode[1] + self.quiet) // 1000)
                while self.next.exists() and self.next.get()[0] == ms:
                    ms += 1
                self.handle.registerTimer(ms)
            self.now.update((*episode, ms))
        else:
            self.now.clear()

    def elapsed(self, key, ms):
        if self.now.exists() and self.now.get()[3] == ms:
            *episode, _ = self.now.get()
            waiting = min((r[0] for r in self.held.get()), default=None) if self.held.exists() else None
            if waiting is None or waiting - episode[1] >= self.quiet:
                then = {k[0]: v[0] for k, v in self.then.iterator()}
                self.now.clear()
                self.then.clear()
                yield self._end(key, episode, then, episode[1] + self.quiet, "quiet")


def convergence_events(peers: DataFrame, routes: DataFrame, stats: DataFrame, quiet_s: float = 5.0, least: int = 1, end_stats: tuple[int, ...] = (7, 8), late: str = "10 seconds") -> DataFrame:
    """D10, J12 as a stream: the episodes of detectors.convergence_events."""
    base = ["event_id", "occurred_at", "speaker_addr", "peer_addr"]
    of = lambda df, kind, prefix, rank=0: df.select(*base, kind.alias("kind"), prefix.alias("prefix"), F.lit(rank).alias("rank"))
    none = F.lit(None).cast("string")
    every = of(peers, F.col("event_type"), none).unionByName(of(routes, F.col("action"), F.col("prefix")))
    every = every.unionByName(of(stats.where(F.col("stat_type").isin(*end_stats) & (F.col("counter_value") == 0)), F.lit("stat"), none, 1))
    out = applied(every, ["speaker_addr", "peer_addr"], Episodes(quiet_s, least), late)
    return out.withColumns({c: F.timestamp_micros(c) for c in ("started_at", "eor_at")})


class StaleRoutes(InOrder):
    """P5, ST6: the live routes of a share of a peer's prefixes. A down makes them stale, one timer expires those that haven't come anew by then."""

    fields = (*InOrder.fields, "kind string", "prefix string")
    out = "peer_addr string, prefix string, at bigint, change string"

    def __init__(self, stale_s: int | None):
        self.stale_s = stale_s

    def open(self):
        self.routes = self.handle.getMapState("routes", "prefix string", "stale_at bigint")  # null: live
        self.due = self.handle.getValueState("due", "at bigint, ms bigint")

    def _expire(self, key, routes, until):
        for prefix, stale in sorted(routes.items()):
            if stale is not None and stale + self.stale_s * SECOND <= until:
                del routes[prefix]
                yield key[0], prefix, stale + self.stale_s * SECOND, "expired"

    def step(self, key, events):
        routes = {k[0]: v[0] for k, v in self.routes.iterator()}
        before = dict(routes)
        for at, _, kind, prefix in events:
            if self.stale_s is not None:
                yield from self._expire(key, routes, at)
            if kind == "announce":
                routes[prefix] = None
            elif kind == "withdraw" and prefix in routes:
                del routes[prefix]
                yield key[0], prefix, at, "withdrawn"
            elif kind == "peer_down":
                for prefix, stale in sorted(routes.items()):
                    if self.stale_s is None:
                        del routes[prefix]
                        yield key[0], prefix, at, "withdrawn"
                    elif stale is None:
                        routes[prefix] = at
                        yield key[0], prefix, at, "stale"
        self._keep(before, routes)

    def _keep(self, before, routes):
        for prefix in before.keys() - routes.keys():
            self.routes.removeKey((prefix,))
        for prefix, stale in routes.items():
            if prefix not in before or before[prefix] != stale:
                self.routes.updateValue((prefix,), (stale,))
        if self.due.exists():
            self.handle.deleteTimer(self.due.get()[1])
            self.due.clear()
        stale = min((s for s in routes.values() if s is not None), default=None)
        if stale is not None:
            ms = -(-stale // 1000) + self.stale_s * 1000
            while self.next.exists() and self.next.get()[0] == ms:
                ms += 1
            self.handle.registerTimer(ms)
            self.due.update((stale, ms))

    def elapsed(self, key, ms):
        if self.due.exists() and self.due.get()[1] == ms:
            until = self.due.get()[0] + self.stale_s * SECOND
            if self.held.exists() and min(r[0] for r in self.held.get()) < until:
                return  # what waits comes first, and expires it then
            routes = {k[0]: v[0] for k, v in self.routes.iterator()}
            before = dict(routes)
            yield from self._expire(key, routes, until)
            self._keep(before, routes)


def stale_routes(changes: DataFrame, stale_s: int | None, late: str = "10 seconds", shares: int = 16) -> DataFrame:
    """P5, ST6 as a stream over (event_id, occurred_at, peer_addr, kind, prefix): withdrawn, stale and expired routes. Kinds are announce, withdraw and peer_down; one down, without a prefix,
    does for all of a peer's routes. Without stale_s (no long-lived restart) a down withdraws them. A peer's prefixes are dealt to `shares` keys, each of which sees its downs."""
    every = F.sequence(F.lit(0), F.lit(shares - 1))
    dealt = changes.withColumn("share", F.explode(F.when(F.col("kind") == "peer_down", every).otherwise(F.array(F.pmod(F.hash("prefix"), F.lit(shares))))))
    return applied(dealt, ["peer_addr", "share"], StaleRoutes(stale_s), late)


def shed(events: DataFrame, budget: int, seconds: int = 1, late: str = "10 seconds") -> DataFrame:
    """D15 as a stream: statistics (kind stats) of spans that aren't over budget, held until their span's count is final. Counts are aggregated before the shuffle, then joined."""
    span = f"{seconds} seconds"
    own = events.withWatermark("occurred_at", late)
    counts = own.groupBy(F.window("occurred_at", span).alias("span")).agg(F.count("*").alias("events"))
    stats = own.where("kind = 'stats'").withColumns({"span": F.window("occurred_at", span), "__at": F.unix_micros("occurred_at")}).drop("occurred_at")  # one event time is left
    kept = stats.join(counts, "span").where(F.col("events") <= budget * seconds)
    return kept.select(*(F.timestamp_micros("__at").alias(c) if c == "occurred_at" else c for c in events.columns))


def down_effects(peers: DataFrame, routes: DataFrame, seconds: int = 30, late: str | None = None) -> DataFrame:
    """Every peer_down with the route events of its peer in so many seconds from it on, or with nulls. With `late` both sides are streams, and a down without any comes out when the
    watermark has passed its span. Over history rows meet by spans of time too: a down's events lie in its own and the next span, whose first and last event tell whether it has any."""
    downs = peers.where("event_type = 'peer_down'").select("speaker_addr", "peer_addr", F.col("event_id").alias("down_id"), F.col("occurred_at").alias("down_at"))
    own = routes.select(F.col("speaker_addr").alias("r_speaker"), F.col("peer_addr").alias("r_peer"), "event_id", F.col("occurred_at").alias("route_at"), "action", "prefix")
    same = (F.col("speaker_addr") == F.col("r_speaker")) & (F.col("peer_addr") == F.col("r_peer"))
    within = (F.col("route_at") >= F.col("down_at")) & (F.col("route_at") <= F.col("down_at") + F.expr(f"INTERVAL {seconds} SECONDS"))
    if late is not None:
        return downs.withWatermark("down_at", late).join(own.withWatermark("route_at", late), same & within, "left_outer").drop("r_speaker", "r_peer")
    wide = max(1, seconds) * SECOND
    span = lambda c: F.floor(F.unix_micros(c) / F.lit(wide))
    downs, own = downs.withColumn("span", span("down_at")), own.withColumn("r_span", span("route_at"))
    met = downs.withColumn("span", F.explode(F.array("span", F.col("span") + 1))).join(own, same & (F.col("span") == F.col("r_span")) & within).drop("r_speaker", "r_peer", "span", "r_span")
    edges = own.groupBy("r_speaker", "r_peer", "r_span").agg(F.min("route_at").alias("first"), F.max("route_at").alias("last"))
    here = edges.select(F.col("r_speaker").alias("speaker_addr"), F.col("r_peer").alias("peer_addr"), F.col("r_span").alias("span"), "last")
    after = edges.select(F.col("r_speaker").alias("speaker_addr"), F.col("r_peer").alias("peer_addr"), (F.col("r_span") - 1).alias("span"), "first")
    some = (F.col("last") >= F.col("down_at")) | (F.col("first") <= F.col("down_at") + F.expr(f"INTERVAL {seconds} SECONDS"))
    key = ["speaker_addr", "peer_addr", "span"]
    alone = downs.join(here, key, "left").join(after, key, "left").where(~F.coalesce(some, F.lit(False)))
    return met.unionByName(alone.select("speaker_addr", "peer_addr", "down_id", "down_at"), allowMissingColumns=True).select(*met.columns)
