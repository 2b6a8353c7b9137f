"""Anomaly detectors over stored history. Each returns rows of ALERT columns or its own facts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.functions import scalars as X
from skerry.operators.aggregates import hourly_churn
from skerry.operators.joins import validate_origins
from skerry.operators.scan import SLICE, rolling_median, running
from skerry.operators.state import ORDER
from skerry.operators.windows import rolling_zscore, running_min_path, trailing_path_mean

ANNOUNCED = "action = 'announce'"


def micros() -> Column:
    return F.unix_micros("occurred_at")


def _range(key: list[str], seconds: int, include: bool = False):
    return Window.partitionBy(*key).orderBy(micros()).rangeBetween(-seconds * 1_000_000, 0 if include else -1)


def new_origins(routes: DataFrame) -> DataFrame:
    """Announcements by an origin not seen for the prefix before, while others were; a row for each of those."""
    w = Window.partitionBy("prefix").orderBy(*ORDER)
    own = routes.where(ANNOUNCED).withColumn("origin", X.origin_asn("as_path", "integer")).where("origin IS NOT NULL")
    # the first announcements of each (prefix, origin) are all that matters: their set stays small however long the history is
    first = own.withColumn("__n", F.row_number().over(Window.partitionBy("prefix", "origin").orderBy(*ORDER))).where("__n = 1")
    known = first.withColumn("known", F.collect_list("origin").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    return known.select("event_id", "occurred_at", "prefix", "peer_addr", F.col("origin").alias("new_origin"), F.explode("known").alias("old_origin"))


def shortened_paths(routes: DataFrame, before: int = 5, share: float = 0.5) -> DataFrame:
    """Paths shorter than half of the mean of the 20 before, of which there are five at least."""
    out = trailing_path_mean(routes).where((F.col("before") >= before) & (F.col("as_path_len") < F.col("mean_before") * share))
    return out.select("event_id", "occurred_at", "prefix", "peer_addr", "as_path_len", F.round("mean_before", 6).alias("mean_before"))


def otc_leaks(routes: DataFrame, customers: DataFrame) -> DataFrame:
    """D3: announcements marked only-to-customer (in ext_communities, or by the attribute) from a peer that is no customer (peer_addr)."""
    marked = F.col("only_to_customer").isNotNull() if "only_to_customer" in routes.columns else F.lit(False)
    if "ext_communities" in routes.columns:
        marked = marked | F.lower(F.coalesce("ext_communities", F.lit(""))).rlike("otc|only-to-customer")
    return routes.where(F.expr(ANNOUNCED) & marked).join(customers.select("peer_addr").distinct(), "peer_addr", "left_anti").select("event_id", "occurred_at", "prefix", "peer_addr")


def origin_changes(routes: DataFrame, vrps: DataFrame | None = None, grace_s: int = 300) -> DataFrame:
    """Announcements whose origin differs from the one before of the same prefix and peer, if that came grace_s earlier at least; severity by validity."""
    w = Window.partitionBy("prefix", "peer_addr").orderBy(*ORDER)
    own = routes.where(ANNOUNCED).withColumn("origin", X.origin_asn("as_path", "integer")).where("origin IS NOT NULL")
    own = own.withColumns({"old_origin": F.lag("origin").over(w), "stable_s": (micros() - F.lag(micros()).over(w)) / 1e6})
    out = own.where((F.col("old_origin") != F.col("origin")) & (F.col("stable_s") >= grace_s))
    return severity_by_validity(out, vrps).select("event_id", "occurred_at", "prefix", "peer_addr", "old_origin", F.col("origin").alias("new_origin"), F.round("stable_s", 6).alias("stable_s"), "severity")


def severity_by_validity(df: DataFrame, vrps: DataFrame | None) -> DataFrame:
    """invalid is critical, valid info, else warning. df has prefix and origin."""
    if vrps is None:
        return df.withColumn("severity", F.lit("warning"))
    v = validate_origins(df, vrps, F.col("origin"))
    return v.withColumn("severity", F.when(F.col("rpki_validity") == "invalid", "critical").when(F.col("rpki_validity") == "valid", "info").otherwise("warning"))


def leaks(routes: DataFrame, hops: int = 3) -> DataFrame:
    """Only-to-customer routes, and paths so many hops shorter than the shortest before."""
    otc = F.col("only_to_customer").isNotNull()
    out = running_min_path(routes).withColumn("evidence", F.when(otc, "otc").when(F.col("min_before") - F.col("as_path_len") >= hops, "short"))
    return out.where("evidence IS NOT NULL").select("event_id", "occurred_at", "prefix", "peer_addr", "evidence")


def med_oscillation(routes: DataFrame, seconds: int = 60, least: int = 5) -> DataFrame:
    """Events whose last `seconds` hold five meds, two of them different, with two turns between rising and not rising (falling or staying) at least.

    Rows of one instant are ordered by event, and each sees those up to itself. Rows are numbered and turns summed up in that order; what the first row of the last `seconds` has of both tells
    what lies since. Where there are two turns, two meds differ.
    """
    key = ["prefix", "peer_addr"]
    own = routes.where(ANNOUNCED).where("med IS NOT NULL").select("event_id", "occurred_at", *key, "med")
    order = Window.partitionBy(*key).orderBy(*ORDER)
    own = own.withColumns({"at": micros(), "rises": F.col("med") > F.lag("med").over(order)})
    own = own.withColumn("turn", F.coalesce((F.col("rises") != F.lag("rises").over(order)).cast("int"), F.lit(0)))
    own = own.withColumns({"i": F.row_number().over(order), "turned": F.sum("turn").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    # a turn takes three events: those of the first two lie partly before the span
    own = own.withColumn("second", F.coalesce(F.lead("turned").over(order), F.col("turned")))
    first = F.min(F.struct("i", "second")).over(Window.partitionBy(*key).orderBy("at").rangeBetween(-seconds * 1_000_000, 0))
    out = own.withColumn("first", first).withColumns({"observations": F.col("i") - F.col("first.i") + 1, "turns": F.col("turned") - F.col("first.second")})
    return out.where((F.col("observations") >= least) & (F.col("turns") >= 2)).select("event_id", "occurred_at", *key, F.col("observations").cast("int").alias("observations"), F.col("turns").cast("int").alias("turns"))


def hijacks(routes: DataFrame, vrps: DataFrame | None = None, seconds: int = 3600) -> DataFrame:
    """Announcements by an origin that the prefix hadn't in the last hour, while it had others.

    The last time of the prefix, and of the prefix and origin, tell which they are; only for those the others are gathered, by time buckets.
    """
    own = routes.where(ANNOUNCED).withColumn("origin", X.origin_asn("as_path", "integer")).where("origin IS NOT NULL").select("event_id", "occurred_at", "prefix", "peer_addr", "as_path", "origin", micros().alias("at"))
    since = seconds * 1_000_000
    before = lambda *k: F.max("at").over(Window.partitionBy(*k).orderBy("at").rangeBetween(Window.unboundedPreceding, -1))
    out = own.withColumns({"last": before("prefix"), "same": before("prefix", "origin")}).where((F.col("last") >= F.col("at") - since) & ~F.coalesce(F.col("same") >= F.col("at") - since, F.lit(False)))
    bucket = F.floor(F.col("at") / since)
    other = own.groupBy("prefix", bucket.alias("bucket"), "origin", "at").agg(F.lit(1).alias("one"))
    hits = out.select("event_id", "prefix", F.col("at").alias("now"), F.explode(F.array(bucket, bucket - 1)).alias("bucket"))
    known = hits.join(other, ["prefix", "bucket"]).where((F.col("at") < F.col("now")) & (F.col("at") >= F.col("now") - since)).groupBy("event_id", "prefix", "now").agg(F.array_join(F.sort_array(F.collect_set("origin")).cast("array<string>"), " ").alias("known"))
    out = out.join(known.withColumnRenamed("now", "at"), ["event_id", "prefix", "at"])
    return severity_by_validity(out, vrps).select("event_id", "occurred_at", "prefix", "peer_addr", F.col("origin").alias("new_origin"), "known", "severity")


ALERT = ("occurred_at", "event_id", "kind", "prefix", "peer_addr", "severity")


def as_alerts(df: DataFrame, kind: str, severity: str | Column | None = None) -> DataFrame:
    s = F.col("severity") if severity is None else F.lit(severity) if isinstance(severity, str) else severity
    return df.select("occurred_at", "event_id", F.lit(kind).alias("kind"), "prefix", "peer_addr", s.alias("severity"))


def all_alerts(routes: DataFrame, vrps: DataFrame | None = None) -> DataFrame:
    """D8, first part: alerts of D4-D7 in one table; order by occurred_at, event_id and kind."""
    return as_alerts(origin_changes(routes, vrps), "origin_change").unionByName(as_alerts(leaks(routes), "leak", "warning")).unionByName(as_alerts(med_oscillation(routes), "med_oscillation", "warning")).unionByName(as_alerts(hijacks(routes, vrps), "hijack"))


def suppress(alerts: DataFrame, seconds: int = 300) -> DataFrame:
    """D8, second part: of the alerts with one kind, prefix and peer those that come so long after the last one that was let through.

    A fold over each key's alerts in order. Alerts of a key that come after a pause of that length start afresh whatever came before, so each run between pauses is folded alone:
    no group is larger than a burst.
    """
    key = ["kind", "prefix", "peer_addr"]
    w = Window.partitionBy(*key).orderBy("occurred_at", "event_id")
    gap = micros() - F.lag(micros()).over(w)
    runs = alerts.withColumn("run", F.sum(F.when(gap.isNull() | (gap >= seconds * 1_000_000), 1).otherwise(0)).over(w))

    columns = alerts.columns

    def fold(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["occurred_at", "event_id"])
        last, kept = None, []
        for t in df["occurred_at"]:
            sent = last is None or (t - last).total_seconds() >= seconds
            kept.append(sent)
            last = t if sent else last
        return df.loc[kept, columns]

    return runs.groupBy(*key, "run").applyInPandas(fold, alerts.schema)


def convergence_events(peers: DataFrame, routes: DataFrame, stats: DataFrame, quiet_s: float = 5.0, least: int = 1, end_stats: tuple[int, ...] = (7, 8), slice_s: int = SLICE) -> DataFrame:
    """Convergence episodes of each peer.

    A down starts an episode, another one restarts it. It ends with an up, with a statistic of end_stats at 0, or, if it has had `least` withdrawals, when quiet_s pass without an event of
    a route; one that none of these ends before the next down, or before the history does, is left out. So there is one at most between two downs, and it ends at the first event there that
    ends it or comes too late. A peer's history, and what lies between two downs, are split by time (scan.running).
    """
    base = ["speaker_addr", "peer_addr", "occurred_at", "event_id"]
    none = F.lit(None).cast("string")
    stops = F.col("stat_type").isin(*end_stats) & (F.col("counter_value") == 0)
    p = peers.select(*base, F.col("event_type").alias("kind"), none.alias("prefix"))
    r = routes.select(*base, F.col("action").alias("kind"), "prefix")
    every = p.unionByName(r).unionByName(stats.where(stops).select(*base, F.lit("stat").alias("kind"), none.alias("prefix")))
    peer, part = ["speaker_addr", "peer_addr"], ["speaker_addr", "peer_addr", "part"]
    order = ("occurred_at", "event_id", "rank", "kind")
    down, route = F.col("kind") == "peer_down", F.col("kind").isin("withdraw", "announce")
    every = every.select(*base, "kind", "prefix", micros().alias("t"), F.when(F.col("kind") == "stat", 1).otherwise(0).alias("rank"))
    every = running(every, peer, {"part": ("sum", down.cast("int"))}, order, seconds=slice_s).where("part > 0")
    seen = running(every, part, {"n": ("sum", (F.col("kind") == "withdraw").cast("int")), "last": ("max", F.when(down | route, F.col("t")))}, order, before=True, seconds=slice_s)
    quiet = int(quiet_s * 1e6)
    over = F.when((F.col("n") >= least) & (F.col("t") - F.col("last") >= quiet), F.struct((F.col("last") + quiet).alias("at"), F.lit("quiet").alias("by"))).when(F.col("kind").isin("peer_up", "stat"), F.struct(F.col("t").alias("at"), F.col("kind").alias("by")))
    live = running(seen.withColumn("over", over), part, {"ended": ("first", F.col("over"))}, order, seconds=slice_s)
    within = live.where(route & F.col("ended").isNull()).groupBy(*part, "prefix").agg(F.count_if(F.col("kind") == "withdraw").alias("n"), F.max("t").alias("last"), F.max_by("kind", F.struct("occurred_at", "event_id", "kind")).alias("then"))
    within = within.groupBy(*part).agg(F.sum("n").alias("withdraws"), F.count("*").alias("affected_prefixes"), F.count_if(F.col("then") == "announce").alias("recovered_prefixes"), F.max("last").alias("last"))
    episodes = live.groupBy(*part).agg(F.min("t").alias("start"), F.max("ended").alias("ended"))
    episodes = episodes.withColumn("next", F.lead("start").over(Window.partitionBy(*peer).orderBy("part"))).join(within, part, "left")
    n = F.coalesce("withdraws", F.lit(0))
    late = F.when((n >= least) & (F.col("next") - F.col("last") >= quiet), F.struct((F.col("last") + quiet).alias("at"), F.lit("quiet").alias("by")))
    out = episodes.withColumn("ended", F.coalesce("ended", late)).where("ended IS NOT NULL")
    hit, back = F.coalesce("affected_prefixes", F.lit(0)), F.coalesce("recovered_prefixes", F.lit(0))
    return out.select(*peer, F.timestamp_micros("start").alias("started_at"), F.timestamp_micros("ended.at").alias("eor_at"), ((F.col("ended.at") - F.col("start")) / 1000).alias("convergence_ms"), n.alias("withdraws"), hit.alias("affected_prefixes"), back.alias("recovered_prefixes"), (hit - back).alias("unreachable_after"), F.col("ended.by").alias("ended_by"))


def slow_convergence(events: DataFrame, days: int = 7, least: int = 3) -> DataFrame:
    """Episodes three times as long as the median of their peer's last days (three or more): warning, or six times: critical."""
    out = rolling_median(events.withColumn("occurred_at", F.col("started_at")), "peer_addr", "convergence_ms", days, ties=("convergence_ms",)).where((F.col("prior") >= least) & (F.col("median") > 0))
    ratio = F.col("convergence_ms") / F.col("median")
    return out.where(ratio >= 3).select("peer_addr", "started_at", "convergence_ms", "median", F.round(ratio, 6).alias("ratio"), F.when(ratio >= 6, "critical").otherwise("warning").alias("severity"))


def flap_scores(peers: DataFrame, hours: float | None = None) -> DataFrame:
    """Each peer's downs an hour over `hours`, or over the history's length; under 3 low, under 10 medium, else high."""
    downs = peers.where("event_type = 'peer_down'").groupBy("peer_addr").agg(F.count("*").alias("downs"))
    if hours is None:
        span = peers.agg(F.greatest((F.unix_micros(F.max("occurred_at")) - F.unix_micros(F.min("occurred_at"))) / 3.6e9, F.lit(1.0)).alias("hours"))
        downs = downs.join(span)  # one row
    else:
        downs = downs.withColumn("hours", F.lit(float(hours)))
    rate = F.col("downs") / F.col("hours")
    return downs.select("peer_addr", "downs", F.round(rate, 6).alias("per_hour"), F.when(rate < 3, "low").when(rate < 10, "medium").otherwise("high").alias("severity"))


def hourly_anomalies(routes: DataFrame, size: int = 60, limit: float = 3.0) -> DataFrame:
    """W5 over D14: prefixes' hours with a z-score beyond the limit."""
    return rolling_zscore(hourly_churn(routes), size, limit)


def anomaly_report(routes: DataFrame, peers: DataFrame, hours: float | None = None) -> DataFrame:
    """Rows for the anomaly table: detected_at, kind, prefix, peer_addr, score, severity. Flaps are counted over `hours`, as flap_scores does."""
    row = lambda df, kind, score, sev: df.select(F.col("occurred_at").alias("detected_at"), F.lit(kind).alias("kind"), "prefix", "peer_addr", F.round(score.cast("double"), 6).alias("score"), sev.alias("severity"))
    origin = row(new_origins(routes), "new_origin", F.lit(0.9), F.lit("critical"))
    short = row(shortened_paths(routes), "short_path", 1 - F.col("as_path_len") / F.col("mean_before"), F.lit("warning"))
    z = hourly_anomalies(routes).where("anomalous").select(F.col("hour").alias("occurred_at"), "prefix", F.lit(None).cast("string").alias("peer_addr"), "z")
    churn = row(z, "churn", F.abs("z"), F.when(F.abs("z") > 5, "critical").otherwise("warning"))
    last = peers.groupBy("peer_addr").agg(F.max("occurred_at").alias("occurred_at"))
    flap = flap_scores(peers, hours).where("severity <> 'low'").join(last, "peer_addr").withColumn("prefix", F.lit(None).cast("string"))
    flap = row(flap, "flap", F.col("per_hour"), F.when(F.col("severity") == "high", "critical").otherwise("warning"))
    return origin.unionByName(short).unionByName(churn).unionByName(flap)
