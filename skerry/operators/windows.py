"""Sequences over time: gaps, sessions, rolling statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.operators.scan import SLICE, following, running
from skerry.operators.state import ORDER, top


def seconds() -> Column:
    return F.unix_micros("occurred_at") / 1e6


def convergence_gaps(routes: DataFrame, prefix: str | None = None, n: int | None = None) -> DataFrame:
    """Seconds since the event before of the same prefix and peer."""
    if prefix is not None:
        routes = routes.where(F.col("prefix") == prefix)
    w = Window.partitionBy("prefix", "peer_addr").orderBy(*ORDER)
    out = routes.select("event_id", "occurred_at", "prefix", "peer_addr", "action", F.round(seconds() - F.lag(seconds()).over(w), 6).alias("gap_s"))
    return top(out, [F.desc("occurred_at"), F.desc("event_id")], n)


def session_timeline(peers: DataFrame, peer: str | None = None, since: str | None = None, slice_s: int = SLICE) -> DataFrame:
    """Seconds until a peer's next session event, among the filtered events. A peer's history is split by time."""
    if peer is not None:
        peers = peers.where(F.col("peer_addr") == peer)
    if since is not None:
        peers = peers.where(F.col("occurred_at") >= F.lit(since).cast("timestamp"))
    out = following(peers.select("event_id", "occurred_at", "speaker_addr", "peer_addr", "event_type"), ["speaker_addr", "peer_addr"], "next", F.unix_micros("occurred_at"), seconds=slice_s)
    return out.select("event_id", "occurred_at", "speaker_addr", "peer_addr", "event_type", F.round(F.col("next") / 1e6 - seconds(), 6).alias("until_next_s"))


def sessions(peers: DataFrame, slice_s: int = SLICE) -> DataFrame:
    """Sessions from a peer's last up before each down; the last one may be ongoing. An island is what lies between downs. A peer's history is split by time."""
    down = F.col("event_type") == "peer_down"
    own = peers.select("event_id", "occurred_at", "speaker_addr", "peer_addr", "event_type")
    isle = running(own, ["speaker_addr", "peer_addr"], {"isle": ("sum", down.cast("int"))}, before=True, seconds=slice_s)
    out = isle.groupBy("speaker_addr", "peer_addr", "isle").agg(F.max(F.when(~down, F.col("occurred_at"))).alias("up_at"), F.max(F.when(down, F.col("occurred_at"))).alias("down_at")).where("up_at IS NOT NULL")
    return out.select("speaker_addr", "peer_addr", "up_at", "down_at", F.round((F.unix_micros("down_at") - F.unix_micros("up_at")) / 1e6, 6).alias("duration_s"), F.col("down_at").isNull().alias("ongoing"))


def longest_sessions(peers: DataFrame) -> DataFrame:
    """Each peer's number of sessions and longest ended one."""
    return sessions(peers).groupBy("speaker_addr", "peer_addr").agg(F.count("*").alias("sessions"), F.max("duration_s").alias("longest_s"))


def rolling_zscore(hourly: DataFrame, size: int = 60, limit: float = 3.0) -> DataFrame:
    """Each prefix's hourly events against its last `size` hours with events, by population deviation; 0 with under two of them or no deviation."""
    w = Window.partitionBy("prefix").orderBy("hour").rowsBetween(-(size - 1), 0)
    mean, dev, n = F.avg("events").over(w), F.stddev_pop("events").over(w), F.count("*").over(w)
    z = F.round(F.when((n < 2) | (dev == 0), 0.0).otherwise((F.col("events") - mean) / dev), 6)
    return hourly.withColumn("z", z).withColumn("anomalous", F.abs("z") > limit)


def trailing_path_mean(routes: DataFrame, size: int = 20) -> DataFrame:
    """The mean length of the last paths announced before for a prefix, and their number."""
    w = Window.partitionBy("prefix").orderBy(*ORDER).rowsBetween(-size, -1)
    return routes.where("action = 'announce' AND as_path_len > 0").withColumns({"mean_before": F.avg("as_path_len").over(w), "before": F.count("*").over(w)})


def running_min_path(routes: DataFrame) -> DataFrame:
    """The shortest path announced before for a prefix and peer."""
    w = Window.partitionBy("prefix", "peer_addr").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    return routes.where("action = 'announce' AND as_path_len > 0").withColumn("min_before", F.min("as_path_len").over(w))
