"""Current state from history: latest rows by key, listings, sessions, best paths, reconstructed tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skerry.functions import scalars as X

ORDER = ("occurred_at", "event_id")


def latest(df: DataFrame, keys: list[str], order: tuple[str, ...] = ORDER) -> DataFrame:
    """L1: the last row of each key; its rank is 1, so Spark keeps one row a key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return df.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def _checkpoint_dir(spark: SparkSession) -> str | None:
    """Where checkpoints go: spark.checkpoint.dir; where that is unset, a folder of this machine's if Spark runs on it alone."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None and re.fullmatch(r"local(\[.*\])?", sc.master):
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="skerry-"))
    return sc.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the checkpoints' folder, so that an executor can be lost."""
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    base = _checkpoint_dir(spark)
    if base is None:
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def top(df: DataFrame, by: list[Column | str], limit: int | None) -> DataFrame:
    """The first rows of a total order; without limit all of them, unsorted."""
    return df if limit is None else df.orderBy(*by).limit(limit)


def newest() -> list[Column]:
    return [F.desc("occurred_at"), F.desc("event_id")]


def current_rib(routes: DataFrame, peer: str | None = None, rib_type: str | None = None, keys: tuple[str, ...] = ("peer_addr", "rib_type", "prefix"), limit: int | None = None) -> DataFrame:
    """L2: routes whose last event announces them. A limit takes them by prefix."""
    if peer is not None:
        routes = routes.where(F.col("peer_addr") == peer)
    if rib_type is not None:
        routes = routes.where(X.rib_type_normal("rib_type") == rib_type)
    return top(latest(routes, list(keys)).where("action = 'announce'"), ["prefix", "peer_addr", "rib_type"], limit)


def prefix_history(routes: DataFrame, prefix: str, limit: int = 100) -> DataFrame:
    """L3."""
    return top(routes.where(F.col("prefix") == prefix), newest(), limit)


def route_changes(routes: DataFrame, since: str, until: str | None = None, limit: int = 100) -> DataFrame:
    """L4: events from since on, before until."""
    out = routes.where(F.col("occurred_at") >= F.lit(since).cast("timestamp"))
    if until is not None:
        out = out.where(F.col("occurred_at") <= F.lit(until).cast("timestamp"))
    return top(out, newest(), limit)


def prefix_peers(routes: DataFrame, prefix: str) -> DataFrame:
    """Each peer's last announcement of a prefix; withdrawals don't count."""
    return latest(routes.where((F.col("prefix") == prefix) & (F.col("action") == "announce")), ["peer_addr"])


def route_visibility(routes: DataFrame, prefix: str) -> DataFrame:
    """When each peer last announced and withdrew a prefix."""
    return routes.where(F.col("prefix") == prefix).groupBy("peer_addr", "action").agg(F.max("occurred_at").alias("last_seen"))


def listing(df: DataFrame, time: str = "occurred_at", hours: float | None = None, as_of: str | None = None, limit: int = 100, tie: str = "event_id", **equal) -> DataFrame:
    """Rows with given values, newest first, of the last hours before as_of."""
    for name, value in equal.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    if hours is not None:
        df = df.where(F.col(time) >= F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(hours * 3600)} SECONDS"))
    return top(df, [F.desc(time), F.desc(tie)], limit)


def live_routes(routes: DataFrame, prefix_like: str | None = None, limit: int | None = None) -> DataFrame:
    """Current routes of all peers whose prefix begins so."""
    out = current_rib(routes)
    if prefix_like:
        out = out.where(F.col("prefix").startswith(prefix_like))
    return top(out, ["prefix", "peer_addr", "rib_type"], limit)


def peer_state(peers: DataFrame, as_of: str) -> DataFrame:
    """State, time of the last up and down, uptime in seconds and flaps (ups after a first up, without a down between or with) of each peer."""
    w = Window.partitionBy("speaker_addr", "peer_addr").orderBy(*ORDER)
    seen = peers.withColumn("again", (F.col("event_type") == "peer_up") & (F.coalesce(F.sum(F.when(F.col("event_type") == "peer_up", 1)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) > 0))
    last = F.max_by("event_type", F.struct(*ORDER))
    out = seen.groupBy("speaker_addr", "peer_addr").agg(last.alias("last_event"), F.max(F.when(F.col("event_type") == "peer_up", F.col("occurred_at"))).alias("up_at"), F.max(F.when(F.col("event_type") == "peer_down", F.col("occurred_at"))).alias("down_at"), F.count_if("again").alias("flap_count"))
    up = F.col("last_event") == "peer_up"
    return out.select("speaker_addr", "peer_addr", F.when(up, "up").otherwise("down").alias("state"), "up_at", "down_at", F.when(up, F.lit(as_of).cast("timestamp").cast("bigint") - F.col("up_at").cast("bigint")).alias("uptime_s"), "flap_count")


def speaker_summary(speakers: DataFrame, peers: DataFrame, routes: DataFrame, inventory: DataFrame | None = None) -> DataFrame:
    """Each speaker's last state, peers up and down, current routes, whether active (a peer up), and its inventory entry where there is one."""
    state = latest(speakers, ["speaker_addr"]).select("speaker_addr", "event_type")
    by_peer = latest(peers, ["speaker_addr", "peer_addr"]).groupBy("speaker_addr").agg(F.count_if(F.col("event_type") == "peer_up").alias("peers_up"), F.count_if(F.col("event_type") == "peer_down").alias("peers_down"))
    total = current_rib(routes).groupBy("speaker_addr").agg(F.count("*").alias("total_routes"))
    out = state.join(by_peer, "speaker_addr", "full").join(total, "speaker_addr", "full")
    out = out.select("speaker_addr", F.coalesce("event_type", F.lit("unknown")).alias("last_event"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("peers_up", "peers_down", "total_routes")))
    out = out.withColumn("status", F.when(F.col("peers_up") > 0, "active").otherwise("idle"))
    return out if inventory is None else enrich(out, inventory)


def enrich(df: DataFrame, inventory: DataFrame) -> DataFrame:
    """Inventory columns by speaker_addr; missing ones are empty. Spark broadcasts the inventory if its size allows."""
    more = [c for c in inventory.columns if c != "speaker_addr"]
    return df.join(inventory.dropDuplicates(["speaker_addr"]), "speaker_addr", "left").select(*df.columns, *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in more))


def capability_flags(peers: DataFrame) -> DataFrame:
    """Whether each peer's last capabilities (a JSON array of names) have add-path, four-byte AS numbers and long-lived restart."""
    caps = F.from_json(F.coalesce("capabilities", F.lit("[]")), "array<string>")
    has = lambda name: F.coalesce(F.exists(F.col("caps"), lambda x: F.lower(x).startswith(name)), F.lit(False))
    return latest(peers.withColumn("caps", caps), ["speaker_addr", "peer_addr"]).select("speaker_addr", "peer_addr", "caps", has("add").alias("add_path"), (has("four") | has("as4")).alias("four_byte_asn"), (has("llgr") | has("long")).alias("llgr"))


def rib_counts(routes: DataFrame) -> DataFrame:
    """Current routes by peer and table."""
    return current_rib(routes).groupBy("peer_addr", "rib_type").agg(F.count("*").alias("routes"))


def path_matrix(marks: DataFrame, as_of: str, minutes: int = 5, afi: str | None = None, min_active: int | None = None, limit: int | None = None) -> DataFrame:
    """The last marking of each prefix and peer in a time span; with min_active only prefixes with fewer active paths than that (bits 0x2 or 0x8)."""
    w = marks.where((F.col("occurred_at") >= F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {minutes} MINUTES")) & (F.col("occurred_at") <= F.lit(as_of).cast("timestamp")))
    if afi is not None:
        w = w.where(X.afi_normal("afi") == afi)
    last = latest(w, ["prefix", "peer_addr"])
    if min_active is not None:
        few = last.groupBy("prefix").agg(F.count_if(F.col("path_status").bitwiseAND(0xA) != 0).alias("active")).where(F.col("active") < min_active)
        last = last.join(few, "prefix", "left_semi")
    return top(last, ["prefix", "peer_addr"], limit)


def path_pivot(marks: DataFrame, peers: list[str]) -> DataFrame:
    """A prefix a row, a peer a column with its last status, and the paths with a bit of 0x5A. The peers are given, so no job looks for them."""
    last = latest(marks, ["prefix", "peer_addr"]).withColumn("label", X.status_label("path_status"))
    wide = last.groupBy("prefix").pivot("peer_addr", peers).agg(F.first("label"))
    active = last.groupBy("prefix").agg(F.count_if(F.col("path_status").bitwiseAND(0x5A) != 0).alias("active_paths"))
    return wide.join(active, "prefix")


def best_paths(routes: DataFrame) -> DataFrame:
    """Of current paths by peer, table and prefix: highest local_pref (missing is worst), shortest path, lowest med (missing is worst), then the earliest event."""
    now = latest(routes, ["peer_addr", "rib_type", "prefix", "as_path"]).where("action = 'announce'")
    w = Window.partitionBy("peer_addr", "rib_type", "prefix").orderBy(F.desc_nulls_last("local_pref"), F.asc("as_path_len"), F.asc_nulls_last("med"), "event_id")
    return now.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def reconstruct(routes: DataFrame, peers: DataFrame, speakers: DataFrame | None = None, as_of: str | None = None, stale_s: int | None = None) -> DataFrame:
    """Current routes after sessions ended. A route older than its peer's last down (or its speaker's) is gone; with stale_s (long-lived restart) it is
    stale until so many seconds after the down. Adds `stale`."""
    now = current_rib(routes)
    down = peers.where("event_type = 'peer_down'").groupBy("speaker_addr", "peer_addr").agg(F.max(F.struct(*ORDER)).alias("down"))
    out = now.join(down, ["speaker_addr", "peer_addr"], "left").withColumn("before", F.struct(*ORDER) < F.col("down"))
    out = out.withColumn("stale", F.coalesce("before", F.lit(False)))
    if stale_s is None:
        out = out.where(~F.col("stale"))
    else:
        out = out.where(~F.col("stale") | (F.unix_micros("down.occurred_at") + stale_s * 1_000_000 > F.unix_micros(F.lit(as_of).cast("timestamp"))))
    if speakers is not None:
        end = speakers.where("event_type = 'speaker_down'").groupBy("speaker_addr").agg(F.max(F.struct(*ORDER)).alias("end"))
        out = out.join(end, "speaker_addr", "left").where(F.col("end").isNull() | (F.struct(*ORDER) > F.col("end"))).drop("end")
    return out.drop("down", "before")


def flow_rules(rules: DataFrame, large: int = 16) -> DataFrame:
    """Destination and source of a flow rule's summary text, and whether either prefix is as large as /large or larger."""
    of = lambda side: F.regexp_extract("summary", rf"(?i)\b{side}\w*[ =:]+([0-9a-f.:]+/[0-9]+)", 1)
    size = lambda c: F.try_element_at(F.split(F.col(c), "/"), F.lit(2)).try_cast("int")
    return rules.withColumns({"destination": F.when(of("(?:dst|dest)") != "", of("(?:dst|dest)")), "source": F.when(of("(?:src|source)") != "", of("(?:src|source)"))}).withColumn("large_prefix", (F.coalesce(size("destination"), F.lit(999)) <= large) | (F.coalesce(size("source"), F.lit(999)) <= large))
