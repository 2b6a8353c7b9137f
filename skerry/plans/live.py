"""Queries that go through sinks and streams: events written to a folder, read as they would land, and what comes out compared with the rows of the batch forms' SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.operators import detectors as D
from skerry.operators.state import shared_path
from skerry.plans import reports  # noqa: F401  its entries in Q are read here
from skerry.plans.catalogue import Q, Views, add
from skerry.sources import tables as S
from skerry.sources.schemas import ENVELOPE
from skerry.streaming import stateful as T

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: The watermark's delay: files hold events of any time, so no event is late.
LATE = "4000 days"


def landed(df: DataFrame, files: int = 6) -> DataFrame:
    """df as a stream of files with events of any time in each. Two events far ahead, of keys of their own, come last and move the watermark."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, "landed")
    df.repartition(files, F.xxhash64("event_id")).write.parquet(path)
    some = df.where("action = 'announce' AND as_path_len > 0 AND med IS NOT NULL") if "action" in df.columns else df  # what detectors take
    for years in (20, 40):
        keys = {c: F.lit("far") for c in ("speaker_addr", "peer_addr", "prefix") if c in df.columns}
        some.limit(1).withColumns({**keys, "occurred_at": F.col("occurred_at") + F.make_interval(F.lit(years))}).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 4).parquet(path)


def drained(stream: DataFrame) -> DataFrame:
    """What a stream gives until it has read all there is, but for the far keys' rows. The session's state store is as it was afterwards."""
    spark, name = stream.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(name)
    out, kept = shared_path(spark, "drained"), shared_path(spark, "kept")
    spark.conf.set(name, _ROCKS)
    try:
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", kept).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, was)
    got = spark.read.schema(stream.schema).parquet(out)
    key = "prefix" if "prefix" in got.columns else "peer_addr"
    return got.where(F.col(key).isNull() | (F.col(key) != "far"))


def streamed(name: str, batch: str, run: Callable[[Views], DataFrame], columns: list[str] | None = None) -> None:
    """Registers stream_`name`: the rows of the query `batch`, or some of their columns, from a stream."""
    sql = Q[batch][1]
    add(f"stream_{name}", f"SELECT {', '.join(columns)} FROM ({sql}) q" if columns else sql)(lambda v: drained(run(v)).select(*columns or "*"))


streamed("new_origins", "new_origins", lambda v: T.new_origins(landed(v.route_events), LATE))
streamed("shortened_paths", "shortened_paths", lambda v: T.shortened_paths(landed(v.route_events), share=0.9, late=LATE))
streamed("leaks", "leaks", lambda v: T.leaks(landed(v.route_events), late=LATE))
streamed("hijacks", "hijacks", lambda v: T.hijacks(landed(v.route_events), 86400, LATE), ["event_id", "occurred_at", "prefix", "peer_addr", "new_origin", "known"])
streamed("origin_changes", "origin_changes", lambda v: T.origin_changes(landed(v.route_events), late=LATE), ["event_id", "occurred_at", "prefix", "peer_addr", "old_origin", "new_origin", "stable_s"])
streamed("med_oscillation", "med_oscillation", lambda v: T.med_oscillation(landed(v.route_events), 864000, late=LATE))
streamed("suppressed_alerts", "suppressed_alerts", lambda v: T.suppress(landed(D.all_alerts(v.route_events, v.roas)), 86400, LATE))


def envelopes(v: Views) -> DataFrame:
    """Events as the monitor's messages: routes, sessions and statistics."""
    schema = v.spark.createDataFrame([], ENVELOPE).schema

    def of(df: DataFrame, kind, **payload) -> DataFrame:
        fields = (payload.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema["payload"].dataType)
        return df.select(F.col("event_id").cast("string").alias("id"), "occurred_at", F.col("speaker_addr").alias("speaker"), kind.alias("kind"), F.struct(*fields).alias("payload"))

    c = F.col
    routes = of(v.route_events, F.lit("route"), **{n: c(n) for n in ("peer_addr", "peer_as", "rib_type", "action", "prefix", "afi", "as_path", "as_path_len", "local_pref", "med", "communities", "only_to_customer")})
    peers = of(v.peer_events, c("event_type"), peer_addr=c("peer_addr"), peer_as=c("peer_as"), reason=c("reason"))
    counter = F.struct(c("stat_type").cast("int").alias("stat_type"), c("counter_value").cast("decimal(20,0)").alias("value"), F.lit(1).alias("afi"), F.lit(1).alias("safi"))
    return routes.unionByName(peers).unionByName(of(v.stats_events, F.lit("stats"), peer_addr=c("peer_addr"), counters=F.array(counter)))


_STORED = "CAST(event_id AS STRING) AS id, occurred_at, speaker_addr, peer_addr"
add("fan_out_routes", f"SELECT {_STORED}, peer_as, rib_type, action, prefix, afi, as_path, as_path_len, local_pref, med, communities, only_to_customer FROM route_events")(lambda v: S.fan_out(envelopes(v))["route_events"].drop("next_hop"))
add("fan_out_peers", f"SELECT {_STORED}, peer_as, event_type, reason FROM peer_events")(lambda v: S.fan_out(envelopes(v))["peer_events"].drop("local_as", "hold_time", "capabilities"))
add("fan_out_stats", f"SELECT {_STORED}, CASE stat_type WHEN 7 THEN 'explicit-withdraw-count' ELSE 'adj-rib-in-routes' END AS counter_name, counter_value, stat_type FROM stats_events")(
    lambda v: S.fan_out(envelopes(v))["stats_events"].drop("afi", "safi").withColumn("counter_value", F.col("counter_value").cast("bigint"))
)
add("topics", """SELECT topic, key, count(*) AS messages FROM (SELECT 'unicast_prefix' AS topic, speaker_addr || ':' || peer_addr || ':' || prefix AS key FROM route_events UNION ALL SELECT 'peer', speaker_addr || ':' || peer_addr FROM peer_events
UNION ALL SELECT 'bmp_stat', speaker_addr || ':' || peer_addr FROM stats_events) m GROUP BY ALL""")(lambda v: S.route_topics(envelopes(v)).groupBy("topic", "key").agg(F.count("*").alias("messages")))


def archived(v: Views) -> DataFrame:
    """Messages written as lines of JSON and read back."""
    path = shared_path(v.spark, "archive")
    envelopes(v).write.json(path)
    return S.read_archive(v.spark, path)


add("archive_kinds", """SELECT kind, count(*) AS messages, count(prefix) AS prefixes, CAST(sum(counter_value) AS BIGINT) AS counted FROM (SELECT 'route' AS kind, prefix, NULL AS counter_value FROM route_events
UNION ALL SELECT event_type, NULL, NULL FROM peer_events UNION ALL SELECT 'stats', NULL, counter_value FROM stats_events) m GROUP BY 1""")(
    lambda v: archived(v).groupBy("kind").agg(F.count("*").alias("messages"), F.count("payload.prefix").alias("prefixes"), F.sum(F.get("payload.counters", F.lit(0))["value"]).cast("bigint").alias("counted"))
)


def stored_anomalies(v: Views) -> DataFrame:
    path = shared_path(v.spark, "tables")
    S.append_anomalies(v.ml_anomalies.select("detected_at", "kind", "prefix", "peer_addr", "score", "severity"), path)
    return S.read_table(v.spark, path, "ml_anomalies").drop("id", "event_date")


add("stored_anomalies", "SELECT detected_at, kind, prefix, peer_addr, score, kind || ' ' || prefix || ' ' || peer_addr AS description, severity FROM ml_anomalies")(stored_anomalies)


def swept_routes(v: Views) -> DataFrame:
    """Routes of a table that retention has swept."""
    path = shared_path(v.spark, "tables")
    S.write_table(v.route_events.withColumn("id", F.col("event_id").cast("string")), path, "route_events")
    S.sweep(v.spark, path, 10, "2024-01-31 07:30:00", ("route_events",))
    return S.read_table(v.spark, path, "route_events").select("id", "occurred_at", "prefix")


add("swept_routes", "SELECT CAST(event_id AS STRING) AS id, occurred_at, prefix FROM route_events WHERE occurred_at >= TIMESTAMP '2024-01-31 07:30:00' - INTERVAL 10 DAYS")(swept_routes)


def dataset_latest(v: Views) -> DataFrame:
    store = S.DatasetStore(v.spark, shared_path(v.spark, "datasets"))
    store.write(v.peer_events.where("event_id % 2 = 0"), "20240101T000000")
    store.write(v.peer_events, "20240102T000000")
    return store.latest().select("event_id", "occurred_at", "peer_addr", "event_type")


add("dataset_latest", "SELECT event_id, occurred_at, peer_addr, event_type FROM peer_events")(dataset_latest)


def loaded_vrps(v: Views) -> DataFrame:
    path = shared_path(v.spark, "vrps")
    roa = F.struct("prefix", F.col("max_len").alias("maxLength"), F.concat(F.lit("AS"), F.col("origin_asn").cast("string")).alias("asn"))
    v.roas.agg(F.to_json(F.struct(F.collect_list(roa).alias("roas")))).write.text(path)  # a dump is one document
    return S.load_vrps(v.spark, path)


add("loaded_vrps", "SELECT net || '/' || CAST(vlen AS STRING) AS prefix, max_len, origin_asn FROM vrps")(loaded_vrps)
