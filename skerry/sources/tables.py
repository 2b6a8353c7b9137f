"""Reading, fanning out, exporting and retaining the event tables."""

from __future__ import annotations

import re
import uuid

from pyspark.errors import ParseException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.functions import prefixes as P
from skerry.functions import scalars as X
from skerry.operators.state import latest
from skerry.sources.schemas import ENVELOPE, SCHEMAS, TIMES


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of SCHEMAS under path; its event_date partitions prune scans that filter on event_date."""
    schema = SCHEMAS[name]
    return spark.read.schema(schema + ", event_date date, batch string").parquet(f"{path}/{name}").drop("batch")


def write_table(df: DataFrame, path: str, name: str, batch: str | None = None, rows: int = 0) -> None:
    """Adds rows to a table by date and batch, a batch's name once: what had been written under it on the same dates is overwritten. Without one they are a batch of their own.

    Rows of a date are sorted by prefix where there is one, so that files skip prefixes; a file has so many rows at most, if that is set.
    """
    df = df.withColumns({"event_date": F.to_date(TIMES.get(name, "occurred_at")), "batch": F.lit(batch or uuid.uuid4().hex)})
    if "prefix" in df.columns:
        df = df.sortWithinPartitions("event_date", "prefix")
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", rows).partitionBy("event_date", "batch").parquet(f"{path}/{name}")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Archived messages, one JSON object a line; a line that isn't one gives a row of nulls."""
    return spark.read.schema(ENVELOPE).json(path)


def fan_out(events: DataFrame) -> dict[str, DataFrame]:
    """An envelope's rows by table; statistics make a row a counter, EVPN updates a row a route. Other kinds make none."""
    p = lambda c: F.col(f"payload.{c}").alias(c)
    base = [F.col("id"), F.col("occurred_at"), F.col("speaker").alias("speaker_addr")]
    peer = [*base, p("peer_addr"), p("peer_as")]
    of = lambda *kinds: events.where(F.col("kind").isin(*kinds))
    counters = of("stats").select(*base, p("peer_addr"), F.explode("payload.counters").alias("c"))
    evpn = of("evpn").select(*peer, p("action"), F.explode("payload.evpn").alias("r"))
    return {
        "route_events": of("route").select(*peer, *map(p, ("rib_type", "action", "prefix", "afi", "as_path", "as_path_len", "next_hop", "local_pref", "med", "communities", "only_to_customer"))),
        "peer_events": of("peer_up", "peer_down").select(*peer, F.col("kind").alias("event_type"), *map(p, ("local_as", "hold_time", "capabilities", "reason"))),
        "speaker_events": of("speaker_up", "speaker_down").select(*base, F.col("kind").alias("event_type"), *map(p, ("sys_name", "sys_descr", "reason"))),
        "stats_events": counters.select("id", "occurred_at", "speaker_addr", "peer_addr", X.counter_name("c.stat_type").alias("counter_name"), F.col("c.value").alias("counter_value"), F.col("c.stat_type").alias("stat_type"), F.col("c.afi").alias("afi"), F.col("c.safi").alias("safi")),
        "evpn_events": evpn.select("id", "occurred_at", "speaker_addr", "peer_addr", "peer_as", "action", *X.evpn_columns("r")),
    }


TOPICS = {"speaker_up": "router", "speaker_down": "router", "peer_up": "peer", "peer_down": "peer", "route": "unicast_prefix", "evpn": "evpn", "ls_node": "ls_node", "stats": "bmp_stat"}


def route_topics(events: DataFrame) -> DataFrame:
    """Events with their topic and key (speaker, with peer and prefix where there are any) and value, as a sink of topics takes them. Other kinds have no topic."""
    topic = F.lit(None).cast("string")
    for kind, name in TOPICS.items():
        topic = F.when(F.col("kind") == kind, name).otherwise(topic)
    key = F.concat_ws(":", "speaker", "payload.peer_addr", "payload.prefix")
    return events.select(topic.alias("topic"), key.alias("key"), F.to_json(F.struct("id", "occurred_at", "speaker", "kind", "payload")).alias("value")).where("topic IS NOT NULL")


EXPORTABLE = frozenset(SCHEMAS)


def export_range(df: DataFrame, name: str, out: str | None = None, since: str | None = None, until: str | None = None, as_of: str | None = None, days: int = 7) -> DataFrame:
    """Rows of a known table between two instants, both included (the last days before as_of by default), written to `out` as zstd Parquet if given."""
    if name not in EXPORTABLE:
        raise ValueError(f"{name} is no table for export")
    t = F.col(TIMES.get(name, "occurred_at"))
    end = F.lit(until or as_of).cast("timestamp")
    begin = F.lit(since).cast("timestamp") if since else end - F.expr(f"INTERVAL {days} DAYS")
    rows = df.where(t.between(begin, end))
    if out:
        rows.write.mode("overwrite").option("compression", "zstd").parquet(out)
    return rows


def route_export(routes: DataFrame) -> DataFrame:
    """Features of each route event: local_pref 100 and med 0 where missing, validity 1, 0 or -1."""
    rpki = F.col("rpki_validity") if "rpki_validity" in routes.columns else F.lit(None).cast("string")
    return routes.select("event_id", "occurred_at", "peer_addr", "peer_as", "prefix", P.prefix_length("prefix").alias("prefix_len"), (F.col("action") == "announce").cast("int").alias("is_announce"), X.origin_asn("as_path").alias("origin_asn"), F.coalesce("as_path_len", F.lit(0)).alias("as_path_len"), X.has_prepending("as_path").cast("int").alias("has_prepend"), F.coalesce("local_pref", F.lit(100)).cast("bigint").alias("local_pref"), F.coalesce("med", F.lit(0)).cast("bigint").alias("med"), X.list_length("communities").alias("n_communities"), X.rpki_code(rpki).alias("rpki_code"))


def peer_export(peers: DataFrame, routes: DataFrame) -> DataFrame:
    """Each peer's ups, downs and route events."""
    p = peers.groupBy("peer_addr").agg(F.count_if(F.col("event_type") == "peer_up").alias("ups"), F.count_if(F.col("event_type") == "peer_down").alias("downs"))
    r = routes.groupBy("peer_addr").agg(F.count("*").alias("routes"))
    return p.join(r, "peer_addr", "left").select("peer_addr", "ups", "downs", F.coalesce("routes", F.lit(0)).alias("routes"))


def prefix_export(routes: DataFrame, as_of: str) -> DataFrame:
    """Eleven features of each prefix; its most common origin is the smallest of equals; churn_rate is events of the last hour a second."""
    recent = F.col("occurred_at") >= F.lit(as_of).cast("timestamp") - F.expr("INTERVAL 1 HOUR")
    ann = F.col("action") == "announce"
    g = routes.withColumn("o", X.origin_asn("as_path")).groupBy("prefix").agg(F.count("*").alias("events"), F.count_if(ann).alias("announces"), F.count_if(~ann).alias("withdraws"), F.countDistinct("peer_addr").alias("peers"), F.countDistinct("o").alias("origins"), F.round(F.avg(F.when(ann, F.col("as_path_len"))), 6).alias("mean_path_len"), F.min("as_path_len").alias("min_path_len"), F.max("as_path_len").alias("max_path_len"), F.round(F.avg("local_pref"), 6).alias("mean_local_pref"), F.round(F.count_if(recent) / 3600, 9).alias("churn_rate_1h"))
    one = routes.withColumn("o", X.origin_asn("as_path")).where("o IS NOT NULL").groupBy("prefix", "o").agg(F.count("*").alias("n")).groupBy("prefix").agg(F.min(F.struct((-F.col("n")).alias("n"), "o")).alias("m")).select("prefix", F.col("m.o").alias("main_origin"))
    return g.join(one, "prefix", "left")


class DatasetStore:
    """Versions of a dataset in partitions of one path, by the text of their time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def write(self, df: DataFrame, version: str) -> None:
        df.withColumn("snapshot_ts", F.lit(version)).write.mode("append").partitionBy("snapshot_ts").parquet(self.path)

    def _folders(self) -> list:
        return _partitions(self.spark, self.path, "snapshot_ts")

    def versions(self) -> list[str]:
        """Newest first, from the folder's listing."""
        return sorted({f[0] for f in self._folders()}, reverse=True)

    def latest(self) -> DataFrame:
        return self.read(self.versions()[0])

    def read(self, version: str) -> DataFrame:
        return self.spark.read.option("basePath", self.path).parquet(self.path).where(F.col("snapshot_ts").cast("string") == version).drop("snapshot_ts")

    def prune(self, keep: int) -> list[str]:
        """Drops all versions but the newest `keep`; returns those dropped."""
        old = self.versions()[keep:]
        for name, folder, fs in self._folders():
            if name in old:
                fs.delete(folder, True)
        return old


def load_vrps(spark: SparkSession, path: str) -> DataFrame:
    """Authorisations of a JSON dump {"roas": [{"prefix", "maxLength", "asn"}]}: asn may have "AS" before it, maxLength is the prefix's length where missing; malformed ones are left out."""
    dump = spark.read.schema("roas array<struct<prefix:string, maxLength:string, asn:string>>").option("multiLine", True).json(path)
    r = dump.select(F.explode("roas").alias("r")).select("r.*")
    return r.select(F.trim("prefix").alias("prefix"), F.coalesce(F.col("maxLength").try_cast("int"), P.prefix_length("prefix")).alias("max_len"), F.regexp_replace("asn", r"^(?i)\s*as", "").try_cast("bigint").alias("origin_asn")).where("prefix IS NOT NULL AND max_len IS NOT NULL AND origin_asn IS NOT NULL").where(P.prefix_length("prefix").isNotNull())


def apply_vrp_delta(vrps: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """Without the removed (prefix, origin_asn), whatever their length, and then with the added."""
    return vrps.join(removed.select("prefix", "origin_asn").distinct(), ["prefix", "origin_asn"], "left_anti").select("prefix", "max_len", "origin_asn").unionByName(added.select("prefix", "max_len", "origin_asn"))


def ecs_documents(routes: DataFrame) -> DataFrame:
    """Route events as JSON documents of the common event schema."""
    doc = F.to_json(F.struct(F.date_format("occurred_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("@timestamp"), F.struct(F.lit("event").alias("kind"), F.lit("network").alias("category"), F.concat(F.lit("route-"), "action").alias("action")).alias("event"), F.struct(F.col("speaker_addr").alias("ip")).alias("observer"), F.struct("peer_addr", "peer_as", "prefix", "as_path", "rib_type").alias("bgp")))
    return routes.select("event_id", doc.alias("document"))


def hec_events(routes: DataFrame, index: str = "bgp", sourcetype: str = "bmp:route") -> DataFrame:
    """Route events as JSON for an event collector, the time in seconds."""
    doc = F.to_json(F.struct((F.unix_millis("occurred_at") / 1000).cast("decimal(20,3)").alias("time"), F.col("speaker_addr").alias("host"), F.lit("bmp").alias("source"), F.lit(sourcetype).alias("sourcetype"), F.lit(index).alias("index"), F.struct("action", "prefix", "peer_addr", "peer_as", "as_path").alias("event")))
    return routes.select("event_id", doc.alias("document"))


PROFILES = ("generic", "slack", "pagerduty", "opsgenie", "teams")


def notifications(alerts: DataFrame, profile: str = "generic", least: str = "warning", routing_key: str = "") -> DataFrame:
    """Alerts (occurred_at, event_id, kind, prefix, peer_addr, severity) of that severity at least, as a profile's JSON; suppress them by key first where wanted."""
    a = alerts.where(X.severity_passes("severity", least))
    who = F.coalesce("peer_addr", F.lit(""))
    text = F.concat_ws(" ", "kind", "prefix", F.concat(F.lit("at "), who))
    key = F.concat_ws(":", "kind", "prefix", "peer_addr")
    rank = X.severity_rank("severity")
    # fixed values: colours and priorities by severity
    pick = lambda *v: F.when(rank == 2, v[0]).when(rank == 1, v[1]).otherwise(v[2])
    shape: dict[str, Column] = {
        "generic": F.struct(F.col("kind"), F.col("severity"), text.alias("summary"), key.alias("key")),
        "slack": F.struct(F.array(F.struct(pick("#FF0000", "#FFA500", "#36A64F").alias("color"), F.concat(F.lit("["), F.upper("severity"), F.lit("] "), text).alias("text"))).alias("attachments")),
        "pagerduty": F.struct(F.lit(routing_key).alias("routing_key"), F.lit("trigger").alias("event_action"), key.alias("dedup_key"), F.struct(text.alias("summary"), who.alias("source"), pick("critical", "warning", "info").alias("severity")).alias("payload")),
        "opsgenie": F.struct(text.alias("message"), key.alias("alias"), pick("P1", "P3", "P5").alias("priority")),
        "teams": F.struct(F.lit("message").alias("type"), F.array(F.struct(F.lit("application/vnd.microsoft.card.adaptive").alias("contentType"), F.struct(F.lit("AdaptiveCard").alias("type"), F.array(F.struct(text.alias("text"), pick("attention", "warning", "good").alias("color"))).alias("body")).alias("content"))).alias("attachments")),
    }
    return a.select("occurred_at", "event_id", key.alias("key"), F.to_json(shape[profile]).alias("payload"))


def retain(df: DataFrame, days: int = 90, as_of: str | None = None, time: str = "occurred_at") -> DataFrame:
    """Rows of the last days before as_of, as sweep leaves them; 0 keeps all."""
    return df if days == 0 else df.where(F.col(time) >= F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS"))


#: Tables that retention sweeps.
SWEPT = ("route_events", "peer_events", "speaker_events", "stats_events", "evpn_events")


def _partitions(spark: SparkSession, path: str, column: str) -> list[tuple]:
    """(value, Hadoop path, file system) of a table's partitions by one column, from the listing."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.listStatus(p) if fs.exists(p) else []
    return [(s.getPath().getName().partition("=")[2], s.getPath(), fs) for s in found if s.isDirectory() and s.getPath().getName().startswith(f"{column}=")]


def sweep(spark: SparkSession, path: str, days: int, as_of: str, names: tuple[str, ...] = SWEPT) -> dict[str, int]:
    """Deletes rows older than so many days before as_of and returns how many each table lost; 0 days keeps all.

    Whole days are dropped as folders, by the listing. Of the day that the limit falls in, each batch's rows that stay are written beside the table (where readers don't look) and then
    overwrite its partitions; a batch without any is dropped. A sweep that fails can be run again.
    """
    if days == 0:
        return dict.fromkeys(names, 0)
    limit, day = spark.range(1).select((F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS")).alias("t")).select(F.col("t").cast("string"), F.to_date("t").cast("string")).first()
    lost = {}
    for name in names:
        lost[name] = 0
        for value, folder, fs in _partitions(spark, f"{path}/{name}", "event_date"):
            if value > day or value == "__HIVE_DEFAULT_PARTITION__":
                continue
            rows = spark.read.schema(SCHEMAS[name] + ", batch string").parquet(folder.toString())
            if value < day:
                lost[name] += rows.count()
                fs.delete(folder, True)
                continue
            staged = f"{path}/{name}/_sweep-{uuid.uuid4().hex}"
            total = rows.count()
            rows.where(F.col(TIMES.get(name, "occurred_at")) >= F.lit(limit).cast("timestamp")).withColumn("event_date", F.lit(value)).write.partitionBy("event_date", "batch").parquet(staged)
            kept = spark.read.schema(SCHEMAS[name] + ", event_date string, batch string").parquet(staged)
            left = {r["batch"]: r["n"] for r in kept.groupBy("batch").agg(F.count("*").alias("n")).collect()}  # a day's batches
            kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event_date", "batch").parquet(f"{path}/{name}")
            for batch, part, _ in _partitions(spark, folder.toString(), "batch"):
                if batch not in left:
                    fs.delete(part, True)
            fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(staged), True)
            lost[name] += total - sum(left.values())
    return lost


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of each table."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in sorted(tables.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def upsert_limits(log: DataFrame) -> DataFrame:
    """The last valid limit of each (speaker, peer, afi_safi) in an append log with updated_at; a limit of 0 or less is rejected."""
    return latest(log.where("max_prefix > 0"), ["speaker_addr", "peer_addr", "afi_safi"], ("updated_at", "max_prefix"))


def append_anomalies(report: DataFrame, path: str) -> None:
    """S19."""
    write_table(report.withColumn("description", F.concat_ws(" ", "kind", "prefix", "peer_addr")), path, "ml_anomalies")


def state_changes(peers: DataFrame) -> DataFrame:
    """Session transitions: an up goes from Active (3) to Established (6), a down from Established to Idle (1)."""
    up = F.col("event_type") == "peer_up"
    return peers.select("event_id", "occurred_at", "peer_addr", "peer_as", F.when(up, 3).otherwise(6).alias("old_state"), F.when(up, 6).otherwise(1).alias("new_state"))


def register(spark: SparkSession, tables: dict[str, DataFrame]) -> None:
    """Names tables for read-only SQL through spark.sql."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


#: Functions that run what isn't SQL.
_CALLS_OUT = re.compile(r"\b(try_)?reflect\s*\(|\bjava_method\s*\(", re.I)


def select_only(spark: SparkSession, query: str, tables: dict[str, DataFrame]) -> DataFrame:
    """The result of a query over named tables; anything else is refused.

    Spark's own parser tells: only a query can stand in parentheses as a relation, so commands, inserts behind a WITH and those with several targets don't parse there. Scripts and calls of
    Java methods are refused too.
    """
    register(spark, tables)
    try:
        inside = spark.sql(f"SELECT * FROM (\n{query.strip().rstrip(';')}\n) AS q")
    except ParseException as e:
        raise ValueError("only SELECT is allowed") from e
    if _CALLS_OUT.search(query) or "ScriptTransformation" in inside._jdf.queryExecution().analyzed().toString():
        raise ValueError("only SELECT is allowed")
    return spark.sql(query.strip().rstrip(";"))
