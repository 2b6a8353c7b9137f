"""Structured Streaming forms of the sinks, windows and stateless detectors; those with state of their own are in stateful."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.sources.schemas import ENVELOPE
from skerry.sources.tables import fan_out, route_topics, write_table


def read_stream(spark: SparkSession, path: str, files: int = 1000) -> DataFrame:
    """S2, ST1: archived messages as they land; a checkpoint replays what a failed run hadn't committed, so none is lost."""
    return spark.readStream.schema(ENVELOPE).option("maxFilesPerTrigger", files).json(path)


def subscribe(events: DataFrame, kinds: list[str]) -> DataFrame:
    """S20."""
    return events.where(F.col("kind").isin(kinds))


def end_of_rib(events: DataFrame) -> DataFrame:
    """ST8: end markers, which aren't stored."""
    return events.where("kind = 'end_of_rib'")


def store(events: DataFrame, path: str, checkpoint: str, interval: str | None = None, rows: int = 500):
    """S3, S4, ST1: a query that stores each micro-batch's rows in their tables once, however often the batch is run: every interval, or all there is and no more.

    A batch owns partitions of its own in each table, named after the query's lasting id in its checkpoint and the batch's number. One that failed midway is run again with the same events
    and overwrites what it had written. A file has so many rows at most. The batch is kept while its five tables read it.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        query = batch.sparkSession.read.json(f"{checkpoint}/metadata").first()["id"]
        batch = batch.persist()
        try:
            for name, part in fan_out(batch).items():
                write_table(part, path, name, f"{query}-{batch_id}", rows)
        finally:
            batch.unpersist()

    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def publish_files(events: DataFrame, path: str, checkpoint: str):
    """A query that writes each topic's messages to files of its own; with a Kafka connector the same rows go to `format("kafka")`."""
    return route_topics(events).writeStream.format("json").partitionBy("topic").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rate(events: DataFrame, budget: int, seconds: int = 1, late: str = "10 seconds") -> DataFrame:
    """ST7, D15: events a span, and whether they are over budget, when the watermark has passed it."""
    return events.withWatermark("occurred_at", late).groupBy(F.window("occurred_at", f"{seconds} seconds")).agg(F.count("*").alias("events")).select(F.col("window.start").alias("start"), "events", (F.col("events") > budget * seconds).alias("over"))


def churn(routes: DataFrame, span: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """D14, ST3: events by prefix and window."""
    w = F.window("occurred_at", span, slide) if slide else F.window("occurred_at", span)
    return routes.withWatermark("occurred_at", late).groupBy("prefix", w).agg(F.count("*").alias("events")).select("prefix", F.col("window.start").alias("start"), "events")


def flaps(peers: DataFrame, span: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Downs by peer and window with their severity."""
    n = peers.where("event_type = 'peer_down'").withWatermark("occurred_at", late).groupBy("peer_addr", F.window("occurred_at", span)).agg(F.count("*").alias("downs"))
    return n.select("peer_addr", F.col("window.start").alias("start"), "downs", F.when(F.col("downs") < 3, "low").when(F.col("downs") < 10, "medium").otherwise("high").alias("severity"))


def quiet_sessions(routes: DataFrame, gap: str = "5 seconds", late: str = "10 seconds") -> DataFrame:
    """ST5: bursts of a peer's route events that end with so long a pause."""
    return routes.withWatermark("occurred_at", late).groupBy("peer_addr", F.session_window("occurred_at", gap)).agg(F.count_if(F.col("action") == "withdraw").alias("withdraws"), F.count("*").alias("events")).select("peer_addr", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events", "withdraws")


def dedup_alerts(alerts: DataFrame, late: str = "300 seconds") -> DataFrame:
    """The first alert of each key until the watermark has passed it."""
    return alerts.withWatermark("occurred_at", late).dropDuplicatesWithinWatermark(["kind", "prefix", "peer_addr"])


def otc_leaks(routes: DataFrame, customers: DataFrame) -> DataFrame:
    """D3: stateless, against a static table of customers (peer_addr)."""
    return routes.where("action = 'announce' AND only_to_customer IS NOT NULL").join(customers.select("peer_addr"), "peer_addr", "left_anti")
