"""Named questions over the tables, and the kinds of anomaly with the question that verifies each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.operators import aggregates as A
from skerry.operators.state import listing, top


def _count(df: DataFrame, key: str, n: int) -> DataFrame:
    return top(df.groupBy(key).agg(F.count("*").alias("n")), [F.desc("n"), key], n)


#: Question: (tables that it takes, function of them and a limit)
QUESTIONS: dict[str, tuple[tuple[str, ...], Callable[..., DataFrame]]] = {
    "top_announced": (("route_events",), lambda r, n=10: _count(r.where("action = 'announce'"), "prefix", n)),
    "top_withdrawn": (("route_events",), lambda r, n=10: _count(r.where("action = 'withdraw'"), "prefix", n)),
    "churn": (("route_events",), lambda r, n=10: A.top_churning(r, n)),
    "peer_downs": (("peer_events",), lambda p, n=10: _count(p.where("event_type = 'peer_down'"), "peer_addr", n)),
    "peer_ups": (("peer_events",), lambda p, n=10: _count(p.where("event_type = 'peer_up'"), "peer_addr", n)),
    "invalids": (("route_events",), lambda r, n=10: listing(r, limit=n, rpki_validity="invalid")),
    "anomalies": (("ml_anomalies",), lambda a, n=10: top(a, [F.desc("detected_at"), F.desc("score")], n)),
    "communities": (("route_events",), lambda r, n=10: A.community_usage(r, n)),
    "longest_paths": (("route_events",), lambda r, n=10: top(r.where("as_path_len IS NOT NULL").select("event_id", "prefix", "as_path", "as_path_len"), [F.desc("as_path_len"), "event_id"], n)),
    "convergence": (("convergence_events",), lambda c, n=10: top(c, [F.desc("convergence_ms"), "peer_addr", "started_at"], n)),
    "recent": (("route_events",), lambda r, n=10: listing(r, limit=n)),
}


def ask(question: str, tables: dict[str, DataFrame], n: int = 10) -> DataFrame:
    names, f = QUESTIONS[question]
    return f(*(tables[t] for t in names), n)


#: Kind, severity, what it means
KINDS = [("origin_change", "critical", "a prefix's origin changed"), ("route_leak", "critical", "a route went where it should not"), ("path_anomaly", "warning", "a path became much shorter"), ("flap", "warning", "a session went down again and again"), ("churn", "info", "a prefix changed unusually often")]


def kinds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(KINDS, "kind string, severity string, meaning string")


#: The question that verifies a kind, over route_events or peer_events
VERIFY: dict[str, Callable[[DataFrame], DataFrame]] = {
    "origin_change": lambda r: A.origin_counts(r),
    "route_leak": lambda r: r.where("only_to_customer IS NOT NULL AND action = 'announce'").select("event_id", "prefix", "peer_addr"),
    "path_anomaly": lambda r: A.path_lengths(r),
    "flap": lambda p: p.where("event_type = 'peer_down'").groupBy("peer_addr").agg(F.count("*").alias("downs")).where("downs > 4"),
    "churn": lambda r: r.groupBy("prefix").agg(F.count("*").alias("events")).where("events > 4"),
}
