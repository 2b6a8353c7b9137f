"""AS-level and link-state graphs as edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.functions import scalars as X
from skerry.operators.state import latest, settled


def igp_nodes(nodes: DataFrame) -> DataFrame:
    """G1: routers announced last."""
    return latest(nodes, ["router_id"]).where("action = 'announce'")


def igp_links(links: DataFrame) -> DataFrame:
    """G1: the last state of each link, where it is announced."""
    return latest(links, ["local_router_id", "remote_router_id"]).where("action = 'announce'")


def path_edges(routes: DataFrame, peer: str | None = None, asn: int | None = None) -> DataFrame:
    """Neighbours in announced paths (repeats of an AS aside) with the number of routes that have them; with asn only in paths that hold it."""
    own = routes.where("action = 'announce'")
    if peer is not None:
        own = own.where(F.col("peer_addr") == peer)
    own = own.select(X.collapse(X.asns("as_path")).alias("asns"))
    if asn is not None:
        own = own.where(F.array_contains("asns", F.lit(asn).cast("bigint")))
    return own.select(F.explode(X.pairs_of(F.col("asns"))).alias("p")).groupBy(F.col("p.a").alias("src"), F.col("p.b").alias("dst")).agg(F.count("*").alias("routes"))


def adjacency(routes: DataFrame) -> DataFrame:
    """Distinct neighbours, either way round."""
    e = path_edges(routes).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    return e.where("a <> b").distinct()


def degrees(routes: DataFrame) -> DataFrame:
    """Each AS's number of neighbours, and whether it is transit: has an AS on both sides in some path."""
    both = adjacency(routes)
    deg = both.selectExpr("a AS asn").unionByName(both.selectExpr("b AS asn")).groupBy("asn").agg(F.count("*").alias("degree"))
    e = path_edges(routes).where("src <> dst")
    transit = e.selectExpr("dst AS asn").distinct().join(e.selectExpr("src AS asn").distinct(), "asn").withColumn("transit", F.lit(True))
    return deg.join(transit, "asn", "left").select("asn", "degree", F.coalesce("transit", F.lit(False)).alias("transit"))


def neighbors(routes: DataFrame, asn: int) -> DataFrame:
    e = adjacency(routes)
    return e.where(F.col("a") == asn).selectExpr("b AS asn").unionByName(e.where(F.col("b") == asn).selectExpr("a AS asn"))


def _edges(links: DataFrame, directed: bool) -> DataFrame:
    e = links.select(F.col("local_router_id").alias("src"), F.col("remote_router_id").alias("dst"), F.coalesce("igp_metric", F.lit(1)).cast("bigint").alias("metric"))
    if not directed:
        e = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "metric"))
    return e.groupBy("src", "dst").agg(F.min("metric").alias("metric"))


def shortest_paths(links: DataFrame, sources: DataFrame | None = None, directed: bool = True, max_rounds: int = 64) -> DataFrame:
    """(source, node, distance, path) by least metric, from every source (router_id) at once, or from all nodes; paths of equal distance: the least as text. Paths of more hops
    than max_rounds raise an error.

    Each round relaxes the frontier, the nodes that got nearer in the last, and is checkpointed: to spark.checkpoint.dir, so that an executor can be lost.
    """
    e = _edges(links, directed)
    src = e.select(F.col("src").alias("source")).distinct() if sources is None else sources.select(F.col("router_id").alias("source")).distinct()
    best = src.select("source", F.col("source").alias("node"), F.lit(0).cast("bigint").alias("distance"), F.col("source").alias("path"))
    front = best
    for _ in range(max_rounds):
        step = front.join(e, front["node"] == e["src"]).select("source", F.col("dst").alias("node"), (F.col("distance") + F.col("metric")).alias("distance"), F.concat_ws(" ", "path", "dst").alias("path"))
        merged = best.withColumn("old", F.lit(0)).unionByName(step.withColumn("old", F.lit(1))).groupBy("source", "node").agg(F.min(F.struct("distance", "path", "old")).alias("m"))
        merged = settled(merged.select("source", "node", "m.distance", "m.path", "m.old"))
        best, front = merged.drop("old"), merged.where("old = 1").drop("old")
        if front.isEmpty():
            return best
    raise RuntimeError(f"shortest paths did not settle in {max_rounds} rounds")


def blast_radius(links: DataFrame, start: str, hops: int = 3, directed: bool = True) -> DataFrame:
    """Nodes within so many hops of start, itself aside, with their distance."""
    e = _edges(links, directed).select("src", "dst")
    seen = e.sparkSession.createDataFrame([(start, 0)], "node string, hops int")
    front = seen
    for k in range(1, hops + 1):
        front = front.join(e, front["node"] == e["src"]).select(F.col("dst").alias("node"), F.lit(k).alias("hops")).distinct()
        seen = seen.unionByName(front)
    return seen.groupBy("node").agg(F.min("hops").alias("hops")).where(F.col("node") != start)


def diverse_paths(links: DataFrame, src: str, dst: str, most_hops: int = 10) -> DataFrame:
    """Simple paths from src to dst of most_hops at most that share no risk group (srlg_groups, comma-separated) with the cheapest, by metric and then path."""
    e = links.select("local_router_id", "remote_router_id", F.coalesce("igp_metric", F.lit(1)).cast("bigint").alias("metric"), X.tokens("srlg_groups", ",").alias("groups"))
    # the hops that each node is from dst at least: parts of paths that can't reach it in time are left out
    away = settled(blast_radius(links.select(F.col("remote_router_id").alias("local_router_id"), F.col("local_router_id").alias("remote_router_id"), "igp_metric"), dst, most_hops))
    e = e.join(away.unionByName(e.sparkSession.createDataFrame([(dst, 0)], "node string, hops int")).select(F.col("node").alias("remote_router_id"), F.col("hops").alias("away")), "remote_router_id")
    walk = e.sparkSession.createDataFrame([(src,)], "node string").select("node", F.array("node").alias("nodes"), F.lit(0).cast("bigint").alias("metric"), F.array().cast("array<string>").alias("groups"))
    done = None
    for k in range(1, most_hops + 1):
        nxt = walk.alias("w").join(e.alias("e"), F.col("w.node") == F.col("e.local_router_id")).where(~F.array_contains(F.col("w.nodes"), F.col("e.remote_router_id")) & (F.col("e.away") <= most_hops - k))
        walk = settled(nxt.select(F.col("e.remote_router_id").alias("node"), F.array_append("w.nodes", F.col("e.remote_router_id")).alias("nodes"), (F.col("w.metric") + F.col("e.metric")).alias("metric"), F.array_union("w.groups", "e.groups").alias("groups")))
        there = walk.where(F.col("node") == dst)
        done = there if done is None else done.unionByName(there)
        walk = walk.where(F.col("node") != dst)
        if walk.isEmpty():
            break
    done = done.select(F.array_join("nodes", " ").alias("path"), "metric", "groups")
    first = done.orderBy("metric", "path").limit(1).select(F.col("path").alias("first"), F.col("groups").alias("used"))
    return done.join(first).where((F.col("path") == F.col("first")) | ~F.arrays_overlap("groups", "used")).select("path", "metric", (F.col("path") == F.col("first")).alias("primary"))
