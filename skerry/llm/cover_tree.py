"""Operator 3: exact threshold pairs of embeddings by dual traversal of cover trees."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skerry.llm.common import components, cut, forest

#: A block has about so many different vectors; a node of so few is a leaf.
BLOCK, LEAF = 2048, 24
#: Half the centres of a label at most, on average, and how many of its vectors are dealt to them in one task.
CELLS, RUN = 512, 16384
#: Tables of so many labels or cells may be sent to all tasks.
BROADCAST_LABELS = 200_000
#: Slack on distances from matrix products; pairs that it leaves open are compared exactly.
EPS = 1e-6


class CoverTree:
    """Nested levels of centres: a node's centre is also its first child's, children's centres are apart by the level's radius, and each level's radius is half
    the one above. Nodes keep the radius that covers what is below them, and own a run of `order`."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.order = np.arange(len(x))
        self.centre, self.radius, self.lo, self.hi, self.kids = [], [], [], [], []
        d = self.distances(0, self.order)
        todo = [(self.node(0, d, 0, len(x)), float(d.max(initial=0)) or 1.0)]
        while todo:
            a, reach = todo.pop()
            lo, hi = self.lo[a], self.hi[a]
            if hi - lo <= LEAF or self.radius[a] <= EPS:
                continue
            while reach / 2 >= self.radius[a]:  # levels that change nothing
                reach /= 2
            reach /= 2
            rest, at, kids, centre = self.order[lo:hi].copy(), lo, [], self.centre[a]
            while len(rest):
                d = self.distances(centre, rest)
                near = d <= reach
                near[rest == centre] = True
                own = rest[near]
                self.order[at : at + len(own)] = own
                kids.append(self.node(centre, d[near], at, at + len(own)))
                at += len(own)
                rest = rest[~near]
                centre = rest[0] if len(rest) else -1
            self.kids[a] = np.array(kids)
            todo += [(k, reach) for k in kids]
        self.centre, self.radius, self.lo, self.hi = (np.array(v) for v in (self.centre, self.radius, self.lo, self.hi))

    def distances(self, c: int, rows: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, 2 - 2 * (self.x[rows] @ self.x[c])))

    def node(self, centre: int, d: np.ndarray, lo: int, hi: int) -> int:
        self.centre.append(centre)
        self.radius.append(float(d.max(initial=0)))
        self.lo.append(lo)
        self.hi.append(hi)
        self.kids.append(None)
        return len(self.centre) - 1


def dual(a: CoverTree, b: CoverTree, cosine: float):
    """Runs of pairs with that cosine at least: (rows of a, rows of b, None) if all of them do, else with a matrix of which do."""
    bound = np.sqrt(max(0.0, 2 - 2 * cosine))
    todo = [(np.array([0]), np.array([0]))]
    while todo:
        m, n = todo.pop()
        if len(m) * len(n) > 1 << 20:
            half = len(m) // 2 if len(m) >= len(n) else len(n) // 2
            todo += [(m[:half], n), (m[half:], n)] if len(m) >= len(n) else [(m, n[:half]), (m, n[half:])]
            continue
        d = np.sqrt(np.maximum(0, 2 - 2 * (a.x[a.centre[m]] @ b.x[b.centre[n]].T)))
        reach = a.radius[m][:, None] + b.radius[n][None, :]
        open_ = d <= reach + bound + EPS
        sure = d + reach <= bound - EPS
        for i, j in zip(*(v.tolist() for v in np.nonzero(open_))):
            p, q = m[i], n[j]
            if sure[i, j]:
                yield a.order[a.lo[p] : a.hi[p]], b.order[b.lo[q] : b.hi[q]], None
                continue
            s, t = a.kids[p], b.kids[q]
            if s is None and t is None:
                left, right = a.order[a.lo[p] : a.hi[p]], b.order[b.lo[q] : b.hi[q]]
                hit = a.x[left] @ b.x[right].T >= cosine
                if hit.any():
                    yield left, right, hit
            else:
                todo.append((np.array([p]) if s is None else s, np.array([q]) if t is None else t))


def link_block(x: np.ndarray, y: np.ndarray | None, wx: np.ndarray, wy: np.ndarray | None, cosine: float) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Weighted links of every row of x, of every row of y, and a spanning forest of the links over the rows of x and then of y; y None: of x with itself."""
    same = y is None
    a = CoverTree(x)
    b = a if same else CoverTree(y)
    wy = wx if same else wy
    nx, ny, edges = np.zeros(len(x), np.int64), np.zeros(len(wy), np.int64), []
    shift = 0 if same else len(x)
    for left, right, hit in dual(a, b, cosine):
        if hit is None:
            nx[left] += wy[right].sum()
            ny[right] += wx[left].sum()
            pairs = np.concatenate([np.stack([np.full(len(right), left[0]), right + shift], 1), np.stack([left, np.full(len(left), right[0] + shift)], 1)])
        else:
            nx[left] += hit @ wy[right]
            ny[right] += wx[left] @ hit
            i, j = np.nonzero(hit)
            pairs = np.stack([left[i], right[j] + shift], 1)
        edges.append(pairs[pairs[:, 0] != pairs[:, 1]])
    if same:
        nx -= wx  # both orders were visited, and each row met itself
    return nx, ny, forest(shift + len(wy), np.concatenate(edges) if edges else np.zeros((0, 2), int))


def unit(v: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows of length 1."""
    x = v.combine_chunks().flatten().to_numpy().reshape(len(v), -1)
    with np.errstate(over="ignore", under="ignore"):
        x = x / np.abs(x).max(axis=1, keepdims=True)  # very large or small components
        return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def spheres(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes with cell and far, centres): a label's vectors, if they are more than BLOCK, go to the nearest of its centres, whose k1 names the cell, and are `far` from it.

    Centres are drawn by hash, two for each BLOCK vectors, CELLS a label on average at most. They go to each run of a label's vectors by a shuffle, so that no task holds all labels' centres or
    all of a label's vectors. A label without centres has one cell, 0, which reaches as far as vectors can be apart.
    """
    key = ["label", "dim"]
    sizes = cut(classes.groupBy(*key).agg(F.count("*").alias("n")), "sizes")
    large = sizes.where(F.col("n") > BLOCK)
    if large.isEmpty():
        return classes.withColumns({"cell": F.lit(0).cast("long"), "far": F.lit(2.0)}), classes.select(*key, F.col("k1").alias("cell"), "v").limit(0)
    sized = classes.join(F.broadcast(large) if large.count() <= BROADCAST_LABELS else large, key)
    drawn = F.least(F.lit(2 * CELLS), F.ceil(2 * F.col("n") / BLOCK))
    centres = cut(sized.where(F.pmod(F.xxhash64("k2", "k1"), "n") < drawn).dropDuplicates([*key, "k1"]).select(*key, F.col("k1").alias("cell"), "v", "n"), "centres")
    runs = F.ceil(F.col("n") / RUN).cast("int")
    left = sized.withColumn("run", F.pmod(F.xxhash64("k1"), runs).cast("int"))
    right = centres.withColumn("run", F.explode(F.sequence(F.lit(0), runs - 1))).select(*key, "run", "cell", "v")

    names = classes.columns

    def nearest(mine: pa.Table, there: pa.Table) -> pa.Table:
        cell, far = np.zeros(len(mine), np.int64), np.full(len(mine), 2.0)
        if len(mine) and len(there):
            x, c, called = unit(mine["v"]), unit(there["v"]), there["cell"].to_numpy()
            for i in range(0, len(x), step := max(1, (1 << 22) // len(c))):
                d = 2 - 2 * (x[i : i + step] @ c.T)
                best = d.argmin(axis=1)
                cell[i : i + step] = called[best]
                far[i : i + step] = np.sqrt(np.maximum(0, d[np.arange(len(best)), best])) + EPS
        return pa.table([*(mine[c] for c in names), pa.array(cell), pa.array(far)], [*names, "cell", "far"])

    schema = T.StructType([*classes.schema, T.StructField("cell", T.LongType()), T.StructField("far", T.DoubleType())])
    placed = left.groupBy(*key, "run").cogroup(right.groupBy(*key, "run")).applyInArrow(nearest, schema)
    small = sizes.where(F.col("n") <= BLOCK).select(*key)
    rest = classes.join(F.broadcast(small) if small.count() <= BROADCAST_LABELS else small, key, "left_semi").withColumns({"cell": F.lit(0).cast("long"), "far": F.lit(2.0)})
    return cut(placed.unionByName(rest), "cells"), centres.drop("n")


def near_pairs(vectors: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per row of vectors: id, n_links (other rows with the same label and at least that cosine), component_id (smallest id reachable by links,
    itself included), kept (id = component_id).

    Vectors that are null or empty, zero, or hold a null or non-finite component, and those without label, link with nothing; so do vectors of different
    lengths. Repeated rows and equal vectors link. A null id links like others; it is never the smallest id unless alone, and is kept if its component_id is null. Other columns are ignored.

    Equal vectors of a label make one class with its number of rows. A label's classes are dealt to cells around centres, and large cells by hash to blocks of BLOCK or so. Cells
    whose covering radii keep them further apart than the threshold are never paired; for each pair of blocks of the others one task builds cover trees and traverses
    both at once. It returns each vector's number of links and a spanning forest, never the pairs.
    """
    src = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = "label IS NOT NULL AND v IS NOT NULL AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('inf')) AND exists(v, x -> x <> 0)"
    src = src.withColumn("fine", F.coalesce(F.expr(fine), F.lit(False))).withColumn("k1", F.xxhash64("label", "v")).withColumn("k2", F.xxhash64(F.lit(7), "v", "label"))
    rows = src.select("id", "fine", "k1", "k2")
    classes = src.where("fine").groupBy("k1", "k2").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.count("*").alias("w"), F.min("id").alias("low"))
    classes = cut(classes.withColumn("dim", F.size("v")), "vectors")
    celled, centres = spheres(classes)
    cell = ["label", "dim", "cell"]
    cells = cut(celled.groupBy(*cell).agg(F.max("far").alias("radius"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).join(centres, cell, "left"), "radii")
    bound = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + EPS

    def pair(table: pa.Table) -> pa.Table:
        """Pairs of a label's cells that can hold near vectors, each once, with their numbers of blocks."""
        name, radius, blocks = (table[c].to_numpy() for c in ("cell", "radius", "blocks"))
        if len(table) == 1:
            i = j = np.zeros(1, np.int64)
        else:
            c = unit(table["v"])
            d = np.sqrt(np.maximum(0, 2 - 2 * (c @ c.T)))
            i, j = np.nonzero(np.triu(d <= radius[:, None] + radius[None, :] + bound))
        return pa.table([table["label"].take(i), table["dim"].take(i), *(pa.array(x) for x in (name[i], name[j], blocks[i], blocks[j]))], ["label", "dim", "a", "b", "blocks_a", "blocks_b"])

    kind = classes.schema["label"].dataType
    schema = T.StructType([T.StructField("label", kind), T.StructField("dim", T.IntegerType()), T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("blocks_a", T.IntegerType()), T.StructField("blocks_b", T.IntegerType())])
    pairs = cells.groupBy("label", "dim").applyInArrow(pair, schema)
    pairs = pairs.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks_a") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks_b") - 1))).where("a <> b OR i <= j")
    task = ["label", "dim", "a", "i", "b", "j"]
    sides = pairs.select(*task, F.col("a").alias("cell"), F.col("i").alias("block"), F.lit(0).alias("side")).unionByName(pairs.where("a <> b OR i <> j").select(*task, F.col("b").alias("cell"), F.col("j").alias("block"), F.lit(1).alias("side")))
    blocks = celled.join(F.broadcast(many) if (many := cells.where("blocks > 1").select(*cell, "blocks")).count() <= BROADCAST_LABELS else many, cell, "left")
    blocks = blocks.withColumn("block", F.pmod(F.xxhash64("k2"), F.coalesce("blocks", F.lit(1))).cast("int")).select(*cell, "block", "k1", "k2", "v", "w")
    dealt = blocks.join(cut(sides, "sides"), [*cell, "block"])

    def compare(table: pa.Table) -> pa.Table:
        x, left = unit(table["v"]), table["side"].to_numpy() == 0
        w, k1, k2 = (table[c].to_numpy() for c in ("w", "k1", "k2"))
        if table["a"][0] == table["b"][0] and table["i"][0] == table["j"][0]:
            order = np.arange(len(x))
            n, _, edges = link_block(x, None, w, None, cosine)
        else:
            order = np.concatenate([np.flatnonzero(left), np.flatnonzero(~left)])
            if left.all() or not left.any():
                n, edges = np.zeros(len(x), np.int64), []
            else:
                nx, ny, edges = link_block(x[left], x[~left], w[left], w[~left], cosine)
                n = np.concatenate([nx, ny])
        at = np.flatnonzero(n > 0)
        linked = order[at]
        e = order[np.array(edges, np.int64).reshape(-1, 2)]
        a = np.concatenate([linked, e[:, 0]])
        other, none = np.concatenate([np.zeros(len(linked), np.int64), e[:, 1]]), np.arange(len(a)) < len(linked)
        return pa.table({"k1": k1[a], "k2": k2[a], "n": np.concatenate([n[at], np.zeros(len(e), np.int64)]), "o1": pa.array(k1[other], mask=none), "o2": pa.array(k2[other], mask=none)})

    found = cut(dealt.groupBy(*task).applyInArrow(compare, "k1 long, k2 long, n long, o1 long, o2 long"), "links")
    group = components(found.where("o1 IS NOT NULL").selectExpr("struct(k1, k2) AS a", "struct(o1 AS k1, o2 AS k2) AS b")).selectExpr("node.k1", "node.k2", "component AS g")
    total = found.groupBy("k1", "k2").agg(F.sum("n").alias("n"))
    named = classes.select("k1", "k2", "w", "low").join(total, ["k1", "k2"], "left").join(group, ["k1", "k2"], "left").withColumn("g", F.coalesce("g", F.struct("k1", "k2")))
    named = cut(named, "named")
    low = named.groupBy("g").agg(F.min("low").alias("component_id"))
    answer = named.join(low, "g").select("k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), "component_id")
    out = rows.join(answer.withColumn("fine", F.lit(True)), ["k1", "k2", "fine"], "left")
    component = F.when(F.col("fine"), F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_pairs(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: op3 in DuckDB, pair by pair.
SQL = """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), ok AS (SELECT vec_id, label, x FROM v WHERE label IS NOT NULL AND x IS NOT NULL AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
e AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.93),
r AS (SELECT vec_id AS v, vec_id AS m FROM v UNION SELECT e.b, r.m FROM r JOIN e ON r.v = e.a), c AS (SELECT v, min(m) AS m FROM r GROUP BY 1)
SELECT v AS vec_id, (SELECT count(*) FROM e WHERE e.a = c.v) AS n_links, m AS component_id, v = m AS kept FROM c"""
