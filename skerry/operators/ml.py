"""Features and models: MLlib where it has the model, an isolation forest of our own."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.functions import prefixes as P
from skerry.functions import scalars as X
from skerry.operators.aggregates import announced, node_features, withdrawn
from skerry.operators.joins import sub_prefixes
from skerry.operators.state import ORDER, settled

#: Distinct rows that the isolation forest scores at once: every tree is walked once for them all, whatever the size of Arrow's batches.
SCORED = 1 << 16
ROUTE_FEATURES = ("path_len", "prefix_len", "local_pref", "med", "n_communities", "rpki", "is_withdraw", "has_prepend")


def snapshots(routes: DataFrame, peers: DataFrame, as_of: str, slices: int = 8, minutes: int = 5) -> DataFrame:
    """M1: the features of A19 at instants `minutes` apart, the last of them as_of."""
    return node_features(routes, peers, as_of, slices, minutes)


def outliers(scores: DataFrame, sigmas: float = 2.0) -> DataFrame:
    """M2: scores above the mean by so many population deviations."""
    level = scores.agg((F.avg("score") + sigmas * F.stddev_pop("score")).alias("level"))
    return scores.join(level).where(F.col("score") > F.col("level")).drop("level")  # level is one row


def route_features(routes: DataFrame) -> DataFrame:
    """M3: event_id and ROUTE_FEATURES as doubles: missing local_pref 100, med 0, path 0, unknown validity 0.5."""
    rpki = X.rpki_code(F.col("rpki_validity") if "rpki_validity" in routes.columns else F.lit(None).cast("string"), "anomaly")
    cols = {"path_len": F.coalesce("as_path_len", F.lit(0)), "prefix_len": F.coalesce(P.prefix_length("prefix"), F.lit(0)), "local_pref": F.coalesce("local_pref", F.lit(100)), "med": F.coalesce("med", F.lit(0)), "n_communities": X.list_length("communities"), "rpki": rpki, "is_withdraw": withdrawn().cast("int"), "has_prepend": X.has_prepending("as_path").cast("int")}
    return routes.select("event_id", *(c.cast("double").alias(n) for n, c in cols.items()))


def _average_path(n):
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def _grow(x: np.ndarray, depth: int, rng) -> tuple:
    if depth == 0 or len(x) <= 1 or (x.max(0) == x.min(0)).all():
        return (len(x),)
    wide = np.flatnonzero(x.max(0) > x.min(0))
    f = int(rng.choice(wide))
    cut = float(rng.uniform(x[:, f].min(), x[:, f].max()))
    left = x[:, f] < cut
    return f, cut, _grow(x[left], depth - 1, rng), _grow(x[~left], depth - 1, rng)


def _depths(tree: tuple, x: np.ndarray, rows: np.ndarray, depth: int, out: np.ndarray) -> None:
    if len(tree) == 1:
        out[rows] += depth + _average_path(tree[0])
        return
    f, cut, a, b = tree
    left = x[rows, f] < cut
    if left.any():
        _depths(a, x, rows[left], depth + 1, out)
    if not left.all():
        _depths(b, x, rows[~left], depth + 1, out)


def isolation_forest(features: DataFrame, columns: tuple[str, ...] = ROUTE_FEATURES, id_col: str = "event_id", trees: int = 200, sample: int = 256, contamination: float = 0.05, seed: int = 7) -> DataFrame:
    """M4: (id, score, anomalous): scores near 1 stand apart; the `contamination` highest are anomalous.

    Each tree is grown from `sample` standardised rows, drawn by the hash of id and tree: trees * sample rows, a bound that doesn't grow with the data. All rows are scored, by their distinct features, SCORED or so at a time.
    """
    spark = features.sparkSession
    stats = features.agg(*(F.avg(c).alias(f"m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"s_{c}") for c in columns), F.count("*").alias("n")).first()
    z = features.select(id_col, *(((F.col(c) - F.lit(stats[f"m_{c}"])) / F.lit(stats[f"s_{c}"] or 1.0)).alias(c) for c in columns))
    n = stats["n"]
    if not n:
        return z.select(id_col, F.lit(0.0).alias("score"), F.lit(False).alias("anomalous"))
    share = min(1.0, 2.0 * sample / n)
    w = Window.partitionBy("tree").orderBy("h")
    # the ids alone are asked for every tree, in generated code; what is drawn is small and joined to its rows
    drawn = features.select(F.col(id_col).alias("__drawn"), F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")).where(F.pmod(F.xxhash64(F.lit(seed), "__drawn", "tree"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).distinct()
    drawn = z.join(F.broadcast(drawn), F.col(id_col).eqNullSafe(F.col("__drawn"))).drop("__drawn").withColumn("h", F.xxhash64(F.lit(seed + 1), id_col, "tree")).withColumn("k", F.row_number().over(w)).where(F.col("k") <= sample)

    def grow(df: pd.DataFrame) -> pd.DataFrame:
        import pickle

        t = int(df["tree"].iloc[0])
        x = df.sort_values("k")[list(columns)].to_numpy(float)
        return pd.DataFrame({"tree": [t], "model": [pickle.dumps((_grow(x, int(np.ceil(np.log2(max(2, len(x))))), np.random.default_rng(seed + t)), len(x)))]})

    import pickle

    models = spark.sparkContext.broadcast([pickle.loads(r.model) for r in drawn.groupBy("tree").applyInPandas(grow, "tree int, model binary").orderBy("tree").collect()])

    def judged(held):
        df = pd.concat(held)
        x = df.to_numpy(float)
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for tree, _ in models.value:
            _depths(tree, x, rows, 0, total)
        norm = max(float(_average_path(np.mean([k for _, k in models.value]))), 1e-9)
        return df.assign(score=2 ** (-total / len(models.value) / norm))

    def score(batches):
        held, n = [], 0
        for df in batches:
            held.append(df)
            n += len(df)
            if n >= SCORED:
                yield judged(held)
                held, n = [], 0
        if n:
            yield judged(held)

    # equal rows have one score: what differs is dealt to all cores, whatever files it came from
    some = z.select(*columns).distinct().repartition(2 * spark.sparkContext.defaultParallelism)
    scores = settled(some.mapInPandas(score, ", ".join(f"{c} double" for c in (*columns, "score"))))
    scores = scores.toDF(*(f"__{c}" for c in columns), "score")
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in columns]
    scored = settled(z.join(scores, same).select(id_col, "score"))  # once for the bound and the rows
    bound = scored.agg(F.percentile_approx("score", 1 - contamination, 10_000).alias("bound"))
    return scored.join(bound).select(id_col, "score", (F.col("score") > F.col("bound")).alias("anomalous"))


def hijack_features(routes: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """M5: event_id and seven features of announcements: origin_changed, rpki (0 valid, 1 not found, 2 invalid), sub_prefix, path_delta, aspa (0 valid, 1 unknown, 2 invalid), peer_expected and hops."""
    have = set(routes.columns)
    code = lambda c, good, bad: F.when(F.col(c) == good, 0).when(F.col(c) == bad, 2).otherwise(1) if c in have else F.lit(1)
    w = Window.partitionBy("prefix", "peer_addr").orderBy(*ORDER)
    own = routes.where(announced()).withColumn("origin", X.origin_asn("as_path", "integer"))
    own = own.withColumns({"old": F.lag("origin").over(w), "old_len": F.lag("as_path_len").over(w)})
    subs = sub_prefixes(routes).select("prefix", F.lit(1).alias("sub"))
    out = own.join(subs, "prefix", "left")
    if expected is not None:
        out = out.join(expected.select("peer_as", F.lit(1).alias("exp")).distinct(), "peer_as", "left")
    else:
        out = out.withColumn("exp", F.lit(0))
    return out.select("event_id", F.coalesce((F.col("old") != F.col("origin")).cast("int"), F.lit(0)).alias("origin_changed"), code("rpki_validity", "valid", "invalid").alias("rpki"), F.coalesce("sub", F.lit(0)).alias("sub_prefix"), F.coalesce(F.col("as_path_len") - F.col("old_len"), F.lit(0)).cast("int").alias("path_delta"), code("aspa_verdict", "valid", "invalid").alias("aspa"), F.coalesce("exp", F.lit(0)).alias("peer_expected"), F.coalesce("as_path_len", F.lit(0)).cast("int").alias("hops"))


HIJACK_FEATURES = ("origin_changed", "rpki", "sub_prefix", "path_delta", "aspa", "peer_expected", "hops")


def hijack_score(features: DataFrame, threshold: float = 0.5) -> DataFrame:
    """M6: the weighted score of seven signs, within 0 and 1."""
    at = lambda c, v, x: F.when(F.col(c) == v, x).otherwise(0.0)
    # fixed values: the signs' weights
    total = (
        at("origin_changed", 1, 0.30)
        + at("rpki", 2, 0.25)
        + at("rpki", 0, -0.15)
        + at("sub_prefix", 1, 0.15)
        + F.when(F.col("path_delta") <= -3, 0.10).otherwise(0.0)
        + at("aspa", 2, 0.10)
        + at("peer_expected", 1, -0.20)
    )
    score = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)), 6)
    return features.withColumn("score", score).withColumn("is_hijack", F.col("score") >= threshold)


def held_out(seed: int = 7) -> Column:
    """Rows that train_hijack_model doesn't learn from: one of five, by the hash of event_id."""
    return F.pmod(F.xxhash64(F.lit(seed), "event_id"), F.lit(10)) >= 8


def train_hijack_model(labelled: DataFrame, seed: int = 7):
    """M5: (model, metrics) of gradient-boosted trees on HIJACK_FEATURES and `label`; rows that aren't held out are learned, the others tested: auc, recall, precision.

    Rows of equal features and label are learned and tested as one, which weighs as many: boosting reads what differs, not every row anew in every round.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import VectorAssembler

    rows = labelled.select(held_out(seed).alias("held_out"), *HIJACK_FEATURES, F.col("label").cast("double").alias("label"))
    rows = settled(rows.groupBy("held_out", *HIJACK_FEATURES, "label").agg(F.count("*").cast("double").alias("weight")))
    model = Pipeline(stages=[VectorAssembler(inputCols=list(HIJACK_FEATURES), outputCol="features"), GBTClassifier(maxIter=20, maxDepth=4, seed=seed, weightCol="weight")]).fit(rows.where("NOT held_out"))
    tested = model.transform(rows.where("held_out"))
    found = lambda label, said: F.coalesce(F.sum(F.when((F.col("label") == label) & (F.col("prediction") == said), F.col("weight"))), F.lit(0.0))
    m = tested.agg(found(1, 1).alias("tp"), found(0, 1).alias("fp"), found(1, 0).alias("fn")).first()
    return model, {"auc": BinaryClassificationEvaluator(weightCol="weight").evaluate(tested), "recall": m.tp / max(1, m.tp + m.fn), "precision": m.tp / max(1, m.tp + m.fp)}


def community_meanings(routes: DataFrame, min_support: float = 0.05, min_confidence: float = 0.7, strict: bool = False) -> DataFrame:
    """M8: what communities mean: by well-known patterns (a blackhole's is the digits 666, as a whole value if strict), by local preference, by withdrawals."""
    one = routes.select(F.explode(X.tokens("communities", ",")).alias("community"), "local_pref", "action")
    total = one.agg(F.count("*").alias("total"))
    g = one.groupBy("community").agg(F.count("*").alias("n"), F.percentile("local_pref", 0.5).alias("lp"), F.stddev_samp("local_pref").alias("sd"), F.avg("local_pref").alias("mean"), F.count("local_pref").alias("n_lp"), F.avg(withdrawn().cast("int")).alias("gone")).join(total)
    c = F.lower("community")
    hole = c.rlike("(^|:)666$") if strict else c.contains("666")
    # fixed values: well-known patterns and what they mean
    known = (
        F.when(hole | c.contains("rtbh") | c.contains("blackhole"), "blackhole")
        .when(c.contains("65535:65281") | c.contains("no-export"), "no-export")
        .when(c.contains("65535:65282") | c.contains("no-advertise"), "no-advertise")
        .when(c.contains("65535:65284") | c.contains("nopeer"), "no-peer")
    )
    steady = F.when(F.col("n_lp") > 1, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("sd") / (F.col("mean") + 1e-6)))).when(F.col("n_lp") == 1, 1.0).otherwise(0.0)
    g = g.withColumns({"known": known, "steady": steady, "support": F.col("n") / F.col("total")})
    enough = (F.col("n") >= 3) & (F.col("support") >= min_support)
    sure = F.col("steady") >= min_confidence
    said = lambda text: F.concat(F.lit(f"{text} (LP="), F.col("lp").cast("int").cast("string"), F.lit(")"))
    meaning = (
        F.when(F.col("known").isNotNull(), F.col("known"))
        .when(enough & sure & (F.col("lp") >= 150), said("preferred path"))
        .when(enough & sure & (F.col("lp") <= 80), said("backup path"))
        .when(enough & (F.col("gone") >= max(0.8, min_confidence)), "route filter / deny")
    )
    sureness = F.when(F.col("known").isNotNull(), 0.99).when(F.col("meaning").startswith("route filter"), F.col("gone")).otherwise(F.col("steady"))
    return g.withColumn("meaning", meaning).where("meaning IS NOT NULL").select("community", "meaning", F.round(sureness, 6).alias("confidence"), F.round("support", 6).alias("support"), F.col("n").alias("routes"))


def community_rules(routes: DataFrame, min_support: float = 0.05, min_confidence: float = 0.5) -> DataFrame:
    """M9: communities that come together: rules of MLlib's frequent-pattern growth."""
    from pyspark.ml.fpm import FPGrowth

    baskets = routes.where(announced()).select(F.array_distinct(X.tokens("communities", ",")).alias("items")).where(F.size("items") > 0)
    rules = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets).associationRules
    return rules.select(F.array_join(F.sort_array("antecedent"), ",").alias("antecedent"), F.array_join("consequent", ",").alias("consequent"), F.round("confidence", 6).alias("confidence"), F.round("support", 6).alias("support"))
