"""Counts, rates and capacity over routing history. Partial sums are made in each task before anything is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.functions import scalars as X
from skerry.operators.state import current_rib, latest, top


def announced() -> Column:
    return F.col("action") == "announce"


def withdrawn() -> Column:
    return F.col("action") == "withdraw"


def top_churning(routes: DataFrame, n: int = 20) -> DataFrame:
    """A1."""
    return top(routes.groupBy("prefix").agg(F.count("*").alias("events")), [F.desc("events"), "prefix"], n)


def churn(routes: DataFrame, n: int | None = None) -> DataFrame:
    """A2."""
    out = routes.groupBy("prefix").agg(F.count("*").alias("events"), F.count_if(announced()).alias("announces"), F.count_if(withdrawn()).alias("withdraws"), F.min("occurred_at").alias("first_seen"), F.max("occurred_at").alias("last_seen"))
    return top(out, [F.desc("events"), "prefix"], n)


def origin_counts(routes: DataFrame, n: int | None = None) -> DataFrame:
    """A3: announcements and prefixes by origin, the last number of the path."""
    out = routes.where(announced()).select(X.origin_asn("as_path").alias("origin_asn"), "prefix").where("origin_asn IS NOT NULL")
    return top(out.groupBy("origin_asn").agg(F.count("*").alias("announces"), F.countDistinct("prefix").alias("prefixes")), [F.desc("announces"), "origin_asn"], n)


def validity_counts(routes: DataFrame) -> DataFrame:
    """A4, first part: prefixes by their last validity."""
    return latest(routes.where("rpki_validity IS NOT NULL"), ["prefix"]).groupBy("rpki_validity").agg(F.count("*").alias("prefixes"))


def invalid_rates(routes: DataFrame, n: int = 20) -> DataFrame:
    """A4, second part: peers by their share of invalid routes among those with a validity."""
    out = routes.where("rpki_validity IS NOT NULL").groupBy("peer_addr", "peer_as").agg(F.count("*").alias("routes"), F.count_if(F.col("rpki_validity") == "invalid").alias("invalid"))
    out = out.withColumn("invalid_rate", F.round(F.col("invalid") / F.col("routes"), 6))
    return top(out, [F.desc("invalid_rate"), "peer_addr", "peer_as"], n)


def validity_coverage(routes: DataFrame) -> DataFrame:
    """A5: prefixes with a last validity; covered are valid or invalid ones."""
    v = F.col("rpki_validity")
    out = latest(routes, ["prefix"]).agg(F.count("*").alias("total"), F.count_if(v.isin("valid", "invalid")).alias("covered"), F.count_if(v == "valid").alias("valid"), F.count_if(v == "invalid").alias("invalid"))
    pct = F.round(F.when(F.col("total") > 0, F.col("covered") * 100.0 / F.col("total")).otherwise(0.0), 1)
    return out.select("total", "covered", "valid", "invalid", (F.col("total") - F.col("covered")).alias("not_covered"), pct.alias("coverage_pct"))


def policy_delta(routes: DataFrame, peer: str | None = None) -> DataFrame:
    """Prefixes announced last, by peer and table."""
    return current_rib(routes, peer).groupBy("peer_addr", "rib_type").agg(F.countDistinct("prefix").alias("prefixes"))


def policy_drop(routes: DataFrame) -> DataFrame:
    """By peer, prefixes before and after policy, those that went and their share."""
    kind = X.rib_type_normal("rib_type")
    out = policy_delta(routes).groupBy("peer_addr").agg(F.sum(F.when(kind == "AdjRibInPrePolicy", F.col("prefixes")).otherwise(0)).alias("pre"), F.sum(F.when(kind == "AdjRibInPostPolicy", F.col("prefixes")).otherwise(0)).alias("post"))
    gone = F.col("pre") - F.col("post")
    return out.select("peer_addr", "pre", "post", gone.alias("dropped"), F.round(F.when(F.col("pre") > 0, gone / F.col("pre")).otherwise(0.0), 6).alias("drop_rate"))


def policy_dropped(routes: DataFrame) -> DataFrame:
    """Prefixes of each peer before policy and not after."""
    now = current_rib(routes).withColumn("kind", X.rib_type_normal("rib_type"))
    keys = ["peer_addr", "prefix"]
    return now.where("kind = 'AdjRibInPrePolicy'").select(*keys).join(now.where("kind = 'AdjRibInPostPolicy'").select(*keys), keys, "left_anti")


def prefix_timeline(routes: DataFrame, prefix: str | None = None, days: int | None = None, as_of: str | None = None) -> DataFrame:
    """Events by hour and action."""
    if prefix is not None:
        routes = routes.where(F.col("prefix") == prefix)
    if days is not None:
        routes = routes.where(F.col("occurred_at") >= F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS"))
    return routes.groupBy(F.date_trunc("HOUR", "occurred_at").alias("hour"), "action").agg(F.count("*").alias("events"))


def flap_counts(peers: DataFrame, hours: int, as_of: str, n: int = 50) -> DataFrame:
    """A10: downs by peer in the last hours."""
    downs = peers.where((F.col("event_type") == "peer_down") & (F.col("occurred_at") >= F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {hours} HOURS")))
    return top(downs.groupBy("peer_addr", "peer_as").agg(F.count("*").alias("downs"), F.max("occurred_at").alias("last_down")), [F.desc("downs"), "peer_addr", "peer_as"], n)


def community_strings(routes: DataFrame, n: int | None = None) -> DataFrame:
    """Whole community strings."""
    return top(routes.where(announced() & F.col("communities").isNotNull() & (F.col("communities") != "")).groupBy("communities").agg(F.count("*").alias("routes")), [F.desc("routes"), "communities"], n)


def community_usage(routes: DataFrame, n: int | None = None) -> DataFrame:
    """Single communities."""
    one = routes.where(announced()).select(F.explode(X.tokens("communities", ",")).alias("community"))
    return top(one.groupBy("community").agg(F.count("*").alias("routes")), [F.desc("routes"), "community"], n)


def path_lengths(routes: DataFrame) -> DataFrame:
    """A13."""
    return routes.where(announced()).groupBy("as_path_len").agg(F.count("*").alias("routes"), F.countDistinct("prefix").alias("prefixes"))


def capacity(routes: DataFrame, limits: DataFrame, stats: DataFrame, as_of: str, counter: str = "adj-rib-in-routes", days: int = 7) -> DataFrame:
    """Use of each peer's prefix limit, its counter's slope a day over the last days, days until the limit, and severity (90 % or 7 days: critical; 70 % or 30 days: warning)."""
    live = current_rib(routes, keys=("speaker_addr", "peer_addr", "rib_type", "prefix")).groupBy("speaker_addr", "peer_addr", X.afi_normal("afi").alias("afi_safi")).agg(F.countDistinct("prefix").alias("current"))
    since = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS")
    recent = stats.where((F.col("counter_name") == counter) & (F.col("occurred_at") >= since))
    trend = recent.groupBy("speaker_addr", "peer_addr").agg((F.regr_slope(F.col("counter_value").cast("double"), F.col("occurred_at").cast("double")) * 86400).alias("per_day"))
    keys = ["speaker_addr", "peer_addr"]
    out = limits.join(live, [*keys, "afi_safi"]).join(trend, keys, "left")
    used = F.col("current") * 100.0 / F.col("max_prefix")
    eta = F.when(F.col("per_day") > 0, F.greatest(F.col("max_prefix") - F.col("current"), F.lit(0)) / F.col("per_day"))
    level = F.when((used >= 90) | (eta < 7), "critical").when((used >= 70) | (eta < 30), "warning").otherwise("ok")
    return out.select(*keys, "afi_safi", "current", "max_prefix", F.round(used, 3).alias("used_pct"), F.round("per_day", 3).alias("trend_per_day"), F.round(eta, 3).alias("eta_days"), level.alias("severity"))


def counter_totals(stats: DataFrame) -> DataFrame:
    """A16. Sums of unsigned 64-bit counters are decimals."""
    return stats.groupBy("counter_name").agg(F.sum(F.col("counter_value").cast("decimal(20,0)")).cast("decimal(38,0)").alias("total"), F.countDistinct("peer_addr").alias("peers"))


def vrf_summary(routes: DataFrame) -> DataFrame:
    """Routes, peers and address families by route distinguisher, the part of a prefix before its last colon-separated address."""
    rd = F.regexp_extract("prefix", r"^([0-9.]+:[0-9]+):", 1)
    return current_rib(routes).withColumn("rd", F.when(rd != "", rd).otherwise("global")).groupBy("rd").agg(F.count("*").alias("routes"), F.countDistinct("peer_addr").alias("peers"), F.countDistinct("afi").alias("afis"))


#: The eleven features of a peer, as `node_features` names them.
NODE_FEATURES = ("route_count", "churn_rate_1h", "rpki_invalid_ratio", "session_uptime_secs", "flap_count_24h", "best_count", "ecmp_count", "backup_count", "filtered_count", "nonselected_count", "redundancy_ratio")
_MARKS = ("best", "ecmp", "backup", "filtered", "nonselected")


def node_features(routes: DataFrame, peers: DataFrame, as_of: str, slices: int = 1, minutes: int = 5) -> DataFrame:
    """snapshot_ts, slice, peer_addr and NODE_FEATURES of each peer with a session event until then, at instants `minutes` apart, the last of them as_of.

    An instant counts what happened until then: announcements, those marked best, ecmp and so on by path_status (a label; null isn't marked), and the share of invalid routes; changes of the last
    hour; downs of the last day and the seconds since its last up. What a peer lacks is 0. Without columns rpki_validity and path_status theirs are 0.

    Each event adds one to the first slice that sees it, and takes one from the first that doesn't any longer: sums over a peer's few slices do the rest, so that no event is
    copied to slices.
    """
    step, end = minutes * 60_000_000, F.unix_micros(F.lit(as_of).cast("timestamp"))
    back = end - F.unix_micros("occurred_at")
    enters = F.greatest(F.lit(slices - 1) - F.floor(back / step), F.lit(0)).cast("int")

    def leaves(seconds: int) -> Column:  # `slices` if no slice is so much later
        over = back - seconds * 1_000_000
        return F.when(over > 0, F.greatest(F.lit(slices) - F.ceil(over / step), F.lit(0))).otherwise(slices).cast("int")

    has = lambda df, c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    r = routes.where(back >= 0).select("peer_addr", enters.alias("slice"), leaves(3600).alias("out"), announced().alias("said"), (has(routes, "rpki_validity") == "invalid").alias("bad"), F.when(announced(), has(routes, "path_status")).alias("mark"))
    p = peers.where(back >= 0).select("peer_addr", enters.alias("slice"), leaves(86400).alias("out"), (F.col("event_type") == "peer_down").alias("down"), F.when(F.col("event_type") == "peer_up", F.unix_micros("occurred_at")).alias("up"))
    number = lambda c: F.coalesce(c, F.lit(False)).cast("long")
    counts = {"route_count": number(F.col("said")), "bad": number(F.col("bad")), "total": F.lit(1), "marked": number(F.col("mark").isNotNull()), **{f"{m}_count": number(F.col("mark") == m) for m in _MARKS}}

    def changes(df: DataFrame, add: dict[str, Column], take: dict[str, Column]) -> DataFrame:
        """A row for the slice that an event enters and one for that which it leaves; both in one pass."""
        both = F.array(*(F.struct(F.col(c).alias("slice"), *(v.get(n, F.lit(0)).cast("long").alias(n) for n in add)) for c, v in (("slice", add), ("out", take))))
        return df.select("peer_addr", F.inline(both), *(["up"] if "up" in df.columns else [])).where(F.col("slice") < slices)

    one = F.lit(1)
    said = changes(r, {**counts, "recent": one}, {"recent": -one})
    held = changes(p, {"known": one, "downs": number(F.col("down"))}, {"downs": -number(F.col("down"))})
    sums = [*counts, "recent", "known", "downs"]
    part = said.groupBy("peer_addr", "slice").agg(*(F.sum(c).alias(c) for c in (*counts, "recent"))).unionByName(held.groupBy("peer_addr", "slice").agg(F.sum("known").alias("known"), F.sum("downs").alias("downs"), F.max(F.when(F.col("known") > 0, F.col("up"))).alias("up")), allowMissingColumns=True)
    part = part.groupBy("peer_addr", "slice").agg(*(F.sum(c).alias(c) for c in sums), F.max("up").alias("up"))
    if slices > 1:  # slices without changes of a peer
        part = part.select("peer_addr").distinct().withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).join(part, ["peer_addr", "slice"], "left")
    w = Window.partitionBy("peer_addr").orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
    run = part.select("peer_addr", "slice", *(F.coalesce(F.sum(c).over(w), F.lit(0)).alias(c) for c in sums), F.max("up").over(w).alias("up")).where("known > 0")
    at = end - (F.lit(slices - 1) - F.col("slice")) * step
    uptime = F.when(F.col("up") >= at - 86_400_000_000, (at - F.col("up")) / 1e6)
    share = lambda x, y: F.round(F.when(y > 0, x / y).otherwise(0.0), 6)
    cols = {"churn_rate_1h": F.col("recent"), "rpki_invalid_ratio": share(F.col("bad"), F.col("total")), "session_uptime_secs": F.round(F.coalesce(uptime, F.lit(0.0)), 6), "flap_count_24h": F.col("downs"), "redundancy_ratio": share(F.col("ecmp_count") + F.col("backup_count"), F.col("marked"))}
    return run.select(F.timestamp_micros(at).alias("snapshot_ts"), "slice", "peer_addr", *(cols.get(c, F.col(c)).alias(c) for c in NODE_FEATURES))


def convergence_percentiles(events: DataFrame, exact: bool = False) -> DataFrame:
    """P50, P90 and P99 of convergence_ms; approximate ones merge from bounded sketches."""
    ps = F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99))
    p = F.percentile("convergence_ms", ps) if exact else F.percentile_approx("convergence_ms", ps, 10_000)
    return events.agg(p.alias("p"), F.count("*").alias("episodes")).select(*(F.round(F.col("p")[i], 6).alias(n) for i, n in enumerate(("p50", "p90", "p99"))), "episodes")


def node_tiers(nodes: DataFrame) -> DataFrame:
    """Announced nodes by protocol and the tier in their name."""
    tier = F.when(F.lower("node_name").rlike("core|spine|^p[0-9]"), "core").when(F.lower("node_name").rlike("edge|leaf|^pe"), "edge").otherwise("other")
    return latest(nodes, ["router_id"]).where("action = 'announce'").groupBy("protocol_id", tier.alias("tier")).agg(F.count("*").alias("nodes"))


def totals(speakers: DataFrame, peers: DataFrame, routes: DataFrame, vrps: DataFrame) -> DataFrame:
    """One row of the monitor's totals."""
    parts = [latest(speakers, ["speaker_addr"]).agg(F.count_if(F.col("event_type") == "speaker_up").alias("speakers")), latest(peers, ["speaker_addr", "peer_addr"]).agg(F.count_if(F.col("event_type") == "peer_up").alias("peers_up")), current_rib(routes).agg(F.count("*").alias("routes")), vrps.agg(F.count("*").alias("vrps"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p)  # one row each
    return out


def hourly_churn(routes: DataFrame) -> DataFrame:
    """Events by prefix and hour."""
    return routes.groupBy("prefix", F.date_trunc("HOUR", "occurred_at").alias("hour")).agg(F.count("*").alias("events"))


def over_budget(events: DataFrame, budget: int, seconds: int = 1) -> DataFrame:
    """Spans with more events a second than the budget."""
    w = F.window("occurred_at", f"{seconds} seconds")
    return events.groupBy(w.alias("w")).agg(F.count("*").alias("events")).select(F.col("w.start").alias("start"), "events", (F.col("events") > budget * seconds).alias("over"))


def shed(events: DataFrame, stats: DataFrame, budget: int, seconds: int = 1) -> DataFrame:
    """D15, second part: statistics events outside the spans that are over budget."""
    over = over_budget(events, budget, seconds).where("over").select("start")
    return stats.withColumn("start", F.window("occurred_at", f"{seconds} seconds")["start"]).join(over, "start", "left_anti").drop("start")
