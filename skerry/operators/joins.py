"""Validation and enrichment joins. Prefix containment becomes an equality of masked networks, so that Spark can hash or broadcast it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.functions import prefixes as P
from skerry.functions import scalars as X


def covering(inner: DataFrame, outer: DataFrame, inner_prefix: str = "prefix", how: str = "left") -> DataFrame:
    """inner's rows with those of outer (o_family, o_net, o_len and others) whose network holds their prefix, or with nulls.

    Each distinct inner prefix makes one key for each length that any outer network has, at most its own: 33 for IPv4 and 129 for IPv6, however many networks there are.
    """
    lengths = F.broadcast(outer.select("o_family", "o_len").distinct())  # 162 rows at most
    keys = inner.select(inner_prefix).distinct().withColumns({"__n4": P.v4_number(inner_prefix), "__len": P.prefix_length(inner_prefix)})
    keys = keys.withColumn("o_family", F.when(F.col("__n4").isNotNull(), 4).when(F.col(inner_prefix).contains(":"), 6)).join(lengths, "o_family")
    keys = keys.where(F.col("o_len") <= F.coalesce("__len", F.when(F.col("o_family") == 4, 32).otherwise(128)))
    net = F.when(F.col("o_family") == 4, F.lpad(P.v4_mask(F.col("__n4"), F.col("o_len")).cast("string"), 10, "0").cast("binary")).otherwise(P.v6_net(inner_prefix, "o_len"))
    found = keys.select(inner_prefix, "o_family", "o_len", net.alias("o_net")).join(outer, ["o_family", "o_len", "o_net"])
    return inner.join(found, inner_prefix, how)


def networks(df: DataFrame, prefix: str = "prefix") -> DataFrame:
    """df with o_family, o_net and o_len of a prefix column, without rows that aren't one."""
    four = P.v4_number(prefix).isNotNull()
    size = F.coalesce(P.prefix_length(prefix), F.when(four, 32).otherwise(128))
    net = F.when(four, F.lpad(P.v4_net(prefix).cast("string"), 10, "0").cast("binary"))
    out = df.withColumns({"o_family": F.when(four, 4).when(F.col(prefix).contains(":"), 6), "o_len": size})
    return out.withColumn("o_net", F.when(F.col("o_family") == 4, net).when(F.col("o_family") == 6, P.v6_net(prefix, "o_len"))).where("o_net IS NOT NULL")


def covering_keys(df: DataFrame, prefix: str = "prefix") -> DataFrame:
    """df with a row for each network (o_family, o_len, o_net) that holds its prefix: 33 for an IPv4 prefix at most, 129 for an IPv6 one."""
    four = P.v4_number(prefix)
    own = F.coalesce(P.prefix_length(prefix), F.when(four.isNotNull(), 32).otherwise(128))
    keys = df.withColumns({"__n4": four, "__own": own}).withColumn("o_family", F.when(F.col("__n4").isNotNull(), 4).when(F.col(prefix).contains(":"), 6)).where("o_family IS NOT NULL AND __own >= 0")
    keys = keys.withColumn("o_len", F.explode(F.sequence(F.lit(0), F.col("__own"))))
    net = F.when(F.col("o_family") == 4, F.lpad(P.v4_mask(F.col("__n4"), F.col("o_len")).cast("string"), 10, "0").cast("binary")).otherwise(P.v6_net(prefix, "o_len"))
    return keys.withColumn("o_net", net).drop("__n4", "__own")


def validate_origins(routes: DataFrame, vrps: DataFrame, origin: Column | None = None) -> DataFrame:
    """Routes with rpki_validity (valid, invalid, not-found) and more_specific: valid by an authorisation of a shorter prefix.

    vrps has prefix, max_len and origin_asn. A route is valid if an authorisation that covers its prefix has its origin and allows its length, invalid if others cover it alone. Each
    (prefix, origin) is validated once, however many events have it, by the networks that hold its prefix; authorisations are read once.
    """
    routes = routes.withColumn("origin_asn", X.origin_asn("as_path") if origin is None else origin)
    outer = networks(vrps).select("o_family", "o_net", "o_len", "max_len", F.col("origin_asn").alias("v_asn"))
    pairs = routes.select("prefix", "origin_asn").distinct()
    hit = covering_keys(pairs).join(outer, ["o_family", "o_len", "o_net"])
    size = P.prefix_length("prefix")
    ok = (F.col("v_asn") == F.col("origin_asn")) & (size <= F.col("max_len")) & (F.col("v_asn") != 0)
    judged = hit.groupBy("prefix", "origin_asn").agg(F.max(F.coalesce(ok, F.lit(False))).alias("valid"), F.max(F.coalesce(ok & (F.col("o_len") < size), F.lit(False))).alias("more_specific"))
    r, j = routes.alias("r"), judged.withColumnRenamed("origin_asn", "__o").alias("j")
    verdict = F.when(F.col("valid"), "valid").when(F.col("r.prefix").isNotNull(), F.when(F.col("valid").isNull(), "not-found").otherwise("invalid"))
    return r.join(j, (F.col("r.prefix") == F.col("j.prefix")) & F.col("r.origin_asn").eqNullSafe(F.col("j.__o")), "left").select("r.*", verdict.alias("rpki_validity"), F.coalesce("more_specific", F.lit(False)).alias("more_specific"))


def validate_paths(routes: DataFrame, aspa: DataFrame, id_col: str = "event_id") -> DataFrame:
    """Id, verdict (valid, invalid, unknown) and the first violated hop (customer, provider) of each route.

    In the path without repeats, each AS should be a provider of the next one. The first hop from the receiver whose customer has records without that provider is the
    violation. Without one a path is valid if every customer has records, else unknown, as is an empty path; a single AS is valid.
    """
    path = routes.select(id_col, X.collapse(X.asns("as_path")).alias("asns"))
    hops = path.select(id_col, F.posexplode(X.pairs_of(F.col("asns"))).alias("pos", "hop")).select(id_col, "pos", F.col("hop.b").alias("customer"), F.col("hop.a").alias("provider"))
    known = aspa.groupBy(F.col("customer_asn").alias("customer")).agg(F.collect_set("provider_asn").alias("providers"))
    judged = hops.join(known, "customer", "left").withColumn("state", F.when(F.col("providers").isNull(), 1).when(F.array_contains("providers", F.col("provider")), 0).otherwise(2))
    folded = judged.groupBy(id_col).agg(F.max("state").alias("worst"), F.min(F.when(F.col("state") == 2, F.struct("pos", "customer", "provider"))).alias("bad"))
    out = path.join(folded, id_col, "left")
    verdict = F.when(F.size("asns") == 0, "unknown").when(F.col("worst") == 2, "invalid").when(F.col("worst") == 1, "unknown").otherwise("valid")
    return out.select(id_col, verdict.alias("verdict"), F.col("bad.customer").alias("bad_customer"), F.col("bad.provider").alias("bad_provider"))


def key_coverage(signed: DataFrame, keys: DataFrame, id_col: str = "event_id") -> DataFrame:
    """Whether every signer of a path (an array signers of AS numbers, null if unsigned) has a router key (asn): absent, malformed (no signers), not_found with the first AS that lacks one, or valid."""
    one = signed.select(id_col, F.posexplode("signers").alias("pos", "asn"))
    missing = one.join(keys.select("asn").distinct(), "asn", "left_anti").groupBy(id_col).agg(F.min_by("asn", "pos").alias("first_missing"))
    verdict = F.when(F.col("signers").isNull(), "absent").when(F.size("signers") == 0, "malformed").when(F.col("first_missing").isNotNull(), "not_found").otherwise("valid")
    return signed.join(missing, id_col, "left").select(id_col, verdict.alias("verdict"), "first_missing")


def registry_check(routes: DataFrame, registry: DataFrame) -> DataFrame:
    """(prefix, origin) pairs against registered ones: match, mismatch (other origins registered) or not_found."""
    pairs = routes.select("prefix", X.origin_asn("as_path").alias("origin_asn")).where("origin_asn IS NOT NULL").distinct()
    reg = registry.select("prefix", F.col("origin_asn").alias("r_asn")).distinct()
    out = pairs.join(reg, "prefix", "left").groupBy("prefix", "origin_asn").agg(F.max(F.when(F.col("r_asn").isNull(), 0).when(F.col("r_asn") == F.col("origin_asn"), 2).otherwise(1)).alias("level"))
    return out.select("prefix", "origin_asn", F.when(F.col("level") == 2, "match").when(F.col("level") == 1, "mismatch").otherwise("not_found").alias("status"))


def open_changes(events: DataFrame, changes: DataFrame, pad_hours: int = 0, bucket_s: int = 86400) -> DataFrame:
    """Change records (change_id, speaker_addr, state, start_at, end_at) in state 2 that were open at an event's time, give or take pad_hours.

    An interval join by time buckets: a change stands in every bucket that it touches, an event in its own.
    """
    pad = pad_hours * 3600
    c = changes.where("state = 2").withColumns({"lo": F.col("start_at").cast("bigint") - pad, "hi": F.col("end_at").cast("bigint") + pad}).where("lo <= hi")
    c = c.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("lo") / bucket_s), F.floor(F.col("hi") / bucket_s)))).select("change_id", "speaker_addr", "lo", "hi", "bucket")
    e = events.withColumn("at", F.col("occurred_at").cast("bigint")).withColumn("bucket", F.floor(F.col("at") / bucket_s))
    return e.join(c, ["speaker_addr", "bucket"]).where(F.col("at").between(F.col("lo"), F.col("hi"))).drop("at", "lo", "hi", "bucket")


def visibility_gaps(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """Where current internal routes (prefix, origin_asn, validity) and external ones (prefix, origin_asn, peers_seeing, peers_total) differ: only_internal, only_external, origin_mismatch, low_visibility (under half of the peers)."""
    i = inner.groupBy("prefix").agg(F.sort_array(F.collect_set("origin_asn")).alias("internal"))
    o = outer.groupBy("prefix").agg(F.sort_array(F.collect_set("origin_asn")).alias("external"), F.max("peers_seeing").alias("seeing"), F.max("peers_total").alias("total"))
    j = i.join(o, "prefix", "full")
    strange = F.array_except("external", "internal")
    rules = F.array_compact(F.array(F.when(F.col("external").isNull(), "only_internal"), F.when(F.col("internal").isNull(), "only_external"), F.when(F.col("internal").isNotNull() & (F.size(strange) > 0), "origin_mismatch"), F.when(F.col("seeing") * 2 < F.col("total"), "low_visibility")))
    return j.withColumn("rule", F.explode(rules)).select("prefix", "rule", "internal", "external")


def sub_prefixes(routes: DataFrame) -> DataFrame:
    """M7: distinct prefixes that lie in a shorter one that is routed too, with the longest such."""
    p = routes.select("prefix").distinct()
    outer = networks(p.select(F.col("prefix").alias("parent")), "parent")
    hit = covering(p, outer, how="inner").where(F.col("o_len") < P.prefix_length("prefix"))
    return hit.groupBy("prefix").agg(F.max_by("parent", F.struct("o_len", "parent")).alias("parent"))


def policy_conflicts(routes: DataFrame, clauses: DataFrame) -> DataFrame:
    """Policy clauses (policy, seq, action, prefix, community, local_pref) against current routes (prefix, communities, local_pref): leaked (a deny clause's network holds a route), blocked
    (no route in a permit clause's network), community_mismatch and local_pref_drift (a permit clause sets what its routes don't have)."""
    outer = networks(clauses.select(F.col("prefix").alias("clause_prefix"), "policy", "seq", F.col("action").alias("term"), F.col("community").alias("want_community"), F.col("local_pref").alias("want_pref")), "clause_prefix")
    hit = covering(routes, outer, how="inner")
    has = F.array_contains(X.tokens("communities", ","), F.col("want_community"))
    kinds = F.array_compact(F.array(F.when(F.col("term") == "deny", "leaked"), F.when((F.col("term") == "permit") & F.col("want_community").isNotNull() & ~has, "community_mismatch"), F.when((F.col("term") == "permit") & F.col("want_pref").isNotNull() & ~F.col("want_pref").eqNullSafe(F.col("local_pref")), "local_pref_drift")))
    found = hit.withColumn("kind", F.explode(kinds)).select("policy", "seq", "clause_prefix", "prefix", "kind")
    permits = outer.where("term = 'permit'").select("policy", "seq", "clause_prefix")
    blocked = permits.join(hit.select("policy", "seq").distinct(), ["policy", "seq"], "left_anti").select("policy", "seq", "clause_prefix", F.lit(None).cast("string").alias("prefix"), F.lit("blocked").alias("kind"))
    return found.unionByName(blocked)


def dossier(routes: DataFrame, registry: DataFrame, asn_info: DataFrame, fallback: DataFrame) -> DataFrame:
    """Every announced (prefix, origin) with its registry objects, the origin's name from asn_info or else fallback, and the peers that see it."""
    seen = routes.where("action = 'announce'").select("prefix", X.origin_asn("as_path").alias("origin_asn"), "peer_addr").where("origin_asn IS NOT NULL")
    base = seen.groupBy("prefix", "origin_asn").agg(F.countDistinct("peer_addr").alias("peers"))
    reg = registry.groupBy("prefix", "origin_asn").agg(F.sort_array(F.collect_set("source")).alias("sources"))
    names = lambda df, c: df.groupBy(F.col("asn").alias("origin_asn")).agg(F.min("name").alias(c))
    out = base.join(reg, ["prefix", "origin_asn"], "left").join(names(asn_info, "n1"), "origin_asn", "left").join(names(fallback, "n2"), "origin_asn", "left")
    return out.select("prefix", "origin_asn", "peers", F.coalesce("sources", F.array().cast("array<string>")).alias("sources"), F.coalesce("n1", "n2").alias("as_name"))


def expand_sets(members: DataFrame, depth: int = 2) -> DataFrame:
    """AS numbers of each set (set_name, member), through nested sets to a depth; a set in itself adds nothing."""
    names = members.select("set_name").distinct()
    walk = members.select("set_name", "member").distinct()
    out = walk
    for _ in range(depth):
        walk = walk.join(members.select(F.col("set_name").alias("member"), F.col("member").alias("next")), "member").select("set_name", F.col("next").alias("member")).distinct()
        out = out.unionByName(walk)
    asn = F.regexp_extract("member", r"(?i)^AS([0-9]+)$", 1).try_cast("bigint")
    return out.distinct().join(names.withColumnRenamed("set_name", "member"), "member", "left_anti").select("set_name", asn.alias("asn")).where("asn IS NOT NULL").distinct()
