"""Route policy as generated CASE columns: ordered rules, a default policy, what-if runs and advice."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.functions import prefixes as P
from skerry.functions import scalars as X

#: Networks that no route should be in.
BOGONS = ["10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "192.0.2.0/24", "198.51.100.0/24", "203.0.113.0/24", "0.0.0.0/8", "240.0.0.0/4", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "198.18.0.0/15"]


def context(routes: DataFrame) -> DataFrame:
    """routes with the columns that rules and expressions use. Missing local_pref and med stay null here: see expression and Rule for their defaults."""
    have = set(routes.columns)
    opt = lambda c, t: F.col(c).cast(t) if c in have else F.lit(None).cast(t)
    return routes.withColumns({
        "prefix_len": P.prefix_length("prefix"), "net4": P.v4_number("prefix"), "asns": X.asns("as_path"), "origin_as": X.origin_asn("as_path", "integer"), "first_as": X.first_asn("as_path"), "path_len": F.coalesce("as_path_len", F.size(X.asns("as_path"))),
        "has_prepend": X.has_prepending("as_path"), "has_loop": X.has_loop("as_path"), "community_list": X.tokens("communities", ","), "rib": X.rib_type_normal("rib_type"), "rpki": F.coalesce(X.validity_normal(opt("rpki_validity", "string")), F.lit("not-found")), "aspa": F.coalesce(opt("aspa_verdict", "string"), F.lit("unknown")), "otc": F.coalesce(opt("only_to_customer", "bigint"), F.lit(0)),
    })


def prefix_in_range(network: str, lenient: bool = False) -> Column:
    """the route lies in an IPv4 network; lenient only looks at its address."""
    base, _, n = network.partition("/")
    a, b, c, d = map(int, base.split("."))
    size = int(n or 32)
    lo = (a << 24 | b << 16 | c << 8 | d) >> (32 - size) << (32 - size)
    inside = F.col("net4").between(lo, lo + (1 << (32 - size)) - 1)
    return F.coalesce(inside if lenient else inside & (F.coalesce("prefix_len", F.lit(32)) >= size), F.lit(False))


def community_has(community: str) -> Column:
    return F.array_contains("community_list", community)


def as_path_contains(asn: int) -> Column:
    return F.array_contains("asns", F.lit(asn).cast("bigint"))


def expression(text: str) -> Column:
    """a Spark SQL condition over context's columns, with local_pref 100 and med 0 where missing; null counts as false."""
    return F.coalesce(F.expr(text.replace("local_pref", "coalesce(local_pref, 100)").replace("med ", "coalesce(med, 0) ")), F.lit(False))


@dataclass
class Rule:
    """criteria of one rule, all of which must hold; those left out always do. A missing local_pref or med counts as 0."""

    name: str
    action: str  # accept, deny or tag
    prefix_list: list[str] = field(default_factory=list)
    peer_as_list: list[int] = field(default_factory=list)
    peer_addr_list: list[str] = field(default_factory=list)
    community_list: list[str] = field(default_factory=list)
    as_path_contains: list[int] = field(default_factory=list)
    local_pref_min: int | None = None
    local_pref_max: int | None = None
    med_max: int | None = None
    when: str | Column | None = None
    lenient: bool = False

    def matches(self) -> Column:
        ok = F.lit(True)
        if self.prefix_list:
            any_of = F.lit(False)
            for p in self.prefix_list:
                any_of = any_of | prefix_in_range(p, self.lenient)
            ok = ok & any_of
        if self.peer_as_list:
            ok = ok & F.col("peer_as").isin(self.peer_as_list)
        if self.peer_addr_list:
            ok = ok & F.col("peer_addr").isin(self.peer_addr_list)
        if self.community_list:
            ok = ok & F.arrays_overlap("community_list", F.array(*map(F.lit, self.community_list)))
        for asn in self.as_path_contains:
            ok = ok & as_path_contains(asn)
        pref, med = F.coalesce("local_pref", F.lit(0)), F.coalesce("med", F.lit(0))
        if self.local_pref_min is not None:
            ok = ok & (pref >= self.local_pref_min)
        if self.local_pref_max is not None:
            ok = ok & (pref <= self.local_pref_max)
        if self.med_max is not None:
            ok = ok & (med <= self.med_max)
        if self.when is not None:
            ok = ok & (expression(self.when) if isinstance(self.when, str) else F.coalesce(self.when, F.lit(False)))
        return F.coalesce(ok, F.lit(False))


def apply_rules(routes: DataFrame, rules: list[Rule], default: str = "accept") -> DataFrame:
    """routes (or candidate ones) with verdict and matched_rule of the first rule that matches; tag accepts. Without a match the default and null."""
    ctx = context(routes)
    verdict, name = F.lit(default), F.lit(None).cast("string")
    for r in reversed(rules):
        hit = r.matches()
        verdict = F.when(hit, "deny" if r.action == "deny" else "accept").otherwise(verdict)
        name = F.when(hit, r.name).otherwise(name)
    return ctx.withColumns({"verdict": verdict, "matched_rule": name}).select(*routes.columns, "verdict", "matched_rule")


def default_rules() -> list[Rule]:
    """withdrawals pass; empty paths, bogons, invalid routes longer than /24, leaks outbound, routes with an invalid path and blackholes are denied."""
    col = F.col
    return [
        Rule("withdraw", "accept", when=col("action") == "withdraw"), Rule("empty-path", "deny", when=(F.coalesce("path_len", F.lit(0)) == 0) & (col("rib") == "AdjRibInPrePolicy")), Rule("bogon", "deny", prefix_list=BOGONS), Rule("hijack", "deny", when=(col("rpki") == "invalid") & (col("prefix_len") > 24)),
        Rule("leak", "deny", when=(col("otc") > 0) & (col("rib") == "AdjRibOutPrePolicy")), Rule("aspa", "deny", when=(col("aspa") == "invalid") & (col("rib") == "AdjRibInPrePolicy")), Rule("blackhole", "deny", community_list=["65535:666"]),
    ]


def verdict_counts(judged: DataFrame) -> DataFrame:
    """A17."""
    return judged.groupBy("verdict").agg(F.count("*").alias("routes"))


#: Communities that ask for a blackhole.
BLACKHOLES = ["65535:666", "65535:0", "0:666"]


def _private() -> Column:
    return F.filter("asns", lambda a: X.is_private_asn(a))


def advise(judged: DataFrame, known_communities: list[str] = ()) -> DataFrame:
    """routes (with verdict accept, deny or fall_through) that the policy may judge wrongly: kind, confidence and evidence, most confident first by `confidence`."""
    c = context(judged)
    private = F.size(_private()) > 0
    aspa, rpki, path = F.col("aspa"), F.col("rpki"), F.col("path_len")
    against = [(rpki == "invalid", 0.95, "origin invalid"), (aspa == "invalid", 0.90, "path invalid"), (private & (rpki != "valid"), 0.75, "private AS in path"), (path > 25, 0.60, "very long path")]
    known = F.arrays_overlap("community_list", F.array(*map(F.lit, known_communities)).cast("array<string>"))
    pro = [(rpki == "valid", 0.80, "origin valid"), (known, 0.65, "known communities")]
    said = lambda rules: F.array_compact(F.array(*(F.when(k, t) for k, _, t in rules)))
    level = lambda rules: F.greatest(*(F.when(k, F.lit(v)).otherwise(0.0) for k, v, _ in rules))
    up = F.when((aspa == "valid") & (rpki == "valid"), F.least(level(pro) + 0.10, F.lit(0.95))).otherwise(level(pro))
    v = F.col("verdict")
    kind = F.when((v == "accept") & (F.size(said(against)) > 0), "should_reject").when(v.isin("deny", "reject") & (F.size(said(pro)) > 0), "should_accept").when(v == "fall_through", "fall_through")
    out = c.withColumn("kind", kind).where("kind IS NOT NULL")
    k = F.col("kind")
    return out.withColumns({"confidence": F.round(F.when(k == "should_reject", level(against)).when(k == "should_accept", up).otherwise(0.5), 2), "evidence": F.concat_ws("; ", F.when(k == "should_reject", said(against)).when(k == "should_accept", said(pro)).otherwise(F.array(F.lit("no rule matched"))))}).select(*judged.columns, "kind", "confidence", "evidence")


def explain(routes: DataFrame) -> DataFrame:
    """F8: routes with the reasons for which they may have been rejected."""
    c = context(routes)
    reasons = F.concat_ws("; ", F.when(F.col("rpki") == "invalid", "origin is invalid"), F.when(F.col("aspa") == "invalid", "path fails the provider check"), F.when(F.size(_private()) > 0, F.concat(F.lit("private AS in path: "), F.array_join(_private().cast("array<string>"), ","))), F.when(F.col("path_len") > 20, F.concat(F.lit("path of "), F.col("path_len").cast("string"), F.lit(" hops"))), F.when(F.arrays_overlap("community_list", F.array(*map(F.lit, BLACKHOLES))), "blackhole community"), F.when(F.col("local_pref") == 0, "local preference 0"))
    return c.withColumn("reason", F.when(reasons == "", "no rule matched; denied by default").otherwise(reasons)).select(*routes.columns, "reason")


def clauses(configs: DataFrame, *also: str) -> DataFrame:
    """one row per clause of policy_configs.clauses_json, in order of seq; with other columns of the configs."""
    kind = "array<struct<seq:int,action:string,match:struct<prefix:string,community:string,as_path:string>,set:struct<local_pref:bigint,med:bigint,community:string>>>"
    one = configs.withColumn("c", F.explode(F.from_json("clauses_json", kind)))
    return one.select(*also, "peer_addr", "policy_name", "direction", F.col("c.seq").alias("seq"), F.col("c.action").alias("action"), F.col("c.match.prefix").alias("prefix"), F.col("c.match.community").alias("match_community"), F.col("c.set.local_pref").alias("local_pref"), F.col("c.set.med").alias("med"), F.col("c.set.community").alias("community"))
