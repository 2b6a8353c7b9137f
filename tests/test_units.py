"""Operators on literal rows whose results are known."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skerry.functions import prefixes as P
from skerry.functions import scalars as X
from skerry.operators import aggregates, detectors, graph, joins, ml, policy, scan, state, windows
from skerry.sources import schemas, tables
from skerry.streaming import streams
from tests.conftest import SF


def at(seconds: float) -> dt.datetime:
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


def one(spark, expr, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return df.select(expr).first()[0]


@pytest.mark.parametrize("path,origin,hops,prepend,loop", [("64500 64501 64502", 64502, 3, False, False), ("64500 64500 64501", 64501, 3, True, False), ("1 2 1", 1, 3, False, True), ("", None, 0, False, False), (None, None, 0, False, False), ("1 {2,3}", 3, 1, False, False)])
def test_paths(spark, path, origin, hops, prepend, loop):
    df = spark.createDataFrame([(path,)], "p string")
    assert tuple(df.select(X.origin_asn("p", "integer"), X.hop_count("p"), X.has_prepending("p"), X.has_loop("p")).first()) == (origin, hops, prepend, loop)


def test_texts(spark):
    assert one(spark, X.community_name(F.lit(0xFFFFFF01))) == "NO_EXPORT" and one(spark, X.community_name(F.lit(65000 * 65536 + 100))) == "65000:100"
    assert one(spark, X.ext_community_text(F.lit("0002fde800000064"))) == "rt:65000:100" and one(spark, X.ext_community_text(F.lit("0102c00002010064"))) == "rt:192.0.2.1:100"
    assert one(spark, X.ext_community_text(F.lit("030b000000000064"))) == "color:100" and one(spark, X.ext_community_kind(F.lit("0003000000000001"))) == "route-origin-soo"
    assert one(spark, X.rd_text(F.lit("0000fde800000064"))) == "65000:100" and one(spark, X.rd_text(F.lit("0001c00002010064"))) == "192.0.2.1:100" and one(spark, X.rd_text(F.lit("00020000fde80064"))) == "65000:100"
    assert one(spark, X.counter_name(F.lit(11))) == "adj-rib-in-routes" and one(spark, X.counter_name(F.lit(99))) == "unknown" and len(X.COUNTERS) == 39
    assert [one(spark, X.rib_type(F.lit(t), F.lit(f))) for t, f in ((0, 0), (0, 0x40), (0, 0x10), (0, 0x50), (3, 0))] == ["AdjRibInPrePolicy", "AdjRibInPostPolicy", "AdjRibOutPrePolicy", "AdjRibOutPostPolicy", "LocRib"]
    assert [one(spark, X.status_label(F.lit(s))) for s in (0x2, 0x10, 0x100, 0x0A, 0x400, 0)] == ["best", "backup", "filtered-inbound", "best", "stale", "unknown"] and one(spark, X.reason_label(F.lit(6))) == "not preferred: MED"
    assert one(spark, X.afi_normal(F.lit("1"))) == "ipv4-unicast" and one(spark, X.rib_type_normal(F.lit("adj-rib-in-pre"))) == "AdjRibInPrePolicy"
    assert one(spark, X.list_length(F.lit(""))) == 0 and one(spark, X.is_private_asn(F.lit(64512))) and not one(spark, X.is_private_asn(F.lit(65535)))
    assert one(spark, P.v4_net(F.lit("10.1.2.3/8"))) == 10 << 24 and one(spark, P.v4_number(F.lit("256.1.1.1"))) is None


def test_ipv6(spark):
    import ipaddress

    texts = ["2001:db8::/32", "::/0", "::1", "2001:db8:1:2:3:4:5:6/77", "fe80::1:2/65", "1::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::/3", "x::1", "1:::2", "1:2:3", ":1::2", "::1:", "12345::", "10.0.0.0/8", "", "1::2::3", "ABCD::/16"]
    for n in (0, 1, 2, 3, 5, 13, 32, 64, 65, 77, 128):
        got = spark.createDataFrame([(t, n) for t in texts], "t string, n int").select("t", P.v6_net("t", "n").alias("net")).collect()
        for r in got:
            try:
                net = ipaddress.IPv6Network(r.t, strict=False)
                want = ipaddress.IPv6Network((int(net.network_address) >> (128 - n) << (128 - n) if n else 0, n)).network_address.packed if n <= net.prefixlen else None
            except ValueError:
                want = None
            assert (bytes(r.net) if r.net is not None else None) == want, (r.t, n)


VRPS = [("192.0.2.0/24", 24, 64496), ("10.0.0.0/8", 16, 64500), ("10.0.0.0/8", 24, 64501), ("2001:db8::/32", 48, 64496), ("198.51.100.0/25", 25, 64496)]


@pytest.mark.parametrize("prefix,origin,verdict", [("192.0.2.0/24", 64496, "valid"), ("192.0.2.0/24", 64497, "invalid"), ("192.0.2.0/25", 64496, "invalid"), ("203.0.113.0/24", 64496, "not-found"), ("10.1.0.0/16", 64500, "valid"), ("10.1.1.0/24", 64500, "invalid"), ("10.1.1.0/24", 64501, "valid"), ("2001:db8:1::/48", 64496, "valid"), ("2001:db8:1:1::/64", 64496, "invalid"), ("2001:db9::/32", 64496, "not-found"), ("198.51.100.0/24", 64496, "not-found")])
def test_validity(spark, prefix, origin, verdict):
    routes = spark.createDataFrame([(prefix, str(origin))], "prefix string, as_path string")
    out = joins.validate_origins(routes, spark.createDataFrame(VRPS, "prefix string, max_len int, origin_asn bigint")).first()
    assert out.rpki_validity == verdict and out.more_specific == (verdict == "valid" and prefix != "192.0.2.0/24")


def test_path_verdicts(spark):
    aspa = spark.createDataFrame([(64501, 64500), (64502, 64501)], "customer_asn bigint, provider_asn bigint")
    cases = {1: ("64500 64501 64502", "valid", None), 2: ("64500 64502", "invalid", (64502, 64500)), 3: ("64500 64501 64501 64502", "valid", None), 4: ("", "unknown", None), 5: ("64500 64501 64599", "unknown", None), 6: ("64500", "valid", None), 7: ("1 2", "unknown", None)}
    got = {r.event_id: r for r in joins.validate_paths(spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "event_id int, as_path string"), aspa).collect()}
    for k, (_, verdict, bad) in cases.items():
        assert got[k].verdict == verdict and (bad is None or (got[k].bad_customer, got[k].bad_provider) == bad)


ROUTE = dict(event_id=1, prefix="10.0.0.0/24", peer_addr="p", peer_as=64500, rib_type="pre-policy", action="announce", as_path="1 2 3 64496", as_path_len=4, local_pref=150, med=50, communities="65000:100", rpki_validity="invalid")


def test_rules(spark):
    r = spark.createDataFrame([tuple(ROUTE.values())], "event_id int, prefix string, peer_addr string, peer_as bigint, rib_type string, action string, as_path string, as_path_len int, local_pref bigint, med bigint, communities string, rpki_validity string")
    first = lambda rules, default="accept": tuple(policy.apply_rules(r, rules, default).select("verdict", "matched_rule").first())
    assert first([]) == ("accept", None) and first([], "deny") == ("deny", None) and first(policy.default_rules()) == ("deny", "bogon")
    assert first([policy.Rule("a", "accept", peer_as_list=[64500]), policy.Rule("b", "deny")]) == ("accept", "a")
    assert first([policy.Rule("c", "deny", community_list=["1:1"]), policy.Rule("d", "tag", local_pref_min=100, local_pref_max=200)]) == ("accept", "d")
    for text, ok in {"prefix_len > 24": False, "prefix_len = 24 AND path_len >= 4": True, "origin_as = 64496": True, "rpki = 'invalid'": True, "local_pref = 150": True, "array_contains(community_list, '65000:100')": True, "NOT has_prepend": True, "peer_as IN (1, 2)": False}.items():
        assert (first([policy.Rule("e", "deny", when=text)])[0] == "deny") == ok, text
    out = policy.advise(r.withColumn("verdict", F.lit("accept"))).first()
    assert (out.kind, out.confidence) == ("should_reject", 0.95) and policy.explain(r).first().reason == "origin is invalid"


def stream_of(spark, df, path):
    df.repartition(1).write.mode("overwrite").parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def drain(spark, df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def episode_fold(rows, quiet_s, least, end_stats, until=None):
    """Convergence episodes in one peer's events (micros, kind, prefix, stat type, value) in order, one event after another: (start, end, withdraws, affected, recovered, ended by)."""
    out, at_ = [], None
    for t, kind, prefix, stat, value in rows:
        if at_ and at_["n"] >= least and t - at_["last"] >= quiet_s * 1e6:
            out.append((at_["start"], int(at_["last"] + quiet_s * 1e6), at_["n"], len(at_["hit"]), len(at_["back"]), "quiet"))
            at_ = None
        if kind == "peer_down":
            at_ = {"start": t, "last": t, "n": 0, "hit": set(), "back": set()}
        elif at_ and kind in ("withdraw", "announce"):
            at_["hit"].add(prefix)
            at_["last"] = t
            at_["n"] += kind == "withdraw"
            (at_["back"].discard if kind == "withdraw" else at_["back"].add)(prefix)
        elif at_ and (kind == "peer_up" or kind == "stat" and stat in end_stats and value == 0):
            out.append((at_["start"], t, at_["n"], len(at_["hit"]), len(at_["back"]), kind))
            at_ = None
    return out


def test_episodes_equal_fold(spark):
    """Random histories, declared and folded: with quiet ends before an event, before the next down, and none at the end of the history."""
    rng = random.Random(6)
    base = "event_id int, occurred_at timestamp, speaker_addr string, peer_addr string, "
    rows = []
    for i in range(900):
        rows.append((i, at(0.5 * rng.randint(0, 4000)), "s", f"p{i % 5}", rng.choice(["peer_down", "peer_up", "withdraw", "withdraw", "announce", "stat"]), rng.choice("abc"), rng.choice([7, 8, 9]), rng.choice([0, 0, 5])))
    rows.sort(key=lambda r: (r[1], r[0]))
    peers = spark.createDataFrame([r[:5] for r in rows if r[4].startswith("peer")], base + "event_type string")
    routes = spark.createDataFrame([r[:6] for r in rows if r[4] in ("withdraw", "announce")], base + "action string, prefix string")
    stats = spark.createDataFrame([(*r[:4], *r[6:]) for r in rows if r[4] == "stat"], base + "stat_type int, counter_value bigint")
    want = set()
    micros = lambda t: int((t - at(0)).total_seconds() * 1e6)
    for p in {r[3] for r in rows}:
        want |= {(p, *e) for e in episode_fold([(micros(r[1]), r[4], r[5], r[6], r[7]) for r in rows if r[3] == p], 5.0, 1, (7, 8))}
    got = {(r.peer_addr, micros(r.started_at), micros(r.eor_at), r.withdraws, r.affected_prefixes, r.recovered_prefixes, r.ended_by) for r in detectors.convergence_events(peers, routes, stats).collect()}
    assert got == want and {w[-1] for w in want} == {"quiet", "peer_up", "stat"}
    sliced = {(r.peer_addr, micros(r.started_at), micros(r.eor_at), r.withdraws, r.affected_prefixes, r.recovered_prefixes, r.ended_by) for r in detectors.convergence_events(peers, routes, stats, slice_s=7).collect()}
    assert sliced == want


def test_unsettled_paths(spark):
    links = spark.createDataFrame([(str(i), str(i + 1), 1) for i in range(5)], "local_router_id string, remote_router_id string, igp_metric bigint")
    with pytest.raises(RuntimeError):
        graph.shortest_paths(links, spark.createDataFrame([("0",)], "router_id string"), max_rounds=3).count()
    assert graph.shortest_paths(links, spark.createDataFrame([("0",)], "router_id string"), max_rounds=6).count() == 6


def test_shortest_paths_from_all_nodes(spark):
    """The query asks from every node that a link leaves, not from some."""
    from skerry.plans import catalogue, index

    got = {r.source for r in index.queries()["shortest_paths"](spark, SF).collect()}
    assert got == {r.local_router_id for r in catalogue.Views(spark, SF).links.collect()} and len(got) > 3


def test_windows_equal_lists(spark):
    """Oscillation, hijacks and rolling medians against lists of what each row sees, with ties of time."""
    rng = random.Random(4)
    rows = [(i, at(rng.randint(0, 200)), rng.choice("xy"), rng.choice("pq"), "announce", f"1 {64500 + rng.randint(0, 3)}", rng.choice([None, 5, 5, 7, 9])) for i in range(400)]
    routes = spark.createDataFrame(rows, "event_id bigint, occurred_at timestamp, prefix string, peer_addr string, action string, as_path string, med bigint")
    osc, hij = set(), set()
    for e, t, x, p, _, path, med in rows:
        seen = [m for u, k, m in sorted((r[1], r[0], r[6]) for r in rows if r[2] == x and r[3] == p and r[6] is not None) if (u, k) <= (t, e) and (t - u).total_seconds() <= 20]
        turns = sum((b > a) != (c > b) for a, b, c in zip(seen, seen[1:], seen[2:]))
        if med is not None and len(seen) >= 5 and len(set(seen)) >= 2 and turns >= 2:
            osc.add((e, len(seen), turns))
        known = {int(r[5].split()[1]) for r in rows if r[2] == x and 0 < (t - r[1]).total_seconds() <= 3}
        if known and int(path.split()[1]) not in known:
            hij.add((e, " ".join(map(str, sorted(known)))))
    assert {(r.event_id, r.observations, r.turns) for r in detectors.med_oscillation(routes, 20).collect()} == osc and osc
    assert {(r.event_id, r.known) for r in detectors.hijacks(routes, seconds=3).collect()} == hij and hij


def test_rolling_median_equals_lists(spark):
    """Medians of the last rows and days against lists, with ties of time, nulls, blocks and slices of a busy key, and whatever else a row has."""
    rng = random.Random(8)
    rows = [(i, at(rng.randint(0, 400) * 1800), "k" if rng.random() < 0.8 else rng.choice("xy"), rng.choice([None, 1, 2, 2, 5, 9, 40]), "kept", [i]) for i in range(900)]
    df = spark.createDataFrame(rows, "event_id bigint, occurred_at timestamp, key string, v bigint, __own string, more array<int>").withColumnRenamed("__own", "own")
    for most, days, block in ((50, 1, 50), (2000, 3, 100), (7, 100, 64)):
        got = {r.event_id: r for r in scan.rolling_median(df, "key", "v", days, most, block=block).collect()}
        assert len(got) == len(rows)
        for key in "kxy":
            own = sorted((r[1], r[0], r[3]) for r in rows if r[2] == key)
            for i, (t, e, _) in enumerate(own):
                seen = [v for u, _, v in own[max(0, i - most) : i] if u < t and (t - u).total_seconds() <= days * 86400 and v is not None]
                r = got[e]
                assert (r.prior, r["median"]) == (len(seen), float(np.median(seen)) if seen else None) and (r.own, r.more) == ("kept", [e])


def test_oscillation_of_one_instant(spark):
    """Ties are told apart, however many: each of 700 rows of one instant sees those before it."""
    rows = [(i, at(0), "x", "p", "announce", (i * 7) % 5) for i in range(700)]
    got = {r.event_id: (r.observations, r.turns) for r in detectors.med_oscillation(spark.createDataFrame(rows, "event_id bigint, occurred_at timestamp, prefix string, peer_addr string, action string, med bigint")).collect()}
    meds = [r[5] for r in rows]
    rises = [b > a for a, b in zip(meds, meds[1:])]
    turns = [0, 0, *np.cumsum([a != b for a, b in zip(rises, rises[1:])]).tolist()]
    assert got == {i: (i + 1, turns[i]) for i in range(4, 700) if turns[i] >= 2} and {497, 498, 500, 699} <= set(got)


def test_running_values_of_a_busy_key(spark):
    """Slices give what one window over the whole key does, for keys with gaps of many slices, ties and nulls; and tasks get slices of a busy key."""
    from pyspark.sql import Window

    rng = random.Random(3)
    rows = [(i, at(rng.choice([rng.randint(0, 5000), 3_000_000 + rng.randint(0, 9000)])), "hot" if rng.random() < 0.9 else f"k{i % 4}", rng.choice([None, 1, 2, 3]), rng.choice([None, None, "a", "b"])) for i in range(800)]
    df = spark.createDataFrame(rows, "event_id bigint, occurred_at timestamp, k string, v bigint, s string")
    w = Window.partitionBy("k").orderBy("occurred_at", "event_id")
    for before in (False, True):
        frame = w.rowsBetween(Window.unboundedPreceding, -1 if before else 0)
        want = df.select("event_id", F.coalesce(F.sum("v").over(frame), F.lit(0)).alias("a"), F.max("v").over(frame).alias("b"), F.first("s", ignorenulls=True).over(frame).alias("c"))
        got = scan.running(df, ["k"], {"a": ("sum", F.col("v")), "b": ("max", F.col("v")), "c": ("first", F.col("s"))}, before=before, seconds=600)
        assert got.columns == [*df.columns, "a", "b", "c"] and sorted(map(tuple, got.select("event_id", "a", "b", "c").collect())) == sorted(map(tuple, want.collect()))
    want = df.select("event_id", F.lead("v").over(w).alias("n"))
    got = scan.following(df, ["k"], "n", F.col("v"), seconds=600)
    assert sorted(map(tuple, got.select("event_id", "n").collect())) == sorted(map(tuple, want.collect()))
    largest = df.where("k = 'hot'").groupBy(scan.slice_of(600)).count().agg(F.max("count")).first()[0]
    assert largest < 0.15 * len(rows)  # of a key with nine tenths of all rows


def test_hijack_model_finds_planted(spark):
    from skerry.plans import catalogue, reports

    rows = reports.hijack_rows(catalogue.Views(spark, SF.replace("0.001", "0.01")))
    _, metrics = ml.train_hijack_model(rows)
    assert metrics["recall"] >= 0.9 and metrics["auc"] >= 0.95 and metrics["precision"] >= 0.9, metrics  # held-out rows, hijacks from usual peers over paths of usual length


def test_models_take_equal_rows_as_one(spark, monkeypatch):
    """M4, M5: rows of equal features are scored and learned once, and every row has its result: twice each row changes no prediction."""
    rng = random.Random(2)
    rows = [(i, *(rng.randint(0, k) for k in (1, 2, 1, 3, 2, 1, 4))) for i in range(400)]
    df = spark.createDataFrame(rows, "event_id bigint, " + ", ".join(f"{c} int" for c in ml.HIJACK_FEATURES)).withColumn("label", (F.col("origin_changed") + F.col("rpki") > 1).cast("int"))
    fitted, walk = [], ml._depths
    from pyspark.ml.classification import GBTClassifier

    fit = GBTClassifier.fit
    monkeypatch.setattr(GBTClassifier, "fit", lambda self, data, *a: fitted.append(data.count()) or fit(self, data, *a))
    _, metrics = ml.train_hijack_model(df.unionByName(df.withColumn("event_id", F.col("event_id"))))
    assert fitted[0] <= df.where(~ml.held_out()).select(*ml.HIJACK_FEATURES, "label").distinct().count() and metrics["recall"] > 0.9
    few = spark.createDataFrame([(i, float(i % 5), float(i % 3)) for i in range(300)], "event_id bigint, a double, b double")
    got = ml.isolation_forest(few, ("a", "b"), trees=10).collect()
    assert len(got) == 300 and len({(r.event_id % 15, r.score) for r in got}) == 15


def test_stored_anomalies_subscriptions_rates(spark, tmp_path):
    report = spark.createDataFrame([(at(0), "churn", "x", None, 3.5, "warning")], "detected_at timestamp, kind string, prefix string, peer_addr string, score double, severity string")
    tables.append_anomalies(report, str(tmp_path / "t"))
    tables.append_anomalies(report, str(tmp_path / "t"))
    assert [r.description for r in tables.read_table(spark, str(tmp_path / "t"), "ml_anomalies").collect()] == ["churn x"] * 2
    events = spark.createDataFrame([("1", at(0), "route"), ("2", at(0.5), "stats"), ("3", at(1.5), "end_of_rib")], "id string, occurred_at timestamp, kind string")
    live = stream_of(spark, events, str(tmp_path / "e"))
    assert [r.id for r in drain(spark, streams.subscribe(live, ["stats"]), "subscribed").collect()] == ["2"]
    assert [r.id for r in drain(spark, streams.end_of_rib(live), "ends").collect()] == ["3"]
    assert {(r.start, r.events, r.over) for r in drain(spark, streams.rate(live, 1), "rates", "complete").collect()} == {(at(0), 2, True), (at(1), 1, False)}


def test_episodes(spark):
    ev = lambda s, kind, prefix=None, stat=None, value=None: (int(s * 1e6), kind, prefix, stat, value)
    fold = lambda rows: episode_fold(rows, 5.0, 1, (7, 8))
    assert fold([ev(0, "withdraw", "a"), ev(1, "peer_up")]) == []
    assert fold([ev(0, "peer_down"), ev(1, "withdraw", "a"), ev(2, "withdraw", "b"), ev(3, "stat", stat=7, value=0)]) == [(0, 3_000_000, 2, 2, 0, "stat")]
    assert fold([ev(0, "peer_down"), ev(1, "withdraw", "a"), ev(2, "stat", stat=7, value=4), ev(9, "withdraw", "b")]) == [(0, 6_000_000, 1, 1, 0, "quiet")]
    assert fold([ev(0, "peer_down"), ev(9, "peer_up")]) == [(0, 9_000_000, 0, 0, 0, "peer_up")]
    assert fold([ev(0, "peer_down"), ev(1, "withdraw", "a"), ev(2, "announce", "a"), ev(3, "peer_up")])[0][4] == 1
    base = "event_id int, occurred_at timestamp, speaker_addr string, peer_addr string, "
    peers = spark.createDataFrame([(1, at(0), "s", "p", "peer_down"), (2, at(0), "s", "q", "peer_down"), (9, at(60), "s", "p", "peer_up")], base + "event_type string")
    routes = spark.createDataFrame([(3, at(1), "s", "p", "withdraw", "a"), (4, at(2), "s", "p", "announce", "b")], base + "action string, prefix string")
    stats = spark.createDataFrame([(5, at(3), "s", "q", 8, 0)], base + "stat_type int, counter_value bigint")
    got = {(r.peer_addr, r.convergence_ms, r.ended_by) for r in detectors.convergence_events(peers, routes, stats).collect()}
    assert got == {("p", 7000.0, "quiet"), ("q", 3000.0, "stat")}  # the up came long after the last route event


def test_suppression(spark):
    rows = [(at(t), i, "k", "x", "p", "warning") for i, t in enumerate([0, 100, 299, 300, 500, 700, 2000])]
    got = detectors.suppress(spark.createDataFrame(rows, "occurred_at timestamp, event_id int, kind string, prefix string, peer_addr string, severity string"))
    assert sorted(r.event_id for r in got.collect()) == [0, 3, 5, 6]


def test_oscillation(spark):
    rows = [(i, at(10 * i), "x", "p", "announce", m) for i, m in enumerate([5, 9, 5, 9, 5, 9])] + [(10 + i, at(10 * i), "y", "p", "announce", 5) for i in range(6)]
    got = detectors.med_oscillation(spark.createDataFrame(rows, "event_id int, occurred_at timestamp, prefix string, peer_addr string, action string, med bigint"))
    assert sorted(r.event_id for r in got.collect()) == [4, 5]


def test_retention_and_limits(spark):
    df = spark.createDataFrame([(1, at(0)), (2, at(99 * 86400))], "event_id int, occurred_at timestamp")
    assert [tables.retain(df, d, "2024-04-10 00:00:00").count() for d in (30, 0)] == [1, 2]
    log = spark.createDataFrame([("s", "p", "a", at(0), 10), ("s", "p", "a", at(9), 0), ("s", "p", "a", at(5), 20)], "speaker_addr string, peer_addr string, afi_safi string, updated_at timestamp, max_prefix bigint")
    assert [r.max_prefix for r in tables.upsert_limits(log).collect()] == [20]
    with pytest.raises(ValueError):
        tables.select_only(spark, "DROP TABLE x", {})


def test_vrp_dump_and_store(spark, tmp_path):
    (tmp_path / "v.json").write_text('{"roas": [{"prefix": "10.0.0.0/8", "maxLength": 16, "asn": "AS1"}, {"prefix": "10.0.0.0/8", "asn": 2}, {"prefix": "bad", "asn": "AS3"}, {"prefix": "1.0.0.0/8", "asn": "x"}]}')
    assert {tuple(r) for r in tables.load_vrps(spark, str(tmp_path / "v.json")).collect()} == {("10.0.0.0/8", 16, 1), ("10.0.0.0/8", 8, 2)}
    s = tables.DatasetStore(spark, str(tmp_path / "store"))
    for v in ("20240101T00", "20240102T00", "20240103T00"):
        s.write(spark.createDataFrame([(v,)], "v string"), v)
    assert s.versions()[0] == "20240103T00" and s.latest().first().v == "20240103T00" and s.prune(1) == ["20240102T00", "20240101T00"] and s.versions() == ["20240103T00"]


def test_capabilities_flow_rules_evpn(spark):
    peers = spark.createDataFrame([(1, at(0), "s", "p", '["Add-Path ipv4", "four-octet"]'), (2, at(0), "s", "q", None)], "event_id int, occurred_at timestamp, speaker_addr string, peer_addr string, capabilities string")
    assert {(r.peer_addr, r.add_path, r.four_byte_asn, r.llgr) for r in state.capability_flags(peers).collect()} == {("p", True, True, False), ("q", False, False, False)}
    rules = spark.createDataFrame([("dst 10.0.0.0/8 src 1.2.3.4/32",), ("dst 10.1.0.0/24",), ("",)], "summary string")
    assert [r.large_prefix for r in state.flow_rules(rules).collect()] == [True, False, False]
    nodes = spark.createDataFrame([(1, at(0), "announce", "r1", "core-1", "isis"), (2, at(1), "withdraw", "r2", "edge-1", "isis")], "event_id int, occurred_at timestamp, action string, router_id string, node_name string, protocol_id string")
    assert [tuple(r) for r in aggregates.node_tiers(nodes).collect()] == [("isis", "core", 1)] and graph.igp_nodes(nodes).count() == 1


def test_envelope_fan_out_and_streams(spark, tmp_path):
    lines = ['{"id":"1","occurred_at":"2024-01-01T00:00:00Z","speaker":"s","kind":"route","payload":{"peer_addr":"p","prefix":"10.0.0.0/8","action":"announce"}}', '{"id":"2","occurred_at":"2024-01-01T00:00:01Z","speaker":"s","kind":"stats","payload":{"peer_addr":"p","counters":[{"stat_type":7,"value":18446744073709551615},{"stat_type":11,"value":2}]}}', '{"id":"3","occurred_at":"2024-01-01T00:00:02Z","speaker":"s","kind":"evpn","payload":{"peer_addr":"p","evpn":[{"route_type":2,"mac":"aa","prefix_len":9}]}}', '{"id":"4","occurred_at":"2024-01-01T00:00:03Z","speaker":"s","kind":"peer_up","payload":{"peer_addr":"p"}}', "not json"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(lines))
    got = {k: v.collect() for k, v in tables.fan_out(tables.read_archive(spark, str(tmp_path / "in"))).items()}
    assert {k: len(v) for k, v in got.items()} == {"route_events": 1, "peer_events": 1, "speaker_events": 0, "stats_events": 2, "evpn_events": 1}
    assert {(r.counter_name, int(r.counter_value)) for r in got["stats_events"]} == {("explicit-withdraw-count", 2**64 - 1), ("adj-rib-in-routes", 2)}
    assert (got["evpn_events"][0].mac, got["evpn_events"][0].prefix_len, got["evpn_events"][0].route_type_name) == ("aa", None, "mac-ip-advertisement")
    events = streams.read_stream(spark, str(tmp_path / "in"))
    streams.store(events, str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination(120)
    assert tables.read_table(spark, str(tmp_path / "out"), "stats_events").count() == 2 and set(schemas.SCHEMAS) >= set(got)
    streams.publish_files(events, str(tmp_path / "topics"), str(tmp_path / "c2")).awaitTermination(120)
    topics = {(r.topic, r.key) for r in spark.read.json(str(tmp_path / "topics")).collect()}
    assert ("unicast_prefix", "s:p:10.0.0.0/8") in topics and ("bmp_stat", "s:p") in topics


def test_streams_equal_batches(spark, tmp_path):
    rows = [(i, at(i * 40), f"10.{i % 3}.0.0/16", f"p{i % 2}", "announce" if i % 5 else "withdraw", f"1 {64500 + (i * 7) % 4}") for i in range(60)]
    routes = spark.createDataFrame(rows, "event_id bigint, occurred_at timestamp, prefix string, peer_addr string, action string, as_path string")
    live = stream_of(spark, routes, str(tmp_path / "r"))
    hours = {(r.prefix, r.hour, r.events) for r in aggregates.hourly_churn(routes).collect()}
    assert {tuple(r) for r in drain(spark, streams.churn(live), "churn", "complete").collect()} == hours
    alerts = routes.withColumn("kind", F.lit("k"))
    assert drain(spark, streams.dedup_alerts(stream_of(spark, alerts, str(tmp_path / "a"))), "alerts").count() == 6
    assert drain(spark, streams.quiet_sessions(live, "50 seconds"), "bursts", "complete").count() >= 2


def test_ml(spark):
    f = spark.createDataFrame([(0, 1, 2, 0, 0, 1, 0, 4), (1, 1, 2, 1, -3, 2, 0, 4), (2, 0, 0, 0, 0, 0, 1, 4), (3, 1, 0, 0, 0, 0, 1, 3)], "event_id int, " + ", ".join(f"{c} int" for c in ml.HIJACK_FEATURES))
    s = {r.event_id: (r.score, r.is_hijack) for r in ml.hijack_score(f).collect()}
    assert s[0] == (0.55, True) and s[1][0] == 0.9 and s[2] == (0.0, False) and s[3][0] < 0.3
    rows = [(i, float(i % 10), float(i % 7)) for i in range(300)] + [(999, 500.0, -400.0)]
    got = {r.event_id: r for r in ml.isolation_forest(spark.createDataFrame(rows, "event_id int, a double, b double"), ("a", "b"), trees=30).collect()}
    assert got[999].anomalous and got[999].score == max(r.score for r in got.values()) and sum(r.anomalous for r in got.values()) <= 20
    ev = [(i, "65535:666", 100, "announce") for i in range(3)] + [(10 + i, "1:1", 200, "announce") for i in range(5)] + [(20 + i, "1:2", 70, "announce") for i in range(5)] + [(30 + i, "1:3", None, "withdraw") for i in range(5)] + [(40, "1:4", 200, "announce")]
    m = {r.community: r.meaning for r in ml.community_meanings(spark.createDataFrame(ev, "event_id int, communities string, local_pref bigint, action string")).collect()}
    assert m == {"65535:666": "blackhole", "1:1": "preferred path (LP=200)", "1:2": "backup path (LP=70)", "1:3": "route filter / deny"}


def test_slow_convergence(spark):
    day = 86400
    rows = [("p", at(i * 3600), 100.0) for i in range(4)] + [("p", at(5 * 3600), 350.0), ("p", at(6 * 3600), 650.0), ("q", at(0), 900.0), ("p", at(20 * day), 900.0)]
    got = {(r.peer_addr, r.convergence_ms, r.severity) for r in detectors.slow_convergence(spark.createDataFrame(rows, "peer_addr string, started_at timestamp, convergence_ms double")).collect()}
    assert got == {("p", 350.0, "warning"), ("p", 650.0, "critical")}


def test_empty_history(spark):
    e = spark.createDataFrame([], "event_id bigint, occurred_at timestamp, speaker_addr string, peer_addr string, prefix string, action string, as_path string, as_path_len int, event_type string")
    assert windows.sessions(e).count() == 0 and detectors.hijacks(e).count() == 0 and graph.path_edges(e).count() == 0 and state.peer_state(e, "2024-01-01").count() == 0


def test_canned_questions(spark):
    from skerry.operators import canned

    r = spark.createDataFrame([(1, at(0), "x", "p", "announce", "1 2", 2, "1:1", "invalid", None), (2, at(1), "x", "p", "withdraw", None, None, None, None, None)], "event_id bigint, occurred_at timestamp, prefix string, peer_addr string, action string, as_path string, as_path_len int, communities string, rpki_validity string, only_to_customer bigint")
    p = spark.createDataFrame([(i, at(i), "p", "peer_down") for i in range(6)], "event_id bigint, occurred_at timestamp, peer_addr string, event_type string")
    a = spark.createDataFrame([(at(0), "k", 0.5)], "detected_at timestamp, kind string, score double")
    c = spark.createDataFrame([("p", at(0), 5.0)], "peer_addr string, started_at timestamp, convergence_ms double")
    t = {"route_events": r, "peer_events": p, "ml_anomalies": a, "convergence_events": c}
    assert {q: canned.ask(q, t).count() for q in canned.QUESTIONS} == {"top_announced": 1, "top_withdrawn": 1, "churn": 1, "peer_downs": 1, "peer_ups": 0, "invalids": 1, "anomalies": 1, "communities": 1, "longest_paths": 1, "convergence": 1, "recent": 2}
    assert canned.VERIFY["flap"](p).count() == 1 and canned.kinds(spark).count() == len(canned.VERIFY)
