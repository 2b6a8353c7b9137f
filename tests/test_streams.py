"""Streams against their batch forms: events of several peers in shuffled micro-batches, with ties of time, late rows, replays and restarts."""

import datetime as dt
import json
import pickle
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from skerry.operators import aggregates, detectors
from skerry.sources import tables
from skerry.streaming import stateful, streams
from tests.test_units import at

ROUTES = "event_id bigint, occurred_at timestamp, speaker_addr string, peer_addr string, prefix string, action string, as_path string, as_path_len int, med bigint, only_to_customer bigint"


def fed(spark, df, path, jitter=30.0, files=8, seed=0, column="occurred_at"):
    """df as a stream of so many files, a file a micro-batch, its rows out of order by up to jitter seconds; two events far ahead then move the watermark."""
    rng = random.Random(seed)
    rows = sorted((r for r in df.collect()), key=lambda r: (r[column].timestamp() + rng.uniform(0, jitter)))
    step = -(-len(rows) // files)
    parts = [rows[i : i + step] for i in range(0, len(rows), step)]
    for days in (4000, 5000):
        far = dict(rows[0].asDict(), **{column: dt.datetime(2024, 1, 1) + dt.timedelta(days=days)})
        far |= {k: "far" for k in ("speaker_addr", "peer_addr", "prefix") if k in far}
        parts.append([far])
    for i, part in enumerate(parts):
        rng.shuffle(part)
        spark.createDataFrame(part, df.schema).coalesce(1).write.parquet(f"{path}/{i:03d}")
    import glob
    import os

    for i, f in enumerate(sorted(glob.glob(f"{path}/*/*.parquet"))):
        os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))  # read in this order
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def drained(df, name):
    """(rows, late rows) of a stream that has read all there is."""
    q = df.writeStream.outputMode("append").format("memory").queryName(name).start()
    q.processAllAvailable()
    late = stateful.late_rows(q)
    q.stop()
    return df.sparkSession.table(name), late


def random_routes(n=700, seed=1, seconds=900):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        x, p = rng.choice("xyz"), rng.choice("pqr")
        size = rng.choice([2, 6, 7, 8, 8, 9])
        out.append((i, at(rng.randint(0, seconds) / 2), "s", p, x, "withdraw" if rng.random() < 0.1 else "announce", f"1 {64500 + int(rng.random() ** 3 * 5)}" if rng.random() < 0.95 else None, size, rng.choice([None, 5, 7, 7, 9]), rng.choice([None] * 20 + [1])))
    return out


def rows_of(df, columns):
    return sorted(map(tuple, df.where("prefix IS NULL OR prefix <> 'far'").select(*columns).collect()), key=str)


DETECTORS = {
    "new_origins": (detectors.new_origins, stateful.new_origins, {}),
    "origin_changes": (lambda r: detectors.origin_changes(r, grace_s=4), lambda r, late: stateful.origin_changes(r, 4, late), {}),
    "shortened_paths": (detectors.shortened_paths, stateful.shortened_paths, {}),
    "leaks": (detectors.leaks, stateful.leaks, {}),
    "med_oscillation": (lambda r: detectors.med_oscillation(r, 20), lambda r, late: stateful.med_oscillation(r, 20, late=late), {}),
    "hijacks": (lambda r: detectors.hijacks(r, seconds=5).drop("severity"), lambda r, late: stateful.hijacks(r, 5, late), {}),
}


@pytest.mark.parametrize("name", sorted(DETECTORS))
def test_detectors_of_unordered_streams(spark, tmp_path, name):
    """The batch form's rows, over several peers."""
    batch, stream, _ = DETECTORS[name]
    routes = spark.createDataFrame(random_routes(), ROUTES)
    want = batch(routes).drop("severity")
    got, late = drained(stream(fed(spark, routes, str(tmp_path), seed=3), late="31 seconds"), f"d_{name}")
    assert rows_of(got, want.columns) == rows_of(want, want.columns) and late == 0 and want.count() > 5


def test_buffers_hold_blocks(spark):
    """ST9: a micro-batch's events of a key go to the state as one value, or one for each BLOCK, and come back in order."""
    held = []

    class State:
        appendList = staticmethod(held.extend)

    d = stateful.Leaks()
    d.names, d.held, d._wait = ["at", "event_id", "as_path_len", "only_to_customer"], State, lambda at: held.append(at)
    rows = [Row(prefix="x", at=i * 7 % 1000, event_id=i, as_path_len=3, only_to_customer=None) for i in range(1000)]
    assert list(d.handleInputRows(("x", "p"), iter(rows), None)) == [] and len(held) == 2 and held[0][0] == held[1] == 0
    assert pickle.loads(held[0][1]) == sorted((r.at, r.event_id, 3, None) for r in rows)


def test_hijack_over_another_peer(spark, tmp_path):
    """D7 goes by prefix: a new origin over a peer that never announced the prefix is one."""
    base = [(1, at(0), "s", "p", "x", "announce", "1 10", 2, None, None), (2, at(5), "s", "q", "x", "announce", "1 11", 2, None, None), (3, at(5000), "s", "p", "x", "announce", "1 12", 2, None, None)]
    got, _ = drained(stateful.hijacks(fed(spark, spark.createDataFrame(base, ROUTES), str(tmp_path)), late="31 seconds"), "one_hijack")
    assert [(r.event_id, r.new_origin, r.known) for r in got.where("prefix <> 'far'").collect()] == [(2, 11, "10")]  # after an hour of silence none is known


def test_events_go_to_state_by_key(spark, tmp_path):
    """ST9: a task's events of a key are one row of the stateful operator's, late ones of a packed row are counted one by one."""
    rows = [(i, at(i / 10), "s", "p", "xy"[i % 2], "announce", "1 2", 7, 7, None) for i in range(400)]
    got = stateful.by_key(spark.createDataFrame(rows, ROUTES).withColumn("at", F.unix_micros("occurred_at")).coalesce(1), ["prefix", "peer_addr"], ["at", "event_id"]).collect()
    assert len(got) == 2 and sorted(e[1] for r in got for e in pickle.loads(r[stateful.PACKED])) == list(range(400))
    late = [(1000 + i, at(1 if i < 3 else 10_000), "s", "p", "x", "announce", "1 2", 2, 7, None) for i in range(4)]
    for k, part in enumerate((rows, [(999, at(5000), "s", "p", "y", "announce", "1 2", 7, 7, None)], late)):
        spark.createDataFrame(part, ROUTES).coalesce(1).write.parquet(f"{tmp_path}/{k}")
    import glob
    import os

    for i, f in enumerate(sorted(glob.glob(f"{tmp_path}/*/*.parquet"))):
        os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema(ROUTES).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/*")
    assert drained(stateful.leaks(stream, late="10 seconds"), "packed")[1] == 3


def test_late_rows_are_counted(spark, tmp_path):
    rows = [(i, at(100 * i), "s", "p", "x", "announce", f"1 {10 + i}", 2, None, None) for i in range(6)]
    df = spark.createDataFrame(rows, ROUTES)
    for k, part in enumerate(([0, 1, 2], [5], [3], [4])):  # 3 and 4 come behind the watermark
        spark.createDataFrame([rows[i] for i in part], ROUTES).coalesce(1).write.parquet(f"{tmp_path}/{k}")
    live = fed(spark, df.where("event_id = 5"), str(tmp_path / "z"), files=1)  # only its far events matter
    both = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/[0-9]").unionByName(live)
    got, late = drained(stateful.new_origins(both, "10 seconds"), "late")
    assert late >= 2 and not {10 + 3, 10 + 4} & {r.new_origin for r in got.collect()}


def test_suppression_stream(spark, tmp_path):
    rng = random.Random(5)
    schema = "occurred_at timestamp, event_id bigint, kind string, prefix string, peer_addr string, severity string"
    rows = [(at(rng.randint(0, 4000)), i, rng.choice("kl"), rng.choice("xy"), rng.choice(["p", None]), "warning") for i in range(400)]
    alerts = spark.createDataFrame(rows, schema)
    want = detectors.suppress(alerts)
    got, late = drained(stateful.suppress(fed(spark, alerts, str(tmp_path), jitter=50), late="51 seconds"), "suppressed")
    assert rows_of(got.where("kind IN ('k', 'l')"), want.columns) == rows_of(want, want.columns) and late == 0 and 20 < want.count() < 200


def test_slow_convergence_stream(spark, tmp_path):
    """Alerts against the rolling median, with ties of time and days that fall out of the window."""
    rng = random.Random(12)
    rows = [(rng.choice("pq"), at(rng.randint(0, 240) * 3600), rng.choice([90.0, 100.0, 110.0, 120.0, 330.0, 700.0])) for _ in range(220)]
    df = spark.createDataFrame(rows, "peer_addr string, started_at timestamp, convergence_ms double")
    want = detectors.slow_convergence(df, days=2)
    got, late = drained(stateful.slow_convergence(fed(spark, df, str(tmp_path), jitter=7200, column="started_at"), days=2, late="7201 seconds"), "slow")
    key = lambda x: sorted(map(tuple, x.where("peer_addr <> 'far'").select(*want.columns).collect()))
    assert key(got) == key(want) and late == 0 and {r.severity for r in want.collect()} == {"warning", "critical"}


def test_episode_stream(spark, tmp_path):
    """One definition, declared over history and kept in state: equal episodes, all of their columns."""
    rng = random.Random(9)
    base = "event_id bigint, occurred_at timestamp, speaker_addr string, peer_addr string, "
    rows = []
    for i in range(500):
        rows.append((i, at(0.5 * rng.randint(0, 3000)), rng.choice("st"), f"p{i % 3}", rng.choice(["peer_down", "peer_up", "withdraw", "withdraw", "announce", "stat"]), rng.choice("abc"), rng.choice([7, 8, 9]), rng.choice([0, 0, 5])))
    every = spark.createDataFrame(rows, base + "kind string, prefix string, stat_type int, counter_value bigint")
    split = lambda df: (df.where("kind LIKE 'peer%'").withColumnRenamed("kind", "event_type"), df.where("kind IN ('withdraw', 'announce')").withColumnRenamed("kind", "action"), df.where("kind = 'stat'"))
    want = detectors.convergence_events(*split(every))
    got, late = drained(stateful.convergence_events(*split(fed(spark, every, str(tmp_path), jitter=20)), late="21 seconds"), "episode_rows")
    key = lambda df: sorted(map(tuple, df.where("peer_addr <> 'far'").select(*want.columns).collect()), key=str)
    assert key(got) == key(want) and late == 0 and {r.ended_by for r in want.collect()} == {"quiet", "peer_up", "stat"}


def stale_fold(events, stale_s):
    """What becomes of routes, one event after another over all prefixes of a peer; events are (at, id, peer, kind, prefix) in order."""
    out, live = [], {}
    horizon = dt.datetime(2030, 1, 1)
    for t, _, peer, kind, prefix in [*events, (horizon, 0, None, "end", None)]:
        for k in sorted(live, key=str):
            if stale_s is not None and live[k] is not None and live[k] + dt.timedelta(seconds=stale_s) <= t:
                out.append((*k, live.pop(k) + dt.timedelta(seconds=stale_s), "expired"))
        if kind == "announce":
            live[peer, prefix] = None
        elif kind == "withdraw" and (peer, prefix) in live:
            del live[peer, prefix]
            out.append((peer, prefix, t, "withdrawn"))
        elif kind == "peer_down":
            for k in [k for k in live if k[0] == peer]:
                if stale_s is None:
                    del live[k]
                    out.append((*k, t, "withdrawn"))
                elif live[k] is None:
                    live[k] = t
                    out.append((*k, t, "stale"))
    return sorted(out, key=str)


@pytest.mark.parametrize("stale_s", [40, None])
def test_stale_stream(spark, tmp_path, stale_s):
    """P5, ST6: one down, without a prefix, makes every route of its peer stale, and those that don't come anew expire."""
    rng = random.Random(2)
    events = []
    for i in range(300):
        kind = rng.choice(["announce"] * 6 + ["withdraw", "peer_down"])
        events.append((i, at(rng.randint(0, 1500)), rng.choice("pq"), kind, None if kind == "peer_down" else f"10.{rng.randint(0, 20)}.0.0/16"))
    df = spark.createDataFrame(events, "event_id bigint, occurred_at timestamp, peer_addr string, kind string, prefix string")
    want = stale_fold(sorted((t, i, p, k, x) for i, t, p, k, x in events), stale_s)
    got, _ = drained(stateful.stale_routes(fed(spark, df, str(tmp_path), jitter=20), stale_s, "21 seconds", shares=3), f"stale_{stale_s}")
    assert sorted(((r.peer_addr, r.prefix, r.occurred_at, r.change) for r in got.where("peer_addr <> 'far'").collect()), key=str) == want
    assert {w[3] for w in want} == ({"stale", "expired", "withdrawn"} if stale_s else {"withdrawn"})


def test_shedding_stream(spark, tmp_path):
    rng = random.Random(4)
    df = spark.createDataFrame([(i, at(rng.randint(0, 400) / 4), rng.choice(["route", "route", "stats"])) for i in range(500)], "event_id bigint, occurred_at timestamp, kind string")
    want = aggregates.shed(df, df.where("kind = 'stats'"), 5)
    got, late = drained(stateful.shed(fed(spark, df, str(tmp_path), jitter=10), 5, late="11 seconds"), "kept_stats")
    ids = lambda x: sorted(r.event_id for r in x.where("occurred_at < '2025-01-01'").collect())
    assert ids(got) == ids(want) and 0 < want.count() < 200 and late == 0


def test_down_effects_stream(spark, tmp_path):
    """The interval join of downs and route events, and downs without any once the watermark has passed."""
    rng = random.Random(6)
    rows = [(i, at(rng.randint(0, 3000)), "s", rng.choice("pqr"), rng.choice(["peer_down"] + ["announce"] * 3), rng.choice("ab")) for i in range(150)] + [(900, at(3500), "s", "lone", "peer_down", None)]
    df = spark.createDataFrame(rows, "event_id bigint, occurred_at timestamp, speaker_addr string, peer_addr string, kind string, prefix string")
    split = lambda x: (x.withColumn("event_type", F.when(F.col("peer_addr") == "far", "peer_down").otherwise(F.col("kind"))), x.where("kind = 'announce' OR peer_addr = 'far'").withColumn("action", F.col("kind")))
    want = stateful.down_effects(*split(df))
    got, late = drained(stateful.down_effects(*split(fed(spark, df, str(tmp_path), jitter=20)), late="21 seconds"), "effects")
    key = lambda x: sorted(((r.down_id, r.event_id) for r in x.where("peer_addr <> 'far'").collect()), key=str)
    assert key(got) == key(want) and (900, None) in key(want) and late == 0
    assert sum(r[1] is None for r in key(want)) > 3


def test_down_effects_over_history(spark):
    """Every row of the nested loop, at a span's borders, with ties, and of downs without any or without a peer; rows of a busy peer meet by time."""
    rng = random.Random(8)
    rows = [(i, at(30 * rng.randint(0, 40) + rng.choice([0, 0, 0.5, 29.999])), "s", rng.choice("pq"), rng.choice(["peer_down", "announce"])) for i in range(200)] + [(900, at(5000), "s", None, "peer_down"), (901, at(9000), "s", "p", "peer_down")]
    df = spark.createDataFrame(rows, "event_id bigint, occurred_at timestamp, speaker_addr string, peer_addr string, event_type string").withColumns({"action": F.col("event_type"), "prefix": F.lit("x")})
    downs, routes = [r for r in rows if r[4] == "peer_down"], [r for r in rows if r[4] == "announce"]
    want = [(d[0], [r[0] for r in routes if r[3] == d[3] and 0 <= (r[1] - d[1]).total_seconds() <= 30] or [None]) for d in downs]
    got = stateful.down_effects(df, df.where("action = 'announce'"))
    key = lambda x: sorted(x, key=str)
    assert key((r.down_id, r.event_id) for r in got.collect()) == key((d, e) for d, found in want for e in found)
    assert sum(found == [None] for _, found in want) >= 2
    joins = got._jdf.queryExecution().optimizedPlan().toString()
    assert "(span#" in [line for line in joins.splitlines() if "Join Inner" in line][0]


def test_judged_alerts_take_newer_authorisations(spark, tmp_path):
    """Severity by the authorisations as they are when a batch is judged."""
    asked, out = [], []

    def vrps():
        asked.append(1)
        return spark.createDataFrame([("10.0.0.0/8", 24, 11 if len(asked) == 1 else 99)], "prefix string, max_len int, origin_asn bigint")

    schema = "event_id bigint, occurred_at timestamp, prefix string, peer_addr string, old_origin bigint, new_origin bigint"
    path = str(tmp_path / "in")
    for i in range(2):
        spark.createDataFrame([(i, at(i), "10.1.0.0/16", "p", 10, 11)], schema).coalesce(1).write.mode("append").parquet(path)
        stateful.judged(spark.readStream.schema(schema).parquet(path), vrps, lambda df, _: out.extend(df.collect()), str(tmp_path / "c")).awaitTermination(120)
    assert [(r.event_id, r.severity) for r in out] == [(0, "info"), (1, "critical")] and set(out[0].asDict()) == {*"event_id occurred_at prefix peer_addr old_origin new_origin severity".split()}


def archive(path, first, n):
    path.mkdir(exist_ok=True)
    lines = []
    for i in range(first, first + n):
        kind, payload = [("route", {"peer_addr": "p", "prefix": "10.0.0.0/8", "action": "announce"}), ("peer_down", {"peer_addr": "p"}), ("stats", {"peer_addr": "p", "counters": [{"stat_type": 7, "value": i}]})][i % 3]
        lines.append(json.dumps({"id": str(i), "occurred_at": f"2024-01-0{1 + i % 2}T00:00:00Z", "speaker": "s", "kind": kind, "payload": payload}))
    (path / f"{first:05d}.json").write_text("\n".join(lines))


def test_stored_once(spark, tmp_path, monkeypatch):
    """S3, ST1: a batch that fails after its second table and is run again leaves no row twice; so do a restart and a query of its own."""
    archive(tmp_path / "in", 0, 60)
    out, real, calls = str(tmp_path / "out"), tables.write_table, []

    def failing(df, path, name, *more):
        calls.append(name)
        if len(calls) == 3:
            raise RuntimeError("lost")
        real(df, path, name, *more)

    monkeypatch.setattr(streams, "write_table", failing)
    run = lambda c="c": streams.store(streams.read_stream(spark, str(tmp_path / "in")), out, str(tmp_path / c), rows=7)
    with pytest.raises(Exception, match="lost"):
        run().awaitTermination(120)
    assert tables.read_table(spark, out, "route_events").count() == 20  # written before the failure
    run().awaitTermination(120)
    archive(tmp_path / "in", 100, 30)
    run().awaitTermination(120)
    count = lambda: {n: tables.read_table(spark, out, n).count() for n in ("route_events", "peer_events", "stats_events")}
    ids = [r.id for r in tables.read_table(spark, out, "route_events").collect()]
    assert count() == {"route_events": 30, "peer_events": 30, "stats_events": 30} and len(set(ids)) == 30
    sizes = [r.n for r in spark.read.parquet(f"{out}/route_events").groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()]
    assert max(sizes) <= 7  # files of so many rows
    run("other").awaitTermination(120)  # another query's batches are others
    assert count()["route_events"] == 60


def test_retention_deletes(spark, tmp_path):
    """Whole days go as folders, the day of the limit is rewritten, other days aren't touched; 0 days keeps all; five tables."""
    import pathlib

    path = str(tmp_path / "t")
    rows = [(str(i), at(3600 * 6 * i), "s", "p") for i in range(40)]  # ten days, four events a day
    for name in tables.SWEPT:
        for k in (0, 1):
            part = spark.createDataFrame(rows[k::2], "id string, occurred_at timestamp, speaker_addr string, peer_addr string")
            schema = spark.createDataFrame([], tables.SCHEMAS[name])
            tables.write_table(part.select(*(F.col(c) if c in part.columns else F.lit(None).cast(schema.schema[c].dataType).alias(c) for c in schema.columns)), path, name, f"b{k}")
    assert tables.sweep(spark, path, 0, "2024-01-11 00:00:00") == dict.fromkeys(tables.SWEPT, 0)
    fresh = sorted(pathlib.Path(path, "route_events", "event_date=2024-01-09").rglob("*.parquet"))
    stamps = [f.stat().st_mtime_ns for f in fresh]
    lost = tables.sweep(spark, path, 5, "2024-01-11 07:00:00")  # keeps from 2024-01-06 07:00
    assert lost == dict.fromkeys(tables.SWEPT, 22)
    for name in tables.SWEPT:
        left = tables.read_table(spark, path, name).collect()
        assert sorted(int(r.id) for r in left) == list(range(22, 40))
        days = sorted(p.name for p in pathlib.Path(path, name).iterdir() if p.is_dir())
        assert days == [f"event_date=2024-01-{d:02d}" for d in range(6, 11)]
    assert [f.stat().st_mtime_ns for f in fresh] == stamps and fresh
    assert tables.sweep(spark, path, 5, "2024-01-11 07:00:00") == dict.fromkeys(tables.SWEPT, 0)
    assert tables.sweep(spark, path, 5, "2024-01-11 13:00:00")["route_events"] == 1 and not list(pathlib.Path(path, "route_events").glob("event_date=2024-01-06/batch=b0"))
    assert tables.sweep(spark, str(tmp_path / "none"), 5, "2024-01-11 00:00:00") == dict.fromkeys(tables.SWEPT, 0)


def test_only_queries(spark, tmp_path):
    """Queries run, whatever else is refused and does nothing."""
    t = {"t": spark.range(3).withColumnRenamed("id", "x")}
    ask = lambda q: tables.select_only(spark, q, t)
    spark.sql(f"CREATE TABLE kept (x bigint) USING parquet LOCATION '{tmp_path}/kept'")
    try:
        assert [r.x for r in ask("SELECT x FROM t ORDER BY x DESC;").collect()] == [2, 1, 0] and ask("WITH a AS (SELECT 1 AS x) SELECT a.x, a.x FROM a").count() == 1
        assert ask("VALUES (1), (2)").count() == 2 and ask("(SELECT x FROM t) UNION ALL (SELECT 9) -- all").count() == 4
        for q in ("WITH a AS (SELECT 1L AS x) INSERT INTO kept SELECT x FROM a", "INSERT INTO kept VALUES (1)", "FROM t INSERT INTO kept SELECT x INSERT INTO kept SELECT x + 1", "WITH a AS (SELECT 1), b AS (SELECT 2L AS x) INSERT OVERWRITE kept SELECT x FROM b", "CREATE TABLE other AS SELECT 1 AS x", "CREATE TEMP VIEW v AS SELECT 1", "DROP TABLE kept", "TRUNCATE TABLE kept", "CACHE TABLE kept", "SET spark.sql.ansi.enabled=false", "ADD JAR 'x.jar'", "EXPLAIN SELECT 1", "SELECT TRANSFORM(x) USING 'cat' AS (y) FROM t", "SELECT java_method('java.lang.System', 'currentTimeMillis')", "SELECT reflect ('java.lang.System', 'lineSeparator')", "SELECT 1; DROP TABLE kept", ""):
            with pytest.raises(ValueError):
                ask(q)
        assert spark.table("kept").count() == 0 and not spark.catalog.tableExists("other")
    finally:
        spark.sql("DROP TABLE kept")
