"""The library's queries by name, and the SQL that gives the same rows. An entry is (function of a dict-like of views, SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.functions import scalars as X
from skerry.operators import aggregates as A
from skerry.operators import detectors as D
from skerry.operators import graph as G
from skerry.operators import joins as J
from skerry.operators import ml as M
from skerry.operators import policy as R
from skerry.operators import scan as C
from skerry.operators import state as L
from skerry.operators import windows as W
from skerry.plans.fixtures import AS_OF, view
from skerry.sources import tables as S


class Views:
    """The derived views of one folder of tables, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name)

    @property
    def roas(self) -> DataFrame:
        return self.vrps.select(F.concat_ws("/", "net", F.col("vlen").cast("string")).alias("prefix"), "max_len", "origin_asn")

    @property
    def judged(self) -> DataFrame:
        """Routes with their validity."""
        return J.validate_origins(self.route_events, self.roas)

    @property
    def marked(self) -> DataFrame:
        """Routes with their validity and a label of their path's status."""
        return J.validate_origins(self.marked_routes, self.roas)

    @property
    def registry(self) -> DataFrame:
        r = self.route_events
        own = r.where("action = 'announce'").select("prefix", X.origin_asn("as_path").alias("o")).where("o < 65200 AND o % 3 <> 0")
        return own.select("prefix", F.col("o").alias("origin_asn"), F.concat(F.lit("REG"), (F.col("o") % 2).cast("string")).alias("source")).distinct()

    @property
    def links(self) -> DataFrame:
        """Links as events, all announced at once."""
        return self.bgpls_links


ID = ["event_id"]
_T = f"TIMESTAMP '{AS_OF}'"
_LAST = "QUALIFY row_number() OVER (PARTITION BY {} ORDER BY occurred_at DESC, event_id DESC) = 1"
RIB = f"rib AS (SELECT * FROM (SELECT * FROM route_events {_LAST.format('peer_addr, rib_type, prefix')}) WHERE action = 'announce')"
ORIGIN = "TRY_CAST(split_part(trim(as_path), ' ', -1) AS BIGINT)"
_NUM = "(CAST(split_part({0}, '.', 1) AS BIGINT) * 16777216 + CAST(split_part({0}, '.', 2) AS BIGINT) * 65536 + CAST(split_part({0}, '.', 3) AS BIGINT) * 256 + CAST(split_part(split_part({0}, '.', 4), '/', 1) AS BIGINT))"
_LEN = "CAST(split_part({0}, '/', 2) AS INT)"
VALID = f"""pairs AS (SELECT DISTINCT prefix, {ORIGIN} AS origin_asn FROM route_events),
hits AS (SELECT p.prefix, p.origin_asn, v.origin_asn AS v_asn, v.max_len, v.vlen FROM pairs p LEFT JOIN vrps v ON {_LEN.format('p.prefix')} >= v.vlen AND {_NUM.format('p.prefix')} // CAST(pow(2, 32 - v.vlen) AS BIGINT) = {_NUM.format('v.net')} // CAST(pow(2, 32 - v.vlen) AS BIGINT)),
verdicts AS (SELECT prefix, origin_asn, CASE WHEN bool_or(coalesce(v_asn = origin_asn AND {_LEN.format('prefix')} <= max_len, false)) THEN 'valid' WHEN bool_or(v_asn IS NOT NULL) THEN 'invalid' ELSE 'not-found' END AS rpki_validity,
 bool_or(coalesce(v_asn = origin_asn AND {_LEN.format('prefix')} <= max_len AND vlen < {_LEN.format('prefix')}, false)) AS more_specific FROM hits GROUP BY ALL),
judged AS (SELECT r.*, v.origin_asn, v.rpki_validity, v.more_specific FROM route_events r JOIN verdicts v ON r.prefix = v.prefix AND {ORIGIN} IS NOT DISTINCT FROM v.origin_asn)"""
ASNS = "list_transform(string_split(as_path, ' '), lambda x: CAST(x AS BIGINT))"
ONCE = f"list_filter({ASNS}, lambda x, i: i = 1 OR x <> ({ASNS})[i - 1])"
HOUR = "date_trunc('hour', occurred_at)"
ANN = "action = 'announce'"
US = "epoch_us(occurred_at)"
#: Path-status bits in the order in which they name a path.
BITS = [(2, "best"), (8, "primary"), (16, "backup"), (64, "best-external"), (128, "add-path"), (4, "nonselected"), (256, "filtered-inbound"), (512, "filtered-outbound"), (1024, "stale"), (2048, "suppressed"), (32, "non-installed"), (1, "invalid")]
LABEL = "CASE " + " ".join(f"WHEN path_status & {b} <> 0 THEN '{n}'" for b, n in BITS) + " ELSE 'unknown' END"
PEERS = [f"10.0.{i % 3}.{i + 1}" for i in range(12)]
ROUTE = "event_id, prefix, peer_addr, rib_type, action, as_path, local_pref"
_R = ROUTE.split(", ")

Q: dict[str, tuple[Callable[[Views], DataFrame], str | None]] = {}


def add(name: str, sql: str | None):
    def put(f):
        Q[name] = f, sql
        return f

    return put


# latest state -------------------------------------------------------------------------------------------------------------------------------------------------------
add("current_rib", f"WITH {RIB} SELECT {ROUTE} FROM rib")(lambda v: L.current_rib(v.route_events).select(*_R))
add("current_rib_by_prefix", f"SELECT {ROUTE} FROM (SELECT * FROM route_events {_LAST.format('prefix')}) WHERE {ANN}")(lambda v: L.current_rib(v.route_events, keys=("prefix",)).select(*_R))
add("prefix_history", f"SELECT {ROUTE} FROM route_events WHERE prefix = '20.37.0.0/17' ORDER BY occurred_at DESC, event_id DESC LIMIT 100")(lambda v: L.prefix_history(v.route_events, "20.37.0.0/17").select(*_R))
add("route_changes", f"SELECT {ROUTE} FROM route_events WHERE occurred_at >= TIMESTAMP '2024-01-10 00:00:00' AND occurred_at <= TIMESTAMP '2024-01-20 00:00:00' ORDER BY occurred_at DESC, event_id DESC LIMIT 200")(lambda v: L.route_changes(v.route_events, "2024-01-10 00:00:00", "2024-01-20 00:00:00", 200).select(*_R))
add("prefix_peers", f"SELECT {ROUTE} FROM (SELECT * FROM route_events WHERE prefix = '20.37.0.0/17' AND {ANN}) {_LAST.format('peer_addr')}")(lambda v: L.prefix_peers(v.route_events, "20.37.0.0/17").select(*_R))
add("route_visibility", "SELECT peer_addr, action, max(occurred_at) AS last_seen FROM route_events WHERE prefix = '20.37.0.0/17' GROUP BY ALL")(lambda v: L.route_visibility(v.route_events, "20.37.0.0/17"))
add("stats_history", "SELECT event_id, peer_addr, counter_name, CAST(counter_value AS BIGINT) AS counter_value FROM stats_events WHERE counter_name = 'adj-rib-in-routes' ORDER BY occurred_at DESC, event_id DESC LIMIT 100")(lambda v: L.listing(v.stats_events, counter_name="adj-rib-in-routes").selectExpr("event_id", "peer_addr", "counter_name", "CAST(counter_value AS BIGINT) AS counter_value"))
add("peer_history", "SELECT event_id, occurred_at, event_type, reason FROM peer_events WHERE peer_addr = '10.0.1.2' ORDER BY occurred_at DESC, event_id DESC LIMIT 200")(lambda v: L.listing(v.peer_events, limit=200, peer_addr="10.0.1.2").select("event_id", "occurred_at", "event_type", "reason"))
add("path_status_history", f"SELECT event_id, prefix, peer_addr, CAST(path_status AS BIGINT) AS path_status FROM path_markings WHERE peer_addr = '10.0.1.2' AND occurred_at >= {_T} - INTERVAL 240 HOURS ORDER BY occurred_at DESC, event_id DESC LIMIT 100")(lambda v: L.listing(v.path_markings, hours=240, as_of=AS_OF, peer_addr="10.0.1.2").selectExpr("event_id", "prefix", "peer_addr", "CAST(path_status AS BIGINT) AS path_status"))
add("rpki_invalids", f"WITH {VALID} SELECT event_id, prefix, peer_addr, origin_asn FROM judged WHERE rpki_validity = 'invalid' ORDER BY occurred_at DESC, event_id DESC LIMIT 100")(lambda v: L.listing(v.judged, rpki_validity="invalid").select("event_id", "prefix", "peer_addr", "origin_asn"))
add("live_routes", f"WITH {RIB} SELECT {ROUTE} FROM rib WHERE prefix LIKE '20.1%'")(lambda v: L.live_routes(v.route_events, "20.1").select(*_R))
add("rib_counts", f"WITH {RIB} SELECT peer_addr, rib_type, count(*) AS routes FROM rib GROUP BY ALL")(lambda v: L.rib_counts(v.route_events))
add("peer_state", f"""WITH s AS (SELECT *, event_type = 'peer_up' AND coalesce(sum(CASE WHEN event_type = 'peer_up' THEN 1 ELSE 0 END) OVER (PARTITION BY speaker_addr, peer_addr ORDER BY occurred_at, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 AS again FROM peer_events),
g AS (SELECT speaker_addr, peer_addr, arg_max(event_type, (occurred_at, event_id)) AS last_event, max(occurred_at) FILTER (event_type = 'peer_up') AS up_at, max(occurred_at) FILTER (event_type = 'peer_down') AS down_at, count(*) FILTER (again) AS flap_count FROM s GROUP BY ALL)
SELECT speaker_addr, peer_addr, CASE WHEN last_event = 'peer_up' THEN 'up' ELSE 'down' END AS state, up_at, down_at, CASE WHEN last_event = 'peer_up' THEN CAST(floor(epoch({_T})) AS BIGINT) - CAST(floor(epoch(up_at)) AS BIGINT) END AS uptime_s, flap_count FROM g""")(lambda v: L.peer_state(v.peer_events, AS_OF))
add("speaker_summary", f"""WITH {RIB}, s AS (SELECT speaker_addr, event_type FROM speaker_events {_LAST.format('speaker_addr')}), p AS (SELECT speaker_addr, count(*) FILTER (event_type = 'peer_up') AS up, count(*) FILTER (event_type = 'peer_down') AS down FROM (SELECT * FROM peer_events {_LAST.format('speaker_addr, peer_addr')}) GROUP BY 1), t AS (SELECT speaker_addr, count(*) AS n FROM rib GROUP BY 1)
SELECT speaker_addr, coalesce(s.event_type, 'unknown') AS last_event, coalesce(up, 0) AS peers_up, coalesce(down, 0) AS peers_down, coalesce(n, 0) AS total_routes, CASE WHEN coalesce(up, 0) > 0 THEN 'active' ELSE 'idle' END AS status, coalesce(hostname, '') AS hostname, coalesce(site, '') AS site
FROM s FULL JOIN p USING (speaker_addr) FULL JOIN t USING (speaker_addr) LEFT JOIN inventory USING (speaker_addr)""")(lambda v: L.speaker_summary(v.speaker_events, v.peer_events, v.route_events, v.inventory))
add("path_matrix", f"""WITH w AS (SELECT * FROM path_markings WHERE occurred_at >= {_T} - INTERVAL 20 DAYS AND occurred_at <= {_T}), l AS (SELECT * FROM w {_LAST.format('prefix, peer_addr')}), few AS (SELECT prefix FROM l GROUP BY 1 HAVING count(*) FILTER (path_status & 10 <> 0) < 5)
SELECT prefix, peer_addr, CAST(path_status AS INT) AS path_status, event_id FROM l WHERE prefix IN (FROM few)""")(lambda v: L.path_matrix(v.path_markings, AS_OF, 20 * 1440, "ipv4-unicast", 5).selectExpr("prefix", "peer_addr", "CAST(path_status AS INT) AS path_status", "event_id"))
add("path_pivot", f"""WITH l AS (SELECT *, {LABEL} AS label FROM (SELECT * FROM path_markings {_LAST.format('prefix, peer_addr')}))
SELECT prefix, {', '.join(f"max(label) FILTER (peer_addr = '{p}') AS \"{p}\"" for p in PEERS)}, count(*) FILTER (path_status & 90 <> 0) AS active_paths FROM l GROUP BY 1""")(lambda v: L.path_pivot(v.path_markings, PEERS))
add("best_paths", f"SELECT event_id, peer_addr, rib_type, prefix, as_path FROM (SELECT * FROM (SELECT * FROM route_events {_LAST.format('peer_addr, rib_type, prefix, as_path')}) WHERE {ANN}) QUALIFY row_number() OVER (PARTITION BY peer_addr, rib_type, prefix ORDER BY local_pref DESC NULLS LAST, as_path_len, med NULLS LAST, event_id) = 1")(lambda v: L.best_paths(v.route_events).select("event_id", "peer_addr", "rib_type", "prefix", "as_path"))
_DOWN = "d AS (SELECT speaker_addr, peer_addr, max((occurred_at, event_id)) AS down FROM peer_events WHERE event_type = 'peer_down' GROUP BY ALL), e AS (SELECT speaker_addr, max((occurred_at, event_id)) AS fin FROM speaker_events WHERE event_type = 'speaker_down' GROUP BY ALL)"
add("reconstructed_rib", f"WITH {RIB}, {_DOWN} SELECT event_id, prefix, peer_addr FROM rib LEFT JOIN d USING (speaker_addr, peer_addr) LEFT JOIN e USING (speaker_addr) WHERE coalesce((occurred_at, event_id) >= down, true) AND coalesce((occurred_at, event_id) > fin, true)")(lambda v: L.reconstruct(v.route_events, v.peer_events, v.speaker_events).select("event_id", "prefix", "peer_addr"))
add("stale_rib", f"WITH {RIB}, {_DOWN} SELECT event_id, prefix, peer_addr, coalesce((occurred_at, event_id) < down, false) AS stale FROM rib LEFT JOIN d USING (speaker_addr, peer_addr) WHERE NOT coalesce((occurred_at, event_id) < down, false) OR down[1] + INTERVAL 2 DAYS > {_T}")(lambda v: L.reconstruct(v.route_events, v.peer_events, as_of=AS_OF, stale_s=172800).select("event_id", "prefix", "peer_addr", "stale"))
# aggregates ----------------------------------------------------------------------------------------------------------------------------------------------------
add("top_churning", "SELECT prefix, count(*) AS events FROM route_events GROUP BY 1 ORDER BY events DESC, prefix LIMIT 20")(lambda v: A.top_churning(v.route_events))
add("churn", f"SELECT prefix, count(*) AS events, count(*) FILTER ({ANN}) AS announces, count(*) FILTER (action = 'withdraw') AS withdraws, min(occurred_at) AS first_seen, max(occurred_at) AS last_seen FROM route_events GROUP BY 1")(lambda v: A.churn(v.route_events))
add("origin_counts", f"SELECT {ORIGIN} AS origin_asn, count(*) AS announces, count(DISTINCT prefix) AS prefixes FROM route_events WHERE {ANN} AND {ORIGIN} IS NOT NULL GROUP BY 1")(lambda v: A.origin_counts(v.route_events))
add("validity_counts", f"WITH {VALID} SELECT rpki_validity, count(*) AS prefixes FROM (SELECT * FROM judged {_LAST.format('prefix')}) GROUP BY 1")(lambda v: A.validity_counts(v.judged))
add("invalid_rates", f"WITH {VALID} SELECT peer_addr, peer_as, count(*) AS routes, count(*) FILTER (rpki_validity = 'invalid') AS invalid, round(count(*) FILTER (rpki_validity = 'invalid') / count(*), 6) AS invalid_rate FROM judged GROUP BY ALL ORDER BY invalid_rate DESC, peer_addr, peer_as LIMIT 20")(lambda v: A.invalid_rates(v.judged))
add("validity_coverage", f"""WITH {VALID} SELECT count(*) AS total, count(*) FILTER (rpki_validity IN ('valid', 'invalid')) AS covered, count(*) FILTER (rpki_validity = 'valid') AS valid, count(*) FILTER (rpki_validity = 'invalid') AS invalid, count(*) FILTER (rpki_validity NOT IN ('valid', 'invalid')) AS not_covered,
round(count(*) FILTER (rpki_validity IN ('valid', 'invalid')) * 100.0 / count(*), 1) AS coverage_pct FROM (SELECT * FROM judged {_LAST.format('prefix')})""")(lambda v: A.validity_coverage(J.validate_origins(L.latest(v.route_events, ["prefix"]), v.roas)))
add("policy_delta", f"WITH {RIB} SELECT peer_addr, rib_type, count(DISTINCT prefix) AS prefixes FROM rib GROUP BY ALL")(lambda v: A.policy_delta(v.route_events))
add("policy_drop", f"WITH {RIB}, g AS (SELECT peer_addr, count(DISTINCT prefix) FILTER (rib_type = 'AdjRibInPrePolicy') AS pre, count(DISTINCT prefix) FILTER (rib_type = 'AdjRibInPostPolicy') AS post FROM rib GROUP BY 1) SELECT *, pre - post AS dropped, round(CASE WHEN pre > 0 THEN (pre - post) / pre ELSE 0 END, 6) AS drop_rate FROM g")(lambda v: A.policy_drop(v.route_events))
add("policy_dropped", f"WITH {RIB} SELECT DISTINCT peer_addr, prefix FROM rib a WHERE rib_type = 'AdjRibInPrePolicy' AND NOT EXISTS (FROM rib b WHERE b.rib_type = 'AdjRibInPostPolicy' AND a.peer_addr = b.peer_addr AND a.prefix = b.prefix)")(lambda v: A.policy_dropped(v.route_events))
add("prefix_timeline", f"SELECT {HOUR} AS hour, action, count(*) AS events FROM route_events WHERE prefix = '20.37.0.0/17' AND occurred_at >= {_T} - INTERVAL 30 DAYS GROUP BY ALL")(lambda v: A.prefix_timeline(v.route_events, "20.37.0.0/17", 30, AS_OF))
add("flap_counts", f"SELECT peer_addr, peer_as, count(*) AS downs, max(occurred_at) AS last_down FROM peer_events WHERE event_type = 'peer_down' AND occurred_at >= {_T} - INTERVAL 240 HOURS GROUP BY ALL ORDER BY downs DESC, peer_addr, peer_as LIMIT 50")(lambda v: A.flap_counts(v.peer_events, 240, AS_OF))
add("community_strings", f"SELECT communities, count(*) AS routes FROM route_events WHERE {ANN} AND communities IS NOT NULL GROUP BY 1")(lambda v: A.community_strings(v.route_events))
add("community_usage", f"SELECT community, count(*) AS routes FROM (SELECT unnest(string_split(communities, ',')) AS community FROM route_events WHERE {ANN}) GROUP BY 1")(lambda v: A.community_usage(v.route_events))
add("path_lengths", f"SELECT as_path_len, count(*) AS routes, count(DISTINCT prefix) AS prefixes FROM route_events WHERE {ANN} GROUP BY 1")(lambda v: A.path_lengths(v.route_events))
add("capacity", f"""WITH live AS (SELECT speaker_addr, peer_addr, count(DISTINCT prefix) AS n FROM (SELECT * FROM route_events {_LAST.format('speaker_addr, peer_addr, rib_type, prefix')}) WHERE {ANN} GROUP BY ALL),
t AS (SELECT speaker_addr, peer_addr, regr_slope(CAST(counter_value AS DOUBLE), epoch_us(occurred_at) / 1e6) * 86400 AS d FROM stats_events WHERE counter_name = 'adj-rib-in-routes' AND occurred_at >= {_T} - INTERVAL 20 DAYS GROUP BY ALL),
x AS (SELECT *, n * 100.0 / max_prefix AS used, CASE WHEN d > 0 THEN greatest(max_prefix - n, 0) / d END AS eta FROM peer_max_prefix JOIN live USING (speaker_addr, peer_addr) LEFT JOIN t USING (speaker_addr, peer_addr))
SELECT speaker_addr, peer_addr, afi_safi, n AS current, CAST(max_prefix AS BIGINT) AS max_prefix, round(used, 3) AS used_pct, round(d, 3) AS trend_per_day, round(eta, 3) AS eta_days, CASE WHEN used >= 90 OR eta < 7 THEN 'critical' WHEN used >= 70 OR eta < 30 THEN 'warning' ELSE 'ok' END AS severity FROM x""")(lambda v: A.capacity(v.route_events, v.peer_max_prefix, v.stats_events, AS_OF, days=20).withColumns({"max_prefix": F.col("max_prefix").cast("bigint"), "used_pct": F.col("used_pct").cast("double")}))
add("counter_totals", "SELECT counter_name, CAST(sum(counter_value) AS BIGINT) AS total, count(DISTINCT peer_addr) AS peers FROM stats_events GROUP BY 1")(lambda v: A.counter_totals(v.stats_events).withColumn("total", F.col("total").cast("bigint")))
add("vrf_summary", f"WITH {RIB} SELECT 'global' AS rd, count(*) AS routes, count(DISTINCT peer_addr) AS peers, count(DISTINCT afi) AS afis FROM rib")(lambda v: A.vrf_summary(v.route_events))
add("totals", f"WITH {RIB} SELECT (SELECT count(*) FROM (SELECT * FROM speaker_events {_LAST.format('speaker_addr')}) WHERE event_type = 'speaker_up') AS speakers, (SELECT count(*) FROM (SELECT * FROM peer_events {_LAST.format('speaker_addr, peer_addr')}) WHERE event_type = 'peer_up') AS peers_up, (SELECT count(*) FROM rib) AS routes, (SELECT count(*) FROM vrps) AS vrps")(lambda v: A.totals(v.speaker_events, v.peer_events, v.route_events, v.vrps))
add("hourly_churn", f"SELECT prefix, {HOUR} AS hour, count(*) AS events FROM route_events GROUP BY ALL")(lambda v: A.hourly_churn(v.route_events))
add("over_budget", "SELECT time_bucket(INTERVAL 3600 SECONDS, occurred_at) AS start, count(*) AS events, count(*) > 14 AS over FROM route_events GROUP BY 1")(lambda v: A.over_budget(v.route_events.withColumn("k", F.lit(1)), 14 / 3600, 3600))
add("shed_stats", "WITH o AS (SELECT time_bucket(INTERVAL 3600 SECONDS, occurred_at) AS start FROM route_events GROUP BY 1 HAVING count(*) > 14) SELECT event_id, peer_addr FROM stats_events WHERE time_bucket(INTERVAL 3600 SECONDS, occurred_at) NOT IN (FROM o)")(lambda v: A.shed(v.route_events, v.stats_events, 14 / 3600, 3600).select("event_id", "peer_addr"))
# windows -----------------------------------------------------------------------------------------------------------------------------------------------------------
add("convergence_gaps", f"SELECT event_id, occurred_at, prefix, peer_addr, action, round(({US} - lag({US}) OVER (PARTITION BY prefix, peer_addr ORDER BY occurred_at, event_id)) / 1e6, 6) AS gap_s FROM route_events")(lambda v: W.convergence_gaps(v.route_events))
add("session_timeline", f"SELECT event_id, occurred_at, speaker_addr, peer_addr, event_type, round((lead({US}) OVER (PARTITION BY speaker_addr, peer_addr ORDER BY occurred_at, event_id) - {US}) / 1e6, 6) AS until_next_s FROM peer_events")(lambda v: W.session_timeline(v.peer_events))
_SESS = "isle AS (SELECT *, coalesce(sum(CASE WHEN event_type = 'peer_down' THEN 1 ELSE 0 END) OVER (PARTITION BY speaker_addr, peer_addr ORDER BY occurred_at, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM peer_events), s AS (SELECT speaker_addr, peer_addr, k, max(occurred_at) FILTER (event_type <> 'peer_down') AS up_at, max(occurred_at) FILTER (event_type = 'peer_down') AS down_at FROM isle GROUP BY ALL)"
add("sessions", f"WITH {_SESS} SELECT speaker_addr, peer_addr, up_at, down_at, round((epoch_us(down_at) - epoch_us(up_at)) / 1e6, 6) AS duration_s, down_at IS NULL AS ongoing FROM s WHERE up_at IS NOT NULL")(lambda v: W.sessions(v.peer_events))
add("longest_sessions", f"WITH {_SESS} SELECT speaker_addr, peer_addr, count(*) AS sessions, max(round((epoch_us(down_at) - epoch_us(up_at)) / 1e6, 6)) AS longest_s FROM s WHERE up_at IS NOT NULL GROUP BY ALL")(lambda v: W.longest_sessions(v.peer_events))
_Z = f"h AS (SELECT prefix, {HOUR} AS hour, count(*) AS events FROM route_events GROUP BY ALL), z AS (SELECT *, avg(events) OVER w AS m, stddev_pop(events) OVER w AS s, count(*) OVER w AS n FROM h WINDOW w AS (PARTITION BY prefix ORDER BY hour ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)), y AS (SELECT prefix, hour, events, round(CASE WHEN n < 2 OR s = 0 THEN 0 ELSE (events - m) / s END, 6) AS z FROM z)"
add("rolling_zscore", f"WITH {_Z} SELECT *, abs(z) > 3 AS anomalous FROM y")(lambda v: D.hourly_anomalies(v.route_events))
add("rolling_median", """WITH s AS (SELECT *, row_number() OVER (PARTITION BY peer_addr ORDER BY occurred_at, event_id) AS i FROM stats_events),
w AS (SELECT a.event_id, median(b.counter_value) AS m, count(b.counter_value) AS n FROM s a LEFT JOIN s b ON a.peer_addr = b.peer_addr AND b.i < a.i AND b.i >= a.i - 2000 AND b.occurred_at < a.occurred_at
 AND b.occurred_at >= a.occurred_at - INTERVAL 7 DAYS GROUP BY a.event_id)
SELECT event_id, round(m, 6) AS median, CAST(n AS INT) AS prior FROM w""")(lambda v: C.rolling_median(v.stats_events, "peer_addr", "counter_value").select("event_id", F.round(F.col("median").cast("double"), 6).alias("median"), "prior"))
_TRAIL = f"t AS (SELECT *, avg(as_path_len) OVER w AS m, count(*) OVER w AS n FROM route_events WHERE {ANN} AND as_path_len > 0 WINDOW w AS (PARTITION BY prefix ORDER BY occurred_at, event_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))"
add("trailing_path_mean", f"WITH {_TRAIL} SELECT event_id, round(m, 6) AS mean_before, n AS before FROM t")(lambda v: W.trailing_path_mean(v.route_events).select("event_id", F.round("mean_before", 6).alias("mean_before"), "before"))
_MIN = f"t AS (SELECT *, min(as_path_len) OVER (PARTITION BY prefix, peer_addr ORDER BY occurred_at, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS min_before FROM route_events WHERE {ANN} AND as_path_len > 0)"
add("running_min_path", f"WITH {_MIN} SELECT event_id, as_path_len, min_before FROM t")(lambda v: W.running_min_path(v.route_events).select("event_id", "as_path_len", "min_before"))
# joins ---------------------------------------------------------------------------------------------------------------------------------------------------------------
add("validate_origins", f"WITH {VALID} SELECT event_id, prefix, origin_asn, rpki_validity, more_specific FROM judged")(lambda v: v.judged.select("event_id", "prefix", "origin_asn", "rpki_validity", "more_specific"))
_HOPS = f"p AS (SELECT event_id, as_path, {ONCE} AS a FROM route_events WHERE as_path IS NOT NULL), h AS (SELECT event_id, unnest(range(1, len(a))) AS i, a FROM p), j AS (SELECT event_id, i, a[i] AS provider, a[i + 1] AS customer, a[i + 1] IN (SELECT customer_asn FROM aspa) AS known, (a[i + 1], a[i]) IN (SELECT (customer_asn, provider_asn) FROM aspa) AS fits FROM h), f AS (SELECT event_id, bool_or(NOT known) AS open, min((i, customer, provider)) FILTER (known AND NOT fits) AS bad FROM j GROUP BY 1)"
add("validate_paths", f"WITH {_HOPS} SELECT r.event_id, CASE WHEN r.as_path IS NULL THEN 'unknown' WHEN bad IS NOT NULL THEN 'invalid' WHEN open THEN 'unknown' ELSE 'valid' END AS verdict, bad[2] AS bad_customer, bad[3] AS bad_provider FROM route_events r LEFT JOIN f USING (event_id)")(lambda v: J.validate_paths(v.route_events, v.aspa))
add("key_coverage", f"WITH s AS (SELECT event_id, CASE WHEN as_path IS NULL THEN NULL ELSE {ASNS} END AS a FROM route_events), k AS (SELECT DISTINCT customer_asn AS asn FROM aspa), m AS (SELECT event_id, min(i) AS i FROM (SELECT event_id, unnest(range(1, len(a) + 1)) AS i, a FROM s) x WHERE a[i] NOT IN (FROM k) GROUP BY 1) SELECT event_id, CASE WHEN a IS NULL THEN 'absent' WHEN len(a) = 0 THEN 'malformed' WHEN i IS NOT NULL THEN 'not_found' ELSE 'valid' END AS verdict, a[i] AS first_missing FROM s LEFT JOIN m USING (event_id)")(lambda v: J.key_coverage(v.route_events.select("event_id", F.when(F.col("as_path").isNotNull(), X.asns("as_path")).alias("signers")), v.aspa.select(F.col("customer_asn").alias("asn"))))
_REG = f"reg AS (SELECT DISTINCT prefix, o AS origin_asn, 'REG' || CAST(o % 2 AS STRING) AS source FROM (SELECT prefix, {ORIGIN} AS o FROM route_events WHERE {ANN}) WHERE o < 65200 AND o % 3 <> 0)"
add("registry_check", f"WITH {_REG}, p AS (SELECT DISTINCT prefix, {ORIGIN} AS origin_asn FROM route_events WHERE {ORIGIN} IS NOT NULL) SELECT prefix, origin_asn, CASE WHEN EXISTS (FROM reg WHERE reg.prefix = p.prefix AND reg.origin_asn = p.origin_asn) THEN 'match' WHEN EXISTS (FROM reg WHERE reg.prefix = p.prefix) THEN 'mismatch' ELSE 'not_found' END AS status FROM p")(lambda v: J.registry_check(v.route_events, v.registry))
_CH = "c AS (SELECT event_id AS change_id, speaker_addr, event_id % 3 AS state, occurred_at AS start_at, occurred_at + INTERVAL 5 HOURS AS end_at FROM peer_events WHERE event_id % 20 = 7)"
add("open_changes", f"WITH {_CH} SELECT e.event_id, c.change_id FROM stats_events e JOIN c ON e.speaker_addr = c.speaker_addr AND c.state = 2 AND floor(epoch(e.occurred_at)) BETWEEN floor(epoch(start_at)) - 7200 AND floor(epoch(end_at)) + 7200")(lambda v: J.open_changes(v.stats_events, v.peer_events.where("event_id % 20 = 7").select(F.col("event_id").alias("change_id"), "speaker_addr", (F.col("event_id") % 3).alias("state"), F.col("occurred_at").alias("start_at"), (F.col("occurred_at") + F.expr("INTERVAL 5 HOURS")).alias("end_at")), 2).select("event_id", "change_id"))
_EXT = f"i AS (SELECT prefix, list_sort(list(DISTINCT {ORIGIN})) AS a FROM rib WHERE prefix NOT LIKE '20.4%' GROUP BY 1), x AS (SELECT prefix, list_sort(list(DISTINCT {ORIGIN})) AS b, count(DISTINCT peer_addr) AS seeing FROM rib WHERE prefix NOT LIKE '20.5%' AND event_id % 3 > 0 GROUP BY 1), j AS (SELECT prefix, a, b, seeing FROM i FULL JOIN x USING (prefix))"
add("visibility_gaps", f"""WITH {RIB}, {_EXT} SELECT prefix, 'only_internal' AS rule FROM j WHERE b IS NULL UNION ALL SELECT prefix, 'only_external' FROM j WHERE a IS NULL UNION ALL SELECT prefix, 'origin_mismatch' FROM j WHERE a IS NOT NULL AND len(list_filter(b, lambda o: NOT list_contains(a, o))) > 0 UNION ALL SELECT prefix, 'low_visibility' FROM j WHERE seeing * 2 < 12""")(lambda v: J.visibility_gaps(L.current_rib(v.route_events).where("prefix NOT LIKE '20.4%'").select("prefix", X.origin_asn("as_path").alias("origin_asn")), (e := L.current_rib(v.route_events).where("prefix NOT LIKE '20.5%' AND event_id % 3 > 0").select("prefix", "peer_addr", X.origin_asn("as_path").alias("origin_asn"))).join(e.groupBy("prefix").agg(F.countDistinct("peer_addr").alias("peers_seeing"), F.lit(12).alias("peers_total")), "prefix")).select("prefix", "rule"))
_CL = "cl AS (SELECT 'p' AS policy, i AS seq, CASE WHEN i % 2 = 0 THEN 'deny' ELSE 'permit' END AS term, '20.' || CAST(i * 8 AS STRING) || '.0.0' AS net, CASE WHEN i % 4 = 1 THEN '65000:111' END AS want_c, CASE WHEN i % 3 = 0 THEN 140 END AS want_p FROM range(14) t(i))"
_IN = f"{_LEN.format('prefix')} >= 13 AND {_NUM.format('prefix')} // 524288 = {_NUM.format('net')} // 524288"
add("policy_conflicts", f"""WITH {RIB}, {_CL}, h AS (SELECT cl.*, prefix, communities, local_pref FROM cl JOIN rib ON {_IN})
SELECT seq, prefix, 'leaked' AS kind, count(*) AS n FROM h WHERE term = 'deny' GROUP BY ALL UNION ALL SELECT seq, prefix, 'community_mismatch', count(*) FROM h WHERE term = 'permit' AND want_c IS NOT NULL AND NOT list_contains(string_split(coalesce(communities, ''), ','), want_c) GROUP BY ALL
UNION ALL SELECT seq, prefix, 'local_pref_drift', count(*) FROM h WHERE term = 'permit' AND want_p IS NOT NULL AND local_pref IS DISTINCT FROM want_p GROUP BY ALL UNION ALL SELECT seq, NULL, 'blocked', 1 FROM cl WHERE term = 'permit' AND seq NOT IN (SELECT seq FROM h)""")(lambda v: J.policy_conflicts(L.current_rib(v.route_events).select("prefix", "communities", "local_pref"), v.spark.range(14).selectExpr("'p' AS policy", "CAST(id AS BIGINT) AS seq", "CASE WHEN id % 2 = 0 THEN 'deny' ELSE 'permit' END AS action", "concat('20.', id * 8, '.0.0/13') AS prefix", "CASE WHEN id % 4 = 1 THEN '65000:111' END AS community", "CASE WHEN id % 3 = 0 THEN 140 END AS local_pref")).groupBy("seq", "prefix", "kind").agg(F.count("*").alias("n")))
add("dossier", f"""WITH {_REG}, b AS (SELECT prefix, {ORIGIN} AS origin_asn, count(DISTINCT peer_addr) AS peers FROM route_events WHERE {ANN} GROUP BY ALL) SELECT b.prefix, b.origin_asn, peers, coalesce((SELECT string_agg(source, ',' ORDER BY source) FROM reg WHERE reg.prefix = b.prefix AND reg.origin_asn = b.origin_asn), '') AS sources, CASE WHEN b.origin_asn % 2 = 0 THEN 'A' || CAST(b.origin_asn AS STRING) WHEN b.origin_asn % 5 > 0 THEN 'B' || CAST(b.origin_asn AS STRING) END AS as_name FROM b""")(lambda v: J.dossier(v.route_events, v.registry, (o := v.route_events.select(X.origin_asn("as_path").alias("asn")).distinct()).where("asn % 2 = 0").withColumn("name", F.concat(F.lit("A"), F.col("asn").cast("string"))), o.where("asn % 5 > 0").withColumn("name", F.concat(F.lit("B"), F.col("asn").cast("string")))).withColumn("sources", F.array_join("sources", ",")))
_SETS = "m AS (SELECT DISTINCT 'AS-' || CAST(provider_asn - 65000 AS STRING) AS set_name, 'AS' || CAST(customer_asn AS STRING) AS member FROM aspa UNION SELECT DISTINCT 'AS-' || CAST(provider_asn - 65000 AS STRING), 'AS-' || CAST((provider_asn - 65000 + 3) % 9 AS STRING) FROM aspa WHERE provider_asn % 2 = 0)"
add("expand_sets", f"WITH RECURSIVE {_SETS}, w AS (SELECT set_name, member, 0 AS d FROM m UNION SELECT w.set_name, m.member, d + 1 FROM w JOIN m ON w.member = m.set_name WHERE d < 2) SELECT DISTINCT set_name, CAST(substr(member, 3) AS BIGINT) AS asn FROM w WHERE member NOT LIKE 'AS-%'")(lambda v: J.expand_sets((n := F.col("provider_asn") - 65000) is not None and v.aspa.select(F.concat(F.lit("AS-"), n.cast("string")).alias("set_name"), F.concat(F.lit("AS"), F.col("customer_asn").cast("string")).alias("member")).union(v.aspa.where("provider_asn % 2 = 0").select(F.concat(F.lit("AS-"), n.cast("string")), F.concat(F.lit("AS-"), ((n + 3) % 9).cast("string")))).distinct()))
add("sub_prefixes", f"WITH p AS (SELECT DISTINCT prefix, {_NUM.format('prefix')} AS n, {_LEN.format('prefix')} AS l FROM route_events UNION SELECT '20.0.0.0/9', {20 << 24}, 9) SELECT a.prefix, arg_max(b.prefix, (b.l, b.prefix)) AS parent FROM p a JOIN p b ON b.l < a.l AND a.n // CAST(pow(2, 32 - b.l) AS BIGINT) = b.n // CAST(pow(2, 32 - b.l) AS BIGINT) GROUP BY 1")(lambda v: J.sub_prefixes(v.route_events.select("prefix").union(v.spark.createDataFrame([("20.0.0.0/9",)], "prefix string"))))
# policy ------------------------------------------------------------------------------------------------------------------------------------------------------------
_RULES = [R.Rule("short", "deny", prefix_list=["20.16.0.0/12"], peer_as_list=[65001, 65004]), R.Rule("marked", "accept", community_list=["65000:111", "65000:222"], local_pref_min=100), R.Rule("via", "deny", as_path_contains=[64603], local_pref_max=140), R.Rule("cheap", "tag", med_max=10), R.Rule("expr", "deny", when="prefix_len > 20 AND NOT has_prepend AND local_pref >= 110")]
add("route_policy", f"""WITH c AS (SELECT *, coalesce(local_pref, 0) AS lp, coalesce(med, 0) AS m, {_NUM.format('prefix')} AS n, {_LEN.format('prefix')} AS l, coalesce(as_path, '') AS p FROM route_events), x AS (SELECT *, CASE WHEN n // 1048576 = {(20 << 24 | 16 << 16) >> 20} AND l >= 12 AND peer_as IN (65001, 65004) THEN 'short' WHEN (list_has_any(string_split(coalesce(communities, ''), ','), ['65000:111', '65000:222'])) AND lp >= 100 THEN 'marked'
 WHEN list_contains(string_split(p, ' '), '64603') AND lp <= 140 THEN 'via' WHEN m <= 10 THEN 'cheap' WHEN l > 20 AND coalesce(as_path_len, 0) <> 4 AND coalesce(local_pref, 100) >= 110 THEN 'expr' END AS matched_rule FROM c) SELECT event_id, matched_rule, CASE WHEN matched_rule IN ('short', 'via', 'expr') THEN 'deny' ELSE 'accept' END AS verdict FROM x""")(lambda v: R.apply_rules(v.route_events, _RULES).select("event_id", "matched_rule", "verdict"))
add("default_policy", f"WITH {VALID} SELECT verdict, matched_rule, count(*) AS routes FROM (SELECT CASE WHEN action = 'withdraw' THEN 'withdraw' WHEN rpki_validity = 'invalid' AND {_LEN.format('prefix')} > 24 THEN 'hijack' WHEN list_contains(string_split(coalesce(communities, ''), ','), '65535:666') THEN 'blackhole' END AS matched_rule, CASE WHEN action <> 'withdraw' AND rpki_validity = 'invalid' AND {_LEN.format('prefix')} > 24 THEN 'deny' ELSE 'accept' END AS verdict FROM judged) GROUP BY ALL")(lambda v: R.apply_rules(v.judged, R.default_rules()).groupBy("verdict", "matched_rule").agg(F.count("*").alias("routes")))
add("verdict_counts", "SELECT CASE WHEN local_pref < 140 AND peer_as = 65003 THEN 'deny' ELSE 'accept' END AS verdict, count(*) AS routes FROM route_events GROUP BY 1")(lambda v: R.verdict_counts(R.apply_rules(v.route_events, [R.Rule("x", "deny", peer_as_list=[65003], when=F.col("local_pref") < 140)])))
_ADV = "v AS (SELECT *, CASE event_id % 3 WHEN 0 THEN 'accept' WHEN 1 THEN 'deny' ELSE 'fall_through' END AS verdict FROM judged)"
add("policy_advice", f"""WITH {VALID}, {_ADV}, e AS (SELECT *, CASE WHEN verdict = 'accept' AND (rpki_validity = 'invalid' OR (as_path IS NOT NULL AND rpki_validity <> 'valid')) THEN 'should_reject' WHEN verdict = 'deny' AND (rpki_validity = 'valid' OR list_contains(string_split(coalesce(communities, ''), ','), '65000:111')) THEN 'should_accept' WHEN verdict = 'fall_through' THEN 'fall_through' END AS kind FROM v)
SELECT event_id, kind, CASE WHEN kind = 'should_reject' THEN CASE WHEN rpki_validity = 'invalid' THEN 0.95 ELSE 0.75 END WHEN kind = 'should_accept' THEN CASE WHEN rpki_validity = 'valid' THEN 0.8 ELSE 0.65 END ELSE 0.5 END AS confidence FROM e WHERE kind IS NOT NULL""")(lambda v: R.advise(v.judged.withColumn("verdict", F.expr("CASE event_id % 3 WHEN 0 THEN 'accept' WHEN 1 THEN 'deny' ELSE 'fall_through' END")), ["65000:111"]).select("event_id", "kind", F.col("confidence").cast("decimal(4,2)").alias("confidence")))
add("rejection_reasons", f"WITH {VALID} SELECT event_id, CASE WHEN rpki_validity = 'invalid' THEN 'origin is invalid' || CASE WHEN priv <> '' THEN '; private AS in path: ' || priv ELSE '' END WHEN priv <> '' THEN 'private AS in path: ' || priv ELSE 'no rule matched; denied by default' END AS reason FROM (SELECT *, coalesce(array_to_string(list_filter({ASNS}, lambda a: a BETWEEN 64512 AND 65534), ','), '') AS priv FROM judged)")(lambda v: R.explain(v.judged).select("event_id", "reason"))
# detectors ---------------------------------------------------------------------------------------------------------------------------------------------------------
_OWN = f"own AS (SELECT *, {ORIGIN} AS origin FROM route_events WHERE {ANN})"
add("new_origins", f"WITH {_OWN}, f AS (SELECT * FROM own QUALIFY row_number() OVER (PARTITION BY prefix, origin ORDER BY occurred_at, event_id) = 1) SELECT b.event_id, b.occurred_at, b.prefix, b.peer_addr, b.origin AS new_origin, a.origin AS old_origin FROM f a JOIN f b ON a.prefix = b.prefix AND (a.occurred_at, a.event_id) < (b.occurred_at, b.event_id)")(lambda v: D.new_origins(v.route_events))
add("shortened_paths", f"WITH {_TRAIL} SELECT event_id, occurred_at, prefix, peer_addr, as_path_len, round(m, 6) AS mean_before FROM t WHERE n >= 5 AND as_path_len < m * 0.9")(lambda v: D.shortened_paths(v.route_events, share=0.9))
add("otc_leaks", f"SELECT event_id, occurred_at, prefix, peer_addr FROM route_events WHERE {ANN} AND only_to_customer IS NOT NULL AND peer_addr NOT IN ('10.0.1.2', '10.0.2.3')")(lambda v: D.otc_leaks(v.route_events, v.peer_max_prefix.where("peer_addr IN ('10.0.1.2', '10.0.2.3')")))
_SEV = "CASE rpki_validity WHEN 'invalid' THEN 'critical' WHEN 'valid' THEN 'info' ELSE 'warning' END AS severity"
add("origin_changes", f"WITH {VALID}, g AS (SELECT *, lag(origin_asn) OVER w AS old, (epoch_us(occurred_at) - lag(epoch_us(occurred_at)) OVER w) / 1e6 AS st FROM judged WHERE {ANN} WINDOW w AS (PARTITION BY prefix, peer_addr ORDER BY occurred_at, event_id)) SELECT event_id, occurred_at, prefix, peer_addr, old AS old_origin, origin_asn AS new_origin, round(st, 6) AS stable_s, {_SEV} FROM g WHERE old <> origin_asn AND st >= 300")(lambda v: D.origin_changes(v.route_events, v.roas))
add("leaks", f"WITH {_MIN} SELECT event_id, occurred_at, prefix, peer_addr, CASE WHEN only_to_customer IS NOT NULL THEN 'otc' ELSE 'short' END AS evidence FROM t WHERE only_to_customer IS NOT NULL OR min_before - as_path_len >= 3")(lambda v: D.leaks(v.route_events))
add("hijacks", f"WITH {VALID}, o AS (SELECT * FROM judged WHERE {ANN}), g AS (SELECT a.event_id, a.occurred_at, a.prefix, a.peer_addr, a.origin_asn, a.rpki_validity, list_sort(list(DISTINCT b.origin_asn)) AS seen FROM o a JOIN o b ON a.prefix = b.prefix AND epoch_us(b.occurred_at) BETWEEN epoch_us(a.occurred_at) - 86400000000 AND epoch_us(a.occurred_at) - 1 GROUP BY ALL) SELECT event_id, occurred_at, prefix, peer_addr, origin_asn AS new_origin, array_to_string(seen, ' ') AS known, {_SEV} FROM g WHERE NOT list_contains(seen, origin_asn)")(lambda v: D.hijacks(v.route_events, v.roas, 86400))
add("convergence_percentiles", f"WITH {_SESS}, e AS (SELECT (epoch_us(down_at) - epoch_us(up_at)) / 1e3 AS convergence_ms FROM s WHERE up_at IS NOT NULL AND down_at IS NOT NULL) SELECT round(quantile_cont(convergence_ms, 0.5), 6) AS p50, round(quantile_cont(convergence_ms, 0.9), 6) AS p90, round(quantile_cont(convergence_ms, 0.99), 6) AS p99, count(*) AS episodes FROM e")(lambda v: A.convergence_percentiles(W.sessions(v.peer_events).where("NOT ongoing").select(((F.unix_micros("down_at") - F.unix_micros("up_at")) / 1e3).alias("convergence_ms")), exact=True))
_EP = f"{_SESS}, e AS (SELECT peer_addr, up_at AS t, (epoch_us(down_at) - epoch_us(up_at)) / 1e3 AS ms FROM s WHERE up_at IS NOT NULL AND down_at IS NOT NULL), i AS (SELECT *, row_number() OVER (PARTITION BY peer_addr ORDER BY t, ms) AS i FROM e), m AS (SELECT a.peer_addr, a.t, a.ms, a.i, median(b.ms) AS med, count(b.ms) AS n FROM i a LEFT JOIN i b ON a.peer_addr = b.peer_addr AND b.i < a.i AND b.i >= a.i - 2000 AND b.t < a.t AND b.t >= a.t - INTERVAL 7 DAYS GROUP BY ALL)"
add("slow_convergence", f"WITH {_EP} SELECT peer_addr, t AS started_at, ms AS convergence_ms, med AS median, round(ms / med, 6) AS ratio, CASE WHEN ms / med >= 6 THEN 'critical' ELSE 'warning' END AS severity FROM m WHERE n >= 3 AND med > 0 AND ms / med >= 3")(lambda v: D.slow_convergence(W.sessions(v.peer_events).where("NOT ongoing").select("peer_addr", F.col("up_at").alias("started_at"), ((F.unix_micros("down_at") - F.unix_micros("up_at")) / 1e3).alias("convergence_ms"))))
add("flap_scores", "WITH s AS (SELECT greatest((epoch_us(max(occurred_at)) - epoch_us(min(occurred_at))) / 3.6e9, 1.0) AS h FROM peer_events), d AS (SELECT peer_addr, count(*) AS downs FROM peer_events WHERE event_type = 'peer_down' GROUP BY 1) SELECT peer_addr, downs, round(downs / h, 6) AS per_hour, CASE WHEN downs / h < 3 THEN 'low' WHEN downs / h < 10 THEN 'medium' ELSE 'high' END AS severity FROM d, s")(lambda v: D.flap_scores(v.peer_events))
# graphs --------------------------------------------------------------------------------------------------------------------------------------------------------------
_E = f"e AS (SELECT src, dst, count(*) AS routes FROM (SELECT unnest(list_transform(range(1, len(a)), lambda i: (a[i], a[i + 1]))) AS p, p[1] AS src, p[2] AS dst FROM (SELECT {ONCE} AS a FROM route_events WHERE {ANN})) GROUP BY ALL)"
add("path_edges", f"WITH {_E} SELECT * FROM e")(lambda v: G.path_edges(v.route_events))
add("adjacency", f"WITH {_E} SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e WHERE src <> dst")(lambda v: G.adjacency(v.route_events))
add("as_degrees", f"WITH {_E}, j AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e WHERE src <> dst), d AS (SELECT asn, count(*) AS degree FROM (SELECT a AS asn FROM j UNION ALL SELECT b FROM j) GROUP BY 1) SELECT asn, degree, asn IN (SELECT src FROM e) AND asn IN (SELECT dst FROM e) AS transit FROM d")(lambda v: G.degrees(v.route_events))
_ED = "e AS (SELECT local_router_id AS src, remote_router_id AS dst, min(CAST(igp_metric AS BIGINT)) AS metric FROM bgpls_links GROUP BY ALL)"
add("shortest_paths", f"WITH RECURSIVE {_ED}, w AS (SELECT DISTINCT src AS source, src AS node, CAST(0 AS BIGINT) AS distance, 0 AS k FROM e UNION SELECT source, dst, min(distance + metric), k + 1 FROM w JOIN e ON node = src WHERE k < 24 GROUP BY source, dst, k) SELECT source, node, min(distance) AS distance FROM w GROUP BY ALL")(lambda v: G.shortest_paths(v.links).select("source", "node", "distance"))
add("blast_radius", f"WITH RECURSIVE {_ED}, w AS (SELECT '10.255.0.3' AS node, 0 AS k UNION SELECT dst, k + 1 FROM w JOIN e ON node = src WHERE k < 3) SELECT node, min(k) AS hops FROM w WHERE node <> '10.255.0.3' GROUP BY 1")(lambda v: G.blast_radius(v.links, "10.255.0.3"))
add("diverse_paths", "WITH RECURSIVE w AS (SELECT '10.255.0.3' AS node, ['10.255.0.3'] AS nodes, CAST(0 AS BIGINT) AS metric, CAST([] AS VARCHAR[]) AS g UNION ALL SELECT remote_router_id, list_append(nodes, remote_router_id), metric + igp_metric, list_append(g, srlg_groups) FROM w JOIN bgpls_links ON node = local_router_id WHERE NOT list_contains(nodes, remote_router_id) AND node <> '10.255.0.9' AND len(nodes) <= 6), d AS (SELECT array_to_string(nodes, ' ') AS path, metric, g FROM w WHERE node = '10.255.0.9'), f AS (SELECT * FROM d ORDER BY metric, path LIMIT 1) SELECT d.path, d.metric, d.path = f.path AS primary FROM d, f WHERE d.path = f.path OR NOT list_has_any(d.g, f.g)")(lambda v: G.diverse_paths(v.links, "10.255.0.3", "10.255.0.9", 6))
# features and models -----------------------------------------------------------------------------------------------------------------------------------------------
add("outliers", f"WITH s AS (SELECT prefix, count(*) AS score FROM route_events GROUP BY 1) SELECT prefix, score FROM s WHERE score > (SELECT avg(score) + stddev_pop(score) FROM s)")(lambda v: M.outliers(v.route_events.groupBy("prefix").agg(F.count("*").alias("score")), 1.0))
add("route_features", f"SELECT event_id, CAST(coalesce(as_path_len, 0) AS DOUBLE) AS path_len, CAST({_LEN.format('prefix')} AS DOUBLE) AS prefix_len, CAST(coalesce(local_pref, 100) AS DOUBLE) AS local_pref, CAST(coalesce(med, 0) AS DOUBLE) AS med, CAST(CASE WHEN communities IS NULL THEN 0 ELSE len(string_split(communities, ',')) END AS DOUBLE) AS n_communities, 0.5 :: DOUBLE AS rpki, CAST(action = 'withdraw' AS DOUBLE) AS is_withdraw, CASE WHEN as_path_len = 4 THEN 1.0 ELSE 0.0 END :: DOUBLE AS has_prepend FROM route_events")(lambda v: M.route_features(v.route_events))
add("isolation_forest", None)(lambda v: M.isolation_forest(M.route_features(v.route_events)))
_HF = f"h AS (SELECT event_id, CAST(coalesce(lag(origin_asn) OVER w <> origin_asn, false) AS INT) AS origin_changed, CASE rpki_validity WHEN 'valid' THEN 0 WHEN 'invalid' THEN 2 ELSE 1 END AS rpki, CAST(coalesce(as_path_len - lag(as_path_len) OVER w, 0) AS INT) AS path_delta, CASE WHEN peer_as < 65006 THEN 1 ELSE 0 END AS peer_expected FROM judged WHERE {ANN} WINDOW w AS (PARTITION BY prefix, peer_addr ORDER BY occurred_at, event_id))"
add("hijack_score", f"WITH {VALID}, {_HF}, s AS (SELECT *, round(least(1, greatest(0, 0.3 * origin_changed + CASE rpki WHEN 2 THEN 0.25 WHEN 0 THEN -0.15 ELSE 0 END + CASE WHEN path_delta <= -3 THEN 0.1 ELSE 0 END - 0.2 * peer_expected)), 6) :: DOUBLE AS score FROM h) SELECT *, score >= 0.5 AS is_hijack FROM s")(lambda v: M.hijack_score(M.hijack_features(v.judged, v.peer_max_prefix.where("peer_as < 65006"))).select("event_id", "origin_changed", "rpki", "path_delta", "peer_expected", "score", "is_hijack"))
# sinks -----------------------------------------------------------------------------------------------------------------------------------------------------------------
add("route_export", f"WITH {VALID} SELECT event_id, {_LEN.format('prefix')} AS prefix_len, CAST({ANN} AS INT) AS is_announce, origin_asn, coalesce(as_path_len, 0) AS as_path_len, CAST(coalesce(local_pref, 100) AS BIGINT) AS local_pref, CAST(coalesce(med, 0) AS BIGINT) AS med, CASE rpki_validity WHEN 'valid' THEN 1 WHEN 'invalid' THEN -1 ELSE 0 END AS rpki_code FROM judged")(lambda v: S.route_export(v.judged).select("event_id", "prefix_len", "is_announce", "origin_asn", "as_path_len", "local_pref", "med", "rpki_code"))
add("peer_export", "WITH p AS (SELECT peer_addr, count(*) FILTER (event_type = 'peer_up') AS ups, count(*) FILTER (event_type = 'peer_down') AS downs FROM peer_events GROUP BY 1) SELECT peer_addr, ups, downs, coalesce((SELECT count(*) FROM route_events r WHERE r.peer_addr = p.peer_addr), 0) AS routes FROM p")(lambda v: S.peer_export(v.peer_events, v.route_events))
add("prefix_export", f"""WITH o AS (SELECT prefix, {ORIGIN} AS o, count(*) AS n FROM route_events WHERE {ORIGIN} IS NOT NULL GROUP BY ALL), b AS (SELECT prefix, o AS main_origin FROM o QUALIFY row_number() OVER (PARTITION BY prefix ORDER BY n DESC, o) = 1)
SELECT prefix, count(*) AS events, count(*) FILTER ({ANN}) AS announces, count(*) FILTER (NOT ({ANN})) AS withdraws, count(DISTINCT peer_addr) AS peers, count(DISTINCT {ORIGIN}) AS origins, round(avg(as_path_len), 6) AS mean_path_len, min(as_path_len) AS min_path_len, max(as_path_len) AS max_path_len, round(avg(local_pref), 6) AS mean_local_pref, round(count(*) FILTER (occurred_at >= {_T} - INTERVAL 1 HOUR) / 3600, 9) AS churn_rate_1h, any_value(main_origin) AS main_origin FROM route_events LEFT JOIN b USING (prefix) GROUP BY 1""")(lambda v: S.prefix_export(v.route_events, AS_OF))
add("export_range", f"SELECT {ROUTE} FROM route_events WHERE occurred_at BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-12 00:00:00'")(lambda v: S.export_range(v.route_events, "route_events", since="2024-01-05 00:00:00", until="2024-01-12 00:00:00").select(*_R))
add("vrp_delta", "SELECT net || '/' || CAST(vlen AS STRING) AS prefix, max_len, origin_asn FROM vrps WHERE origin_asn % 4 <> 0 UNION ALL SELECT '20.90.0.0/16', 24, 64790")(lambda v: S.apply_vrp_delta(v.roas, v.roas.where("origin_asn % 4 = 0"), v.spark.createDataFrame([("20.90.0.0/16", 24, 64790)], "prefix string, max_len int, origin_asn bigint")))
add("retained_routes", f"SELECT {ROUTE} FROM route_events WHERE occurred_at >= {_T} - INTERVAL 10 DAYS")(lambda v: S.retain(v.route_events, 10, AS_OF).select(*_R))
add("row_counts", "SELECT 'peer_events' AS table_name, count(*) AS n FROM peer_events UNION ALL SELECT 'route_events', count(*) FROM route_events UNION ALL SELECT 'stats_events', count(*) FROM stats_events")(lambda v: S.row_counts({n: getattr(v, n) for n in ("route_events", "peer_events", "stats_events")}))
add("limit_upserts", f"SELECT peer_addr, CAST(max_prefix AS BIGINT) AS max_prefix FROM (SELECT speaker_addr, peer_addr, occurred_at AS t, event_id % 50 AS max_prefix FROM peer_events WHERE event_id % 50 > 0) QUALIFY row_number() OVER (PARTITION BY speaker_addr, peer_addr ORDER BY t DESC, max_prefix DESC) = 1")(lambda v: S.upsert_limits(v.peer_events.select("speaker_addr", "peer_addr", F.lit("ipv4-unicast").alias("afi_safi"), F.col("occurred_at").alias("updated_at"), (F.col("event_id") % 50).cast("bigint").alias("max_prefix"))).select("peer_addr", "max_prefix"))
add("state_changes", "SELECT event_id, occurred_at, peer_addr, peer_as, CASE WHEN event_type = 'peer_up' THEN 3 ELSE 6 END AS old_state, CASE WHEN event_type = 'peer_up' THEN 6 ELSE 1 END AS new_state FROM peer_events")(lambda v: S.state_changes(v.peer_events))
add("ad_hoc_select", "SELECT peer_addr, count(*) AS n FROM route_events GROUP BY 1")(lambda v: S.select_only(v.spark, "SELECT peer_addr, count(*) AS n FROM routes_now GROUP BY 1", {"routes_now": v.route_events}))
