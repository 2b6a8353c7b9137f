"""More of the library's queries: alerts, features, models, listings, documents for other systems, texts of wire values."""

from __future__ import annotations

from pyspark.sql import functions as F

from skerry.functions import scalars as X
from skerry.operators import aggregates as A
from skerry.operators import canned
from skerry.operators import detectors as D
from skerry.operators import graph as G
from skerry.operators import joins as J
from skerry.operators import ml as M
from skerry.operators import policy as R
from skerry.operators import state as L
from skerry.plans.catalogue import _LAST, _MIN, _OWN, _SEV, _T, _TRAIL, _Z, ANN, LABEL, ORIGIN, VALID, Views, add
from skerry.plans.fixtures import AS_OF
from skerry.sources import tables as S
from skerry.streaming import stateful as T

# features ------------------------------------------------------------------------------------------------------------------------------------------------------------
MARK = "CASE event_id % 7 WHEN 0 THEN 'best' WHEN 1 THEN 'ecmp' WHEN 2 THEN 'backup' WHEN 3 THEN 'nonselected' WHEN 4 THEN 'filtered' WHEN 5 THEN 'stale' END"


def features_sql(slices: int, minutes: int) -> str:
    marks = ", ".join(f"count(*) FILTER ({ANN} AND mark = '{m}') AS {m}_count" for m in ("best", "ecmp", "backup", "filtered", "nonselected"))
    return f"""WITH {VALID},
t AS (SELECT CAST(i AS INT) AS slice, {_T} - INTERVAL 1 MINUTE * ({minutes} * ({slices} - 1 - i)) AS snapshot_ts FROM range({slices}) r(i)),
base AS (SELECT DISTINCT slice, snapshot_ts, peer_addr FROM t JOIN peer_events ON occurred_at <= snapshot_ts),
rs AS (SELECT slice, peer_addr, count(*) FILTER ({ANN}) AS route_count, count(*) FILTER (occurred_at >= snapshot_ts - INTERVAL 1 HOUR) AS recent, count(*) FILTER (rpki_validity = 'invalid') AS bad,
 count(*) AS total, {marks}, count(*) FILTER ({ANN} AND mark IS NOT NULL) AS marked FROM t JOIN (SELECT *, {MARK} AS mark FROM judged) j ON occurred_at <= snapshot_ts GROUP BY ALL),
fs AS (SELECT slice, peer_addr, count(*) FILTER (event_type = 'peer_down') AS flaps, max(occurred_at) FILTER (event_type = 'peer_up') AS up
 FROM t JOIN peer_events ON occurred_at BETWEEN snapshot_ts - INTERVAL 24 HOUR AND snapshot_ts GROUP BY ALL)
SELECT snapshot_ts, slice, peer_addr, coalesce(route_count, 0) AS route_count, coalesce(recent, 0) AS churn_rate_1h, round(coalesce(bad / total, 0), 6) AS rpki_invalid_ratio,
 round(coalesce((epoch_us(snapshot_ts) - epoch_us(up)) / 1e6, 0), 6) AS session_uptime_secs, coalesce(flaps, 0) AS flap_count_24h,
 coalesce(best_count, 0) AS best_count, coalesce(ecmp_count, 0) AS ecmp_count, coalesce(backup_count, 0) AS backup_count, coalesce(filtered_count, 0) AS filtered_count,
 coalesce(nonselected_count, 0) AS nonselected_count, round(coalesce(CASE WHEN marked > 0 THEN (ecmp_count + backup_count) / marked END, 0), 6) AS redundancy_ratio
FROM base LEFT JOIN rs USING (slice, peer_addr) LEFT JOIN fs USING (slice, peer_addr)"""


add("node_features", features_sql(1, 5))(lambda v: A.node_features(v.marked, v.peer_events, AS_OF))
add("snapshots", features_sql(8, 600))(lambda v: M.snapshots(v.marked, v.peer_events, AS_OF, 8, 600))

# detectors ---------------------------------------------------------------------------------------------------------------------------------------------------------


def oscillation_sql(seconds: int) -> str:
    """CTE osc: the meds of an event's last seconds in order, and how often rising turns to not rising or back."""
    return f"""o AS (SELECT a.event_id, a.occurred_at, a.prefix, a.peer_addr, list(b.med ORDER BY b.occurred_at, b.event_id) AS m FROM route_events a JOIN route_events b
 ON a.prefix = b.prefix AND a.peer_addr = b.peer_addr AND b.action = 'announce' AND b.med IS NOT NULL AND (b.occurred_at, b.event_id) <= (a.occurred_at, a.event_id)
 AND epoch_us(b.occurred_at) >= epoch_us(a.occurred_at) - {seconds}000000 WHERE a.action = 'announce' AND a.med IS NOT NULL GROUP BY ALL),
osc AS (SELECT *, len(list_filter(range(2, len(m)), lambda i: (m[i] > m[i - 1]) <> (m[i + 1] > m[i]))) AS turns FROM o WHERE len(m) >= 5 AND len(list_distinct(m)) >= 2)"""


add("med_oscillation", f"""WITH {oscillation_sql(864000)}
SELECT event_id, occurred_at, prefix, peer_addr, CAST(len(m) AS INT) AS observations, CAST(turns AS INT) AS turns FROM osc WHERE turns >= 2""")(lambda v: D.med_oscillation(v.route_events, 864000))

ALERTS = f"""{VALID}, {_MIN}, {oscillation_sql(60)},
changed AS (SELECT *, lag(origin_asn) OVER w AS old, epoch_us(occurred_at) - lag(epoch_us(occurred_at)) OVER w AS stable FROM judged WHERE {ANN} WINDOW w AS (PARTITION BY prefix, peer_addr ORDER BY occurred_at, event_id)),
own_routes AS (SELECT * FROM judged WHERE {ANN}),
seen AS (SELECT a.event_id, list(DISTINCT b.origin_asn) AS origins FROM own_routes a JOIN own_routes b ON a.prefix = b.prefix AND epoch_us(b.occurred_at) BETWEEN epoch_us(a.occurred_at) - 3600000000 AND epoch_us(a.occurred_at) - 1 GROUP BY 1),
alerts AS (SELECT occurred_at, event_id, 'origin_change' AS kind, prefix, peer_addr, {_SEV} FROM changed WHERE old <> origin_asn AND stable >= 300000000
UNION ALL SELECT occurred_at, event_id, 'leak', prefix, peer_addr, 'warning' FROM t WHERE only_to_customer IS NOT NULL OR min_before - as_path_len >= 3
UNION ALL SELECT occurred_at, event_id, 'med_oscillation', prefix, peer_addr, 'warning' FROM osc WHERE turns >= 2
UNION ALL SELECT occurred_at, event_id, 'hijack', prefix, peer_addr, {_SEV} FROM own_routes JOIN seen USING (event_id) WHERE NOT list_contains(origins, origin_asn))"""
add("all_alerts", f"WITH {ALERTS} SELECT * FROM alerts")(lambda v: D.all_alerts(v.route_events, v.roas))
add("suppressed_alerts", f"""WITH RECURSIVE {ALERTS},
placed AS MATERIALIZED (SELECT *, epoch_us(occurred_at) AS us, row_number() OVER (PARTITION BY kind, prefix, peer_addr ORDER BY occurred_at, event_id) AS i FROM alerts),
after AS MATERIALIZED (SELECT a.kind, a.prefix, a.peer_addr, a.i, min(b.i) AS j FROM placed a JOIN placed b ON a.kind = b.kind AND a.prefix = b.prefix AND a.peer_addr = b.peer_addr AND b.us - a.us >= 86400000000 GROUP BY ALL),
sent AS (SELECT DISTINCT kind, prefix, peer_addr, CAST(1 AS BIGINT) AS i FROM placed UNION ALL SELECT s.kind, s.prefix, s.peer_addr, a.j FROM sent s JOIN after a USING (kind, prefix, peer_addr, i))
SELECT occurred_at, event_id, kind, prefix, peer_addr, severity FROM placed JOIN sent USING (kind, prefix, peer_addr, i)""")(lambda v: D.suppress(D.all_alerts(v.route_events, v.roas), 86400))
add("convergence_events", """WITH ev AS (SELECT speaker_addr, peer_addr, occurred_at, event_id, event_type AS kind, NULL AS prefix, 0 AS k FROM peer_events
UNION ALL SELECT speaker_addr, peer_addr, occurred_at, event_id, action, prefix, 0 FROM route_events
UNION ALL SELECT speaker_addr, peer_addr, occurred_at, event_id, 'stat', NULL, 1 FROM stats_events WHERE stat_type IN (7, 8) AND counter_value = 0),
c AS (SELECT *, epoch_us(occurred_at) AS us, count(*) FILTER (kind = 'peer_down') OVER (PARTITION BY speaker_addr, peer_addr ORDER BY occurred_at, event_id, k, kind) AS part FROM ev),
d AS (SELECT *, count(*) FILTER (kind = 'withdraw') OVER w AS n, max(us) FILTER (kind IN ('peer_down', 'withdraw', 'announce')) OVER w AS last, row_number() OVER (PARTITION BY speaker_addr, peer_addr, part ORDER BY occurred_at, event_id, k, kind) AS i
 FROM c WHERE part > 0 WINDOW w AS (PARTITION BY speaker_addr, peer_addr, part ORDER BY occurred_at, event_id, k, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
e AS (SELECT speaker_addr, peer_addr, part, min(i) AS stop, arg_min(CASE WHEN n >= 1 AND us - last >= 3600000000 THEN last + 3600000000 ELSE us END, i) AS fin, arg_min(CASE WHEN n >= 1 AND us - last >= 3600000000 THEN 'quiet' ELSE kind END, i) AS by_
 FROM d WHERE i > 1 AND (n >= 1 AND us - last >= 3600000000 OR kind IN ('peer_up', 'stat')) GROUP BY ALL),
r AS (SELECT d.* FROM d LEFT JOIN e USING (speaker_addr, peer_addr, part) WHERE kind IN ('withdraw', 'announce') AND i < coalesce(stop, 1000000000)),
p AS (SELECT speaker_addr, peer_addr, part, prefix, arg_max(kind, i) AS then_, count(*) FILTER (kind = 'withdraw') AS n, max(us) AS last FROM r GROUP BY ALL),
q AS (SELECT speaker_addr, peer_addr, part, CAST(sum(n) AS BIGINT) AS withdraws, count(*) AS hit, count(*) FILTER (then_ = 'announce') AS back, max(last) AS last FROM p GROUP BY ALL),
s AS (SELECT *, lead(start) OVER (PARTITION BY speaker_addr, peer_addr ORDER BY part) AS next FROM (SELECT speaker_addr, peer_addr, part, min(us) AS start FROM d GROUP BY ALL)),
f AS (SELECT *, coalesce(fin, CASE WHEN withdraws >= 1 AND next - last >= 3600000000 THEN last + 3600000000 END) AS fin_us, coalesce(by_, 'quiet') AS ended_by FROM s LEFT JOIN e USING (speaker_addr, peer_addr, part) LEFT JOIN q USING (speaker_addr, peer_addr, part))
SELECT speaker_addr, peer_addr, make_timestamp(start) AS started_at, make_timestamp(fin_us) AS eor_at, (fin_us - start) / 1000 AS convergence_ms, coalesce(withdraws, 0) AS withdraws, coalesce(hit, 0) AS affected_prefixes,
 coalesce(back, 0) AS recovered_prefixes, coalesce(hit - back, 0) AS unreachable_after, ended_by FROM f WHERE fin_us IS NOT NULL""")(lambda v: D.convergence_events(v.peer_events, v.route_events, v.stats_events, 3600.0))
add("anomaly_report", f"""WITH {_OWN}, f AS (SELECT * FROM own QUALIFY row_number() OVER (PARTITION BY prefix, origin ORDER BY occurred_at, event_id) = 1), {_TRAIL}, {_Z},
downs AS (SELECT peer_addr, count(*) FILTER (event_type = 'peer_down') AS n, max(occurred_at) AS last FROM peer_events GROUP BY 1)
SELECT b.occurred_at AS detected_at, 'new_origin' AS kind, b.prefix, b.peer_addr, 0.9 :: DOUBLE AS score, 'critical' AS severity FROM f a JOIN f b ON a.prefix = b.prefix AND (a.occurred_at, a.event_id) < (b.occurred_at, b.event_id)
UNION ALL SELECT occurred_at, 'short_path', prefix, peer_addr, round(1 - as_path_len / round(m, 6), 6), 'warning' FROM t WHERE n >= 5 AND as_path_len < m * 0.5
UNION ALL SELECT hour, 'churn', prefix, NULL, round(abs(z), 6), CASE WHEN abs(z) > 5 THEN 'critical' ELSE 'warning' END FROM y WHERE abs(z) > 3
UNION ALL SELECT last, 'flap', NULL, peer_addr, n / 2, CASE WHEN n / 2 < 10 THEN 'warning' ELSE 'critical' END FROM downs WHERE n / 2 >= 3""")(lambda v: D.anomaly_report(v.route_events, v.peer_events, 2.0))

# models ----------------------------------------------------------------------------------------------------------------------------------------------------------------


def hijack_rows(v: Views):
    """Features of routes among which hijacks are planted, with their label."""
    routes = J.validate_origins(v.planted_routes, v.roas)
    routes = routes.join(J.validate_paths(routes, v.aspa).select("event_id", F.col("verdict").alias("aspa_verdict")), "event_id")
    return M.hijack_features(routes, v.peer_max_prefix).join(v.planted_routes.select("event_id", "label"), "event_id")


def hijack_model(v: Views):
    """Rows that the model hasn't learned from, with what it says of them."""
    rows = L.settled(hijack_rows(v))
    return M.train_hijack_model(rows)[0].transform(rows.where(M.held_out())).select("event_id", "label", F.col("prediction").cast("int").alias("prediction"))


add("hijack_model", None)(hijack_model)
_SAID = "o AS (SELECT unnest(string_split(communities, ',')) AS community, local_pref, action FROM community_routes WHERE communities IS NOT NULL)"
add("community_meanings", f"""WITH {_SAID},
g AS (SELECT community, count(*) AS n, quantile_cont(local_pref, 0.5) AS lp, coalesce(greatest(0, least(1, 1 - stddev_samp(local_pref) / (avg(local_pref) + 1e-6))), 0) AS steady,
 avg(CAST(action = 'withdraw' AS INT)) AS gone, count(*) / (SELECT count(*) FROM o) AS support FROM o GROUP BY 1),
k AS (SELECT *, CASE WHEN community LIKE '%666%' THEN 'blackhole' WHEN n < 3 OR support < 0.05 THEN NULL WHEN steady >= 0.7 AND lp >= 150 THEN 'preferred path (LP=' || CAST(CAST(floor(lp) AS INT) AS STRING) || ')'
 WHEN steady >= 0.7 AND lp <= 80 THEN 'backup path (LP=' || CAST(CAST(floor(lp) AS INT) AS STRING) || ')' WHEN gone >= 0.8 THEN 'route filter / deny' END AS meaning FROM g)
SELECT community, meaning, CASE WHEN meaning = 'blackhole' THEN 0.99 WHEN meaning LIKE 'route filter%' THEN gone ELSE round(steady, 6) END :: DOUBLE AS confidence, round(support, 6) AS support, n AS routes FROM k WHERE meaning IS NOT NULL""")(lambda v: M.community_meanings(v.community_routes))
add("community_rules", f"""WITH b AS (SELECT event_id, string_split(communities, ',') AS items FROM community_routes WHERE {ANN} AND communities IS NOT NULL), n AS (SELECT count(*) AS n FROM b),
one AS (SELECT unnest(items) AS a, count(*) AS n FROM b GROUP BY 1), two AS (SELECT x.a, y.a AS c, count(*) AS n FROM (SELECT event_id, unnest(items) AS a FROM b) x JOIN (SELECT event_id, unnest(items) AS a FROM b) y ON x.event_id = y.event_id AND x.a <> y.a GROUP BY ALL)
SELECT two.a AS antecedent, c AS consequent, round(two.n / one.n, 6) AS confidence, round(two.n / n.n, 6) AS support FROM two JOIN one USING (a), n WHERE two.n >= 0.02 * n.n AND two.n / one.n >= 0.3""")(lambda v: M.community_rules(v.community_routes, 0.02, 0.3))

# documents for other systems ---------------------------------------------------------------------------------------------------------------------------------------
_PATH = "CASE WHEN as_path IS NULL THEN '' ELSE '\"as_path\":\"' || as_path || '\"' || {} END"
add("ecs_documents", f"""SELECT event_id, '{{"@timestamp":"' || strftime(occurred_at, '%Y-%m-%dT%H:%M:%S.%g') || 'Z","event":{{"kind":"event","category":"network","action":"route-' || action || '"}},"observer":{{"ip":"' || speaker_addr
 || '"}},"bgp":{{"peer_addr":"' || peer_addr || '","peer_as":' || peer_as || ',"prefix":"' || prefix || '",' || {_PATH.format("','")} || '"rib_type":"' || rib_type || '"}}}}' AS document FROM route_events""")(lambda v: S.ecs_documents(v.route_events))
add("hec_events", f"""SELECT event_id, '{{"time":' || CAST(epoch_us(occurred_at) // 1000000 AS STRING) || '.' || lpad(CAST(epoch_us(occurred_at) // 1000 % 1000 AS STRING), 3, '0') || ',"host":"' || speaker_addr
 || '","source":"bmp","sourcetype":"bmp:route","index":"bgp","event":{{"action":"' || action || '","prefix":"' || prefix || '","peer_addr":"' || peer_addr || '","peer_as":' || peer_as
 || CASE WHEN as_path IS NULL THEN '' ELSE ',"as_path":"' || as_path || '"' END || '}}}}' AS document FROM route_events""")(lambda v: S.hec_events(v.route_events))
_SENT = f"WITH {_MIN}, a AS (SELECT occurred_at, event_id, 'leak:' || prefix || ':' || peer_addr AS key, 'leak ' || prefix || ' at ' || peer_addr AS said, peer_addr FROM t WHERE only_to_customer IS NOT NULL OR min_before - as_path_len >= 3)"
_PAYLOADS = {
    "generic": "json_object('kind', 'leak', 'severity', 'warning', 'summary', said, 'key', key)",
    "slack": "json_object('attachments', json_array(json_object('color', '#FFA500', 'text', '[WARNING] ' || said)))",
    "pagerduty": "json_object('routing_key', '', 'event_action', 'trigger', 'dedup_key', key, 'payload', json_object('summary', said, 'source', peer_addr, 'severity', 'warning'))",
    "opsgenie": "json_object('message', said, 'alias', key, 'priority', 'P3')",
    "teams": "json_object('type', 'message', 'attachments', json_array(json_object('contentType', 'application/vnd.microsoft.card.adaptive', 'content', json_object('type', 'AdaptiveCard', 'body', json_array(json_object('text', said, 'color', 'warning'))))))",
}
for _name, _json in _PAYLOADS.items():
    add("notifications" if _name == "pagerduty" else f"notifications_{_name}", f"{_SENT} SELECT occurred_at, event_id, key, CAST({_json} AS STRING) AS payload FROM a")(lambda v, p=_name: S.notifications(D.as_alerts(D.leaks(v.route_events), "leak", "warning"), p))

# listings --------------------------------------------------------------------------------------------------------------------------------------------------------------


def listed(name: str, table: str, columns: str, time: str, limit: int, **equal) -> None:
    """A query of `listing` and its SQL."""
    where = " AND ".join(f"{k} = '{v}'" for k, v in equal.items()) or "true"
    names = columns.split(", ")
    add(name, f"SELECT {columns} FROM {table} WHERE {where} ORDER BY {time} DESC, event_id DESC LIMIT {limit}")(lambda v: L.listing(getattr(v, table), time, limit=limit, **equal).select(*names))


_SR = "event_id, occurred_at, speaker_addr, peer_addr, peer_as, action, endpoint, color, preference"
listed("srpolicies", "srpolicy_events", _SR, "occurred_at", 100)
listed("srpolicies_of_peer", "srpolicy_events", _SR, "occurred_at", 100, peer_addr="10.0.1.2")
listed("anomalies", "ml_anomalies", "event_id, detected_at, kind, prefix, peer_addr, score, severity", "detected_at", 100)
listed("anomalies_of_kind", "ml_anomalies", "event_id, detected_at, kind, prefix, peer_addr, score, severity", "detected_at", 100, kind="churn")
listed("policy_list", "policy_configs", "event_id, fetched_at, peer_addr, speaker_addr, policy_name, direction", "fetched_at", 500, peer_addr="10.0.1.2")
add("convergence_list", f"SELECT event_id, started_at, peer_addr, convergence_ms, affected_prefixes FROM convergence_log WHERE started_at >= {_T} - INTERVAL 240 HOURS ORDER BY started_at DESC, event_id DESC LIMIT 100")(
    lambda v: L.listing(v.convergence_log, "started_at", 240, AS_OF).select("event_id", "started_at", "peer_addr", "convergence_ms", "affected_prefixes")
)
add("policy_clauses", """WITH c AS (SELECT *, unnest([1, 2]) AS i FROM policy_configs)
SELECT event_id, peer_addr, policy_name, direction, i * 10 AS seq, CASE i WHEN 1 THEN 'permit' ELSE 'deny' END AS action, json_extract_string(clauses_json, '$[' || (i - 1) || '].match.prefix') AS prefix,
 json_extract_string(clauses_json, '$[' || (i - 1) || '].match.community') AS match_community, CAST(json_extract_string(clauses_json, '$[' || (i - 1) || '].set.local_pref') AS BIGINT) AS local_pref FROM c""")(
    lambda v: R.clauses(v.policy_configs, "event_id").select("event_id", "peer_addr", "policy_name", "direction", "seq", "action", "prefix", "match_community", "local_pref")
)
add("peer_capabilities", f"""WITH l AS (SELECT * FROM peer_capabilities {_LAST.format('speaker_addr, peer_addr')})
SELECT speaker_addr, peer_addr, coalesce(regexp_matches(lower(capabilities), '"add'), false) AS add_path, coalesce(regexp_matches(lower(capabilities), '"(four|as4)'), false) AS four_byte_asn,
 coalesce(regexp_matches(lower(capabilities), '"(llgr|long)'), false) AS llgr FROM l""")(lambda v: L.capability_flags(v.peer_capabilities).drop("caps"))
add("node_tiers", f"""WITH l AS (SELECT * FROM (SELECT * FROM node_events {_LAST.format('router_id')}) WHERE {ANN})
SELECT protocol_id, CASE CAST(split_part(router_id, '.', 4) AS INT) % 4 WHEN 0 THEN 'core' WHEN 3 THEN 'other' ELSE 'edge' END AS tier, count(*) AS nodes FROM l GROUP BY ALL""")(lambda v: A.node_tiers(v.node_events))
add("igp_nodes", f"SELECT router_id, node_name, event_id FROM (SELECT * FROM node_events {_LAST.format('router_id')}) WHERE {ANN}")(lambda v: G.igp_nodes(v.node_events).select("router_id", "node_name", "event_id"))
add("igp_links", f"SELECT local_router_id, remote_router_id, igp_metric, event_id FROM (SELECT * FROM link_events {_LAST.format('local_router_id, remote_router_id')}) WHERE {ANN}")(
    lambda v: G.igp_links(v.link_events).select("local_router_id", "remote_router_id", "igp_metric", "event_id")
)
add("flow_rules", """WITH p AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN split_part(substr(summary, 5), ' ', 1) WHEN 1 THEN split_part(summary, 'dest ', 2) END AS destination, CASE event_id % 4 WHEN 1 THEN split_part(substr(summary, 9), ',', 1) END AS source FROM flow_rules)
SELECT *, coalesce(CAST(split_part(destination, '/', 2) AS INT) <= 16, false) OR coalesce(CAST(split_part(source, '/', 2) AS INT) <= 16, false) AS large_prefix FROM p""")(lambda v: L.flow_rules(v.flow_rules).select("event_id", "destination", "source", "large_prefix"))

# texts of wire values --------------------------------------------------------------------------------------------------------------------------------------------------
_NUMBERS = "64000 + event_id % 500 AS n, event_id % 70000 AS m"
_DOT = "CAST((64000 + event_id % 500) // 256 AS STRING) || '.' || CAST((64000 + event_id % 500) % 256 AS STRING) || '.' || CAST(event_id % 70000 // 16777216 AS STRING) || '.' || CAST(event_id % 70000 // 65536 AS STRING) || ':' || CAST(event_id % 70000 % 65536 AS STRING)"
add("path_facts", """SELECT event_id, CAST(len(string_split(as_path, ' ')) AS INT) AS hops, CAST(string_split(as_path, ' ')[1] AS BIGINT) AS first FROM wire_values WHERE as_path IS NOT NULL""")(
    lambda v: v.wire_values.where("as_path IS NOT NULL").select("event_id", X.hop_count("as_path").alias("hops"), X.first_asn("as_path").alias("first"))
)
add("community_names", """SELECT event_id, CASE community WHEN 4294967041 THEN 'NO_EXPORT' WHEN 4294967042 THEN 'NO_ADVERTISE' WHEN 4294967043 THEN 'NO_EXPORT_SUBCONFED' WHEN 4294902426 THEN 'BLACKHOLE' WHEN 4294901760 THEN 'GRACEFUL_SHUTDOWN'
 WHEN 4294901761 THEN 'ACCEPT_OWN' ELSE '65000:' || CAST(event_id % 300 AS STRING) END AS name FROM wire_values""")(
    lambda v: v.wire_values.select("event_id", X.community_name("community").alias("name"))
)
add("ext_communities", f"""WITH w AS (SELECT event_id, ext_community, {_NUMBERS} FROM wire_values)
SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'route-target' WHEN 1 THEN 'route-origin-soo' WHEN 2 THEN 'route-target' WHEN 3 THEN 'sr-te-color' ELSE 'extended-community' END AS kind,
 CASE event_id % 5 WHEN 0 THEN 'rt:' || n || ':' || m WHEN 1 THEN 'soo:' || n || ':' || m WHEN 2 THEN 'rt:' || {_DOT} WHEN 3 THEN 'color:' || m ELSE 'ext:0x' || substr(ext_community, 1, 4) || ':' || substr(ext_community, 5) END AS text FROM w""")(
    lambda v: v.wire_values.select("event_id", X.ext_community_kind("ext_community").alias("kind"), X.ext_community_text("ext_community").alias("text"))
)
add("route_distinguishers", f"""WITH w AS (SELECT event_id, rd, {_NUMBERS} FROM wire_values)
SELECT event_id, CASE event_id % 4 WHEN 0 THEN n || ':' || m WHEN 1 THEN {_DOT} WHEN 2 THEN CAST(n * 65536 + m // 65536 AS STRING) || ':' || CAST(m % 65536 AS STRING) ELSE rd END AS text FROM w""")(lambda v: v.wire_values.select("event_id", X.rd_text("rd").alias("text")))
add("counter_names", "SELECT event_id, CASE stat_type " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in X.COUNTERS.items()) + " ELSE 'unknown' END AS name FROM wire_values")(
    lambda v: v.wire_values.select("event_id", X.counter_name("stat_type").alias("name"))
)
add("rib_types", """SELECT event_id, CASE WHEN peer_type = 3 AND flags & 8 <> 0 THEN 'LocRibFiltered' WHEN peer_type = 3 THEN 'LocRib'
 ELSE 'AdjRib' || CASE WHEN flags & 16 <> 0 OR peer_type = 2 THEN 'Out' ELSE 'In' END || CASE WHEN flags & 64 <> 0 THEN 'PostPolicy' ELSE 'PrePolicy' END END AS rib_type FROM wire_values""")(
    lambda v: v.wire_values.select("event_id", X.rib_type("peer_type", "flags").alias("rib_type"))
)
add("address_families", "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'ipv4-unicast' WHEN 1 THEN 'ipv4-unicast' WHEN 2 THEN 'ipv6-unicast' WHEN 3 THEN 'ipv6-unicast' WHEN 4 THEN 'evpn' END AS afi FROM wire_values")(
    lambda v: v.wire_values.select("event_id", X.afi_normal("afi").alias("afi"))
)
#: Reason codes of paths.
_REASONS = {1: "AS loop", 2: "unresolvable nexthop", 3: "not preferred: LOCAL_PREF", 4: "not preferred: AS_PATH length", 5: "not preferred: ORIGIN type", 6: "not preferred: MED", 7: "not preferred: peer type", 8: "not preferred: IGP cost", 9: "not preferred: router-ID", 10: "not preferred: peer address", 11: "not preferred: AIGP"}
add("path_labels", f"SELECT path_status, path_reason, {LABEL} AS label, CASE path_reason " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in _REASONS.items()) + " ELSE '' END AS reason, count(*) AS paths FROM path_markings GROUP BY ALL")(
    lambda v: v.path_markings.groupBy("path_status", "path_reason", X.status_label("path_status").alias("label"), X.reason_label("path_reason").alias("reason")).agg(F.count("*").alias("paths"))
)
add("evpn_routes", """SELECT event_id, 1 + event_id % 12 AS route_type, CASE event_id % 12 WHEN 0 THEN 'ethernet-auto-discovery' WHEN 1 THEN 'mac-ip-advertisement' WHEN 2 THEN 'inclusive-multicast' WHEN 3 THEN 'ethernet-segment' WHEN 4 THEN 'ip-prefix' WHEN 5 THEN 'selective-multicast'
 WHEN 6 THEN 'multicast-join-sync' WHEN 7 THEN 'multicast-leave-sync' WHEN 8 THEN 'per-region-i-pmsi' WHEN 9 THEN 's-pmsi' WHEN 10 THEN 'leaf' ELSE 'unknown' END AS route_type_name,
 CASE WHEN event_id % 12 IN (0, 1, 2, 4) THEN event_id % 100 END AS ethernet_tag, CASE WHEN event_id % 12 = 1 THEN '00:11:22:33:44:55' END AS mac, CASE WHEN event_id % 12 IN (1, 2, 3, 4) THEN peer_addr END AS ip,
 CASE WHEN event_id % 12 = 4 THEN 24 END AS prefix_len, CASE WHEN event_id % 12 IN (0, 1, 4) THEN 1000 + event_id % 7 END AS mpls_label FROM route_events""")(
    lambda v: v.route_events.selectExpr("event_id", "named_struct('route_type', 1 + event_id % 12, 'rd', '1:1', 'ethernet_tag', event_id % 100, 'mac', '00:11:22:33:44:55', 'ip', peer_addr, 'prefix_len', 24, 'mpls_label', 1000 + event_id % 7, 'esi_hex', '00') AS r").select("event_id", *X.evpn_columns("r")).drop("rd", "esi_hex")
)

# IPv6 --------------------------------------------------------------------------------------------------------------------------------------------------------------


def roas6(v: Views):
    return v.vrps6.select(F.concat_ws("/", "net", F.col("vlen").cast("string")).alias("prefix"), "max_len", "origin_asn")


add("validate_origins_ipv6", f"""WITH p AS (SELECT DISTINCT prefix, x, l, {ORIGIN} AS origin_asn FROM route6_events),
h AS (SELECT p.prefix, p.origin_asn, p.l, v.origin_asn AS v_asn, v.max_len, v.vlen FROM p LEFT JOIN vrps6 v ON v.vlen <= p.l AND p.x >> (48 - v.vlen) = v.x >> (48 - v.vlen)),
w AS (SELECT prefix, origin_asn, max(CASE WHEN v_asn IS NULL THEN 0 WHEN v_asn = origin_asn AND l <= max_len THEN 2 ELSE 1 END) AS level, bool_or(coalesce(v_asn = origin_asn AND l <= max_len AND vlen < l, false)) AS more_specific FROM h GROUP BY ALL)
SELECT event_id, r.prefix, w.origin_asn, CASE level WHEN 2 THEN 'valid' WHEN 1 THEN 'invalid' ELSE 'not-found' END AS rpki_validity, more_specific
FROM route6_events r JOIN w ON r.prefix = w.prefix AND {ORIGIN} IS NOT DISTINCT FROM w.origin_asn""")(
    lambda v: J.validate_origins(v.route6_events, roas6(v)).select("event_id", "prefix", "origin_asn", "rpki_validity", "more_specific")
)
add("sub_prefixes_ipv6", """WITH p AS (SELECT DISTINCT prefix, x, l FROM route6_events UNION SELECT '2001:db8::/33', 0, 33 UNION SELECT '2001:db8:2500::/44', 9472, 44)
SELECT a.prefix, arg_max(b.prefix, (b.l, b.prefix)) AS parent FROM p a JOIN p b ON b.l < a.l AND a.x >> (48 - b.l) = b.x >> (48 - b.l) GROUP BY 1""")(
    lambda v: J.sub_prefixes(v.route6_events.select("prefix").union(v.spark.createDataFrame([("2001:db8::/33",), ("2001:db8:2500::/44",)], "prefix string")))
)
add("policy_conflicts_ipv6", """WITH rib AS (SELECT * FROM (SELECT * FROM route6_events QUALIFY row_number() OVER (PARTITION BY peer_addr, rib_type, prefix ORDER BY occurred_at DESC, event_id DESC) = 1) WHERE action = 'announce'),
cl AS (SELECT i AS seq, CASE WHEN i % 2 = 0 THEN 'deny' ELSE 'permit' END AS term, i * 2048 AS cx, CASE WHEN i % 3 = 0 THEN 140 END AS want_p FROM range(14) t(i)),
h AS (SELECT cl.*, prefix, local_pref FROM cl JOIN rib ON x >> 11 = cx >> 11)
SELECT seq, prefix, 'leaked' AS kind, count(*) AS n FROM h WHERE term = 'deny' GROUP BY ALL
UNION ALL SELECT seq, prefix, 'local_pref_drift', count(*) FROM h WHERE term = 'permit' AND want_p IS NOT NULL AND local_pref IS DISTINCT FROM want_p GROUP BY ALL
UNION ALL SELECT seq, NULL, 'blocked', 1 FROM cl WHERE term = 'permit' AND seq NOT IN (SELECT seq FROM h)""")(
    lambda v: J.policy_conflicts(
        L.current_rib(v.route6_events).select("prefix", "communities", "local_pref"),
        v.spark.range(14).selectExpr("'p' AS policy", "id AS seq", "CASE WHEN id % 2 = 0 THEN 'deny' ELSE 'permit' END AS action", "concat('2001:db8:', lower(hex(id * 2048)), '::/37') AS prefix", "CAST(NULL AS STRING) AS community", "CASE WHEN id % 3 = 0 THEN 140 END AS local_pref"),
    ).groupBy("seq", "prefix", "kind").agg(F.count("*").alias("n"))
)

# streams' batch forms and named questions --------------------------------------------------------------------------------------------------------------------------
add("down_effects", """SELECT d.speaker_addr, d.peer_addr, d.event_id AS down_id, d.occurred_at AS down_at, r.event_id, r.occurred_at AS route_at, r.action, r.prefix FROM (SELECT * FROM peer_events WHERE event_type = 'peer_down') d
LEFT JOIN route_events r ON r.speaker_addr = d.speaker_addr AND r.peer_addr = d.peer_addr AND r.occurred_at >= d.occurred_at AND r.occurred_at <= d.occurred_at + INTERVAL 900 SECONDS""")(lambda v: T.down_effects(v.peer_events, v.route_events, 900))
_ASKED = {
    "top_announced": "SELECT prefix, count(*) AS n FROM route_events WHERE action = 'announce' GROUP BY 1 ORDER BY n DESC, prefix LIMIT 10",
    "top_withdrawn": "SELECT prefix, count(*) AS n FROM route_events WHERE action = 'withdraw' GROUP BY 1 ORDER BY n DESC, prefix LIMIT 10",
    "peer_downs": "SELECT peer_addr, count(*) AS n FROM peer_events WHERE event_type = 'peer_down' GROUP BY 1 ORDER BY n DESC, peer_addr LIMIT 10",
    "peer_ups": "SELECT peer_addr, count(*) AS n FROM peer_events WHERE event_type = 'peer_up' GROUP BY 1 ORDER BY n DESC, peer_addr LIMIT 10",
    "longest_paths": "SELECT event_id, prefix, as_path, as_path_len FROM route_events WHERE as_path_len IS NOT NULL ORDER BY as_path_len DESC, event_id LIMIT 10",
}
for _name, _sql in _ASKED.items():
    add(f"ask_{_name}", _sql)(lambda v, q=_name: canned.ask(q, {"route_events": v.route_events, "peer_events": v.peer_events}))
_VERIFIED = {
    "route_leak": f"SELECT event_id, prefix, peer_addr FROM route_events WHERE only_to_customer IS NOT NULL AND {ANN}",
    "flap": "SELECT peer_addr, count(*) AS downs FROM peer_events WHERE event_type = 'peer_down' GROUP BY 1 HAVING count(*) > 4",
    "churn": "SELECT prefix, count(*) AS events FROM route_events GROUP BY 1 HAVING count(*) > 4",
}
for _name, _sql in _VERIFIED.items():
    add(f"verify_{_name}", _sql)(lambda v, k=_name: canned.VERIFY[k](v.peer_events if k == "flap" else v.route_events))
