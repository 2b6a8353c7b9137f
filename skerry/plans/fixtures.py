"""Routing tables derived from the driver's tables by SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The instant that look-back queries count from.
AS_OF = "2024-01-31 00:00:00"

#: name: (SQL, names of the tables and views it reads)
VIEWS: dict[str, str] = {
    "route_events": """
SELECT event_id, CAST(ts AS TIMESTAMP) AS occurred_at,
 '192.0.2.' || CAST(user_id % 3 + 1 AS STRING) AS speaker_addr,
 '10.0.' || CAST(user_id % 3 AS STRING) || '.' || CAST(user_id % 12 + 1 AS STRING) AS peer_addr,
 65000 + user_id % 12 AS peer_as,
 CASE WHEN event_id % 5 = 0 THEN 'AdjRibInPostPolicy' ELSE 'AdjRibInPrePolicy' END AS rib_type,
 CASE WHEN event_type = 'error' THEN 'withdraw' ELSE 'announce' END AS action,
 '20.' || CAST((event_id * 37) % 97 AS STRING) || '.0.0/' || CAST(16 + (event_id * 37) % 97 % 9 AS STRING) AS prefix,
 '1' AS afi,
 CASE WHEN event_type = 'error' THEN NULL ELSE
   CAST(65000 + user_id % 12 AS STRING) || ' ' || CAST(64600 + event_id % 7 AS STRING) ||
   CASE WHEN event_id % 4 = 0 THEN ' ' || CAST(64600 + event_id % 7 AS STRING) ELSE '' END || ' ' ||
   CAST(64700 + (event_id * 37) % 97 + CASE WHEN event_id % 41 = 0 THEN 500 ELSE 0 END AS STRING) END AS as_path,
 CASE WHEN event_type = 'error' THEN NULL ELSE CASE WHEN event_id % 4 = 0 THEN 4 ELSE 3 END END AS as_path_len,
 CASE WHEN event_type = 'error' THEN NULL ELSE 80 + (event_id % 5) * 30 END AS local_pref,
 CASE WHEN event_type IN ('click', 'view') THEN CAST(floor(value) AS BIGINT) ELSE NULL END AS med,
 CASE WHEN event_type = 'error' OR event_id % 3 = 0 THEN NULL ELSE
   '65000:' || CAST(event_id % 6 * 111 AS STRING) || ',65000:' || CAST(user_id % 4 AS STRING) END AS communities,
 CASE WHEN event_type <> 'error' AND event_id % 50 = 0 THEN 65000 + user_id % 12 ELSE NULL END AS only_to_customer
FROM events""",
    "peer_events": """
SELECT event_id, CAST(ts AS TIMESTAMP) AS occurred_at,
 '192.0.2.' || CAST(user_id % 3 + 1 AS STRING) AS speaker_addr,
 '10.0.' || CAST(user_id % 3 AS STRING) || '.' || CAST(user_id % 12 + 1 AS STRING) AS peer_addr,
 65000 + user_id % 12 AS peer_as,
 CASE WHEN event_id % 10 = 3 THEN 'peer_up' ELSE 'peer_down' END AS event_type,
 CASE WHEN event_id % 10 = 3 THEN NULL ELSE 'Hold timer expired' END AS reason
FROM events WHERE event_id % 10 IN (3, 7)""",
    "speaker_events": """
SELECT event_id, CAST(ts AS TIMESTAMP) AS occurred_at, '192.0.2.' || CAST(user_id % 3 + 1 AS STRING) AS speaker_addr,
 CASE WHEN event_id % 400 = 11 THEN 'speaker_down' ELSE 'speaker_up' END AS event_type
FROM events WHERE event_id % 100 = 11""",
    "stats_events": """
SELECT event_id, CAST(ts AS TIMESTAMP) AS occurred_at,
 '192.0.2.' || CAST(user_id % 3 + 1 AS STRING) AS speaker_addr,
 '10.0.' || CAST(user_id % 3 AS STRING) || '.' || CAST(user_id % 12 + 1 AS STRING) AS peer_addr,
 CASE WHEN event_id % 3 = 0 THEN 'explicit-withdraw-count' ELSE 'adj-rib-in-routes' END AS counter_name,
 CASE WHEN event_id % 20 = 5 THEN 0 ELSE CAST(floor(value * 10) AS BIGINT) END AS counter_value,
 CASE WHEN event_id % 3 = 0 THEN 7 ELSE 11 END AS stat_type
FROM events WHERE event_id % 10 = 5""",
    "path_markings": """
SELECT event_id, occurred_at, speaker_addr, peer_addr, peer_as, prefix, afi,
 CASE event_id % 7 WHEN 0 THEN 2 WHEN 1 THEN 10 WHEN 2 THEN 16 WHEN 3 THEN 4 WHEN 4 THEN 256 WHEN 5 THEN 1024 ELSE 64 END AS path_status,
 CASE WHEN event_id % 7 = 3 THEN 1 + event_id % 11 ELSE 0 END AS path_reason
FROM route_events WHERE action = 'announce'""",
    "marked_routes": """
SELECT *, CASE event_id % 7 WHEN 0 THEN 'best' WHEN 1 THEN 'ecmp' WHEN 2 THEN 'backup' WHEN 3 THEN 'nonselected' WHEN 4 THEN 'filtered' WHEN 5 THEN 'stale' ELSE NULL END AS path_status
FROM route_events""",
    "community_routes": """
SELECT event_id, action, local_pref,
 CASE WHEN action = 'withdraw' THEN '65030:9'
  WHEN event_id % 5 = 0 THEN '65020:80,65000:1'
  WHEN event_id % 5 = 3 THEN CASE WHEN event_id % 2 = 0 THEN '65020:170,65000:3' ELSE '65020:170' END
  WHEN event_id % 5 = 4 THEN '65020:200,65000:666' ELSE NULL END AS communities
FROM route_events""",
    "srpolicy_events": """
SELECT event_id, occurred_at, speaker_addr, peer_addr, peer_as, CASE WHEN event_id % 30 = 1 THEN 'withdraw' ELSE 'announce' END AS action,
 '10.9.0.' || CAST(event_id % 9 + 1 AS STRING) AS endpoint, 100 + event_id % 4 * 100 AS color, 50 + event_id % 3 * 50 AS preference
FROM route_events WHERE event_id % 10 = 1""",
    "ml_anomalies": """
SELECT event_id, occurred_at AS detected_at, CASE event_id % 3 WHEN 0 THEN 'churn' WHEN 1 THEN 'new_origin' ELSE 'flap' END AS kind, prefix, peer_addr,
 CAST(event_id % 100 AS DOUBLE) / 100 AS score, CASE WHEN event_id % 4 = 0 THEN 'critical' ELSE 'warning' END AS severity
FROM route_events WHERE event_id % 10 = 9""",
    "convergence_log": """
SELECT event_id, occurred_at AS started_at, speaker_addr, peer_addr, CAST(event_id % 997 * 10 AS DOUBLE) AS convergence_ms, event_id % 11 AS affected_prefixes
FROM peer_events WHERE event_type = 'peer_down'""",
    "policy_configs": """
SELECT event_id, occurred_at AS fetched_at, peer_addr, speaker_addr, 'policy-' || CAST(event_id % 5 AS STRING) AS policy_name, CASE WHEN event_id % 2 = 0 THEN 'import' ELSE 'export' END AS direction,
 '[{"seq":10,"action":"permit","match":{"prefix":"' || prefix || '"},"set":{"local_pref":' || CAST(100 + event_id % 9 AS STRING) || '}},' ||
 '{"seq":20,"action":"deny","match":{"community":"65000:' || CAST(event_id % 6 AS STRING) || '"},"set":{}}]' AS clauses_json
FROM route_events WHERE event_id % 20 = 2""",
    "peer_capabilities": """
SELECT event_id, occurred_at, speaker_addr, peer_addr,
 CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '["route-refresh","add-path"]' WHEN 2 THEN '["four-octet-as"]' WHEN 3 THEN '["AS4","LLGR"]' ELSE '["long-lived-graceful-restart","additional-paths"]' END AS capabilities
FROM route_events WHERE event_id % 10 = 6""",
    "node_events": """
SELECT event_id, occurred_at, CASE WHEN event_id % 8 = 0 THEN 'withdraw' ELSE 'announce' END AS action, '10.255.0.' || CAST(event_id % 25 AS STRING) AS router_id,
 CASE event_id % 25 % 4 WHEN 0 THEN 'core' WHEN 1 THEN 'pe' WHEN 2 THEN 'Leaf-' ELSE 'rr' END || CAST(event_id % 25 AS STRING) AS node_name,
 CASE WHEN event_id % 25 < 15 THEN 'isis-l2' ELSE 'ospfv2' END AS protocol_id
FROM route_events WHERE event_id % 10 = 4""",
    "link_events": """
SELECT event_id, occurred_at, CASE WHEN event_id % 6 = 0 THEN 'withdraw' ELSE 'announce' END AS action, '10.255.0.' || CAST(event_id % 25 AS STRING) AS local_router_id,
 '10.255.0.' || CAST((event_id % 25 + 1 + event_id % 3) % 25 AS STRING) AS remote_router_id, 1 + event_id % 9 AS igp_metric
FROM route_events WHERE event_id % 10 = 8""",
    "flow_rules": """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'dst=' || prefix || ' proto=6' WHEN 1 THEN 'Source: 10.' || CAST(event_id % 200 AS STRING) || '.0.0/' || CAST(8 + event_id % 20 AS STRING) || ', dest ' || prefix
  WHEN 2 THEN 'port=80' ELSE NULL END AS summary
FROM route_events WHERE event_id % 10 = 2""",
    "wire_values": """
SELECT event_id, as_path, event_id % 45 AS stat_type, event_id % 4 AS peer_type, event_id % 3 * 32 + event_id % 5 * 8 AS flags,
 CASE event_id % 9 WHEN 0 THEN 4294967041 WHEN 1 THEN 4294967042 WHEN 2 THEN 4294967043 WHEN 3 THEN 4294902426 WHEN 4 THEN 4294901760 WHEN 5 THEN 4294901761 ELSE 4259840000 + event_id % 300 END AS community,
 CASE event_id % 5 WHEN 0 THEN '0002' WHEN 1 THEN '0003' WHEN 2 THEN '0102' WHEN 3 THEN '030b' ELSE '0306' END || lpad(lower(hex(64000 + event_id % 500)), 4, '0') || lpad(lower(hex(event_id % 70000)), 8, '0') AS ext_community,
 lpad(CAST(event_id % 4 AS STRING), 4, '0') || lpad(lower(hex(64000 + event_id % 500)), 4, '0') || lpad(lower(hex(event_id % 70000)), 8, '0') AS rd,
 CASE event_id % 6 WHEN 0 THEN '1' WHEN 1 THEN 'IPv4' WHEN 2 THEN '2' WHEN 3 THEN 'ipv6-unicast' WHEN 4 THEN 'EVPN' ELSE NULL END AS afi
FROM route_events""",
    "planted_routes": """
SELECT * FROM (
SELECT event_id, occurred_at, speaker_addr, peer_addr, peer_as, rib_type, action, prefix, afi, as_path, as_path_len, local_pref, med, communities, only_to_customer, false AS label FROM route_events
UNION ALL
SELECT event_id + 1000000000, occurred_at, speaker_addr, peer_addr, peer_as, rib_type, 'announce',
 CASE WHEN event_id % 80 = 9 AND (event_id * 37) % 97 % 2 = 0 AND (event_id * 37) % 97 < 60 THEN prefix ELSE '20.' || CAST((event_id * 37) % 97 AS STRING) || '.0.0/26' END, afi,
 CAST(peer_as AS STRING) || ' ' || CAST(64600 + event_id % 7 AS STRING) || ' ' || CAST(64990 + event_id % 7 AS STRING), 3, local_pref, med, communities, NULL, true
FROM route_events WHERE event_id % 40 = 9 AND action = 'announce') u""",
    "route6_events": """
SELECT event_id, occurred_at, speaker_addr, peer_addr, peer_as, rib_type, action, (event_id * 37) % 97 * 256 AS x, 40 + (event_id * 37) % 97 % 9 AS l,
 '2001:db8:' || lower(hex((event_id * 37) % 97 * 256)) || '::/' || CAST(40 + (event_id * 37) % 97 % 9 AS STRING) AS prefix, as_path, as_path_len, local_pref, communities
FROM route_events""",
    "bgpls_links": """
SELECT '10.255.0.' || CAST(a.n_nationkey AS STRING) AS local_router_id,
 '10.255.0.' || CAST(b.n_nationkey AS STRING) AS remote_router_id,
 1 + (a.n_nationkey * 5 + b.n_nationkey) % 9 AS igp_metric,
 CAST((a.n_nationkey + b.n_nationkey) % 4 AS STRING) AS srlg_groups
FROM nation a JOIN nation b ON b.n_nationkey IN ((a.n_nationkey + 1) % 25, (a.n_nationkey * 7 + 3) % 25) AND a.n_nationkey <> b.n_nationkey""",
    "peer_max_prefix": """
SELECT speaker_addr, peer_addr, peer_as, 'ipv4-unicast' AS afi_safi, 60 + (peer_as % 4) * 20 AS max_prefix, 75 AS warning_pct
FROM (SELECT DISTINCT speaker_addr, peer_addr, peer_as FROM route_events) t""",
    "vrps": """
SELECT '20.' || CAST(i AS STRING) || '.0.0' AS net, CASE WHEN i % 8 = 0 THEN 13 ELSE 16 END AS vlen,
 CASE WHEN i % 3 = 0 THEN 18 ELSE 24 END AS max_len, 64700 + i + CASE WHEN i % 7 = 0 THEN 1 ELSE 0 END AS origin_asn
FROM (SELECT DISTINCT (event_id * 37) % 97 AS i FROM events) t WHERE i % 2 = 0 AND i < 60""",
    "vrps6": """
SELECT '2001:db8:' || lower(hex(i * 256)) || '::' AS net, i * 256 AS x, CASE WHEN i % 8 = 0 THEN 37 ELSE 40 END AS vlen,
 CASE WHEN i % 3 = 0 THEN 42 ELSE 48 END AS max_len, 64700 + i + CASE WHEN i % 7 = 0 THEN 1 ELSE 0 END AS origin_asn
FROM (SELECT DISTINCT (event_id * 37) % 97 AS i FROM events) t WHERE i % 2 = 0 AND i < 60""",
    "aspa": """
SELECT DISTINCT 64600 + event_id % 7 AS customer_asn, 65000 + user_id % 12 AS provider_asn FROM events WHERE user_id % 12 < 9""",
    "inventory": """
SELECT '192.0.2.' || CAST(s_suppkey + 1 AS STRING) AS speaker_addr, s_name AS hostname, n_name AS site
FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey < 2""",
}
_TABLES = ("events", "nation", "supplier")


def reads(name: str) -> list[str]:
    """The tables and views that a view's SQL names after FROM or JOIN."""
    words = VIEWS[name].replace("(", " ").replace(")", " ").split()
    return list(dict.fromkeys(words[i + 1] for i, w in enumerate(words[:-1]) if w in ("FROM", "JOIN") and words[i + 1] in {*VIEWS, *_TABLES}))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table in sf_dir."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame over the tables in sf_dir."""
    sources = {n: view(spark, sf_dir, n) if n in VIEWS else read(spark, sf_dir, n) for n in reads(name)}
    text = VIEWS[name].replace("{", "{{").replace("}", "}}")  # spark.sql formats
    for n in sources:
        for word in ("FROM", "JOIN"):
            text = text.replace(f"{word} {n}", f"{word} {{{n}}}")
    return spark.sql(text, **sources)


def with_views(body: str) -> str:
    """DuckDB SQL of body with the views that it names before it."""
    need: list[str] = []

    def add(name: str) -> None:
        for n in reads(name):
            if n in VIEWS:
                add(n)
        if name not in need:
            need.append(name)

    for name in VIEWS:
        if name in body:
            add(name)
    recursive = "RECURSIVE " if "RECURSIVE" in body else ""
    body = body.replace("WITH RECURSIVE ", "WITH ", 1) if recursive else body
    views = ", ".join(f"{n} AS ({VIEWS[n]})" for n in need)
    if not views:
        return body if not recursive else body.replace("WITH ", "WITH RECURSIVE ", 1)
    if body.lstrip().startswith("WITH "):
        return f"WITH {recursive}{views}, {body.lstrip()[5:]}"
    return f"WITH {recursive}{views} {body}"
