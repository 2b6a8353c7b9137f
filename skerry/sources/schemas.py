"""Explicit schemas of the event tables and reference sets; nothing is inferred on read."""

_PEER = "id string, occurred_at timestamp, speaker_addr string, peer_addr string, peer_as bigint"

SCHEMAS = {
    "route_events": f"{_PEER}, rib_type string, action string, prefix string, afi string, origin string, as_path string, as_path_len int, next_hop string, local_pref bigint, med bigint, communities string, ext_communities string, large_communities string, originator_id string, atomic_aggregate boolean, only_to_customer bigint, collector_id string",
    "peer_events": f"{_PEER}, event_type string, local_as bigint, hold_time int, capabilities string, reason string, collector_id string",
    "speaker_events": "id string, occurred_at timestamp, speaker_addr string, event_type string, sys_name string, sys_descr string, reason string, collector_id string",
    "stats_events": "id string, occurred_at timestamp, speaker_addr string, peer_addr string, counter_name string, counter_value decimal(20,0), stat_type int, afi int, safi int",
    "evpn_events": f"{_PEER}, action string, route_type int, route_type_name string, rd string, ethernet_tag bigint, mac string, ip string, prefix_len int, mpls_label bigint, esi_hex string",
    "ml_anomalies": "id int, detected_at timestamp, kind string, prefix string, peer_addr string, score double, description string, severity string",
    "srpolicy_events": f"{_PEER}, action string, endpoint string, color bigint, preference bigint, bsid string, segment_list string, distinguisher bigint",
    "aspa_validations": "id string, occurred_at timestamp, prefix string, peer_addr string, peer_as bigint, customer_asn bigint, provider_asns string, result string, direction string",
    "bgpsec_validations": "occurred_at timestamp, prefix string, peer_addr string, as_path string, verdict string, invalid_hop int, invalid_reason string",
    "convergence_events": "event_id string, started_at timestamp, eor_at timestamp, convergence_ms double, speaker_addr string, peer_addr string, trigger_type string, affected_prefixes bigint, recovered_prefixes bigint, unreachable_after bigint",
    "policy_configs": "fetched_at timestamp, peer_addr string, speaker_addr string, policy_name string, direction string, vendor string, clauses_json string, source string, confidence double",
    "peer_max_prefix": "updated_at timestamp, speaker_addr string, peer_addr string, peer_as bigint, afi_safi string, max_prefix bigint, warning_pct int",
    "path_markings": "occurred_at timestamp, speaker_addr string, peer_addr string, peer_as bigint, prefix string, afi string, path_status bigint, path_reason int, status_label string, reason_label string, collector_id string",
    "bgpls_nodes": "occurred_at timestamp, action string, router_id string, node_name string, protocol_id string",
    "bgpls_links": "occurred_at timestamp, action string, local_router_id string, remote_router_id string, local_ip string, remote_ip string, igp_metric bigint, max_bandwidth double, adj_sid_labels string, srlg_groups string",
    "vrps": "prefix string, max_len int, origin_asn bigint",
    "aspa": "customer_asn bigint, provider_asn bigint",
    "inventory": "speaker_addr string, hostname string, site string, role string, model string",
}
#: The column that a table's rows are dated by, for date partitions and retention.
TIMES = {"ml_anomalies": "detected_at", "convergence_events": "started_at", "policy_configs": "fetched_at", "peer_max_prefix": "updated_at"}

#: One decoded message of a monitoring session; its payload has what its kind has.
ENVELOPE = f"""id string, occurred_at timestamp, speaker string, kind string, payload struct<
  peer_addr:string, peer_as:bigint, rib_type:string, action:string, prefix:string, afi:string, as_path:string, as_path_len:int, next_hop:string, local_pref:bigint, med:bigint, communities:string, only_to_customer:bigint,
  sys_name:string, sys_descr:string, reason:string, local_as:bigint, hold_time:int, capabilities:string,
  counters:array<struct<stat_type:int, value:decimal(20,0), afi:int, safi:int>>,
  evpn:array<struct<route_type:int, rd:string, ethernet_tag:bigint, mac:string, ip:string, prefix_len:int, mpls_label:bigint, esi_hex:string>>>"""
