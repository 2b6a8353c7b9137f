"""Column functions over routing attributes. Each takes and returns Columns and stays inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

C = Column | str


def _c(x: C) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokens(text: C, sep: str = r"\s+") -> Column:
    """Non-empty, trimmed parts of a delimited string; null and blank give an empty array."""
    parts = F.transform(F.split(F.coalesce(_c(text), F.lit("")), sep), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def list_length(text: C, sep: str = ",") -> Column:
    return F.size(tokens(text, sep))


def joined(parts: Column, sep: str = ",") -> Column:
    return F.array_join(parts, sep)


def asns(path: C) -> Column:
    """All AS numbers of a path in order; sets {..} and confederations (..) [..] count with their members."""
    return F.filter(F.transform(tokens(F.regexp_replace(_c(path), r"[{}()\[\],]", " ")), lambda x: x.try_cast("bigint")), lambda x: x.isNotNull())


def sequence_asns(path: C) -> Column:
    """AS numbers of the plain sequences alone."""
    return asns(F.regexp_replace(_c(path), r"\{[^}]*\}|\([^)]*\)|\[[^\]]*\]", " "))


def origin_asn(path: C, how: str = "last") -> Column:
    """Origin of a path. "last": its last token, null unless a number; "integer": its last number; "sequence": the last of its first plain sequence."""
    if how == "last":
        return F.try_element_at(tokens(path), F.lit(-1)).try_cast("bigint")
    if how == "integer":
        return F.try_element_at(asns(path), F.lit(-1))
    first = F.regexp_extract(F.coalesce(_c(path), F.lit("")), r"(?:^|[})\]])\s*([0-9][0-9 ]*)", 1)
    return F.try_element_at(asns(first), F.lit(-1))


def first_asn(path: C) -> Column:
    return F.try_element_at(sequence_asns(path), F.lit(1))


def hop_count(path: C) -> Column:
    return F.size(sequence_asns(path))


def pairs_of(items: Column) -> Column:
    """Neighbours of an array as structs (a, b)."""
    n = F.greatest(F.size(items) - 1, F.lit(0))
    return F.zip_with(F.slice(items, F.lit(1), n), F.slice(items, F.lit(2), n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def has_prepending(path: C) -> Column:
    return F.exists(pairs_of(asns(path)), lambda p: p["a"] == p["b"])


def has_loop(path: C) -> Column:
    """An AS number comes back after another one."""
    once = collapse(asns(path))
    return F.size(F.array_distinct(once)) < F.size(once)


def collapse(items: Column) -> Column:
    """Without repeats of the element before."""
    return F.filter(items, lambda x, i: (i == 0) | (x != F.element_at(items, F.greatest(i, F.lit(1)))))


#: Well-known communities.
WELL_KNOWN = {0xFFFFFF01: "NO_EXPORT", 0xFFFFFF02: "NO_ADVERTISE", 0xFFFFFF03: "NO_EXPORT_SUBCONFED", 0xFFFF029A: "BLACKHOLE", 0xFFFF0000: "GRACEFUL_SHUTDOWN", 0xFFFF0001: "ACCEPT_OWN"}


def community_name(value: C) -> Column:
    """A 32-bit community's well-known name, or asn:value."""
    v = _c(value).cast("bigint")
    out = F.concat_ws(":", F.shiftright(v, 16).cast("string"), v.bitwiseAND(0xFFFF).cast("string"))
    for k, name in WELL_KNOWN.items():
        out = F.when(v == k, name).otherwise(out)
    return F.when(v.isNotNull(), out)


def _hex(text: Column, start: int, digits: int) -> Column:
    return F.conv(F.substring(text, start, digits), 16, 10).cast("bigint")


def _dotted(text: Column, start: int) -> Column:
    return F.concat_ws(".", *(_hex(text, start + 2 * i, 2).cast("string") for i in range(4)))


def _ext_parts(raw: C) -> tuple[Column, Column, Column]:
    h = F.lower(_c(raw))
    return h, _hex(h, 1, 2).bitwiseAND(0x3F), F.substring(h, 3, 2)


#: The kinds' names are fixed values.
def ext_community_kind(raw: C) -> Column:
    """What an extended community of 16 hexadecimal digits is."""
    _, kind, sub = _ext_parts(raw)
    return F.when(kind.isin(0, 1, 2) & (sub == "02"), "route-target").when(kind.isin(0, 1, 2) & (sub == "03"), "route-origin-soo").when((kind == 3) & (sub == "0b"), "sr-te-color").when((kind == 1) & (sub == "0c"), "vxlan-vni").otherwise("extended-community")


def ext_community_text(raw: C) -> Column:
    """An extended community of 16 hexadecimal digits: rt and soo by AS number or address, color, vni, else its digits."""
    h, kind, sub = _ext_parts(raw)
    name = F.when(sub == "02", "rt").when(sub == "03", "soo")
    by_as = F.concat_ws(":", name, _hex(h, 5, 4).cast("string"), _hex(h, 9, 8).cast("string"))
    by_address = F.concat_ws(":", name, _dotted(h, 5), _hex(h, 13, 4).cast("string"))
    color = F.concat(F.lit("color:"), _hex(h, 9, 8).cast("string"))
    vni = F.concat(F.lit("vni:"), _hex(h, 11, 6).cast("string"))
    rest = F.concat(F.lit("ext:0x"), F.substring(h, 1, 4), F.lit(":"), F.substring(h, 5, 12))
    return F.when(name.isNotNull() & kind.isin(0, 2), by_as).when(name.isNotNull() & (kind == 1), by_address).when((kind == 3) & (sub == "0b"), color).when((kind == 1) & (sub == "0c"), vni).otherwise(rest)


def rd_text(raw: C) -> Column:
    """A route distinguisher of 16 hexadecimal digits as text, by its type 0, 1 or 2."""
    h = F.lower(_c(raw))
    kind = _hex(h, 1, 4)
    return F.when(kind == 0, F.concat_ws(":", _hex(h, 5, 4).cast("string"), _hex(h, 9, 8).cast("string"))).when(kind == 1, F.concat_ws(":", _dotted(h, 5), _hex(h, 13, 4).cast("string"))).when(kind == 2, F.concat_ws(":", _hex(h, 5, 8).cast("string"), _hex(h, 13, 4).cast("string"))).otherwise(h)


#: The monitoring protocol's counters, types 0 to 38 in order.
COUNTERS = {
    0: "prefixes-rejected-by-inbound-policy",
    1: "duplicate-prefix-advertisements",
    2: "duplicate-withdrawals",
    3: "cluster-list-loop-detections",
    4: "as-path-loop-detections",
    5: "originator-id-loop-detections",
    6: "implicit-withdraw-count",
    7: "explicit-withdraw-count",
    8: "update-treatments-as-withdraw",
    9: "prefixes-treated-as-withdraw",
    10: "duplicate-update-messages",
    11: "adj-rib-in-routes",
    12: "loc-rib-routes",
    13: "per-afi-safi-adj-rib-in-routes",
    14: "per-afi-safi-loc-rib-routes",
    15: "updates-subjected-to-treat-as-withdraw",
    16: "prefixes-subjected-to-treat-as-withdraw",
    17: "duplicate-update-messages-rcvd",
    18: "pre-policy-adj-rib-in-routes",
    19: "per-afi-safi-pre-policy-adj-rib-in-routes",
    20: "post-policy-adj-rib-in-routes",
    21: "per-afi-safi-post-policy-adj-rib-in-routes",
    22: "per-afi-safi-pre-policy-routes-rejected-inbound",
    23: "per-afi-safi-post-policy-routes-accepted-inbound",
    24: "adj-rib-out-pre-policy-routes",
    25: "per-afi-safi-adj-rib-out-pre-policy-routes",
    26: "per-afi-safi-damped-routes",
    27: "per-afi-safi-gr-stale-routes",
    28: "per-afi-safi-llgr-stale-routes",
    29: "pre-route-limit-adj-rib-in",
    30: "per-afi-safi-pre-route-limit-adj-rib-in",
    31: "pre-license-limit-routes",
    32: "per-afi-safi-pre-license-limit-routes",
    33: "max-aspath-length-rejected",
    34: "per-afi-safi-max-aspath-length-rejected",
    35: "per-afi-safi-rpki-invalidated-routes",
    36: "per-afi-safi-rpki-not-valid-routes",
    37: "adj-rib-out-post-policy-routes",
    38: "per-afi-safi-adj-rib-out-post-policy-routes",
}


def counter_name(kind: C) -> Column:
    out = F.lit("unknown")
    for k, name in COUNTERS.items():
        out = F.when(_c(kind) == k, name).otherwise(out)
    return out


def rib_type(peer_type: C, flags: C) -> Column:
    """The table that a message is about: flag 0x40 means after policy, 0x10 outbound; peer type 3 is the local table, filtered with 0x08, and 2 a local instance."""
    post, out = _c(flags).bitwiseAND(0x40) != 0, (_c(flags).bitwiseAND(0x10) != 0) | (_c(peer_type) == 2)
    return F.when((_c(peer_type) == 3) & (_c(flags).bitwiseAND(8) != 0), "LocRibFiltered").when(_c(peer_type) == 3, "LocRib").when(out & post, "AdjRibOutPostPolicy").when(out, "AdjRibOutPrePolicy").when(post, "AdjRibInPostPolicy").otherwise("AdjRibInPrePolicy")


def rib_type_normal(text: C) -> Column:
    """One spelling for a table's name."""
    t = F.lower(F.regexp_replace(_c(text), "[-_ ]", ""))
    return F.when(t.isin("adjribinprepolicy", "prepolicy", "adjribinpre"), "AdjRibInPrePolicy").when(t.isin("adjribinpostpolicy", "postpolicy", "adjribinpost"), "AdjRibInPostPolicy").when(t.isin("adjriboutprepolicy", "outpre", "adjriboutpre"), "AdjRibOutPrePolicy").when(t.isin("adjriboutpostpolicy", "outpost", "adjriboutpost"), "AdjRibOutPostPolicy").when(t.isin("locrib", "local"), "LocRib").otherwise(_c(text))


SEVERITIES = {"info": 0, "warning": 1, "warn": 1, "critical": 2}


def severity_rank(severity: C) -> Column:
    s = F.lower(_c(severity))
    return F.when(s == "critical", 2).when(s.isin("warning", "warn"), 1).otherwise(0)


def severity_passes(severity: C, least: str) -> Column:
    return severity_rank(severity) >= SEVERITIES[least]


def afi_normal(afi: C) -> Column:
    a = F.lower(_c(afi))
    return F.when(a.isin("1", "ipv4", "ipv4-unicast"), "ipv4-unicast").when(a.isin("2", "ipv6", "ipv6-unicast"), "ipv6-unicast").otherwise(a)


def validity_normal(text: C) -> Column:
    return F.when(_c(text) == "not_found", "not-found").otherwise(_c(text))


def rpki_code(validity: C, of: str = "export") -> Column:
    """Validity as a number; each consumer has its own. export: valid 1, invalid -1, else 0. anomaly: valid 1, invalid 0, else 0.5. hijack: valid 0, not found 0.5, invalid 1."""
    v = validity_normal(validity)
    if of == "export":
        return F.when(v == "valid", 1).when(v == "invalid", -1).otherwise(0)
    if of == "anomaly":
        return F.when(v == "valid", 1.0).when(v == "invalid", 0.0).otherwise(0.5)
    return F.when(v == "valid", 0.0).when(v == "invalid", 1.0).otherwise(0.5)


def is_private_asn(asn: C) -> Column:
    return _c(asn).between(64512, 65534) | _c(asn).between(4200000000, 4294967294)


#: Names of EVPN route types.
EVPN_NAMES = {1: "ethernet-auto-discovery", 2: "mac-ip-advertisement", 3: "inclusive-multicast", 4: "ethernet-segment", 5: "ip-prefix", 6: "selective-multicast", 7: "multicast-join-sync", 8: "multicast-leave-sync", 9: "per-region-i-pmsi", 10: "s-pmsi", 11: "leaf"}


def evpn_columns(route: C) -> list[Column]:
    """Flat columns of an EVPN route struct: what its type doesn't have is null."""
    r = _c(route)
    kind = r["route_type"]
    name = F.lit("unknown")
    for k, v in EVPN_NAMES.items():
        name = F.when(kind == k, v).otherwise(name)
    only = lambda field, *kinds: F.when(kind.isin(*kinds), r[field]).alias(field)
    return [kind.alias("route_type"), name.alias("route_type_name"), r["rd"].alias("rd"), only("ethernet_tag", 1, 2, 3, 5), only("mac", 2), only("ip", 2, 3, 4, 5), only("prefix_len", 5), only("mpls_label", 1, 2, 5), only("esi_hex", 1, 2, 4, 5)]


#: Path-status bits in the order in which they name a path, and reason codes.
STATUS_BITS = [(0x0002, "best"), (0x0008, "primary"), (0x0010, "backup"), (0x0040, "best-external"), (0x0080, "add-path"), (0x0004, "nonselected"), (0x0100, "filtered-inbound"), (0x0200, "filtered-outbound"), (0x0400, "stale"), (0x0800, "suppressed"), (0x0020, "non-installed"), (0x0001, "invalid")]
REASONS = {1: "AS loop", 2: "unresolvable nexthop", 3: "not preferred: LOCAL_PREF", 4: "not preferred: AS_PATH length", 5: "not preferred: ORIGIN type", 6: "not preferred: MED", 7: "not preferred: peer type", 8: "not preferred: IGP cost", 9: "not preferred: router-ID", 10: "not preferred: peer address", 11: "not preferred: AIGP"}


def status_label(status: C) -> Column:
    out = F.lit("unknown")
    for bit, name in reversed(STATUS_BITS):
        out = F.when(_c(status).bitwiseAND(bit) != 0, name).otherwise(out)
    return out


def reason_label(reason: C) -> Column:
    out = F.lit("")
    for k, name in REASONS.items():
        out = F.when(_c(reason) == k, name).otherwise(out)
    return out
