"""Prefixes as numbers and bytes, in Spark's own functions. A prefix is kept as (family, net, len); net is the masked network."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skerry.functions.scalars import C, _c

_PART = "(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
V4 = rf"^(?:{_PART}\.){{3}}{_PART}(?:/[0-9]{{1,2}})?$"


def v4_number(text: C) -> Column:
    """An IPv4 address's 32-bit number; null unless four parts to 255."""
    parts = F.split(F.substring_index(_c(text), "/", 1), r"\.")
    part = lambda i: F.get(parts, F.lit(i)).cast("bigint")
    return F.when(_c(text).rlike(V4), part(0) * (1 << 24) + part(1) * (1 << 16) + part(2) * (1 << 8) + part(3))


def prefix_length(text: C) -> Column:
    return F.try_element_at(F.split(_c(text), "/"), F.lit(2)).try_cast("int")


def v4_mask(number: Column, length: Column | int) -> Column:
    """The network of so many bits that holds a number."""
    size = F.pow(F.lit(2.0), F.lit(32) - (F.lit(length) if isinstance(length, int) else length)).cast("bigint")
    return number - F.pmod(number, size)


def v4_net(text: C) -> Column:
    """The masked network of an IPv4 prefix."""
    n = F.least(F.coalesce(prefix_length(text), F.lit(32)), F.lit(32))
    return v4_mask(v4_number(text), n)


def is_v4(text: C) -> Column:
    return v4_number(text).isNotNull()


def v4_contains(net: C, length: C, inner_net: C, inner_length: C) -> Column:
    """(net, length) holds the inner prefix."""
    return (_c(inner_length) >= _c(length)) & (v4_mask(_c(inner_net), _c(length)) == _c(net))


def _let(value: str, name: str, use: str) -> str:
    """SQL of `use` in which `name` stands for a value that is worked out once, and is once in the plan, however often it is named."""
    return f"transform(array({value}), {name} -> {use})[0]"


#: The 32 hexadecimal digits of an IPv6 address or prefix {text}; null unless it is one in groups of digits.
_V6_HEX = _let(
    "lower(trim(substring_index({text}, '/', 1)))",
    "a",
    "IF(a RLIKE '^[0-9a-f:]+$' AND NOT a RLIKE ':::|^:[^:]|[^:]:$', "
    + _let(
        "split(a, '::', -1)",
        "h",
        _let(
            "struct(size(h) AS halves, filter(split(h[0], ':'), x -> x <> '') AS l, filter(split(coalesce(get(h, 1), ''), ':'), x -> x <> '') AS r)",
            "g",
            "IF((g.halves = 1 AND size(g.l) = 8 OR g.halves = 2 AND size(g.l) + size(g.r) < 8) AND forall(concat(g.l, g.r), x -> length(x) <= 4), "
            "array_join(transform(concat(g.l, array_repeat('0', greatest(8 - size(g.l) - size(g.r), 0)), g.r), x -> lpad(x, 4, '0')), ''), NULL)",
        ),
    )
    + ", NULL)",
)
#: Its first {n} bits as 16 bytes: whole digits, and the first bits of the next one.
_V6_NET = _let(
    _V6_HEX,
    "f",
    "IF(f IS NULL, NULL, unhex(rpad(concat(substring(f, 1, {n} DIV 4), IF({n} % 4 = 0, '', " + _let("CAST(conv(substring(f, {n} DIV 4 + 1, 1), 16, 10) AS INT)", "d", "lower(hex(d - d % array(16, 8, 4, 2)[{n} % 4]))") + ")), 32, '0')))",
)


def v6_net(text: str, length: str) -> Column:
    """16 bytes of an IPv6 prefix's network, masked to the given length (both names of columns); null if it isn't one or is shorter than that length."""
    net = _V6_NET.format(text=f"`{text}`", n=f"CAST(`{length}` AS INT)")
    return F.when(F.col(text).contains(":") & (F.coalesce(prefix_length(text), F.lit(128)) >= F.col(length)) & F.col(length).between(0, 128), F.expr(net))
