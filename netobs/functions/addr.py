"""Address text, private ranges and CIDR tests over BINARY addresses."""

from __future__ import annotations

import ipaddress
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from netobs.functions.bytes import as_col, blob, shl, u8

ZERO_MAC = "000000000000"
BROADCAST_MAC = "ffffffffffff"

# Address ranges treated as private / local.
PRIVATE_V4 = (
    "0.0.0.0/32",
    "10.0.0.0/8",
    "100.64.0.0/10",
    "127.0.0.0/8",
    "169.254.0.0/16",
    "172.16.0.0/12",
    "192.168.0.0/16",
)
PRIVATE_V6 = ("::/128", "fc00::/7", "fe80::/10")
# Ranges that may sit behind an edge router.
ROUTABLE_BEHIND_V4 = ("10.0.0.0/8", "100.64.0.0/10", "172.16.0.0/12", "192.168.0.0/16")


def cidr_bounds(cidr: str) -> tuple[int, bytes, bytes, int]:
    """``(family, first, last, prefix_len)`` of a CIDR; host bits are masked off."""
    net = ipaddress.ip_network(cidr, strict=False)
    return net.version, net.network_address.packed, net.broadcast_address.packed, net.prefixlen


def in_cidr(ip: Column, cidr: str) -> Column:
    """True when a 4- or 16-byte address lies in ``cidr`` (never across families)."""
    family, lo, hi, _ = cidr_bounds(cidr)
    width = 4 if family == 4 else 16
    return (F.length(ip) == width) & ip.between(F.lit(lo), F.lit(hi))


def any_of(preds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, preds, F.lit(False))


def in_any(ip: Column, cidrs: tuple[str, ...] | list[str]) -> Column:
    return any_of([in_cidr(ip, c) for c in cidrs])


def is_private_v4(ip: Column) -> Column:
    return in_any(ip, PRIVATE_V4)


def is_private_v6(ip: Column) -> Column:
    return in_any(ip, PRIVATE_V6)


def is_private(ip: Column) -> Column:
    return is_private_v4(ip) | is_private_v6(ip)


def mac_text(mac: str) -> Column:
    """Colon text of a MAC column, given by name."""
    parts = ", ".join(f"substring(h, {2 * i + 1}, 2)" for i in range(6))
    return F.expr(f"transform(array(lower(hex({mac}))), h -> concat_ws(':', {parts}))[0]")


def mac_bytes(text: Column) -> Column:
    return F.unhex(F.replace(text, F.lit(":"), F.lit("")))


def is_unicast_mac(mac: Column) -> Column:
    """Six bytes, not all zero, group bit clear."""
    return (F.length(mac) == 6) & (mac != blob(ZERO_MAC)) & (u8(mac, 0) % 2 == 0)


def _ipv4_sql(ip: str) -> str:
    octets = ", ".join(f"string(shiftright(n, {s}) & 255)" for s in (24, 16, 8, 0))
    return f"transform(array(bigint(conv(hex({ip}), 16, 10))), n -> concat_ws('.', {octets}))[0]"


def ipv4_text(ip: str) -> Column:
    """Dotted text of a 4-byte SQL expression (a column name, usually)."""
    return F.expr(_ipv4_sql(ip))


def ipv4_bytes(text: Column) -> Column:
    parts = F.split(text, "\\.")
    return F.unhex(F.concat(*[F.lpad(F.hex(parts[i].cast("bigint")), 2, "0") for i in range(4)]))


def _ipv6_sql(ip: str) -> str:
    groups = ", ".join(
        f"lower(hex(bigint(conv(hex(substring({ip}, {2 * i + 1}, 2)), 16, 10))))" for i in range(8)
    )
    # g is ':a:b:...:h:'; the first match of the longest zero run is cut out
    cuts = []
    for run in range(8, 1, -1):
        pat = ":0" * run + ":"
        cuts.append(
            f"WHEN instr(g, '{pat}') > 0 THEN concat(substring(g, 2, instr(g, '{pat}') - 2), '::', "
            f"rtrim(':', substring(g, instr(g, '{pat}') + {len(pat)})))"
        )
    compressed = (
        f"transform(array(concat(':', concat_ws(':', {groups}), ':')), "
        f"g -> CASE {' '.join(cuts)} ELSE trim(BOTH ':' FROM g) END)[0]"
    )
    head, tail = f"hex(substring({ip}, 1, 12))", _ipv4_sql(f"substring({ip}, 13, 4)")
    return (
        f"CASE WHEN {head} = '{'0' * 20}FFFF' THEN concat('::ffff:', {tail}) "
        f"WHEN {head} = '{'0' * 24}' AND substring({ip}, 13, 2) != X'0000' THEN concat('::', {tail}) "
        f"ELSE {compressed} END"
    )


def ipv6_text(ip: str) -> Column:
    """Canonical lower-case text: the first longest run of zero groups becomes ``::``.

    An address whose first 96 bits are zero (or end in ``ffff``) and whose next
    group is not zero is shown with a dotted IPv4 tail.  ``ip`` is SQL text.
    """
    return F.expr(_ipv6_sql(ip))


def ip_text(ip: str) -> Column:
    return F.expr(
        f"CASE WHEN length({ip}) = 4 THEN {_ipv4_sql(ip)} WHEN length({ip}) = 16 THEN {_ipv6_sql(ip)} END"
    )


def vlan_label(outer: Column, inner: Column) -> Column:
    """``0`` untagged, ``N`` single tag, ``outer/inner`` for stacked tags."""
    o = outer.cast("string")
    return F.when(inner != 0, F.concat(o, F.lit("/"), inner.cast("string"))).otherwise(o)


def mask_ip(ip: Column, prefix_len: int | Column) -> Column:
    """Network address of ``ip`` for ``prefix_len``, same width as ``ip``."""
    plen = as_col(prefix_len)
    whole = F.floor(plen / 8).cast("int")
    rest = plen % 8
    keep = F.lit(256) - shl(F.lit(1), (F.lit(8) - rest).cast("int"))
    part = F.when(
        rest == 0, F.lit("")
    ).otherwise(F.lpad(F.hex(u8(ip, whole).bitwiseAND(keep).cast("bigint")), 2, "0"))
    head = F.concat(F.hex(F.substring(ip, F.lit(1), whole)), part)
    return F.unhex(F.rpad(head, 2 * F.length(ip), F.lit("0")))
