"""Inside / direct / off-link classification against prefix tables.

A configuration written out in a ``PrefixSet`` folds into literal range
predicates: no join, no broadcast, and the tests run inside the decode
projection.  Prefix tables go through ``prefixes.Lookup``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netobs.functions.addr import (
    ROUTABLE_BEHIND_V4,
    any_of,
    cidr_bounds,
    in_any,
    in_cidr,
    is_private,
)
from netobs.functions.bytes import bits, take, u8
from netobs.operators.prefixes import Lookup
from netobs.schemas import PREFIX


@dataclass(frozen=True)
class PrefixSet:
    """``inside`` CIDRs and ``learned`` ``(iface, cidr)`` pairs."""

    inside: tuple[str, ...] = ()
    learned: tuple[tuple[str, str], ...] = field(default=())

    def __post_init__(self):
        for cidr in (*self.inside, *(c for _, c in self.learned)):
            cidr_bounds(cidr)

    def rows(self) -> list[tuple]:
        out = []
        for kind, iface, cidr in [
            *(("inside", None, c) for c in self.inside),
            *(("learned", i, c) for i, c in self.learned),
        ]:
            family, lo, hi, plen = cidr_bounds(cidr)
            out.append((kind, family, iface, bytearray(lo), bytearray(hi), plen))
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows(), PREFIX)

    # -- predicates -----------------------------------------------------------

    def is_inside(self, ip: Column) -> Column:
        """Configured, private or learned on any interface."""
        learned = tuple(dict.fromkeys(c for _, c in self.learned))
        return F.coalesce(in_any(ip, self.inside) | is_private(ip) | in_any(ip, learned), F.lit(False))

    def has_prefix(self, iface: Column, family: int) -> Column:
        names = {i for i, c in self.learned if cidr_bounds(c)[0] == family}
        return iface.isin(*sorted(names)) if names else F.lit(False)

    def is_direct(self, ip: Column, iface: Column) -> Column:
        return any_of([(iface == i) & in_cidr(ip, c) for i, c in self.learned])

    def offlink_routed_v4(self, ip: Column, iface: Column) -> Column:
        """Private-style source that is not on the interface's own network."""
        return (
            self.has_prefix(iface, 4)
            & ~self.is_direct(ip, iface)
            & in_any(ip, ROUTABLE_BEHIND_V4)
        )

    def offlink_routed_v6(self, ip: Column, iface: Column) -> Column:
        """Unique-local source, or a global one sharing 48 bits with the interface."""
        siblings = []
        for i, cidr in self.learned:
            family, lo, _, _ = cidr_bounds(cidr)
            if family == 6 and lo[0] & 0xE0 == 0x20:
                siblings.append((iface == i) & (take(ip, 0, 6) == F.lit(lo[:6])))
        first = u8(ip, 0)
        ula = bits(first, 254) == 252
        gua = bits(first, 224) == 32
        return (
            (F.length(ip) == 16)
            & self.has_prefix(iface, 6)
            & ~self.is_direct(ip, iface)
            & (ula | (gua & any_of(siblings)))
        )

    def offlink_routed(self, ip: Column, iface: Column) -> Column:
        return F.coalesce(
            self.offlink_routed_v4(ip, iface) | self.offlink_routed_v6(ip, iface), F.lit(False)
        )

    # -- the same on tables, as ``PrefixTable`` has it ---------------------------

    def classified(self, df: DataFrame, inside: dict[str, str], offlink: dict[str, str]) -> DataFrame:
        """Add a flag for each address column: configured, private or learned; come through a router."""
        flags = {out: self.is_inside(F.col(ip)) for ip, out in inside.items()}
        flags |= {out: self.offlink_routed(F.col(ip), F.col("iface")) for ip, out in offlink.items()}
        return df.withColumns(flags)


class PrefixTable:
    """Prefixes of any number, as a table with the PREFIX schema (see ``prefixes``)."""

    inside: tuple[str, ...] = ()

    def __init__(self, table: DataFrame):
        self.lookup = Lookup(table)

    def classified(self, df: DataFrame, inside: dict[str, str], offlink: dict[str, str]) -> DataFrame:
        """Add a flag for each address column, as ``PrefixSet`` does; an address is looked up once."""
        found = {ip: f"_of_{ip}" for ip in dict.fromkeys([*inside, *offlink])}
        marked = self.lookup.add(df, found)
        flags = {}
        for ip, out in inside.items():
            flags[out] = F.col(f"{found[ip]}.any") | F.coalesce(is_private(F.col(ip)), F.lit(False))
        for ip, out in offlink.items():
            address, first, iface = F.col(ip), u8(F.col(ip), 0), F.col("iface")
            direct, near = (F.coalesce(F.array_contains(f"{found[ip]}.{k}", iface), F.lit(False)) for k in ("direct", "near"))
            behind = F.when(F.length(ip) == 4, in_any(address, ROUTABLE_BEHIND_V4)).otherwise(
                (bits(first, 254) == 252) | ((bits(first, 224) == 32) & near)
            )
            flags[out] = F.coalesce(self.lookup.knows(address, iface) & ~direct & behind, F.lit(False))
        return marked.withColumns(flags).drop(*found.values())


def direction(packets: DataFrame, prefixes: PrefixSet | PrefixTable) -> DataFrame:
    """Add ``is_outbound, offlink_routed``; drop IP packets with no inside end.

    ARP and LLDP rows pass with both flags false.
    """
    is_ip = F.col("ip_version").isNotNull()
    df = prefixes.classified(packets, {"src_ip": "_src_in", "dst_ip": "_dst_in"}, {"src_ip": "offlink_routed"})
    df = df.withColumn("offlink_routed", is_ip & F.col("offlink_routed"))
    df = df.where(~is_ip | F.col("_src_in") | F.col("_dst_in") | F.col("offlink_routed"))
    return df.withColumn(
        "is_outbound", is_ip & (F.col("_src_in") | F.col("offlink_routed"))
    ).drop("_src_in", "_dst_in")
