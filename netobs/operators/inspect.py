"""Live-inspector text lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netobs.functions.addr import ip_text
from netobs.functions.bytes import bits, u8, u16, u32
from netobs.operators import decode as d
from netobs.operators.filters import endpoint_filter, exclude_filter


def inspector_line() -> Column:
    """One readable line per packet, NULL when the TCP header is broken."""
    b, n = F.col("l4"), F.length("l4")
    stamp = F.date_format("ts", "HH:mm:ss.SSSSSS")
    src, dst = ip_text("src_ip"), ip_text("dst_ip")
    flags = u8(b, 13)
    # Flag letters in display order.
    letters = F.concat(
        *[
            F.when(bits(flags, bit) != 0, F.lit(ch)).otherwise(F.lit(""))
            for bit, ch in ((d.SYN, "S"), (d.ACK, "."), (d.PSH, "P"), (d.FIN, "F"), (d.RST, "R"))
        ]
    )
    hl = F.shiftright(u8(b, 12), 4) * 4
    tcp = F.when(
        (hl >= 20) & (hl <= n),
        F.format_string(
            "%s IP %s.%d > %s.%d: Flags [%s], seq %d, win %d, length %d",
            stamp, src, u16(b, 0), dst, u16(b, 2),
            F.when(letters != "", letters).otherwise(F.lit("none")), u32(b, 4), u16(b, 14), n - hl,
        ),
    )
    udp = F.format_string(
        "%s IP %s.%d > %s.%d: UDP, length %d", stamp, src, u16(b, 0), dst, u16(b, 2), u16(b, 4)
    )
    ip_len = F.col("l3_end") - F.col("l3_off")
    v4 = (
        F.when((F.col("proto") == d.TCP) & (n >= 20), tcp)
        .when((F.col("proto") == d.UDP) & (n >= 8), udp)
        .when(F.col("proto") == d.ICMP, F.format_string("%s IP %s > %s: ICMP, length %d", stamp, src, dst, n))
        .otherwise(
            F.format_string("%s IP %s > %s: proto %d, length %d", stamp, src, dst, F.col("proto"), ip_len)
        )
    )
    v6 = F.format_string(
        "%s IP6 %s > %s: next-hdr %d, length %d", stamp, src, dst, F.col("next_hdr"), ip_len - 40
    )
    arp = F.format_string("%s ARP, length %d", stamp, F.length("data") - F.col("l3_off"))
    other = F.format_string(
        "%s ethertype 0x%s, length %d", stamp,
        F.lpad(F.lower(F.hex(F.col("l3_proto").cast("bigint"))), 4, "0"), F.length("data"),
    )
    return (
        F.when(F.col("ip_version") == 4, v4)
        .when(F.col("ip_version") == 6, v6)
        .when(F.col("l3_proto") == d.ETH_ARP, arp)
        .otherwise(other)
    )


def limit_packets(packets: DataFrame, n: int) -> DataFrame:
    """First ``n`` packets in arrival order; 0 means all.

    A stream counts them in its state and gives any ``n`` of the batch that reaches it.
    """
    if n <= 0:
        return packets
    return packets.limit(n) if packets.isStreaming else packets.orderBy("ts", "seq").limit(n)


def inspect_packets(
    packets: DataFrame, show: str, exclude: str | None = None, count: int = 0
) -> DataFrame:
    """``ts, seq, line`` of packets matching ``show``.

    Packets count towards ``count`` even when they give no line.
    """
    hit = exclude_filter(packets, exclude).where(endpoint_filter(show))
    lines = limit_packets(hit, count).select("ts", "seq", inspector_line().alias("line"))
    return lines.where(F.col("line").isNotNull())
