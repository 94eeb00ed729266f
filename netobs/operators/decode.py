"""Frames to packets: link layer, VLAN, IPv4 / IPv6, transport slice.

Each step adds a handful of columns and one filter, so every value is computed
once and rows that cannot be decoded leave early.  No step shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netobs.functions.addr import BROADCAST_MAC, ZERO_MAC, mac_text, vlan_label
from netobs.functions.bytes import bits, blob, let, take, u8, u16, walk
from netobs.plans.stage import stage

# Protocol numbers.
VLAN_TPIDS = (0x8100, 0x88A8)
PPPOE_SESSION = 0x8864
ETH_IPV4, ETH_IPV6, ETH_ARP, ETH_LLDP = 0x0800, 0x86DD, 0x0806, 0x88CC
PPP_IPV4, PPP_IPV6 = 0x0021, 0x0057
TCP, UDP, ICMP, ICMPV6 = 6, 17, 1, 58
EXT_OPTIONS = (0, 43, 60)
EXT_FRAGMENT, EXT_AUTH, EXT_NONE = 44, 51, 59


def strip_l2(frames: DataFrame) -> DataFrame:
    """Add ``src_mac, dst_mac, l3_proto, l3_off, outer_vlan, inner_vlan``."""
    b, n = F.col("data"), F.length("data")
    eth, cooked, raw = (F.col("link_type") == t for t in ("ethernet", "cooked", "raw_ip"))
    df = stage(
        frames,
        {"_n": n, "_t0": F.when(eth, u16(b, 12)), "_t1": F.when(eth, u16(b, 16))},
        where=n >= F.when(eth, F.lit(14)).when(cooked, F.lit(16)).otherwise(F.lit(1)),
    )
    tagged = F.coalesce(F.col("_t0").isin(*VLAN_TPIDS), F.lit(False))
    stacked = tagged & F.coalesce(F.col("_t1").isin(*VLAN_TPIDS), F.lit(False))
    end = (
        F.when(stacked, F.lit(22)).when(tagged, F.lit(18)).when(eth, F.lit(14))
        .when(cooked, F.lit(16)).otherwise(F.lit(0))
    )
    zero = blob(ZERO_MAC)
    nibble = F.shiftright(u8(b, 0), 4)
    df = stage(
        df,
        {
            "_end": end,
            "_et": F.when(raw, F.when(nibble == 4, F.lit(ETH_IPV4)).when(nibble == 6, F.lit(ETH_IPV6)))
            .when(stacked, u16(b, 20)).when(tagged, F.col("_t1")).when(eth, F.col("_t0"))
            .otherwise(u16(b, 14)),
            "src_mac": F.when(eth | (cooked & (u8(b, 4) >= 6)), take(b, 6, 6)).otherwise(zero),
            "dst_mac": F.when(eth, take(b, 0, 6)).otherwise(zero),
            "outer_vlan": F.when(tagged, bits(u16(b, 14), 4095)).otherwise(F.lit(0)),
            "inner_vlan": F.when(stacked, bits(u16(b, 18), 4095)).otherwise(F.lit(0)),
        },
        where=F.col("_n") >= end,
        drop=("_t0", "_t1"),
    )
    pppoe = eth & (F.col("_et") == PPPOE_SESSION)
    ppp = u16(b, F.col("_end") + 6)
    proto = F.when(
        pppoe,
        F.when(
            F.col("_n") >= F.col("_end") + 8,
            F.when(ppp == PPP_IPV4, F.lit(ETH_IPV4)).when(ppp == PPP_IPV6, F.lit(ETH_IPV6)),
        ),
    ).otherwise(F.col("_et"))
    df = stage(
        df,
        {"l3_proto": proto, "l3_off": F.when(pppoe, F.col("_end") + 8).otherwise(F.col("_end"))},
        drop=("_n", "_end", "_et"),
    )
    return df.where(F.col("l3_proto").isNotNull())


def merge_aux_vlan(df: DataFrame) -> DataFrame:
    """Combine the tag stripped by hardware with the tags in the frame."""
    aux = bits(F.col("aux_vlan"), 4095)
    outer, inner = F.col("outer_vlan"), F.col("inner_vlan")
    push = aux.isNotNull() & (outer != 0) & (aux != outer)
    return df.withColumns(
        {
            "outer_vlan": F.when(aux.isNotNull() & ((outer == 0) | push), aux).otherwise(outer),
            "inner_vlan": F.when(push, outer).otherwise(inner),
        }
    )


def source_mac_sane(df: DataFrame) -> DataFrame:
    """Drop zero and broadcast source MACs on links that have MACs."""
    bad = F.col("src_mac").isin(bytes.fromhex(ZERO_MAC), bytes.fromhex(BROADCAST_MAC))
    return df.where((F.col("link_type") == "raw_ip") | ~bad)


def ipv6_l4(b: Column, l3_off: Column) -> Column:
    """``STRUCT<proto, off, ok>`` after the extension headers."""
    n = F.length(b)

    def state(proto, off, ok, done):
        return F.struct(
            proto.cast("int").alias("proto"),
            off.cast("int").alias("off"),
            ok.alias("ok"),
            done.alias("done"),
        )

    def step(s):
        off, proto = s["off"], s["proto"]
        fail = state(proto, off, F.lit(False), F.lit(True))

        def jump(size):
            return F.when(off + 2 > n, fail).otherwise(
                let(
                    size,
                    lambda z: F.when(off + z > n, fail).otherwise(
                        state(u8(b, off), off + z, F.lit(True), F.lit(False))
                    ),
                )
            )

        fragment = F.when(
            (off + 8 > n) | (bits(u16(b, off + 2), 65528) != 0), fail
        ).otherwise(state(u8(b, off), off + 8, F.lit(True), F.lit(False)))
        return (
            F.when(proto.isin(*EXT_OPTIONS), jump((u8(b, off + 1) + 1) * 8))
            .when(proto == EXT_FRAGMENT, fragment)
            .when(proto == EXT_AUTH, jump((u8(b, off + 1) + 2) * 4))
            .when(proto == EXT_NONE, fail)
            .otherwise(state(proto, off, F.lit(True), F.lit(True)))
        )

    first = u8(b, l3_off + 6)
    start = state(first, l3_off + 40, F.lit(True), F.lit(False))
    chained = first.isin(*EXT_OPTIONS, EXT_FRAGMENT, EXT_AUTH, EXT_NONE)
    end = F.when(chained, walk(F.floor((n - l3_off - 40) / 8).cast("int") + 1, start, step, lambda s: s["done"])).otherwise(start)
    return let(end, lambda e: F.struct(e["proto"].alias("proto"), e["off"].alias("off"), e["ok"].alias("ok")))


def decode_l3(df: DataFrame, ipv6: bool = True) -> DataFrame:
    """IP headers and the bounded transport slice.

    Adds ``ip_version`` (NULL for ARP / LLDP), ``src_ip, dst_ip, proto,
    next_hdr, ttl, is_fragment, l3_end, l4_off`` and ``l4``.  For ARP and LLDP
    ``l4`` is the whole payload after the link layer.
    """
    b, n, off = F.col("data"), F.length("data"), F.col("l3_off")
    v4 = F.col("l3_proto") == ETH_IPV4
    v6 = F.col("l3_proto") == ETH_IPV6
    other = F.col("l3_proto").isin(ETH_ARP, ETH_LLDP)
    avail = n - off
    keep = other | (v4 & (avail >= 20))
    if ipv6:
        keep = keep | (v6 & (avail >= 40))
    first = u8(b, off)
    df = stage(
        df,
        {
            "ip_version": F.when(~other, F.shiftright(first, 4)),
            "_hl": F.when(v4, bits(first, 15) * 4).when(v6, F.lit(40)).otherwise(F.lit(0)),
            "_len": F.when(v4, u16(b, off + 2)).when(v6, u16(b, off + 4) + 40).otherwise(avail),
        },
        where=keep,
    )
    whole = (
        (F.col("ip_version") == F.when(v4, F.lit(4)).otherwise(F.lit(6)))
        & (F.col("_hl") >= 20)
        & (F.col("_hl") <= F.col("_len"))
        & (F.col("_len") <= avail)
    )
    plain = F.struct(
        F.when(v4, u8(b, off + 9)).alias("proto"),
        (off + F.col("_hl")).cast("int").alias("off"),
        F.lit(True).alias("ok"),
    )
    six = F.when(v6, ipv6_l4(b, off)).otherwise(plain) if ipv6 else plain
    df = stage(
        df,
        {
            "_t": six,
            "l3_end": (off + F.col("_len")).cast("int"),
            "src_ip": F.when(v4, take(b, off + 12, 4)).when(v6, take(b, off + 8, 16)),
            "dst_ip": F.when(v4, take(b, off + 16, 4)).when(v6, take(b, off + 24, 16)),
            "next_hdr": F.when(v4, u8(b, off + 9)).when(v6, u8(b, off + 6)),
            "ttl": F.when(v4, u8(b, off + 8)).when(v6, u8(b, off + 7)),
            "is_fragment": F.when(v4, bits(u16(b, off + 6), 8191) != 0).otherwise(F.lit(False)),
        },
        where=other | whole,
        drop=("_hl", "_len"),
    )
    return stage(
        df,
        {
            "proto": F.col("_t.proto"),
            "l4_off": F.col("_t.off"),
            "l4": take(b, F.col("_t.off"), F.col("l3_end") - F.col("_t.off")),
        },
        where=F.col("_t.ok"),
        drop=("_t",),
    )


def decode_frames(frames: DataFrame, ipv6: bool = True) -> DataFrame:
    """All structural decoding; direction and identity need the prefix set."""
    df = source_mac_sane(merge_aux_vlan(strip_l2(frames)))
    return decode_l3(df, ipv6).withColumn("vlan", vlan_label(F.col("outer_vlan"), F.col("inner_vlan")))


def device_identity(packets: DataFrame) -> DataFrame:
    """Add ``device_mac``: who the record is about.

    Control frames and outbound packets name their sender, inbound packets the
    receiver; a raw IP link has no MAC, so its interface name stands in.
    """
    sender = F.col("ip_version").isNull() | F.col("is_outbound")
    raw = F.col("link_type") == "raw_ip"
    df = packets.withColumn("_dev", F.when(sender, F.col("src_mac")).otherwise(F.col("dst_mac")))
    bad = F.col("_dev").isin(bytes.fromhex(ZERO_MAC), bytes.fromhex(BROADCAST_MAC))
    return (
        df.where(raw | ~bad)
        .withColumn("device_mac", F.when(raw, F.col("iface")).otherwise(mac_text("_dev")))
        .drop("_dev")
    )


def tcp_segments(packets: DataFrame) -> DataFrame:
    """TCP packets with ``sport, dport, flags, window, tcp_hl, tcp_options, payload``."""
    b, n, hl = F.col("l4"), F.length("l4"), F.col("tcp_hl")
    df = stage(
        packets.where((F.col("proto") == TCP) & ~F.col("is_fragment")),
        {
            "tcp_hl": F.shiftright(u8(b, 12), 4) * 4,
            "sport": u16(b, 0),
            "dport": u16(b, 2),
            "flags": u8(b, 13),
            "window": u16(b, 14),
        },
        where=n >= 20,
    )
    return df.where((hl >= 20) & (hl <= n)).withColumns(
        {"tcp_options": take(b, 20, hl - 20), "payload": take(b, hl, n - hl)}
    )


FIN, SYN, RST, PSH, ACK = 1, 2, 4, 8, 16


def has_flag(flag: int, flags: str = "flags") -> Column:
    return bits(F.col(flags), flag) != 0


def udp_datagrams(packets: DataFrame) -> DataFrame:
    """UDP packets with ``sport, dport, payload``; empty payloads are dropped."""
    b, n = F.col("l4"), F.length("l4")
    df = stage(
        packets.where((F.col("proto") == UDP) & ~F.col("is_fragment")),
        {"sport": u16(b, 0), "dport": u16(b, 2), "_ulen": u16(b, 4)},
        where=n >= 8,
    )
    return (
        df.where((F.col("_ulen") > 8) & (F.col("_ulen") <= n))
        .withColumn("payload", take(b, 8, F.col("_ulen") - 8))
        .drop("_ulen")
    )


def tcp_and_udp(packets: DataFrame) -> DataFrame:
    """TCP segments and UDP datagrams in one pass: ``sport, dport, payload`` as the two functions above give them."""
    b, n, tcp = F.col("l4"), F.length("l4"), F.col("proto") == TCP
    start, end = F.col("_start"), F.col("_stop")
    df = stage(
        packets.where(F.col("proto").isin(TCP, UDP) & ~F.col("is_fragment")),
        {
            "_start": F.when(tcp, F.shiftright(u8(b, 12), 4) * 4).otherwise(F.lit(8)),
            "_stop": F.when(tcp, n).otherwise(u16(b, 4)),
            "sport": u16(b, 0),
            "dport": u16(b, 2),
        },
        where=n >= F.when(tcp, F.lit(20)).otherwise(F.lit(8)),
    )
    fits = F.when(tcp, (start >= 20) & (start <= end)).otherwise((end > 8) & (end <= n))
    return df.where(fits).withColumn("payload", take(b, start, end - start)).drop("_start", "_stop")
