"""Frame decoding: built frames decode back to the columns they came from."""

from __future__ import annotations

from pyspark.sql import functions as F

from netobs.checks.common import hex_lower, link_local, tcp_frames, udp_frames, v4_frames, v6_frames
from netobs.checks.registry import query
from netobs.functions.addr import ip_text, mac_text
from netobs.operators.classify import PrefixSet, direction
from netobs.operators.decode import (
    decode_frames,
    device_identity,
    merge_aux_vlan,
    source_mac_sane,
    strip_l2,
    tcp_segments,
    udp_datagrams,
)
from netobs.operators.inspect import inspect_packets
from netobs.checks import derived as g
from netobs.plans.jobs import Options, located_packets
from netobs.operators.vectors import vectors


def tagged_frames(p):
    """No tag, one tag, provider tag, two tags, by k; the last byte is padding."""
    o, i = F.col("outer_vlan"), F.col("inner_vlan")
    tags = (
        F.when(o == 0, F.lit(""))
        .when(o == 20, g.cat("8100", g.hx(o + 8192, 2)))
        .when(o == 30, g.cat("88a8", g.hx(o, 2)))
        .otherwise(g.cat("88a8", g.hx(o, 2), "8100", g.hx(i, 2)))
    )
    ip = g.ipv4(6, g.ip_hex(F.col("src_ip")), g.ip_hex(F.col("dst_ip")), g.tcp(F.col("sport"), F.col("dport"), 2))
    return g.as_frames(p, g.cat(g.ether(g.GATEWAY, g.mac_hex(), "0800", ip, tags), "ee"))


@query(
    "decode_l2",
    """SELECT seq, mac AS src_mac, '02:00:00:00:ff:01' AS dst_mac, 2048 AS l3_proto,
       14 + 4 * CAST(outer_vlan > 0 AS INTEGER) + 4 * CAST(inner_vlan > 0 AS INTEGER) AS l3_off,
       outer_vlan, inner_vlan FROM pk""",
)
def _decode_l2(spark, sf):
    return strip_l2(tagged_frames(g.pk(spark, sf))).select(
        "seq", mac_text("src_mac").alias("src_mac"), mac_text("dst_mac").alias("dst_mac"), "l3_proto",
        "l3_off", "outer_vlan", "inner_vlan",
    )


@query(
    "decode_ipv4_tcp",
    """SELECT seq, src_ip, dst_ip, sport, dport, 2 AS flags, 6 AS proto, 64 AS ttl, 20 AS l4_len,
       CASE WHEN inner_vlan <> 0 THEN outer_vlan || '/' || inner_vlan ELSE CAST(outer_vlan AS VARCHAR) END AS vlan
FROM pk""",
)
def _decode_tcp(spark, sf):
    seg = tcp_segments(decode_frames(tagged_frames(g.pk(spark, sf))))
    return seg.select(
        "seq", ip_text("src_ip").alias("src_ip"), ip_text("dst_ip").alias("dst_ip"), "sport", "dport",
        "flags", "proto", "ttl", F.length("l4").alias("l4_len"), "vlan",
    )


@query(
    "decode_udp",
    "SELECT seq, sport, dport, 10 + k AS payload_len, repeat('ab', 10 + k) AS payload FROM pk",
)
def _decode_udp(spark, sf):
    frames = udp_frames(g.pk(spark, sf), F.col("sport"), F.col("dport"), F.repeat(F.lit("ab"), F.col("k") + 10))
    return udp_datagrams(decode_frames(frames)).select(
        "seq", "sport", "dport", F.length("payload").alias("payload_len"), hex_lower("payload").alias("payload")
    )


@query(
    "decode_fragments",
    """SELECT seq, CAST(k % 3 = 1 AS INTEGER) AS is_fragment, CAST(k % 3 <> 1 AS INTEGER) AS has_l4 FROM pk""",
)
def _decode_fragments(spark, sf):
    """More-fragments on the first piece keeps L4, a later piece has none."""
    k = F.col("k")
    frag = F.when(k % 3 == 0, F.lit(8192)).when(k % 3 == 1, k + 1).otherwise(F.lit(16384))
    p = g.pk(spark, sf)
    pk = decode_frames(v4_frames(p, 17, g.udp(F.col("sport"), F.lit(53), "abcd"), frag=frag))
    l4 = udp_datagrams(pk).select("seq", F.lit(1).alias("has_l4"))
    return pk.select("seq", F.col("is_fragment").cast("int")).join(l4, "seq", "left").na.fill(0, ["has_l4"])


@query(
    "decode_truncated",
    "SELECT count(*) AS kept, CAST(sum(k) AS BIGINT) AS k_sum FROM pk WHERE k >= 44",
)
def _decode_truncated(spark, sf):
    """Frames cut to k bytes: only those holding Ethernet, IP and TCP headers are segments."""
    p = g.pk(spark, sf)
    frames = tcp_frames(p, 2, F.col("sport"), F.col("dport"))
    cut = frames.join(p.select("seq", "k"), "seq").withColumn(
        "data", F.expr("substring(data, 1, least(k, 43) + CASE WHEN k >= 44 THEN 11 ELSE 0 END)")
    )
    return tcp_segments(decode_frames(cut.drop("k"))).join(p.select("seq", "k"), "seq").agg(
        F.count("*").alias("kept"), F.sum("k").alias("k_sum")
    )


@query(
    "decode_ipv6",
    """SELECT seq, printf('fe80::%x', dev + 1) AS src_ip,
       CASE k % 3 WHEN 0 THEN 'ff02::1' WHEN 1 THEN '2001:db8:0:1::' || printf('%x', k + 1)
            ELSE '::ffff:203.0.113.' || k END AS dst_ip,
       6 AS ip_version, 17 AS proto, 64 - k % 64 AS ttl, CAST(sport AS INTEGER) AS sport,
       CASE WHEN k % 5 = 4 THEN 51 WHEN k % 5 = 0 THEN 17 ELSE [0, 43, 44][k % 5] END AS next_hdr
FROM pk WHERE NOT (k % 5 = 3 AND k % 2 = 1)""",
)
def _decode_ipv6(spark, sf):
    """Extension chains by k: none, options, options+routing, fragment, authentication."""
    k = F.col("k")
    dst = (
        F.when(k % 3 == 0, F.lit("ff02" + "00" * 13 + "01"))
        .when(k % 3 == 1, g.cat("20010db800000001", "00" * 6, g.hx(k + 1, 2)))
        .otherwise(g.cat("00" * 10 + "ffff", "cb0071", g.hx(k, 1)))
    )
    datagram = g.udp(F.col("sport"), F.lit(5353), "abcd")
    offset = F.when(k % 2 == 1, F.lit("0008")).otherwise(F.lit("0001"))
    case = k % 5
    body = (
        F.when(case == 1, g.cat("1100" + "00" * 6, datagram))
        .when(case == 2, g.cat("3c01" + "00" * 14, "1100" + "00" * 6, datagram))
        .when(case == 3, g.cat("1100", offset, "00000000", datagram))
        .when(case == 4, g.cat("1102" + "00" * 14, datagram))
        .otherwise(datagram)
    )
    first = F.when(case == 4, F.lit(51)).when(case == 0, F.lit(17)).otherwise(
        F.element_at(F.array(F.lit(0), F.lit(43), F.lit(44)), F.greatest(case, F.lit(1)))
    )
    p = g.pk(spark, sf)
    frames = v6_frames(p, first, body, dst=dst, hops=F.lit(64) - k % 64)
    return udp_datagrams(decode_frames(frames)).select(
        "seq", ip_text("src_ip").alias("src_ip"), ip_text("dst_ip").alias("dst_ip"), "ip_version",
        "proto", "ttl", "sport", "next_hdr",
    )


@query(
    "decode_pppoe_cooked_raw",
    """SELECT seq, CASE WHEN k % 4 = 2 AND k % 3 = 0 THEN '00:00:00:00:00:00' WHEN k % 4 = 3 THEN '00:00:00:00:00:00'
       ELSE mac END AS src_mac, src_ip, CASE k % 4 WHEN 0 THEN 14 WHEN 1 THEN 22 WHEN 2 THEN 16 ELSE 0 END AS l3_off
FROM pk WHERE NOT (k % 4 = 2 AND k % 3 = 0) AND NOT (k % 4 = 1 AND k % 3 = 0)""",
)
def _decode_links(spark, sf):
    """Ethernet, PPPoE (one third with another protocol), cooked (one third without a MAC), raw IP."""
    k = F.col("k")
    ip = g.ipv4(6, g.ip_hex(F.col("src_ip")), g.ip_hex(F.col("dst_ip")), g.tcp(F.col("sport"), F.col("dport"), 2))
    ppp = F.when(k % 3 == 0, F.lit("c021")).otherwise(F.lit("0021"))
    mac = g.mac_hex()
    frame = (
        F.when(k % 4 == 0, g.ether(g.GATEWAY, mac, "0800", ip))
        .when(k % 4 == 1, g.ether(g.GATEWAY, mac, "8864", g.cat("110000010000", ppp, ip)))
        .when(
            k % 4 == 2,
            g.cat("00000001", F.when(k % 3 == 0, F.lit("00")).otherwise(F.lit("06")), "00", mac, "0000", "0800", ip),
        )
        .otherwise(ip)
    )
    link = F.when(k % 4 < 2, F.lit("ethernet")).when(k % 4 == 2, F.lit("cooked")).otherwise(F.lit("raw_ip"))
    return decode_frames(g.as_frames(g.pk(spark, sf), frame, link)).select(
        "seq", mac_text("src_mac").alias("src_mac"), ip_text("src_ip").alias("src_ip"), "l3_off"
    )


@query(
    "aux_vlan_merge",
    """, a AS (SELECT seq, outer_vlan AS o, inner_vlan AS i, CASE WHEN k % 5 = 0 THEN NULL ELSE 20 + k % 5 END AS aux FROM pk)
SELECT seq, CASE WHEN aux IS NULL THEN o WHEN o = 0 THEN aux WHEN aux <> o THEN aux ELSE o END AS outer_vlan,
       CASE WHEN aux IS NOT NULL AND o <> 0 AND aux <> o THEN o ELSE i END AS inner_vlan FROM a""",
)
def _aux_vlan(spark, sf):
    p = g.pk(spark, sf).withColumn("aux_vlan", F.when(F.col("k") % 5 != 0, F.col("k") % 5 + 20))
    return merge_aux_vlan(strip_l2(tagged_frames(p))).select("seq", "outer_vlan", "inner_vlan")


@query(
    "source_mac_sanity",
    "SELECT seq, mac AS src_mac FROM pk WHERE k % 4 >= 2",
)
def _source_mac(spark, sf):
    p = g.pk(spark, sf)
    k = F.col("k")
    src = F.when(k % 4 == 0, F.lit("00" * 6)).when(k % 4 == 1, F.lit("ff" * 6)).otherwise(g.mac_hex())
    ip = g.ipv4(6, g.ip_hex(F.col("src_ip")), g.ip_hex(F.col("dst_ip")), g.tcp(F.col("sport"), F.col("dport"), 2))
    frames = g.as_frames(p, g.ether(g.GATEWAY, src, "0800", ip))
    return source_mac_sane(strip_l2(frames)).select("seq", mac_text("src_mac").alias("src_mac"))


@query(
    "device_direction",
    """, f AS (
  SELECT *, CASE k % 4 WHEN 0 THEN 'out' WHEN 1 THEN 'in' WHEN 2 THEN 'transit' ELSE 'raw' END AS kind FROM pk)
SELECT seq, CASE kind WHEN 'raw' THEN 'lan0' ELSE mac END AS device_mac, CAST(kind <> 'in' AS INTEGER) AS is_outbound
FROM f WHERE kind <> 'transit' AND NOT (kind = 'in' AND k % 3 = 0)""",
)
def _device_direction(spark, sf):
    """Outbound, inbound (one third to the broadcast MAC), public to public, raw IP."""
    k, mac = F.col("k"), g.mac_hex()
    dev_ip, pub, seg = g.ip_hex(F.col("src_ip")), g.ip_hex("198.51.100.7"), g.tcp(F.col("sport"), F.col("dport"), 2)
    to = F.when(k % 3 == 0, F.lit("ff" * 6)).otherwise(mac)
    frame = (
        F.when(k % 4 == 0, g.ether(g.GATEWAY, mac, "0800", g.ipv4(6, dev_ip, pub, seg)))
        .when(k % 4 == 1, g.ether(to, g.GATEWAY, "0800", g.ipv4(6, pub, dev_ip, seg)))
        .when(k % 4 == 2, g.ether(g.GATEWAY, mac, "0800", g.ipv4(6, g.ip_hex("203.0.113.9"), pub, seg)))
        .otherwise(g.ipv4(6, dev_ip, pub, seg))
    )
    link = F.when(k % 4 == 3, F.lit("raw_ip")).otherwise(F.lit("ethernet"))
    rows = device_identity(direction(decode_frames(g.as_frames(g.pk(spark, sf), frame, link)), PrefixSet()))
    return rows.select("seq", "device_mac", F.col("is_outbound").cast("int"))


def inspect_frames(p):
    k = F.col("k")
    src, dst = g.ip_hex(F.col("src_ip")), g.ip_hex(F.col("dst_ip"))
    ip = (
        F.when(k % 4 == 0, g.ipv4(6, src, dst, g.tcp(F.col("sport"), F.col("dport"), F.col("k") % 32, "abcd")))
        .when(k % 4 == 1, g.ipv4(17, src, dst, g.udp(F.col("sport"), F.col("dport"), "abcdef")))
        .when(k % 4 == 2, g.ipv4(1, src, dst, "0800000000010001"))
        .otherwise(g.ipv4(47, src, dst, "00000800"))
    )
    return g.as_frames(p, g.ether(g.GATEWAY, g.mac_hex(), "0800", ip))


INSPECT_SQL = """, l AS (
  SELECT seq, mac, strftime(make_timestamp(ts_us), '%H:%M:%S.%f') || ' IP ' AS head,
    CASE WHEN k % 2 = 0 AND (k % 32 & 2) <> 0 THEN 'S' ELSE '' END || CASE WHEN (k % 32 & 16) <> 0 THEN '.' ELSE '' END
    || CASE WHEN (k % 32 & 8) <> 0 THEN 'P' ELSE '' END || CASE WHEN (k % 32 & 1) <> 0 THEN 'F' ELSE '' END
    || CASE WHEN (k % 32 & 4) <> 0 THEN 'R' ELSE '' END AS fl, * EXCLUDE (seq, mac) FROM pk),
lines AS (
  SELECT seq, mac, head || CASE k % 4
    WHEN 0 THEN src_ip || '.' || sport || ' > ' || dst_ip || '.' || dport || ': Flags ['
         || CASE WHEN fl = '' THEN 'none' ELSE fl END || '], seq 1, win 64240, length 2'
    WHEN 1 THEN src_ip || '.' || sport || ' > ' || dst_ip || '.' || dport || ': UDP, length 11'
    WHEN 2 THEN src_ip || ' > ' || dst_ip || ': ICMP, length 8'
    ELSE src_ip || ' > ' || dst_ip || ': proto 47, length 24' END AS line FROM l)
"""


@query("inspect_lines", INSPECT_SQL + "SELECT seq, line FROM lines")
def _inspect_lines(spark, sf):
    opts = Options(selection=vectors("a"))
    rows = located_packets(inspect_frames(g.pk(spark, sf)), opts, prefilter=False)
    return inspect_packets(rows, "192.168.0.0/16").select("seq", "line")


@query(
    "inspect_limit",
    INSPECT_SQL + "SELECT seq, line FROM lines WHERE mac = '02:00:00:00:00:05' ORDER BY seq LIMIT 25",
)
def _inspect_limit(spark, sf):
    opts = Options(selection=vectors("a"))
    rows = located_packets(inspect_frames(g.pk(spark, sf)), opts, prefilter=False)
    return inspect_packets(rows, "02:00:00:00:00:05", count=25).select("seq", "line")


EVERY_DEVICE = " or ".join(f"02:00:00:00:00:{i:02x}" for i in range(20))


@query(
    "inspect_other",
    """SELECT seq, strftime(make_timestamp(ts_us), '%H:%M:%S.%f') || CASE k % 3
    WHEN 0 THEN ' IP6 ' || printf('fe80::%x', dev + 1) || ' > ff02::1: next-hdr 17, length ' || (9 + k)
    WHEN 1 THEN ' ARP, length 28' ELSE ' ethertype 0x88cc, length ' || (14 + 9 + k) END AS line FROM pk""",
)
def _inspect_other(spark, sf):
    """IPv6, ARP and another link-layer protocol."""
    p = g.pk(spark, sf)
    k, mac, ip = F.col("k"), g.mac_hex(), g.ip_hex(F.col("src_ip"))
    filler = F.repeat(F.lit("ab"), k + 1)
    six = g.ipv6(17, link_local(F.col("dev")), "ff02" + "00" * 13 + "01", g.udp(F.lit(5000), 5001, filler))
    frame = (
        F.when(k % 3 == 0, g.ether("333300000001", mac, "86dd", six))
        .when(k % 3 == 1, g.ether("ff" * 6, mac, "0806", g.cat("0001080006040001", mac, ip, "00" * 6, ip)))
        .otherwise(g.ether("0180c200000e", mac, "88cc", g.cat("0207040200000000", filler)))
    )
    rows = located_packets(g.as_frames(p, frame), Options(selection=vectors("a")), prefilter=False)
    return inspect_packets(rows, EVERY_DEVICE).select("seq", "line")
