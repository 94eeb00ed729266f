"""Classification and filtering of packets."""

from __future__ import annotations

from pyspark.sql import functions as F

from netobs.checks.common import hex_lower, udp_frames
from netobs.checks.registry import PK, query
from netobs.functions.addr import is_private_v4, is_private_v6, is_unicast_mac, mac_bytes
from netobs.operators.classify import PrefixSet, direction
from netobs.operators.prefixes import Lookup
from netobs.operators.decode import decode_frames, tcp_segments, udp_datagrams
from netobs.operators.filters import (
    endpoint_filter,
    exclude_filter,
    hard_mac_exclusion,
    interest_prefilter,
    router_mac_exclusion,
    target_filter,
    tcp_relevant,
    udp_vector,
)
from netobs.operators.vectors import vectors
from netobs.checks import derived as g

# A spread-out address per event: every /2 block occurs, and so do the special ranges.
SPREAD = PK + """, ip AS (
  SELECT seq, k, dev, CASE k % 10
    WHEN 0 THEN 167772160 + seq % 16777216 WHEN 1 THEN 2886729728 + (seq * 77) % 2097152
    WHEN 2 THEN 3232235520 + (seq * 3) % 131072 WHEN 3 THEN 1681915904 + (seq * 999) % 8388608
    WHEN 4 THEN 2130706432 + seq WHEN 5 THEN 2851995648 + (seq * 7) % 131072 WHEN 6 THEN 0
    ELSE (seq * 2654435761) % 4294967296 END AS n FROM pulse),
ipc AS (SELECT *, n = 0 OR n // 16777216 IN (10, 127) OR n // 1048576 = 2753 OR n // 65536 IN (49320, 43518)
    OR n // 4194304 = 401 AS private FROM ip)"""


def spread(spark, sf):
    s, k = F.col("seq"), F.col("k")
    n = (
        F.when(k % 10 == 0, s % 16777216 + 167772160)
        .when(k % 10 == 1, (s * 77) % 2097152 + 2886729728)
        .when(k % 10 == 2, (s * 3) % 131072 + 3232235520)
        .when(k % 10 == 3, (s * 999) % 8388608 + 1681915904)
        .when(k % 10 == 4, s + 2130706432)
        .when(k % 10 == 5, (s * 7) % 131072 + 2851995648)
        .when(k % 10 == 6, F.lit(0))
        .otherwise((s * 2654435761) % 4294967296)
    )
    return g.pulse(spark, sf).select("ts", "seq", "k", "dev", n.alias("n")).withColumn(
        "ip", F.unhex(g.hx(F.col("n"), 4))
    )


def flag(c):
    return c.cast("int")


@query("private_v4", "SELECT seq, n, CAST(private AS INTEGER) AS private FROM ipc", SPREAD)
def _private_v4(spark, sf):
    return spread(spark, sf).select("seq", "n", flag(is_private_v4(F.col("ip"))).alias("private"))


V6_HEADS = ["0000", "0001", "fbff", "fc00", "fd12", "fe00", "fe7f", "fe80", "febf", "fec0", "2001", "3fff"]
V6_SQL = f"""SELECT seq, CAST(h IN ('fc00', 'fd12', 'fe80', 'febf') OR (h = '0000' AND k % 2 = 0) AS INTEGER) AS private
FROM (SELECT seq, k, {V6_HEADS}[seq % 12 + 1] AS h FROM pulse)"""


@query("private_v6", V6_SQL)
def _private_v6(spark, sf):
    heads = F.element_at(F.array(*[F.lit(h) for h in V6_HEADS]), (F.col("seq") % 12 + 1).cast("int"))
    tail = g.hx(F.col("k") % 2, 14)
    p = g.pulse(spark, sf).withColumn("ip", F.unhex(g.cat(heads, tail)))
    return p.select("seq", flag(is_private_v6(F.col("ip"))).alias("private"))


PREFIXES = PrefixSet(
    inside=("203.0.0.0/9", "224.0.0.0/5"),
    learned=(("eth0", "192.168.0.0/24"), ("eth0", "100.0.0.0/8"), ("eth1", "10.0.0.0/8"),
             ("eth1", "2001:db8:1:2::/64"), ("eth2", "fd00:1::/32")),
)


@query(
    "inside_class",
    """SELECT seq, CAST(private OR n // 8388608 = 406 OR n // 134217728 = 28 OR n // 16777216 = 100 AS INTEGER) AS inside
FROM ipc""",
    SPREAD,
)
def _inside_class(spark, sf):
    return spread(spark, sf).select("seq", flag(PREFIXES.is_inside(F.col("ip"))).alias("inside"))


@query(
    "inside_class_by_table",
    "SELECT seq, CAST(n // 8388608 = 406 OR n // 134217728 = 28 AS INTEGER) AS inside FROM ipc",
    SPREAD,
)
def _inside_by_table(spark, sf):
    table = PREFIXES.table(spark).where(F.col("kind") == "inside")
    found = Lookup(table).add(spread(spark, sf), {"ip": "found"})
    return found.select("seq", flag(F.col("found.any")).alias("inside"))


DIRECT_SQL = """(CASE dev % 3 WHEN 0 THEN n // 256 = 12625920 OR n // 16777216 = 100
  WHEN 1 THEN n // 16777216 = 10 ELSE false END)"""


@query("direct_class", f"SELECT seq, CAST({DIRECT_SQL} AS INTEGER) AS direct FROM ipc", SPREAD)
def _direct_class(spark, sf):
    iface = F.concat(F.lit("eth"), (F.col("dev") % 3).cast("string"))
    df = spread(spark, sf).withColumn("iface", iface)
    return df.select("seq", flag(PREFIXES.is_direct(F.col("ip"), F.col("iface"))).alias("direct"))


@query("direct_class_by_table", f"SELECT seq, CAST({DIRECT_SQL} AS INTEGER) AS direct FROM ipc", SPREAD)
def _direct_by_table(spark, sf):
    iface = F.concat(F.lit("eth"), (F.col("dev") % 3).cast("string"))
    df = spread(spark, sf).withColumn("iface", iface)
    found = Lookup(PREFIXES.table(spark)).add(df, {"ip": "found"})
    return found.select("seq", flag(F.array_contains("found.direct", F.col("iface"))).alias("direct"))


@query(
    "offlink_routed_v4",
    f"""SELECT seq, CAST(dev % 3 < 2 AND NOT {DIRECT_SQL} AND (n // 16777216 = 10 OR n // 1048576 = 2753
    OR n // 65536 = 49320 OR n // 4194304 = 401) AS INTEGER) AS routed FROM ipc""",
    SPREAD,
)
def _offlink_v4(spark, sf):
    iface = F.concat(F.lit("eth"), (F.col("dev") % 3).cast("string"))
    df = spread(spark, sf).withColumn("iface", iface)
    return df.select("seq", flag(PREFIXES.offlink_routed_v4(F.col("ip"), F.col("iface"))).alias("routed"))


@query(
    "offlink_routed_v6",
    """SELECT seq, CAST(CASE seq % 6 WHEN 1 THEN dev % 3 = 1 WHEN 3 THEN dev % 3 = 1 WHEN 2 THEN dev % 3 > 0
       WHEN 5 THEN dev % 3 = 1 ELSE false END AS INTEGER) AS routed FROM pulse""",
)
def _offlink_v6(spark, sf):
    """Direct, sibling /48, own ULA elsewhere, sibling again, foreign global, ULA direct on eth2."""
    heads = ["20010db800010002", "20010db800010003", "fd99000000000000", "20010db80001ffff",
             "20010db800020002", "fd00000100000000"]
    ip = F.unhex(g.cat(F.element_at(F.array(*[F.lit(h) for h in heads]), (F.col("seq") % 6 + 1).cast("int")), g.hx(F.col("k"), 8)))
    iface = F.concat(F.lit("eth"), (F.col("dev") % 3).cast("string"))
    df = g.pulse(spark, sf).withColumns({"ip": ip, "iface": iface})
    return df.select("seq", flag(F.coalesce(PREFIXES.offlink_routed_v6(F.col("ip"), F.col("iface")), F.lit(False))).alias("routed"))


@query("in_cidr", "SELECT seq, CAST(n // 2048 = 1578240 AS INTEGER) AS hit FROM ipc", SPREAD)
def _in_cidr(spark, sf):
    from netobs.functions.addr import in_cidr

    return spread(spark, sf).select("seq", flag(in_cidr(F.col("ip"), "192.168.0.0/21")).alias("hit"))


@query(
    "owner_mac_check",
    """SELECT seq, CAST(h % 2 = 0 AND NOT (h = 0 AND k % 2 = 0) AS INTEGER) AS ok
FROM (SELECT seq, k, k % 5 AS h FROM pulse)""",
)
def _owner_mac_check(spark, sf):
    mac = F.unhex(g.cat(g.hx(F.col("k") % 5, 1), "00000000", g.hx(F.col("k") % 2, 1)))
    return g.pulse(spark, sf).select("seq", flag(is_unicast_mac(mac)).alias("ok"))


def plain_packets(spark, sf):
    """Device traffic on its own ports, TCP or UDP by ``proto``."""
    p = g.pk(spark, sf)
    body = F.repeat(F.lit("00"), F.col("k") % 3)
    src, dst = g.ip_hex(F.col("src_ip")), g.ip_hex(F.col("dst_ip"))
    ip = F.when(
        F.col("proto") == 6, g.ipv4(6, src, dst, g.tcp(F.col("sport"), F.col("dport"), F.col("k") % 32, body))
    ).otherwise(g.ipv4(17, src, dst, g.udp(F.col("sport"), F.col("dport"), body)))
    return g.as_frames(p, g.ether(g.GATEWAY, g.mac_hex(), "0800", ip))


@query(
    "prefilter",
    """SELECT seq FROM pk WHERE CASE WHEN proto = 6 THEN (k % 32 & 7) <> 0 OR (k % 3 > 0 AND dport IN (80, 8080, 443))
ELSE dport IN (67, 137, 1900, 3702, 5353, 53, 443) OR sport IN (67, 137, 1900, 3702, 5353, 53) END""",
)
def _prefilter(spark, sf):
    return interest_prefilter(plain_packets(spark, sf)).select("seq")


@query(
    "prefilter_classes",
    "SELECT seq FROM pk WHERE k % 8 <> 7",
)
def _prefilter_classes(spark, sf):
    """Frame types kept whole, and one that is dropped."""
    types = ["0806", "88cc", "8100", "88a8", "8864", "86dd", "0806", "9000"]
    t = F.element_at(F.array(*[F.lit(x) for x in types]), F.col("k") % 8 + 1)
    p = g.pk(spark, sf)
    return interest_prefilter(g.as_frames(p, g.cat(g.GATEWAY, g.mac_hex(), t, "00" * 30))).select("seq")


def located(spark, sf):
    return direction(decode_frames(plain_packets(spark, sf)), PrefixSet())


FILTER_TEXT = "(192.168.1.0/24 or 203.0.0.0/8) && !02:00:00:00:00:05 and not fe80::/10 || 198.4.113.94"
FILTER_SQL = """((src_ip LIKE '192.168.1.%' OR dst_ip LIKE '203.%') AND mac <> '02:00:00:00:00:05'
  OR dst_ip = '198.4.113.94')"""


@query("endpoint_filter", f"SELECT seq FROM pk WHERE {FILTER_SQL}")
def _endpoint_filter(spark, sf):
    return located(spark, sf).where(endpoint_filter(FILTER_TEXT)).select("seq")


@query(
    "exclude_then_target",
    "SELECT seq FROM pk WHERE dst_ip NOT LIKE '10.%' AND src_ip LIKE '192.168.2.%'",
)
def _exclude_target(spark, sf):
    rows = exclude_filter(located(spark, sf), "10.0.0.0/8")
    return target_filter(rows, "192.168.2.0/24").select("seq")


@query("hard_mac_exclusion", "SELECT seq FROM pk WHERE dev NOT IN (3, 4)")
def _hard(spark, sf):
    return hard_mac_exclusion(located(spark, sf), ["02:00:00:00:00:03", "2:0:0:0:0:4"]).select("seq")


@query(
    "router_mac_exclusion",
    "SELECT seq FROM pk WHERE dev <> 3 OR (k % 3 <> 0 AND k % 4 < 2) OR (k % 3 = 0 AND k % 2 = 1)",
)
def _router(spark, sf):
    """Router 3: inbound SYN+ACK (two in four TCP rows) and DNS answers pass."""
    k = F.col("k")
    p = g.pk(spark, sf)
    pub, dev = g.ip_hex("198.51.100.7"), g.ip_hex(F.col("src_ip"))
    flags = F.when(k % 4 < 2, F.lit(18)).otherwise(F.lit(16))
    sport = F.when(k % 2 == 1, F.lit(53)).otherwise(F.lit(5000))
    ip = F.when(k % 3 == 0, g.ipv4(17, pub, dev, g.udp(sport, 6000, "00"))).otherwise(
        g.ipv4(6, pub, dev, g.tcp(443, F.col("sport"), flags))
    )
    frames = g.as_frames(p, g.ether(g.GATEWAY, g.mac_hex(), "0800", ip))
    rows = direction(decode_frames(frames), PrefixSet())
    return router_mac_exclusion(rows, ["02:00:00:00:00:03"]).select("seq")


@query(
    "tcp_relevance",
    """SELECT seq, dport, CAST((k % 32 & 7) <> 0 AS INTEGER) AS control FROM pk
WHERE proto = 6 AND ((k % 32 & 7) <> 0 OR dport IN (80, 8080, 443))""",
)
def _tcp_relevance(spark, sf):
    seg = tcp_segments(decode_frames(plain_packets(spark, sf)))
    return seg.where(tcp_relevant()).select(
        "seq", "dport", flag(F.col("flags").bitwiseAND(F.lit(7)) != 0).alias("control")
    )


@query(
    "udp_vector",
    """SELECT seq, CASE WHEN dport = 67 OR sport = 67 THEN 'DHCP' WHEN dport = 137 OR sport = 137 THEN 'NBNS'
  WHEN dport IN (1900, 3702) OR sport IN (1900, 3702) THEN 'L7' WHEN dport = 5353 OR sport = 5353 THEN 'MDNS'
  WHEN dport = 53 OR sport = 53 THEN 'DNS' WHEN dport = 443 THEN 'QUIC' END AS vector
FROM pk""",
)
def _udp_vector(spark, sf):
    p = g.pk(spark, sf)
    frames = udp_frames(p, F.col("sport"), F.col("dport"), F.lit("00"))
    return udp_datagrams(decode_frames(frames)).select("seq", udp_vector().alias("vector"))


@query(
    "vector_selection",
    """SELECT seq, CAST(dport IN (5353, 1900) OR sport IN (5353, 1900, 3702) AS INTEGER) AS multicast
FROM pk""",
)
def _vector_selection(spark, sf):
    """Only the multicast group is selected, so other datagrams route nowhere."""
    p = g.pk(spark, sf)
    chosen = vectors("M").groups
    frames = udp_frames(p, F.col("sport"), F.col("dport"), F.lit("00"))
    return udp_datagrams(decode_frames(frames)).select(
        "seq", flag(udp_vector(chosen).isNotNull()).alias("multicast")
    )


@query("mac_text", "SELECT seq, mac, replace(mac, ':', '') AS mac_hex FROM pk")
def _mac_text(spark, sf):
    from netobs.functions.addr import mac_text

    p = g.pk(spark, sf).withColumn("b", mac_bytes(F.col("mac")))
    return p.select("seq", mac_text("b").alias("mac"), hex_lower("b").alias("mac_hex"))

