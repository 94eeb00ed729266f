"""Record tables: frames built from ``events`` and ``pages`` against their source columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from netobs.checks.common import records, tcp_frames, udp_frames, v4_frames, v6_frames
from netobs.checks.functions import HELLO_SQL, HOSTS, hosts
from netobs.checks.registry import PK, WIRE, query
from netobs.operators.classify import PrefixSet
from netobs.operators.reassembly import quic_reassemble
from netobs.operators.vectors import vectors
from netobs.checks import derived as g
from netobs.plans.jobs import Options, job_lines, telemetry, wire_lines
from netobs.plans.stage import stage, work_folder
from netobs.sources.frames import read_frames
from netobs.sources.sinks import Sink, write_telemetry

ROUTED = "0 AS routed"


def event_options(k):
    """Option blocks by k: none, MSS, MSS + scale, timestamps."""
    return F.element_at(
        F.array(F.lit(""), F.lit("020405b4"), F.lit("020405b40103030701010402"), F.lit("080a" + "00" * 8 + "0101")),
        k % 4 + 1,
    )


SYN_COLS = """CASE WHEN k % 4 IN (1, 2) THEN 1460 END AS mss, CASE WHEN k % 4 = 2 THEN 7 END AS wscale,
  [NULL, 'M*', 'M*,N,W*,N,N,S', 'T,N,N'][k % 4 + 1] AS opts, 1024 + k AS "window", 64 AS ttl"""


@query(
    "rec_syn",
    f"""SELECT seq, mac, CASE WHEN k % 5 = 0 THEN dst_ip ELSE src_ip END AS src_ip, {SYN_COLS},
  CASE WHEN k % 5 = 0 THEN sport ELSE dport END AS dst_port, {ROUTED} FROM pk
WHERE NOT (k % 5 = 0 AND k < 30)
UNION ALL SELECT seq, '02:00:00:00:ff:01', dst_ip, {SYN_COLS}, sport, 0 FROM pk WHERE k % 5 = 0 AND k < 30""",
)
def _rec_syn(spark, sf):
    """One in five comes in from outside (or from another inside net: then its sender is the device)."""
    p = g.pk(spark, sf)
    k, mac = F.col("k"), g.mac_hex()
    opts, win = event_options(k), k + 1024
    dev, far = g.ip_hex(F.col("src_ip")), g.ip_hex(F.col("dst_ip"))
    out = g.ether(g.GATEWAY, mac, "0800", g.ipv4(6, dev, far, g.tcp(F.col("sport"), F.col("dport"), 2, "", opts, win)))
    back = g.ether(mac, g.GATEWAY, "0800", g.ipv4(6, far, dev, g.tcp(F.col("dport"), F.col("sport"), 2, "", opts, win)))
    return records(g.as_frames(p, F.when(k % 5 == 0, back).otherwise(out)), "SYN", "S")


@query(
    "rec_synack",
    f"SELECT seq, mac, src_ip, {SYN_COLS}, dport AS src_port, {ROUTED} FROM pk WHERE dev <> 7",
)
def _rec_synack(spark, sf):
    p = g.pk(spark, sf)
    seg = g.tcp(F.col("dport"), F.col("sport"), 18, "", event_options(F.col("k")), F.col("k") + 1024)
    ip = g.ipv4(6, g.ip_hex(F.col("src_ip")), g.ip_hex(F.col("dst_ip")), seg)
    frames = g.as_frames(p, g.ether(g.GATEWAY, g.mac_hex(), "0800", ip))
    return records(frames, "SYNACK", "S", router_macs=("02:00:00:00:00:07",))


@query(
    "rec_http",
    f"""SELECT seq, mac, src_ip, 'agent/' || k || ' (' || event_type || ' )' AS user_agent, {ROUTED}
FROM pk WHERE k % 6 < 4""",
)
def _rec_http(spark, sf):
    """GET and POST; a third header case; no agent; another method."""
    p = g.pk(spark, sf)
    k = F.col("k")
    name = F.when(k % 3 == 0, F.lit("user-agent")).otherwise(F.lit("User-Agent"))
    verb = F.when(k % 6 == 5, F.lit("PUT ")).when(k % 2 == 0, F.lit("GET ")).otherwise(F.lit("POST "))
    agent = F.concat(F.lit("agent/"), k.cast("string"), F.lit(" ("), F.col("event_type"), F.lit("|)"))
    head = F.when(k % 6 == 4, F.lit("X: y")).otherwise(F.concat(name, F.lit(": "), agent))
    text = F.concat(verb, F.lit("/ HTTP/1.1\r\nHost: a\r\n"), head, F.lit("\r\n\r\n"))
    port = F.when(k % 2 == 0, F.lit(80)).otherwise(F.lit(8080))
    return records(tcp_frames(p, 24, F.col("sport"), port, g.text_hex(text)), "HTTP", "H")


@query(
    "rec_tls",
    HELLO_SQL
    + f"""SELECT ja.seq, mac, src_ip, dst_ip, 443 AS dst_port, sni, ja4, alpn, {ROUTED}
FROM ja JOIN pk ON pk.seq = ja.seq""",
    PK,
)
def _rec_tls(spark, sf):
    p = g.pk(spark, sf)
    body = g.record_hex(g.event_hello(F.col("k"), F.col("seq")))
    return records(tcp_frames(p, 24, F.col("sport"), 443, body), "TLS", "T")


@query(
    "rec_dns",
    f"""SELECT page_id AS seq, '02:00:00:00:00:' || printf('%02x', page_id % 20) AS mac,
  printf('192.168.0.%d', page_id % 20 + 10) AS src_ip, host AS query_domain, {ROUTED} FROM hosts WHERE host <> ''""",
    HOSTS,
)
def _rec_dns(spark, sf):
    h = hosts(spark, sf).select(
        F.timestamp_micros(F.col("page_id") * 700000).alias("ts"), F.col("page_id").alias("seq"), "host",
        F.concat(F.lit("02:00:00:00:00:"), F.format_string("%02x", F.col("page_id") % 20)).alias("mac"),
        F.format_string("192.168.0.%d", F.col("page_id") % 20 + 10).alias("src_ip"),
        F.lit("198.51.100.53").alias("dst_ip"),
    )
    body = g.dns_hex(F.col("seq") % 65536, "0100", F.upper(F.col("host")))
    return records(udp_frames(h, F.lit(40000), 53, body), "DNS", "Q")


# Queries and responses by event type on (device, k % 2); names differ in entropy.
EXT_SQL = """, m AS (
  SELECT *, event_type IN ('purchase', 'signup') AS resp,
    CASE WHEN k % 2 = 0 THEN 'abcdefghijklmnopqrstuvwxyz0123456789.x' || k ELSE 'host' || k || '.example.com' END AS name
  FROM pk),
x AS (
  SELECT seq, dev, mac, src_ip, resp, ts_us, k, lag(resp) OVER w AS p_resp, lag(ts_us) OVER w AS q_us,
    lag(name) OVER w AS query_domain, lag(k) OVER w AS qk
  FROM m WINDOW w AS (PARTITION BY dev, k % 2 ORDER BY seq)),
hit AS (SELECT * FROM x WHERE resp AND NOT p_resp AND ts_us - q_us < 5000000),
ch AS (SELECT seq, c, count(*) AS n FROM (
  SELECT seq, unnest(string_split(query_domain, '')) AS c FROM hit) GROUP BY 1, 2),
en AS (SELECT seq, round(-sum((n / length(query_domain)) * log2(n / length(query_domain))), 4) AS entropy
  FROM ch JOIN hit USING (seq) GROUP BY 1)
"""


def dns_traffic(spark, sf):
    p = g.pk(spark, sf)
    k = F.col("k")
    resp = F.col("event_type").isin("purchase", "signup")
    name = F.when(
        k % 2 == 0, F.concat(F.lit("abcdefghijklmnopqrstuvwxyz0123456789.x"), k.cast("string"))
    ).otherwise(F.concat(F.lit("host"), k.cast("string"), F.lit(".example.com")))
    mac, dev, srv = g.mac_hex(), g.ip_hex(F.col("src_ip")), g.ip_hex("198.51.100.53")
    ask = g.dns_hex(k % 2, "0100", name, k % 5 + 1)
    answer = g.dns_hex(k % 2, "8183", name, k % 5 + 1)
    out = g.ether(g.GATEWAY, mac, "0800", g.ipv4(17, dev, srv, g.udp(F.lit(5000), 53, ask)))
    back = g.ether(mac, g.GATEWAY, "0800", g.ipv4(17, srv, dev, g.udp(F.lit(53), 5000, answer)))
    return g.as_frames(p, F.when(resp, back).otherwise(out))


@query(
    "rec_dnsext",
    EXT_SQL
    + f"""SELECT seq, mac, src_ip, '198.51.100.53' AS dst_ip, query_domain, qk % 5 + 1 AS qtype, 3 AS rcode,
  round((ts_us - q_us) / 1000.0, 2) AS latency_ms, entropy, {ROUTED} FROM hit JOIN en USING (seq)""",
)
def _rec_dnsext(spark, sf):
    df = records(dns_traffic(spark, sf), "DNSEXT", "Q", extended=True)
    return df.withColumns({"entropy": F.round("entropy", 4), "latency_ms": F.round("latency_ms", 2)})


@query(
    "rec_alert",
    EXT_SQL
    + f"""SELECT seq, mac, src_ip, 'HIGH_DNS_ENTROPY' AS kind, query_domain, entropy, {ROUTED}
FROM hit JOIN en USING (seq) WHERE entropy >= 4.2""",
)
def _rec_alert(spark, sf):
    df = records(dns_traffic(spark, sf), "ALERT", "Q", extended=True)
    return df.withColumn("entropy", F.round("entropy", 4))


@query(
    "rec_dhcp",
    f"""SELECT seq, mac, src_ip, CASE WHEN k % 4 <> 0 THEN 'host-' || dev ELSE '' END AS hostname,
  CASE WHEN k % 3 <> 0 THEN 'MSFT 5.0' ELSE '' END AS vendor_class,
  CASE WHEN k % 2 = 0 THEN '1,3,6,' || k ELSE '' END AS prl, {ROUTED} FROM pk WHERE NOT (k % 4 = 0 AND k % 3 = 0 AND k % 2 = 1)""",
)
def _rec_dhcp(spark, sf):
    p = g.pk(spark, sf)
    k = F.col("k")
    none = F.lit("")
    host = g.text_hex(F.concat(F.lit("host-"), F.col("dev").cast("string")))
    opts = g.cat(
        "350101",
        F.when(k % 4 != 0, g.cat("0c", g.sized(host, 1))).otherwise(none),
        F.when(k % 3 != 0, g.cat("3c08", g.text_hex("MSFT 5.0"))).otherwise(none),
        F.when(k % 2 == 0, g.cat("3704010306", g.hx(k, 1))).otherwise(none),
        "ff",
    )
    body = g.cat("010106" + "00" * 233, "63825363", opts)
    return records(udp_frames(p, F.lit(68), 67, body), "DHCP", "D")


@query(
    "rec_dhcp6",
    f"""SELECT seq, mac, printf('fe80::%x', dev + 1) AS src_ip, CASE WHEN k % 2 = 0 THEN 'SOLICIT' ELSE 'REQUEST' END AS msg_type,
  CASE WHEN k % 3 = 0 THEN 'UNKNOWN' ELSE 'LLT' END AS duid_type, CASE WHEN k % 4 = 1 THEN 'vendor ' || k END AS vendor_class,
  CASE WHEN k % 5 <> 0 THEN '23,24,' || k END AS oro, CASE WHEN k % 6 = 2 THEN 'host' || k || '.lan' END AS fqdn,
  {ROUTED} FROM pk WHERE k % 7 <> 6""",
)
def _rec_dhcp6(spark, sf):
    p = g.pk(spark, sf)
    k = F.col("k")
    none = F.lit("")
    vendor = g.text_hex(F.concat(F.lit("vendor|"), k.cast("string")))
    fqdn = g.cat("00", g.labels_hex(F.concat(F.lit("host"), k.cast("string"), F.lit(".lan"))), "00")
    opts = g.cat(
        F.when(k % 3 != 0, F.lit("0001000400010001")).otherwise(none),
        F.when(k % 5 != 0, g.cat("0006000600170018", g.hx(k, 2))).otherwise(none),
        F.when(k % 4 == 1, g.cat("0010", g.sized(g.cat("00000137", g.sized(vendor, 2)), 2))).otherwise(none),
        F.when(k % 6 == 2, g.cat("0027", g.sized(fqdn, 2))).otherwise(none),
    )
    # relay messages are not client messages
    kind = F.when(k % 7 == 6, F.lit("0c")).when(k % 2 == 0, F.lit("01")).otherwise(F.lit("03"))
    body = g.udp(F.lit(546), 547, g.cat(kind, "abcdef", opts))
    return records(v6_frames(p, 17, body, dst="ff02" + "00" * 11 + "010002"), "DHCP6", "D")


@query(
    "rec_mdns",
    f"""SELECT seq, mac, src_ip, 5353 AS port, '_svc' || k || '._tcp.local' AS qname, {ROUTED} FROM pk
WHERE k % 4 <> 3 AND sport NOT IN (1900, 3702)""",
)
def _rec_mdns(spark, sf):
    """One in four has no question; a source port of another discovery service comes first in the order."""
    p = g.pk(spark, sf)
    k = F.col("k")
    name = F.concat(F.lit("_SVC"), k.cast("string"), F.lit("._tcp.local"))
    count = F.when(k % 4 == 3, F.lit("0000")).otherwise(F.lit("0001"))
    body = g.cat("00000000", count, "000000000000", g.labels_hex(name), "00000c0001")
    return records(udp_frames(p, F.col("sport"), 5353, body), "MDNS", "M")


@query(
    "rec_nbns",
    f"SELECT seq, mac, src_ip, 'HOST-' || dev AS netbios_name, {ROUTED} FROM pk",
)
def _rec_nbns(spark, sf):
    p = g.pk(spark, sf)
    padded = F.rpad(g.text_hex(F.concat(F.lit("HOST-"), F.col("dev").cast("string"))), 32, "20")
    enc = g.text_hex(F.translate(padded, "0123456789ABCDEF", "ABCDEFGHIJKLMNOP"))
    body = g.cat("123401100001000000000000", "20", enc, "0000200001")
    return records(udp_frames(p, F.lit(137), 137, body), "NBNS", "N")


@query(
    "rec_l7",
    f"""SELECT page_id AS seq, '02:00:00:00:00:' || printf('%02x', page_id % 20) AS mac,
  printf('192.168.0.%d', page_id % 20 + 10) AS src_ip, 1900 AS dst_port,
  'notify * http/1.1  location: ' || lower(url) || '  ' AS payload, {ROUTED} FROM pages""",
    "hosts AS (SELECT 1)",
)
def _rec_l7(spark, sf):
    h = g.table(spark, sf, "pages").select(
        F.timestamp_micros(F.col("page_id") * 700000).alias("ts"), F.col("page_id").alias("seq"), "url",
        F.concat(F.lit("02:00:00:00:00:"), F.format_string("%02x", F.col("page_id") % 20)).alias("mac"),
        F.format_string("192.168.0.%d", F.col("page_id") % 20 + 10).alias("src_ip"),
        F.lit("239.255.255.250").alias("dst_ip"),
    )
    text = F.concat(F.lit("NOTIFY * HTTP/1.1\r\nLOCATION: "), F.col("url"), F.lit("\r\n"))
    return records(udp_frames(h, F.lit(50000), 1900, g.text_hex(text)), "L7", "M")


@query(
    "rec_lldp",
    f"""SELECT seq, mac, 'switch-' || dev AS sysname, CASE WHEN k % 2 = 0 THEN 'desc ' || repeat('y', k) ELSE '' END AS sysdesc,
  {ROUTED} FROM pk""",
)
def _rec_lldp(spark, sf):
    p = g.pk(spark, sf)
    k = F.col("k")

    def tlv(typ, text):
        return g.once(text, lambda h: g.cat(g.hx(g.size(h) + typ * 512, 2), h))

    name = tlv(5, g.text_hex(F.concat(F.lit("switch-"), F.col("dev").cast("string"))))
    desc = tlv(6, g.text_hex(F.concat(F.lit("desc|"), F.repeat(F.lit("y"), k))))
    body = g.cat("0207040200000000010405aabbccddee"[:4] + "04" + "020000000001", name,
                 F.when(k % 2 == 0, desc).otherwise(F.lit("")), "0000")
    return records(g.as_frames(p, g.ether("0180c200000e", g.mac_hex(), "88cc", body)), "LLDP", "L")


LAN = PrefixSet(learned=(("lan0", "192.168.0.0/24"),))


@query(
    "rec_arp",
    """SELECT seq, mac, src_ip AS sender_ip, dst_ip AS target_ip,
  CASE k % 3 WHEN 1 THEN 'request' WHEN 2 THEN 'reply' ELSE 'other' END AS op,
  CAST(dev % 4 <> 0 AS INTEGER) AS routed FROM pk WHERE k % 5 <> 4""",
)
def _rec_arp(spark, sf):
    """One in five has a hardware type that is not Ethernet; off-link senders are marked routed."""
    p = g.pk(spark, sf)
    k = F.col("k")
    hw = F.when(k % 5 == 4, F.lit("0006")).otherwise(F.lit("0001"))
    op = g.hx(F.when(k % 3 == 0, F.lit(9)).otherwise(k % 3), 2)
    body = g.cat(hw, "08000604", op, g.mac_hex(), g.ip_hex(F.col("src_ip")), "00" * 6, g.ip_hex(F.col("dst_ip")))
    return records(g.as_frames(p, g.ether("ff" * 6, g.mac_hex(), "0806", body)), "ARP", "L", prefixes=LAN)


@query(
    "rec_ndp",
    """, c AS (SELECT *, CASE WHEN k % 2 = 0 THEN mac ELSE '02:00:00:00:aa:' || printf('%02x', k) END AS claim FROM pk),
n AS (SELECT * EXCLUDE (mac), claim AS mac, CAST(coalesce(lag(claim) OVER w <> claim AND ts_s - lag(ts_s) OVER w <= 180, false) AS INTEGER) AS routed
  FROM c WINDOW w AS (PARTITION BY dev ORDER BY seq))
SELECT seq, mac, printf('fe80::%x', dev + 1) AS src_ip, ['RS', 'NS', 'NA'][k % 3 + 1] AS type,
  CASE WHEN k % 3 > 0 THEN printf('2001:db8::%x', seq + 65536 - seq // 65536 * 65536 - 65536 + 1) END AS target_ip,
  CASE WHEN k % 3 = 2 THEN CASE WHEN k % 4 < 2 THEN 'RS' ELSE 'SO' END END AS flags, routed FROM n""",
)
def _rec_ndp(spark, sf):
    """The link-layer option names the sender in odd rows; the message before may have named another."""
    p = g.pk(spark, sf)
    k = F.col("k")
    target = g.cat("20010db8" + "00" * 8, g.hx(F.col("seq") % 65536 + 1, 4))
    option = g.cat(F.when(k % 3 == 2, F.lit("0201")).otherwise(F.lit("0101")), "02000000aa", g.hx(k, 1))
    tail = F.when(k % 2 == 0, F.lit("")).otherwise(option)
    bits = F.when(k % 4 < 2, F.lit("c0000000")).otherwise(F.lit("60000000"))
    body = (
        F.when(k % 3 == 0, g.cat("85000000" + "00000000", tail))
        .when(k % 3 == 1, g.cat("87000000" + "00000000", target, tail))
        .otherwise(g.cat("88000000", bits, target, tail))
    )
    return records(v6_frames(p, 58, body, hops=255), "NDP", "L")


@query(
    "rec_ra",
    """SELECT seq, mac, printf('fe80::%x', dev + 1) AS src_ip, 64 AS hop_limit,
  CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN 'M' WHEN 2 THEN 'O' ELSE 'MO' END AS flags, 1800 + k AS router_lifetime,
  CASE WHEN k % 2 = 0 THEN printf('2001:db8:%x::', dev + 1) END AS prefix, CASE WHEN k % 2 = 0 THEN 64 ELSE 0 END AS prefix_len,
  CASE WHEN k % 3 = 0 THEN 1400 + k ELSE 0 END AS mtu, 0 AS routed FROM pk""",
)
def _rec_ra(spark, sf):
    p = g.pk(spark, sf)
    k = F.col("k")
    flags = F.element_at(F.array(F.lit("00"), F.lit("80"), F.lit("40"), F.lit("c0")), k % 4 + 1)

    def prefix(net):
        return g.cat("0304" + "40c0" + "00" * 12, net, "00" * 10)

    net = g.cat("20010db8", g.hx(F.col("dev") + 1, 2))
    opts = g.cat(
        F.when(k % 2 == 0, g.cat(prefix(net), prefix("20010db8ffff"))).otherwise(F.lit("")),
        F.when(k % 3 == 0, g.cat("05010000", g.hx(F.lit(1280), 4), "05010000", g.hx(k + 1400, 4))).otherwise(F.lit("")),
    )
    body = g.cat("86000000", "40", flags, g.hx(k + 1800, 2), "00" * 8, opts)
    return records(v6_frames(p, 58, body, hops=255), "RA", "L")


# -- routed marker through the whole job ------------------------------------------


@query(
    "routed_flag",
    """, c AS (SELECT seq AS c_seq, ts_s AS c_s, ipk, dev AS owner FROM pk WHERE event_type = 'signup'),
p AS (SELECT * FROM pk WHERE event_type <> 'signup')
SELECT p.seq, p.mac, printf('192.168.7.%d', p.ipk + 1) AS src_ip,
  CAST(coalesce(p.ts_s - c.c_s <= 180 AND c.owner <> p.dev, false) AS INTEGER) AS routed
FROM p ASOF LEFT JOIN c ON p.ipk = c.ipk AND p.seq > c.c_seq""",
)
def _routed_flag(spark, sf):
    """SYNs of shared addresses against the ARP claims before them."""
    p = g.pk(spark, sf).withColumn("src_ip", F.format_string("192.168.7.%d", F.col("ipk") + 1))
    ip = g.ip_hex(F.col("src_ip"))
    syn = g.ether(g.GATEWAY, g.mac_hex(), "0800", g.ipv4(6, ip, g.ip_hex(F.col("dst_ip")), g.tcp(F.col("sport"), 443, 2)))
    arp = g.ether("ff" * 6, g.mac_hex(), "0806", g.cat("0001080006040001", g.mac_hex(), ip, "00" * 6, ip))
    frames = g.as_frames(p, F.when(F.col("event_type") == "signup", arp).otherwise(syn))
    return records(frames, "SYN", "SL").select("seq", "mac", "src_ip", "routed")


@query(
    "job_lines",
    """, l AS (
  SELECT seq, ts_s, mac, src_ip, k, dev FROM pk),
d AS (SELECT *, lag(ts_s) OVER (PARTITION BY mac, src_ip, k ORDER BY seq) AS prev FROM l)
SELECT seq, 'OBS|sensor-a|lan0|0|DNS|' || mac || '|' || src_ip || '|host' || k || '.example.com' AS line
FROM d WHERE prev IS NULL OR ts_s - prev >= 35""",
)
def _job_lines(spark, sf):
    """Frames to deduplicated wire lines of a sensor."""
    p = g.pk(spark, sf).withColumn("dst_ip", F.lit("198.51.100.53"))
    name = F.concat(F.lit("host"), F.col("k").cast("string"), F.lit(".example.com"))
    frames = udp_frames(p, F.col("sport") % 1000 + 40000, 53, g.dns_hex(F.col("k"), "0100", name))
    opts = Options(selection=vectors("q", "v"), iface="lan0", sensor_name="sensor-a")
    return wire_lines(telemetry(frames, opts), sensor=True).select("seq", "line")


def mixed_frames(spark, sf):
    """A DNS query, a SYN, a web request, a DHCP request or an ARP request, by event type."""
    p = g.spread(g.pk(spark, sf))
    k, kind, mac, ip = F.col("k"), F.col("event_type"), g.mac_hex(), g.ip_hex(F.col("src_ip"))
    far = g.ip_hex(F.col("dst_ip"))

    def to_gateway(proto, body):
        return g.ether(g.GATEWAY, mac, "0800", g.ipv4(proto, ip, far, body))

    port = F.col("sport") % 1000 + 40000
    name = F.concat(F.lit("host"), k.cast("string"), F.lit(".example.com"))
    agent = F.concat(F.lit("GET / HTTP/1.1\r\nUser-Agent: agent/"), k.cast("string"), F.lit("\r\n\r\n"))
    host = g.text_hex(F.concat(F.lit("host-"), F.col("dev").cast("string")))
    options = g.cat("0c", g.sized(host, 1), "3c08", g.text_hex("MSFT 5.0"), "3704010306", g.hx(k, 1), "ff")
    frame = (
        F.when(kind == "view", to_gateway(17, g.udp(port, 53, g.dns_hex(k, "0100", name))))
        .when(kind == "click", to_gateway(6, g.tcp(port, 443, 2, "", "020405b4", k + 1024)))
        .when(kind == "purchase", to_gateway(6, g.tcp(port, 80, 24, g.text_hex(agent))))
        .when(kind == "signup", to_gateway(17, g.udp(F.lit(68), 67, g.cat("010106" + "00" * 233, "63825363", options))))
        .otherwise(g.ether("ff" * 6, mac, "0806", g.cat("0001080006040001", mac, ip, "00" * 6, far)))
    )
    return g.as_frames(p, frame)


MIXED_SQL = """, m AS (SELECT seq, event_type, CASE event_type
    WHEN 'view' THEN 'DNS|' || mac || '|' || src_ip || '|host' || k || '.example.com'
    WHEN 'click' THEN 'SYN|' || mac || '|' || src_ip || '|64|' || (1024 + k) || '|-1|1460|M*|443'
    WHEN 'purchase' THEN 'HTTP|' || mac || '|' || src_ip || '|agent/' || k
    WHEN 'signup' THEN 'DHCP|' || mac || '|' || src_ip || '|host-' || dev || '|MSFT 5.0|1,3,6,' || k
    ELSE 'ARP|' || mac || '|' || src_ip || '|' || dst_ip || '|request' END AS line FROM pk)
SELECT seq, line FROM m"""


@query("job_default", MIXED_SQL + " WHERE event_type IN ('click', 'signup')")
def _job_default(spark, sf):
    """The default selection; names, web requests and ARP are outside it. The frames are made and decoded once for all tables."""
    tables = telemetry(mixed_frames(spark, sf), Options(dedup_ttl=0), store=work_folder(spark))
    return wire_lines(tables).select("seq", "line")


@query("lines_to_files", "SELECT seq, line FROM wire UNION ALL SELECT seq, line FROM wire", WIRE)
def _lines_to_files(spark, sf):
    """Lines written to two sinks at once, read back from both."""
    folder = work_folder(spark)
    named = g.wire(spark, sf).select(F.concat_ws(" ", "seq", "line").alias("line"))
    write_telemetry(named, [Sink("text", f"{folder}/text"), Sink("parquet", f"{folder}/parquet")])
    both = spark.read.text(f"{folder}/text").unionAll(spark.read.parquet(f"{folder}/parquet").select("line"))
    parts = F.split(F.col("value"), " ", 2)
    return both.select(parts[0].cast("bigint").alias("seq"), parts[1].alias("line"))


@query(
    "frames_from_files",
    """, m AS (SELECT seq, CASE WHEN event_type = 'error' THEN 42 END AS bytes, 'eth0' AS iface FROM pk)
SELECT count(*) AS frames, count(bytes) AS arp_frames FROM m""",
)
def _frames_from_files(spark, sf):
    """Frames written as a table and read with the frame schema; other link types stay out."""
    folder = work_folder(spark)
    frames = mixed_frames(spark, sf)
    other = frames.withColumn("link_type", F.lit("other"))
    frames.unionByName(other).write.parquet(folder)
    read = read_frames(spark, folder)
    return read.agg(F.count("*").alias("frames"), F.count(F.when(F.length("data") == 42, 1)).alias("arp_frames"))


@query("job_all", MIXED_SQL)
def _job_all(spark, sf):
    """Every record group, extended, without suppression; the frames are decoded and stored once."""
    opts = Options(selection=vectors("A", extended=True))
    return job_lines(mixed_frames(spark, sf), opts, work_folder(spark)).select("seq", "line")


# -- QUIC ---------------------------------------------------------------------------


def quic_frames(p, hello, broken=None):
    """One datagram per event whose Initial carries the whole hello."""
    p = g.spread(p)
    plain = F.unhex(g.pad_hex(g.crypto_frame_hex(0, hello), 1200))
    packet = g.quic_initial(F.unhex(g.hx(F.col("seq"), 8)), F.col("k"), plain)
    body = F.hex(packet)
    if broken is not None:
        # one ciphertext byte flipped: the tag no longer verifies
        p = stage(p, {"x": F.hex(packet)})
        body = F.when(broken, F.concat(F.expr("substring(x, 1, length(x) - 2)"), F.when(F.expr("right(x, 2)") == "00", F.lit("01")).otherwise(F.lit("00")))).otherwise(F.col("x"))
    return v4_frames(p, 17, g.udp(F.col("sport"), F.lit(443), body))


@query(
    "rec_tls_quic",
    HELLO_SQL
    + f"""SELECT ja.seq, mac, src_ip, dst_ip, 443 AS dst_port, sni, ja4, alpn, {ROUTED}
FROM ja JOIN pk ON pk.seq = ja.seq""",
    PK,
)
def _rec_tls_quic(spark, sf):
    p = g.pk(spark, sf)
    return records(quic_frames(p, g.event_hello(F.col("k"), F.col("seq"))), "TLS", "T")


@query(
    "rec_quic",
    """, q AS (SELECT * REPLACE (printf('203.0.113.%d', seq % 2) AS dst_ip) FROM pk),
b AS (SELECT * FROM q WHERE k % 4 = 0),
o AS (SELECT seq AS o_seq, ts_s AS o_s, mac, dst_ip FROM q WHERE k % 4 <> 0)
SELECT b.seq, b.mac, src_ip, b.dst_ip, 443 AS dst_port, 'encrypted' AS sni, 'v1' AS version, 0 AS routed
FROM b ASOF LEFT JOIN o ON b.mac = o.mac AND b.dst_ip = o.dst_ip AND b.seq > o.o_seq
WHERE o.o_s IS NULL OR b.ts_s - o.o_s > 15""",
)
def _rec_quic(spark, sf):
    """A quarter of the datagrams does not verify; recent successes of a flow silence them."""
    p = g.pk(spark, sf).withColumn("dst_ip", F.concat(F.lit("203.0.113."), (F.col("seq") % 2).cast("string")))
    hello = g.event_hello(F.col("k"), F.col("seq"))
    return records(quic_frames(p, hello, F.col("k") % 4 == 0), "QUIC", "T")


@query(
    "quic_initials",
    "SELECT seq, 1 + CAST(k % 3 = 0 AS INTEGER) AS packets, printf('%016x', seq) AS dcid, 1200 AS plain_len FROM pk",
)
def _quic_initials(spark, sf):
    """A third of the datagrams holds two coalesced Initials; both verify."""
    from netobs.operators.records import with_initials

    p = g.spread(g.pk(spark, sf))
    plain = F.unhex(F.repeat(F.lit("00"), 1200))
    one = g.quic_initial(F.unhex(g.hx(F.col("seq"), 8)), F.col("k"), plain, token="abcd")
    p = stage(p, {"x": one})
    df = p.withColumn("payload", F.when(F.col("k") % 3 == 0, F.concat("x", "x")).otherwise(F.col("x")))
    return with_initials(df).select(
        "seq", F.size("initials").alias("packets"),
        F.lower(F.hex(F.col("initials")[0]["dcid"])).alias("dcid"),
        F.length(F.element_at("initials", -1)["plain"]).alias("plain_len"),
    )


def split_hello(spark, sf):
    """Each event's hello in two fragments, the tail first, 0.1 s apart."""
    p = g.pk(spark, sf)
    p = stage(p, {"h": F.unhex(g.hello_hex(F.array(F.lit(4865) + F.col("k")), "00" * 100))})
    cut = F.col("k") + 10
    tail = F.struct(cut.alias("off"), F.expr("substring(h, k + 11)").alias("bytes"))
    head = F.struct(F.lit(0).alias("off"), F.expr("substring(h, 1, k + 12)").alias("bytes"))
    rows = p.select(
        "ts", "seq", F.hex(F.encode(F.col("seq").cast("string"), "UTF-8")).alias("dcid"), "k", "h",
        F.posexplode(F.array(tail, head)).alias("part", "frag"),
    )
    late = F.when((F.col("part") == 1) & (F.col("k") % 5 == 0), F.expr("INTERVAL 7 SECONDS")).otherwise(
        F.expr("INTERVAL 0 SECONDS")
    )
    return rows.select(
        (F.col("ts") + late).alias("ts"), "seq", "dcid", "part", F.length("h").alias("n"),
        F.array("frag").alias("frags"),
    )


REASSEMBLED_SQL = "SELECT seq, 4 + 2 + 32 + 1 + 2 + 2 + 2 + 2 + 100 AS n FROM pk WHERE k % 5 <> 0"


@query("quic_reassemble", REASSEMBLED_SQL)
def _quic_reassemble(spark, sf):
    """The second half comes too late in a fifth of the rows."""
    done = quic_reassemble(split_hello(spark, sf), ["dcid"])
    return done.where(F.length("hello") == F.col("n")).select("seq", F.length("hello").alias("n"))


SPLIT_SQL = (
    HELLO_SQL
    + f"""SELECT ja.seq, mac, src_ip, dst_ip, 443 AS dst_port, sni, ja4, alpn, {ROUTED}
FROM ja JOIN pk ON pk.seq = ja.seq"""
)


def split_frames(spark, sf, number, size=4):
    """Every hello in two datagrams a second apart, tail first; ``number`` gives their packet numbers."""
    p = g.spread(g.pk(spark, sf))
    p = stage(p, {"h": g.event_hello(F.col("k"), F.col("seq"))})
    tail = g.crypto_frame_hex(40, F.expr("substring(h, 81)"))
    head = g.crypto_frame_hex(0, F.expr("substring(h, 1, 80)"))
    rows = p.withColumn("half", F.explode(F.array(F.lit(0), F.lit(1))))
    body = F.when(F.col("half") == 0, tail).otherwise(head)
    rows = stage(rows, {"plain": F.unhex(g.pad_hex(body, 1200))}, drop=("h",))
    rows = rows.withColumns(
        {"ts": F.col("ts") + F.make_interval(secs=F.col("half")), "seq": F.col("seq") * 2 + F.col("half"), "id": F.col("seq")}
    )
    packet = g.quic_initial(F.unhex(g.hx(F.col("id"), 8)), number(F.col("half")), F.col("plain"), size=size)
    return v4_frames(rows, 17, g.udp(F.col("sport"), F.lit(443), F.hex(packet)))


@query("rec_tls_quic_stateful", SPLIT_SQL, PK)
def _rec_tls_quic_stateful(spark, sf):
    """Only the two datagrams of a hello together give a record."""
    df = records(split_frames(spark, sf, lambda half: half), "TLS", "T", quic_stateful=True)
    return df.withColumn("seq", F.floor(F.col("seq") / 2))


def far_frames(spark, sf):
    """Numbers 200 and 300 in one byte each: the second verifies only as the nearest to the first."""
    return split_frames(spark, sf, lambda half: half * 100 + 200, size=1)


@query("rec_tls_quic_far", SPLIT_SQL, PK)
def _rec_tls_quic_far(spark, sf):
    df = records(far_frames(spark, sf), "TLS", "T", quic_stateful=True)
    return df.withColumn("seq", F.floor(F.col("seq") / 2))

