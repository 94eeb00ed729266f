"""Stateful operators over ``pulse``."""

from __future__ import annotations

from pyspark.sql import functions as F

from netobs.checks.common import records, tcp_frames, udp_frames
from netobs.checks.registry import PULSE, query
from netobs.operators.dedup import dedup_refresh, dedup_sliding
from netobs.operators.dnslat import dns_latency
from netobs.operators.drops import drop_report
from netobs.operators.flows import app_flow_budget
from netobs.operators.handshake import tcp_handshake
from netobs.operators.owner import owner_asof
from netobs.operators.records import quic_failure_gate
from netobs.checks import derived as g
from netobs.plans.stage import work_folder
from netobs.sources.frames import read_capture_stats

SLIDING_SQL = """
SELECT seq, dev, event_type, ts_s FROM (
  SELECT *, lag(ts_s) OVER (PARTITION BY dev, event_type ORDER BY seq) AS prev FROM pulse)
WHERE prev IS NULL OR ts_s - prev >= 35"""


@query("dedup_sliding", SLIDING_SQL, PULSE)
def _dedup_sliding(spark, sf):
    return dedup_sliding(g.pulse(spark, sf), ["dev", "event_type"], 35).select("seq", "dev", "event_type", "ts_s")


REFRESH_SQL = """, ev AS (
  SELECT seq, dev, event_type, ts_s,
         row_number() OVER (PARTITION BY dev, event_type ORDER BY seq) AS rn FROM pulse),
st AS (
  SELECT seq, dev, event_type, ts_s, rn, ts_s AS anchor FROM ev WHERE rn = 1
  UNION ALL
  SELECT e.seq, e.dev, e.event_type, e.ts_s, e.rn,
         CASE WHEN e.ts_s - s.anchor >= 900 THEN e.ts_s ELSE s.anchor END
  FROM st s JOIN ev e ON e.dev = s.dev AND e.event_type = s.event_type AND e.rn = s.rn + 1)
SELECT min(seq) AS seq, dev, event_type, anchor AS ts_s FROM st
WHERE anchor = ts_s GROUP BY dev, event_type, anchor"""


@query("dedup_refresh", REFRESH_SQL, PULSE)
def _dedup_refresh(spark, sf):
    return dedup_refresh(g.pulse(spark, sf), ["dev", "event_type"], 900).select("seq", "dev", "event_type", "ts_s")


DNS_SQL = """
SELECT seq, dev, chan, CAST(ts_us - q_us AS BIGINT) AS latency_us, q_seq FROM (
  SELECT seq, dev, k % 2 AS chan, ts_us, event_type IN ('purchase', 'signup') AS resp,
         lag(event_type NOT IN ('purchase', 'signup')) OVER w AS was_query,
         lag(ts_us) OVER w AS q_us, lag(seq) OVER w AS q_seq
  FROM pulse
  WINDOW w AS (PARTITION BY dev, k % 2 ORDER BY seq))
WHERE resp AND was_query AND ts_us - q_us < 20000000"""


def dns_events(p):
    """Two kinds of events are responses, all others queries."""
    return p.select(
        "ts", "seq", "dev", (F.col("k") % 2).alias("chan"),
        F.col("event_type").isin("purchase", "signup").alias("is_response"),
        F.col("seq").alias("q_seq"),
    )


@query("dns_latency", DNS_SQL, PULSE)
def _dns_latency(spark, sf):
    df = dns_latency(dns_events(g.pulse(spark, sf)), ["dev", "chan"], 20, carry=("q_seq",))
    return df.select("seq", "dev", "chan", "latency_us", "q_seq")


FLOW_SQL = """, gaps AS (
  SELECT *, CASE WHEN ts_s - lag(ts_s) OVER (PARTITION BY dev ORDER BY seq) > 30 THEN 1 ELSE 0 END AS brk
  FROM pulse),
ep AS (SELECT *, sum(brk) OVER (PARTITION BY dev ORDER BY seq) AS ep FROM gaps),
r AS (
  SELECT *, row_number() OVER w AS n,
         coalesce(max(CAST(k >= 80 AS INTEGER)) OVER (
           PARTITION BY dev, ep ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done
  FROM ep WINDOW w AS (PARTITION BY dev, ep ORDER BY seq))
SELECT seq, dev, ts_s, k FROM r WHERE n <= 8 AND done = 0"""


@query("app_flow_budget", FLOW_SQL, PULSE)
def _app_flow_budget(spark, sf):
    p = g.pulse(spark, sf).withColumn("complete", F.col("k") >= 80)
    return app_flow_budget(p, ["dev"], idle=30).select("seq", "dev", "ts_s", "k")


OWNER_SQL = """, c AS (SELECT seq AS c_seq, ts_s AS c_s, ipk, dev AS owner FROM pulse WHERE event_type = 'signup'),
p AS (SELECT * FROM pulse WHERE event_type <> 'signup')
SELECT p.seq, p.ipk, p.dev,
       CAST(coalesce(p.ts_s - c.c_s <= 18 AND c.owner <> p.dev, false) AS INTEGER) AS mismatch
FROM p ASOF LEFT JOIN c ON p.ipk = c.ipk AND p.seq > c.c_seq"""


def ownership(p):
    claims = p.where(F.col("event_type") == "signup").select(
        "ts", "seq", F.col("ipk").alias("ip"), F.col("dev").alias("owner_mac")
    )
    packets = p.where(F.col("event_type") != "signup").select(
        "ts", "seq", F.col("ipk").alias("ip"), F.col("dev").alias("mac")
    )
    return packets, claims


@query("owner_mismatch", OWNER_SQL, PULSE)
def _owner_mismatch(spark, sf):
    packets, claims = ownership(g.pulse(spark, sf))
    df = owner_asof(packets, claims, ttl=18)
    return df.select("seq", F.col("ip").alias("ipk"), F.col("mac").alias("dev"), F.col("mismatch").cast("int"))


# One automaton step per row: the SYN time of the live entry and what is emitted.
TCP_STATE_SQL = """, ev AS (
  SELECT seq, ts_us, dev, k, row_number() OVER (PARTITION BY dev ORDER BY seq) AS rn,
         CASE event_type WHEN 'view' THEN 'SYN' WHEN 'click' THEN 'SYNACK'
              WHEN 'purchase' THEN 'FIN' WHEN 'error' THEN 'RST'
              ELSE CASE WHEN k % 2 = 0 THEN 'SYN' ELSE 'SYNACK' END END AS kind
  FROM pulse),
st AS (
  SELECT dev, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS syn_us, CAST(NULL AS BIGINT) AS seq,
         CAST(NULL AS VARCHAR) AS kind, CAST(NULL AS BIGINT) AS rtt
  FROM ev GROUP BY dev
  UNION ALL
  SELECT e.dev, e.rn,
    CASE WHEN e.kind = 'SYN' THEN
           CASE WHEN s.syn_us IS NULL OR e.ts_us - s.syn_us > 120000000 THEN e.ts_us ELSE s.syn_us END
         WHEN e.kind = 'SYNACK' THEN NULL ELSE s.syn_us END,
    e.seq,
    CASE WHEN e.kind <> 'SYN' AND s.syn_us IS NOT NULL AND e.ts_us - s.syn_us <= 120000000
              AND (e.kind <> 'SYNACK' OR e.ts_us > s.syn_us) THEN e.kind END,
    CASE WHEN e.kind = 'SYNACK' THEN e.ts_us - s.syn_us ELSE 0 END
  FROM st s JOIN ev e ON e.dev = s.dev AND e.rn = s.rn + 1)
"""


def tcp_kind():
    return (
        F.when(F.col("event_type") == "view", F.lit("SYN"))
        .when(F.col("event_type") == "click", F.lit("SYNACK"))
        .when(F.col("event_type") == "purchase", F.lit("FIN"))
        .when(F.col("event_type") == "error", F.lit("RST"))
        .otherwise(F.when(F.col("k") % 2 == 0, F.lit("SYN")).otherwise(F.lit("SYNACK")))
    )


@query(
    "tcp_handshake",
    TCP_STATE_SQL + "SELECT seq, dev, kind AS state_event, rtt AS rtt_us FROM st WHERE kind IS NOT NULL",
    PULSE,
)
def _tcp_handshake(spark, sf):
    p = g.pulse(spark, sf).withColumn("kind", tcp_kind())
    df = tcp_handshake(p.withColumn("forward", F.lit(True)), ["dev"])
    return df.select("seq", "dev", "state_event", F.col("rtt_us").cast("bigint"))


@query(
    "rec_tcplvl",
    TCP_STATE_SQL
    + """SELECT seq, '02:00:00:00:00:' || printf('%02x', dev) AS mac,
       printf('192.168.%d.%d', dev % 4, dev + 10) AS src_ip, printf('198.51.100.%d', dev) AS dst_ip,
       443 AS dst_port, rtt AS rtt_us, 0 AS retrans_count, kind AS state_event, 0 AS routed
FROM st WHERE kind IS NOT NULL""",
    PULSE,
)
def _rec_tcplvl(spark, sf):
    return records(handshake_frames(spark, sf), "TCPLVL", "s", extended=True)


def handshake_frames(spark, sf):
    """A connection of every device, answers and half of the ends from the server."""
    p = g.pk(spark, sf).withColumn("kind", tcp_kind())
    p = p.withColumn("server", F.format_string("198.51.100.%d", "dev"))
    kind = F.col("kind")
    # TCP flag bytes.
    flags = F.when(kind == "SYN", F.lit(2)).when(kind == "SYNACK", F.lit(18)).when(kind == "FIN", F.lit(17)).otherwise(F.lit(4))
    from_server = (kind == "SYNACK") | (kind.isin("FIN", "RST") & (F.col("k") % 2 == 1))
    cport, mac = F.col("dev") + 40000, g.mac_hex()
    cip, sip = g.ip_hex(F.col("src_ip")), g.ip_hex(F.col("server"))
    out = g.ether(g.GATEWAY, mac, "0800", g.ipv4(6, cip, sip, g.tcp(cport, 443, flags)))
    back = g.ether(mac, g.GATEWAY, "0800", g.ipv4(6, sip, cip, g.tcp(F.lit(443), cport, flags)))
    return g.as_frames(p, F.when(from_server, back).otherwise(out))


DROP_SQL = """, s AS (
  SELECT ts_s // 10 AS slot, seq % 2 AS ifc, count(*) AS packets,
         count(*) FILTER (WHERE event_type = 'error') AS drops
  FROM pulse GROUP BY 1, 2),
t AS (
  SELECT *, sum(packets) OVER w AS total_packets, sum(drops) OVER w AS total_drops
  FROM s WINDOW w AS (PARTITION BY ifc ORDER BY slot))
SELECT slot, 'eth' || ifc AS iface, packets, drops, round(100.0 * drops / packets, 2) AS drop_pct,
       CAST(total_packets AS BIGINT) AS total_packets, CAST(total_drops AS BIGINT) AS total_drops
FROM t WHERE drops > 0"""


def counters(p):
    return p.select(
        "ts", F.concat(F.lit("eth"), (F.col("seq") % 2).cast("string")).alias("iface"),
        F.lit(1).cast("bigint").alias("packets"),
        (F.col("event_type") == "error").cast("bigint").alias("drops"),
    )


@query("drop_report", DROP_SQL, PULSE)
def _drop_report(spark, sf):
    df = drop_report(counters(g.pulse(spark, sf)))
    return df.select(
        F.floor(F.unix_seconds("ts") / 10).alias("slot"), "iface", "packets", "drops", "drop_pct",
        "total_packets", "total_drops",
    )


@query("capture_stats_files", DROP_SQL, PULSE)
def _capture_stats_files(spark, sf):
    """Counters polled into files of JSON lines, read with the counters' schema."""
    folder = work_folder(spark)
    counters(g.pulse(spark, sf)).write.json(folder)
    df = drop_report(read_capture_stats(spark, folder, fmt="json"))
    return df.select(
        F.floor(F.unix_seconds("ts") / 10).alias("slot"), "iface", "packets", "drops", "drop_pct",
        "total_packets", "total_drops",
    )


GATE_SQL = """, ok AS (SELECT seq AS o_seq, ts_s AS o_s, dev FROM pulse WHERE event_type = 'view'),
bad AS (SELECT * FROM pulse WHERE event_type IN ('error', 'signup'))
SELECT bad.seq, bad.dev FROM bad ASOF LEFT JOIN ok ON bad.dev = ok.dev AND bad.seq > ok.o_seq
WHERE ok.o_s IS NULL OR bad.ts_s - ok.o_s > 15"""


@query("quic_failure_gate", GATE_SQL, PULSE)
def _quic_failure_gate(spark, sf):
    p = g.pulse(spark, sf).select("ts", "seq", "dev", "event_type")
    bad = p.where(F.col("event_type").isin("error", "signup")).drop("event_type")
    ok = p.where(F.col("event_type") == "view").drop("event_type")
    return quic_failure_gate(bad, ok, ["dev"]).select("seq", "dev")
