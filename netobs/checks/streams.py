"""Streaming forms of the stateful operators, against the SQL of the batch forms.

Each table is cut into parts by time. A part is added to the stream's folder and
the query runs until it has read it; the next run goes on from the state that the
one before left, so every rule's state has to cross a restart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netobs.checks.registry import PK, PULSE, query
from netobs.checks.state import DROP_SQL, FLOW_SQL, GATE_SQL, OWNER_SQL, REFRESH_SQL, SLIDING_SQL, TCP_STATE_SQL, DNS_SQL, counters, dns_events, ownership, tcp_kind
from netobs.checks import derived as g
from netobs.checks.wirechecks import ACTIVITY_SQL
from netobs.checks.recordchecks import MIXED_SQL, REASSEMBLED_SQL, SPLIT_SQL, far_frames, mixed_frames
from netobs.operators.vectors import vectors
from netobs.plans.jobs import Options
from netobs.plans.stage import discard, move, work_folder
from netobs.schemas import record_columns
from netobs.sources.wire import parse_wire, to_typed
from netobs.streaming import keyed
from netobs.streaming.job import discard_packets, packet_lines, store_packets, stored_packets

PARTS = 3
JITTER = 5  # seconds that a row may come after newer ones; the operators allow ten
DAY = "INTERVAL 1 DAY"


def through_stream(
    spark: SparkSession, op: Callable[..., DataFrame], *tables: DataFrame, store: Options | None = None, span: DataFrame | None = None
) -> DataFrame:
    """Rows of ``op`` over the tables (with ``ts``), each read as a stream in parts.

    The parts are cut by time, each row up to some seconds late, so that newer
    rows come before older ones. The clock of ``pulse`` starts where a stream's
    first watermark stands, so the rows run a day later and come back. A row long
    after all others, in a last part, moves the watermark past them; it stays
    unjudged itself. With ``store`` the table is one of frames, and ``op`` takes
    the packets that a query before it stores. ``span`` are slim rows over about
    the same time, where the first table itself is costly to make.

    The tables are made and written once, by part; a part is moved to the stream,
    not copied, and goes when the stream has read it.
    """
    folder = work_folder(spark)
    low, high = (tables[0] if span is None else span).agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    width = max(1, (high - low) // PARTS + 1)
    late = F.pmod(F.xxhash64("seq"), F.lit(JITTER * 1_000_000)) if "seq" in tables[0].columns else F.lit(0)
    part = F.floor((F.unix_micros("ts") + late - low) / width)
    part = F.least(F.greatest(part, F.lit(0)), F.lit(PARTS - 1))
    for i, table in enumerate(tables):
        table.withColumn("p", part.cast("int")).withColumn("ts", F.col("ts") + F.expr(DAY)).write.partitionBy("p").parquet(f"{folder}/made{i}")
    made = [spark.read.schema(table.schema).parquet(f"{folder}/made{i}") for i, table in enumerate(tables)]
    high = made[0].agg(F.max(F.unix_micros("ts"))).first()[0]
    for i, table in enumerate(made):
        last = table.limit(1).withColumn("ts", F.col("ts") + F.expr("INTERVAL 3650 DAYS"))
        last.coalesce(1).write.parquet(f"{folder}/made{i}/p={PARTS}")
    out = None
    for n in range(PARTS + 1):
        for i in range(len(tables)):
            move(spark, f"{folder}/made{i}/p={n}", f"{folder}/in{i}/p{n}")
        sources = [spark.readStream.schema(table.schema).parquet(f"{folder}/in{i}/p*") for i, table in enumerate(tables)]
        if store is not None:
            store_packets(sources[0], store, folder).awaitTermination()
            discard(spark, f"{folder}/in0/p{n}")
            sources = [stored_packets(sources[0], store, folder)] if out is None else []
        if out is None:
            out = op(*sources)
        run = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
        run.trigger(availableNow=True).start().awaitTermination()
        for i in range(len(tables)):
            discard(spark, f"{folder}/in{i}/p{n}")
        if store is not None:
            discard_packets(spark, folder)
    done = spark.read.schema(out.schema).parquet(f"{folder}/out").withColumn("ts", F.col("ts") - F.expr(DAY))
    return done.where(F.unix_micros(F.col("ts") + F.expr(DAY)) <= high)


@query("stream_dedup_sliding", SLIDING_SQL, PULSE)
def _dedup_sliding(spark, sf):
    rows = g.pulse(spark, sf).select("ts", "seq", "dev", "event_type", "ts_s")
    return through_stream(spark, lambda r: keyed.dedup_sliding(r, ["dev", "event_type"], 35), rows).drop("ts")


@query("stream_dedup_refresh", REFRESH_SQL, PULSE)
def _dedup_refresh(spark, sf):
    rows = g.pulse(spark, sf).select("ts", "seq", "dev", "event_type", "ts_s")
    return through_stream(spark, lambda r: keyed.dedup_refresh(r, ["dev", "event_type"], 900), rows).drop("ts")


@query("stream_dns_latency", DNS_SQL, PULSE)
def _dns_latency(spark, sf):
    rows = dns_events(g.pulse(spark, sf))
    out = through_stream(spark, lambda r: keyed.dns_latency(r, ["dev", "chan"], 20, carry=("q_seq",)), rows)
    return out.select("seq", "dev", "chan", "latency_us", "q_seq")


@query("stream_app_flow_budget", FLOW_SQL, PULSE)
def _app_flow_budget(spark, sf):
    rows = g.pulse(spark, sf).select("ts", "seq", "dev", "ts_s", "k", (F.col("k") >= 80).alias("complete"))
    out = through_stream(spark, lambda r: keyed.app_flow_budget(r, ["dev"], idle=30), rows)
    return out.select("seq", "dev", "ts_s", "k")


@query("stream_owner_mismatch", OWNER_SQL, PULSE)
def _owner_mismatch(spark, sf):
    packets, claims = ownership(g.pulse(spark, sf))
    out = through_stream(spark, lambda p, c: keyed.owner_asof(p, c, ttl=18), packets, claims)
    return out.select("seq", F.col("ip").alias("ipk"), F.col("mac").alias("dev"), F.col("mismatch").cast("int"))


@query("stream_quic_failure_gate", GATE_SQL, PULSE)
def _failure_gate(spark, sf):
    p = g.pulse(spark, sf).select("ts", "seq", "dev", "event_type")
    bad = p.where(F.col("event_type").isin("error", "signup")).drop("event_type")
    ok = p.where(F.col("event_type") == "view").drop("event_type")
    return through_stream(spark, lambda b, o: keyed.failure_gate(b, o, ["dev"]), bad, ok).select("seq", "dev")


@query(
    "stream_tcp_handshake",
    TCP_STATE_SQL + "SELECT seq, dev, kind AS state_event, rtt AS rtt_us FROM st WHERE kind IS NOT NULL",
    PULSE,
)
def _tcp_handshake(spark, sf):
    p = g.pulse(spark, sf).withColumn("kind", tcp_kind()).select("ts", "seq", "dev", "kind")
    return through_stream(spark, lambda r: keyed.tcp_handshake(r, ["dev"]), p).select("seq", "dev", "state_event", "rtt_us")


@query(
    "stream_drop_report",
    DROP_SQL + " AND slot < (SELECT max(x.slot) FROM t AS x WHERE x.ifc = t.ifc)",
    PULSE,
)
def _drop_report(spark, sf):
    """The last interval is still open when the stream stops."""
    out = through_stream(spark, keyed.drop_report, counters(g.pulse(spark, sf)))
    return out.select(
        F.floor(F.unix_seconds("ts") / 10).alias("slot"), "iface", "packets", "drops", "drop_pct",
        "total_packets", "total_drops",
    )


@query("stream_quic_reassemble", REASSEMBLED_SQL, PK)
def _quic_reassemble(spark, sf):
    """The second half comes too late in a fifth of the rows."""
    from netobs.checks.recordchecks import split_hello

    rows = split_hello(spark, sf).drop("k", "h")
    out = through_stream(spark, lambda r: keyed.quic_reassemble(r, ["dcid"]), rows)
    return out.where(F.length("hello") == F.col("n")).select("seq", F.length("hello").alias("n"))


@query(
    "stream_routed_flag",
    """, c AS (SELECT seq AS c_seq, ts_s AS c_s, ipk, dev AS owner FROM pk WHERE event_type = 'signup'),
p AS (SELECT * FROM pk WHERE event_type <> 'signup')
SELECT p.seq, CAST(k % 10 = 9 OR (k % 4 > 0 AND coalesce(p.ts_s - c.c_s <= 180 AND c.owner <> p.dev, false)) AS INTEGER) AS routed
FROM p ASOF LEFT JOIN c ON p.ipk = c.ipk AND p.seq > c.c_seq""",
    PK,
)
def _routed_flag(spark, sf):
    """Packets of shared addresses against the claims before them; one in four is not judged."""
    p = g.pk(spark, sf).withColumns({"a": F.unhex(F.hex("ipk")), "m": F.unhex(g.mac_hex())})
    claims = p.where(F.col("event_type") == "signup").select("ts", "seq", F.col("a").alias("ip"), F.col("m").alias("owner_mac"))
    packets = p.where(F.col("event_type") != "signup").select(
        "ts", "seq", "k", F.col("a").alias("src_ip"), F.col("m").alias("src_mac"), (F.col("k") % 10 == 9).alias("offlink_routed")
    )
    out = through_stream(spark, lambda q, c: keyed.routed_flag(q, c, F.col("k") % 4 > 0), packets, claims)
    return out.select("seq", F.col("routed").cast("int"))


@query("stream_device_activity", ACTIVITY_SQL)
def _device_activity(spark, sf):
    """Records per device and tag after deduplication: all tags in one operator."""
    kept = through_stream(spark, lambda r: keyed.dedup_wire(parse_wire(r)), g.wire(spark, sf).select("ts", "seq", "line"))
    return kept.groupBy("tag", "mac").agg(F.count("*").alias("records"))


@query("stream_tls_quic_stateful", SPLIT_SQL, PK)
def _tls_quic_stateful(spark, sf):
    """Hellos over two datagrams whose numbers lie beyond what their one byte can hold."""
    opts = Options(selection=vectors("T", "v", quic_stateful=True), dedup_ttl=0)
    lines = through_stream(spark, lambda packets: packet_lines(packets, opts), far_frames(spark, sf), store=opts, span=g.pulse(spark, sf))
    rows = to_typed(parse_wire(lines.select("seq", "line")), "TLS").withColumn("routed", F.col("routed").cast("int"))
    return rows.select(F.floor(F.col("seq") / 2).alias("seq"), "mac", *record_columns("TLS"), "routed")


@query("stream_job_all", MIXED_SQL)
def _job_all(spark, sf):
    """Every record group, extended, without suppression, from a stream of frames with restarts."""
    opts = Options(selection=vectors("A", extended=True, quic_stateful=True))
    return through_stream(spark, lambda packets: packet_lines(packets, opts), mixed_frames(spark, sf), store=opts, span=g.pulse(spark, sf)).select("seq", "line")
