"""Whole jobs on streams: frames to wire lines and sinks.

Frames are decoded once and stored by route, which needs no state; a second query
reads the stored packets, every record table its own routes. All tables then go
through one chain of stateful operators in one plan, each of which judges rows in
event-time order and passes its watermark on:

1. with stateful QUIC, packet numbers and hellos of a connection (its packets only),
2. the owner of an address against the claims of ARP and NDP,
3. the rules of a flow: handshakes, DNS latency, QUIC failures, flow budgets,
4. suppression of repeats, every tag with its own key and window.

Rows to which a step has nothing to say pass it at once. The lines are those of
the batch job over the same frames.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from netobs.functions.quic import as_tls_record
from netobs.operators import records as r
from netobs.operators.dedup import REFRESH_FLOORS, refresh_ttl
from netobs.operators.dnslat import DNS_TIMEOUT
from netobs.operators.flows import FLOW_BUDGET, FLOW_IDLE
from netobs.operators.handshake import SYN_TTL
from netobs.operators.owner import OWNER_TTL
from netobs.operators.reassembly import SESSION_IDLE, opened_initials
from netobs.plans.jobs import Options, packets, with_route
from netobs.plans.rows import DNS, FLOW, QUIC, TCP, extracted, finished
from netobs.plans.stage import stage
from netobs.sources.sinks import Sink, stream_telemetry
from netobs.sources.wire import with_marker, wrap_observation
from netobs.streaming import keyed
from netobs.streaming.inorder import DELAY, Rule, in_order

OPENER = "iface string, vlan string, routed boolean, body string"


def _initials(udp: DataFrame) -> DataFrame:
    """One row per Initial packet with the number it verifies under and its fragments."""
    own = r._own(udp)
    slim = ["ts", "seq", *own, "iface", "vlan", "routed", r.SENDER, "device_mac", "src_ip", "dst_ip", "dport"]
    rows = opened_initials(r.with_initials(r.long_datagrams(udp), decrypt=False))
    none = F.lit(0).cast("bigint")
    return rows.select(
        *slim, "part", F.hex("dcid").alias("dcid"), F.coalesce("_pn", none).alias("_pn"), F.coalesce("_size", F.lit(1)).alias("_size"),
        F.coalesce("_full", none - 1).alias("_full"), F.col("_frags").alias("frags"),
    )


def found_hellos(udp: DataFrame, stateful: bool) -> DataFrame:
    """Datagrams with Initials and ``tls``, the hello they complete or NULL."""
    if not stateful:
        return r.quic_hello(r.quic_datagrams(udp))
    found = keyed.quic_stateful(_initials(udp), [*r._own(udp), "dcid"], SESSION_IDLE, delay=None)
    return found.withColumn("tls", F.when(F.col("hello").isNotNull(), as_tls_record(F.col("hello"))))


def routed_packets(frames: DataFrame, opts: Options) -> DataFrame:
    """Decoded, filtered packets with the route by which they are stored."""
    return with_route(packets(frames, opts), opts)


# -- the chain ---------------------------------------------------------------------------


def gate(ttl: int) -> Rule:
    """Failures (``ok`` false) that no success stands shortly before."""

    def rule(us: np.ndarray, columns: dict, held: dict):
        sec, ok = us // keyed.SECOND, np.array(columns["ok"], bool)
        before = held.get("sec") if held.get("sec") is not None else keyed.LONG_AGO
        seen = np.maximum.accumulate(np.where(ok, sec, before))
        last = np.concatenate([[before], seen[:-1]])  # of the rows before each
        return np.flatnonzero(~ok & (sec - last > ttl)), {}, {"sec": int(seen[-1])}

    return rule


def by_name(rules: dict[str, Rule]) -> Rule:
    """The rule that a key's rows name."""

    def rule(us: np.ndarray, columns: dict, held: dict):
        return rules[columns["rule"][0]](us, columns, held)

    return rule


def flow_rules(rows: DataFrame, budget: int | None) -> DataFrame:
    """Handshakes, DNS latency, QUIC failures and flow budgets in one operator."""
    rules = {
        TCP: keyed.handshakes(SYN_TTL), DNS: keyed.latencies(DNS_TIMEOUT), QUIC: gate(r.QUIC_SUCCESS_TTL),
        FLOW: keyed.budgets(FLOW_IDLE, FLOW_BUDGET if budget is None else budget),
    }
    inputs = "rule string, kind string, _fwd string, _rev string, is_response boolean, ok boolean, _complete boolean, _record boolean"
    state = f"{keyed.HANDSHAKE_STATE}, us long, resp boolean, row string, {keyed.BUDGET_STATE}"
    return in_order(
        rows, [*r._own(rows), "rule", "conn"], by_name(rules), inputs, "rtt_us long, latency_us long, _from string", state,
        idle=max(SYN_TTL, FLOW_IDLE), order=("seq", "part"), at_once=F.col("rule").isNull(), delay=None,
        gone=("rule", "_fwd", "_rev", "is_response", "ok", "_complete", "_record"),
    )


def packet_lines(pk: DataFrame, opts: Options, delay: str = DELAY) -> DataFrame:
    """``ts, seq, [sensor_name], iface, vlan, tag, line`` of all records of a stream of routed packets."""
    marked = pk.withWatermark("ts", delay)
    rows, claims = extracted(marked, opts.selection, opts.prefixes, opts.router_macs, opts.flow_budget, found_hellos)
    own, sel = r._own(rows), opts.selection
    if claims is None:
        rows = rows.withColumn("routed", F.col("off")).drop("ip", "smac", "off", "ask")
    else:
        known = claims.select("ts", "seq", *own, F.hex("ip").alias("ip"), F.hex("owner_mac").alias("owner_mac"))
        rows = keyed.owner_asof(rows, known, (*own, "ip"), "smac", ttl=OWNER_TTL, at_once=~F.col("ask"), delay=None)
        rows = rows.withColumn("routed", F.coalesce(F.col("off"), F.lit(False)) | F.col("mismatch")).drop("ip", "smac", "off", "ask", "mismatch")
    ruled = flow_rules(rows, opts.flow_budget)
    rows = finished(stage(ruled, {"opened": F.from_json("_from", StructType.fromDDL(OPENER))}, drop=("_from",)))
    held_back = [t for t in sel.tags if sel.deduplicated(t)]
    if opts.dedup_ttl > 0 and held_back:
        tag, most = F.col("tag"), max(opts.dedup_ttl, *(refresh_ttl(t, opts.dedup_ttl) for t in REFRESH_FLOORS))
        ttl = F.lit(opts.dedup_ttl)
        for t in REFRESH_FLOORS:
            ttl = F.when(tag == t, F.lit(refresh_ttl(t, opts.dedup_ttl))).otherwise(ttl)
        keyed_rows = rows.withColumn("_r", F.when(tag != "LLDP", F.col("routed")))
        rows = keyed.dedup_by_row(
            keyed_rows, [*own, "tag", "mac", "sig", "_r"], ttl, tag.isin(*REFRESH_FLOORS), most, ~tag.isin(*held_back), delay=None
        )
    lines = rows.withColumn("line", with_marker(F.col("line"), F.col("routed")))
    if opts.sensor_name is not None:
        lines = wrap_observation(lines)
    return lines.select("ts", "seq", *own, "iface", "vlan", "tag", "line")


def stream_lines(frames: DataFrame, opts: Options, delay: str = DELAY) -> DataFrame:
    """The lines of a stream of frames in a single query; every table decodes for itself, so it suits a few tables."""
    return packet_lines(routed_packets(frames, opts), opts, delay)


def store_packets(frames: DataFrame, opts: Options, folder: str, **trigger) -> StreamingQuery:
    """Decode a stream of frames into ``folder``, by route; exactly once, whatever fails."""
    writer = routed_packets(frames, opts).writeStream.format("parquet").partitionBy("route")
    writer = writer.option("path", f"{folder}/packets").option("checkpointLocation", f"{folder}/stored")
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def stored_packets(frames: DataFrame, opts: Options, folder: str, **options: str) -> DataFrame:
    """The stream of what ``store_packets`` has written."""
    shape = routed_packets(frames, opts).schema
    return frames.sparkSession.readStream.schema(shape).options(**options).parquet(f"{folder}/packets")


def discard_packets(spark: SparkSession, folder: str) -> None:
    """Remove the stored packets, of which a query that has ended has read all; the log of what was stored stays.

    A query that goes on from its checkpoint knows what it has read and does not
    look for it again. Not for packets that a running query may still read.
    """
    packets = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/packets")
    files = packets.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in files.listStatus(packets):
        if status.getPath().getName().startswith("route="):
            files.delete(status.getPath(), True)


def stream_job(frames: DataFrame, opts: Options, sinks: list[Sink], folder: str, delay: str = DELAY, **trigger) -> list[StreamingQuery]:
    """A whole stream: frames to wire lines in every sink. The queries that store packets and that make lines.

    With the default trigger what is there is worked off, the second query after
    the first; with others both run side by side.
    """
    first = store_packets(frames, opts, folder, **trigger)
    if not trigger or trigger.get("availableNow"):
        first.awaitTermination()
    lines = packet_lines(stored_packets(frames, opts, folder), opts, delay)
    return [first, stream_telemetry(lines, sinks, f"{folder}/lines", **trigger)]
