"""ClientHello reassembly across QUIC Initial packets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netobs.functions.quic import (
    as_tls_record,
    crypto_fragments,
    quic_open,
    quic_open_any,
    quic_packet_number,
)
from netobs.plans.slices import SLICE, drop_slices, micros, ordered_scan, time_slices
from netobs.plans.stage import stage
from netobs.streaming.hello import HelloParts

SESSION_IDLE = 5


def quic_reassemble(
    fragments: DataFrame, keys: list[str], idle: int = SESSION_IDLE, out: str = "hello"
) -> DataFrame:
    """Rows that complete a hello.

    ``fragments`` has ``ts, seq, part, frags`` (``ARRAY<STRUCT<off, bytes>>``),
    one row per packet; ``part`` is its place in the datagram.  A connection's
    state is the fragments of one unfinished hello.
    """
    slim = fragments.withColumn("_sec", F.unix_seconds("ts"))
    scanned = ordered_scan(
        slim, keys, ["ts", "seq", "part"], ["_sec", "frags"], lambda: HelloParts(idle), out, "binary"
    )
    return scanned.where(F.col(out).isNotNull()).drop("_sec", "frags")


AT = "_at"  # where a packet is shuffled to: all packets of a connection id to one place
OPENED = [AT, "dcid", "part", "_pn", "_size", "_full", "_frags", "_again"]


def opened_initials(grams: DataFrame, outer: bool = False) -> DataFrame:
    """One row per Initial packet, opened before anything is shuffled.

    ``part`` is its place in the datagram, ``_pn`` and ``_size`` are its truncated
    number and that number's bytes, ``_full`` the number it verifies under and
    ``_frags`` its CRYPTO fragments. ``_again`` is what it takes to try further
    numbers, for packets that none of the tried ones opens; only these keep their
    bytes. ``grams`` comes from ``with_initials`` without plain texts; with
    ``outer`` its rows without Initials stay, ``part`` NULL.
    """
    own = ["sensor_name"] if "sensor_name" in grams.columns else []
    split = F.posexplode_outer("initials") if outer else F.posexplode("initials")
    rows = grams.select(*[c for c in grams.columns if c not in ("initials", *([] if outer else ["payload"]))], split.alias("part", "_i"))
    u, hit = F.col("_u"), F.col("_hit")
    rows = stage(rows, {"dcid": F.col("_i.dcid"), "_u": F.col("_i.u"), "_hit": F.when(F.col("_i.u").isNotNull(), quic_open_any(F.col("_i.u")))}, drop=("_i",))
    return stage(
        rows,
        {
            # Rows without Initials belong to no connection and go anywhere.
            AT: F.when(F.col("part").isNull(), F.xxhash64("ts", "seq")).otherwise(F.xxhash64(*own, "dcid")),
            "_pn": u["pn"].cast("bigint"), "_size": u["pn_len"], "_full": hit["full"], "_frags": crypto_fragments(hit["plain"]),
            "_again": F.when(hit.isNull(), u),
        },
        drop=("_u", "_hit"),
    )


def stateful_packets(opened: DataFrame, idle: int = SESSION_IDLE) -> DataFrame:
    """``frags``: the CRYPTO fragments of ``opened_initials``, NULL for packets that do not verify.

    A packet counts when it verifies under its own truncated number, or under the
    number nearest to the largest one that verified so before on the connection.
    """
    own = ["sensor_name"] if "sensor_name" in opened.columns else []
    us, idle_us = F.col("_us"), (idle + 1) * 1_000_000
    sliced = time_slices(opened.withColumn("_us", micros()), us, 60_000_000, idle_us)
    w = (
        Window.partitionBy(AT, *own, "dcid", SLICE)
        .orderBy("_us", "seq", "part")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    pn, full, near = F.col("_pn"), F.col("_full"), F.col("_near")
    largest = F.max(F.when(full == pn, pn)).over(w)
    numbered = drop_slices(sliced.withColumn("_largest", largest)).drop("_us")
    expected = F.coalesce(F.col("_largest") + 1, F.lit(0).cast("bigint"))
    rows = stage(numbered, {"_near": quic_packet_number(expected, pn, F.col("_size"))}, drop=("_largest",))
    further = F.col("_again").isNotNull() & (near != pn)
    frags = F.when((full == pn) | (full == near), F.col("_frags")).when(further, crypto_fragments(quic_open(F.col("_again"), near)))
    return stage(rows, {"frags": frags}, drop=("_near", "_frags", "_again", "_pn", "_size", "_full"))


def hello_records(done: DataFrame, hello: str = "hello") -> DataFrame:
    """Completed hellos as TLS records in column ``tls``."""
    return done.withColumn("tls", as_tls_record(F.col(hello)))
