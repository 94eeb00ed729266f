"""TCP handshake time and connection state records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netobs.plans.recurrence import anchored
from netobs.plans.slices import SLICE, first_rows, micros, time_slices
from netobs.plans.stage import shared

SYN_TTL = 120
SYN, SYNACK, FIN, RST = "SYN", "SYNACK", "FIN", "RST"


def tcp_handshake(
    events: DataFrame,
    keys: list[str],
    ttl: int = SYN_TTL,
    carry: tuple[str, ...] = (),
    id_cols: tuple[str, ...] = ("ts", "seq"),
    width: int | None = None,
) -> DataFrame:
    """Handshake and state records from ``SYN, SYNACK, FIN, RST`` events.

    ``events`` has ``ts, seq, kind``, the client-side ``keys`` and ``forward``:
    FIN / RST rows come twice, as client and as server, and the client reading
    wins.  ``carry`` columns are taken from the opening SYN.

    A SYN opens an entry unless one is live; SYN+ACK closes it and gives the
    time when it is later than the SYN; FIN and RST report and keep it; an entry
    dies ``ttl`` seconds after its SYN.  The opening rule is a recurrence
    (``anchored``) over slim SYN / SYNACK rows; the look-up of the live entry
    reaches back ``ttl`` seconds at most and runs in time slices.
    """
    ttl_us = ttl * 1_000_000
    width_us = (width or max(4 * ttl, 600)) * 1_000_000
    slim = [*keys, "ts", "seq", "kind", "forward", *carry]
    df = events.select(*slim).withColumn("_us", micros())
    df = shared(df, *keys, F.floor(F.col("_us") / width_us))
    marks = df.where(F.col("kind").isin(SYN, SYNACK)).withColumn("_ends", F.col("kind") == SYNACK)
    opened = anchored(marks, keys, "_us", ttl_us, "_open", order=("seq",), reset="_ends", strict=True, width=width_us)
    opened = opened.where((F.col("kind") == SYNACK) | F.col("_open")).drop("_open", "_ends")
    rows = opened.unionByName(df.where(F.col("kind").isin(FIN, RST)))

    anchor = F.col("kind").isin(SYN, SYNACK)
    sliced = time_slices(rows, F.col("_us"), width_us, ttl_us, only=anchor)
    w = (
        Window.partitionBy(*keys, SLICE)
        .orderBy("_us", "seq")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    entry = F.struct("kind", "_us", *carry)
    live = F.last(F.when(anchor, entry), ignorenulls=True).over(w)
    hit = (
        sliced.withColumn("_e", live)
        .where(~F.col("_context") & (F.col("kind") != SYN) & (F.col("_e.kind") == SYN))
        .where(F.col("_us") - F.col("_e._us") <= ttl_us)
        .where((F.col("kind") != SYNACK) | (F.col("_us") > F.col("_e._us")))
        .select(
            *keys,
            "ts",
            "seq",
            "forward",
            F.when(F.col("kind") == SYNACK, F.col("_us") - F.col("_e._us"))
            .otherwise(F.lit(0))
            .alias("rtt_us"),
            F.lit(0).alias("retrans_count"),
            F.col("kind").alias("state_event"),
            *[F.col(f"_e.{c}").alias(c) for c in carry],
        )
    )
    # A FIN / RST that matches in both readings counts once, as the client's.
    one = hit.withColumn("_rank", F.when(F.col("forward"), F.lit(0)).otherwise(F.lit(1)))
    return first_rows(one, [*id_cols], ["_rank"]).drop("_rank", "forward")
