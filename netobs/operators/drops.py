"""Capture loss report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

INTERVAL = 10


def drop_counts(stats: DataFrame, interval: int = INTERVAL, keys: tuple[str, ...] = ("iface",)) -> DataFrame:
    """Packets and drops per interface and interval; combines before the shuffle."""
    slot = F.window("ts", f"{interval} seconds")
    return (
        stats.groupBy(slot.alias("w"), *keys)
        .agg(F.sum("packets").alias("packets"), F.sum("drops").alias("drops"))
        .select(F.col("w.start").alias("ts"), *keys, "packets", "drops")
    )


def drop_report(stats: DataFrame, interval: int = INTERVAL, keys: tuple[str, ...] = ("iface",)) -> DataFrame:
    """Intervals with losses: counts, percentage and running totals.

    The running window sees one row per interface and interval, whatever the
    number of counter rows.
    """
    w = Window.partitionBy(*keys).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    pct = F.when(F.col("packets") > 0, F.lit(100.0) * F.col("drops") / F.col("packets")).otherwise(F.lit(0.0))
    return (
        drop_counts(stats, interval, keys)
        .withColumns({"total_packets": F.sum("packets").over(w), "total_drops": F.sum("drops").over(w)})
        .where(F.col("drops") > 0)
        .withColumn("drop_pct", F.round(pct, 2))
    )
