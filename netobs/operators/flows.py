"""Application-flow budget: which payload packets are still worth parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netobs.plans.slices import SLICE, drop_slices, first_rows, seconds, time_slices

FLOW_IDLE = 60
FLOW_BUDGET = 8


def app_flow_budget(
    packets: DataFrame,
    keys: list[str],
    complete: str = "complete",
    idle: int = FLOW_IDLE,
    budget: int = FLOW_BUDGET,
    sec: Column | None = None,
    order: tuple[str, ...] = ("ts", "seq"),
    width: int | None = None,
) -> DataFrame:
    """Keep a packet while its flow episode is young and unfinished.

    An episode ends after more than ``idle`` seconds without a packet.  A packet
    is kept when fewer than ``budget`` packets of the episode came before it and
    none of them was ``complete``.  Kept packets lie within ``budget`` gaps of
    their episode's start, so looking back ``budget * idle`` seconds is exact
    and busy flows are cut into time slices; packets beyond ``budget`` in one
    second are never kept and are cut before the shuffle.
    """
    lookback = budget * idle
    width = width or max(4 * lookback, 1800)
    df = packets.withColumn("_sec", seconds() if sec is None else sec)
    slim = first_rows(df, [*keys, "_sec"], list(order), budget)
    sliced = time_slices(slim, F.col("_sec"), width, lookback)
    by_flow = Window.partitionBy(*keys, SLICE).orderBy("_sec", *order)
    gap = F.col("_sec") - F.lag("_sec").over(by_flow)
    started = sliced.withColumn("_new", F.coalesce((gap > idle).cast("int"), F.lit(1)))
    episode = started.withColumn("_ep", F.sum("_new").over(by_flow))
    in_ep = Window.partitionBy(*keys, SLICE, "_ep").orderBy("_sec", *order)
    done = F.max(F.col(complete).cast("int")).over(in_ep.rowsBetween(Window.unboundedPreceding, -1))
    ranked = episode.withColumn("_n", F.row_number().over(in_ep)).withColumn(
        "_done", F.coalesce(done, F.lit(0))
    )
    kept = drop_slices(ranked).where((F.col("_n") <= budget) & (F.col("_done") == 0))
    return kept.select(*packets.columns)
