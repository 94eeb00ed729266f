"""DNS latency: responses matched with the query before them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netobs.plans.slices import SLICE, drop_slices, micros, time_slices

DNS_TIMEOUT = 5


def dns_latency(
    messages: DataFrame,
    keys: list[str],
    timeout: float = DNS_TIMEOUT,
    carry: tuple[str, ...] = (),
    width: int = 60,
) -> DataFrame:
    """Responses that answer a query, with ``latency_us`` and the query's ``carry``.

    ``messages`` has ``ts, seq, is_response``.  A query replaces an older one of
    its key and a match consumes it, so a response matches exactly when the row
    before it is a query less than ``timeout`` seconds old.  One window does it;
    rows reach only ``timeout`` back, so busy keys are cut into time slices.
    """
    limit = int(timeout * 1_000_000)
    width_us = max(width, int(12 * timeout)) * 1_000_000
    df = messages.withColumn("_us", micros())
    sliced = time_slices(df, F.col("_us"), width_us, limit)
    w = Window.partitionBy(*keys, SLICE).orderBy("_us", "seq")
    prev = F.lag(F.struct("is_response", "_us", *carry)).over(w)
    hit = sliced.withColumn("_q", prev).where(
        F.col("is_response") & ~F.col("_q.is_response") & (F.col("_us") - F.col("_q._us") < limit)
    )
    taken = [c for c in messages.columns if c not in carry]
    return drop_slices(hit).select(
        *taken,
        (F.col("_us") - F.col("_q._us")).alias("latency_us"),
        *[F.col(f"_q.{c}").alias(c) for c in carry],
    )
