"""Anchored windows against the rule row by row."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from netobs.plans.recurrence import anchored


def plain(rows, ttl, strict):
    """(key, t, seq) of the anchors."""
    out, last = set(), {}
    for key, t, seq, reset in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        if reset:
            last.pop(key, None)
        elif key not in last or t - last[key] >= ttl + strict:
            out.add((key, t, seq))
            last[key] = t
    return out


@pytest.mark.parametrize("seed", range(4))
def test_random_rows(spark, seed):
    rng = random.Random(seed)
    rows, at = [], {}
    for seq in range(900):
        key = rng.choice(["a", "a", "a", "b", "c", None])
        at[key] = at.get(key, rng.randrange(-50, 50)) + rng.choice([0, 1, 2, 7, 30, 200])
        rows.append((key, at[key], seq, rng.random() < 0.1))
    ttl, width, strict, resets = rng.choice([(1, 1, False, False), (10, 10, True, True), (10, 33, False, True), (25, 300, True, True), (60, 7, False, False)])
    rows = [(k, t, s, r and resets) for k, t, s, r in rows]
    df = spark.createDataFrame(rows, "key string, t long, seq long, gone boolean").repartition(3)
    got = anchored(df, ["key"], "t", ttl, "hit", order=("seq",), reset="gone" if resets else None, strict=strict, width=width)
    assert got.columns == [*df.columns, "hit"] and got.count() == len(rows)
    assert {(r.key, r.t, r.seq) for r in got.where("hit").collect()} == plain(rows, ttl, strict)


def test_empty_and_single(spark):
    df = spark.createDataFrame([], "key string, t long")
    assert anchored(df, ["key"], "t", 5, "hit").count() == 0
    one = spark.createDataFrame([(None, 5)], "key string, t long")
    assert [r.hit for r in anchored(one, ["key"], "t", 5, "hit").collect()] == [True]


def test_one_key_with_all_rows_runs_in_many_tasks(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.range(40_000).select(F.lit("hot").alias("key"), F.col("id").alias("t"))
        got = anchored(df, ["key"], "t", 9, "hit", width=500)
        tasks = got.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.sum(F.col("hit").cast("int")).alias("hits")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(tasks) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(r.n for r in tasks) < 20_000
    assert sum(r.hits for r in tasks) == -(-40_000 // 9)
