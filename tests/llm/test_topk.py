"""Exact top-k against brute force."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from netobs.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, id long, rank int, q int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, 3, 1, 2) for i, v in rows], SCHEMA)


def brute(rows, every, k):
    clean = [
        (i, [math.floor(256 * float(np.float32(x))) for x in v])
        for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for i, q in clean:
        if i % every == 0:
            held = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
            scored = sorted((-held(sum(a * b for a, b in zip(q, c, strict=True))), j) for j, c in clean if j != i and len(c) == len(q))
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored[:k])]
    return sorted(out)


def agree(spark, rows, every=5, k=5):
    got = topk.top_k(vectors(spark, rows), F.col("vec_id") % every == 0, k).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == brute(rows, every, k)


@pytest.mark.parametrize("size", [3, 40])
def test_random_vectors_and_ties(spark, monkeypatch, size):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 16)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 50)
    monkeypatch.setattr(topk, "DIMENSIONS", 4)
    rng = random.Random(size)
    rows = [(i, [rng.choice([rng.gauss(0, 0.2), 0.25]) for _ in range(size)]) for i in range(300)]
    rows += [(1000 + i, rows[i % 7][1]) for i in range(60)]
    agree(spark, rows)


def test_odd_rows(spark):
    rows = [
        (0, [0.5, 0.5]), (1, None), (2, [0.5, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (None, [1.0, 1.0]),
        (5, [0.5, 0.5]), (6, [1.0]), (10, []), (15, []), (7, [-0.001, 0.0]), (20, [3.0]),
    ]
    agree(spark, rows)


def test_components_beyond_exact_doubles(spark):
    rows = [(i, [1e9 * (i + 1), 1e9, -1e8 * i]) for i in range(12)] + [(30, [3e38, 1.0, 1.0]), (31, [-3e38, 1.0, 1.0])]
    agree(spark, rows)


def test_nothing(spark):
    assert topk.top_k(vectors(spark, []), F.col("vec_id") % 50 == 0, 5).count() == 0


def test_repeated_ids(spark, monkeypatch):
    """Every row but the query's own is a candidate, also one with the same id; both are queries."""
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 7)
    rng = random.Random(5)
    for scale in (0.2, 1e9):
        rows = [(i % 20, [rng.gauss(0, scale) for _ in range(3)]) for i in range(50)] + [(0, [scale] * 3)] * 3
        whole = [[math.floor(256 * float(np.float32(x))) for x in v] for _, v in rows]
        held = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
        wanted = []
        for i, q in enumerate(whole):
            if rows[i][0] % 5 == 0:
                others = sorted((-held(sum(a * b for a, b in zip(q, c, strict=True))), rows[j][0]) for j, c in enumerate(whole) if j != i)
                wanted += [(rows[i][0], n + 1, j, -s) for n, (s, j) in enumerate(others[:5])]
        got = topk.top_k(vectors(spark, rows), F.col("vec_id") % 5 == 0, 5).collect()
        assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == sorted(wanted)
