"""Whitening against a dense eigendecomposition."""

from __future__ import annotations

import math

import numpy as np
import pytest

from netobs.llm import whitening
from netobs.llm.common import table
from netobs.llm.whitening import Spectrum, rank_one, whiten

SF = "/root/testdata/sf0.01"


def whole(vector):
    return [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in vector]


def check(rows, got, most=16):
    """All columns of all rows against numpy over the distinct vectors."""
    good = [(i, whole(v)) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in good})
    n, total = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array(fit, float) - np.array([t / n for t in total])
    v = centred.T @ centred / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(most, int((values > 1e-12 * values[0]).sum()))
    by = {}
    for r in got:
        by.setdefault(r.component, {}).setdefault(r.vec_id, []).append(r)
    assert sorted(by) == list(range(1, k + 1)) and len(got) == k * len(good)
    error = {r.identity_error for r in got}
    assert len(error) == 1 and error.pop() < 1e-8
    for c, rows_of in by.items():
        sign = None
        for i, x in good:
            for r in rows_of[i]:
                if [y for j, y in good if j == i] != [x]:
                    continue  # rows that share an id: which is which cannot be told
                assert r.n == n and r.deviation == sum((n * a - t) ** 2 for a, t in zip(x, total, strict=True))
                assert r.explained == pytest.approx(values[c - 1] / np.trace(v), rel=1e-9)
                want = (np.array(x) - np.array([t / n for t in total])) @ vectors[:, c - 1] / math.sqrt(values[c - 1])
                if sign is None and abs(want) > 0.1:
                    sign = 1 if want * r.whitened > 0 else -1
                if sign is not None:
                    assert r.whitened * sign == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("group", [2, 8])
def test_the_table(spark, monkeypatch, group):
    monkeypatch.setattr(whitening, "GROUP", group)
    rows = table(spark, SF, "embeddings").repartition(7)
    check([(r.vec_id, r.embedding) for r in rows.collect()], whiten(rows).collect())


VECTORS = "vec_id long, embedding array<float>, x string, n long, part int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], VECTORS)


def test_messy_rows(spark):
    """Nulls, gaps, non-finite and repeated vectors, ranks below the number of dimensions, clashing column names."""
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=3)] + [0.5]) for i in range(40)] + [(100 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(300)]
    rows += [(500, None), (501, [1.0, None, 2.0, 3.0]), (502, [float("nan"), 1.0, 1.0, 1.0]), (503, [float("inf"), 0.0, 0.0, 0.0]), (504, []), (None, [1.0, 1.0, 0.0, 0.0]), (0, [9.0, 9.0, 9.0, 9.0])]
    got = whiten(frame(spark, rows)).collect()
    check([r for r in rows if r[1] != []], got)


def test_lengths_apart_and_tables_without_spread(spark):
    rng = np.random.default_rng(2)
    two = [(i, [float(x) for x in rng.normal(size=2)]) for i in range(30)]
    three = [(100 + i, [float(x) for x in rng.normal(size=3)]) for i in range(30)]
    got = whiten(frame(spark, two + three)).collect()
    check(two, [r for r in got if r.vec_id < 100])
    check(three, [r for r in got if r.vec_id >= 100])
    assert whiten(frame(spark, [])).collect() == [] == whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    big = whiten(frame(spark, [(1, [1e30, 0.0]), (2, [0.0, 1.0]), (3, [3e38, -1e38])])).collect()
    assert {r.vec_id for r in big} == {1, 2, 3} and all(math.isfinite(r.whitened) for r in big) and any(r.deviation is None for r in big)


def test_deviations_are_exact():
    x = np.array([[5, -7], [1 << 40, 3]])
    total = [(1 << 41) + 1, 12]
    want = [sum((3 * int(a) - t) ** 2 for a, t in zip(row, total, strict=True)) for row in x]
    assert whitening.deviations(x, 3, total) == [w if w < 1 << 63 else None for w in want]
    assert whitening.deviations(np.array([[3, 4]]), 2, [5, 9]) == [2]


@pytest.mark.parametrize("kind", ["normal", "few", "repeated", "wide"])
def test_updates_and_merges_keep_the_spectrum(kind):
    rng = np.random.default_rng(3)
    d = 24
    x = rng.normal(size=(300, d))
    if kind == "few":
        x[:, 4:] = x[:, :1]
    if kind == "repeated":
        x = np.repeat(x[:10], 30, axis=0)
    if kind == "wide":
        x *= 10.0 ** rng.integers(-3, 4, d)
    parts = []
    for rows in (x[:1], x[1:180], x[180:]):
        s = Spectrum.nothing(d)
        for row in rows:
            s.add(row)
        parts.append(s)
    whole_, *others = parts
    for other in (*others, Spectrum.nothing(d)):
        whole_.merge(other)
    centred = x - x.mean(axis=0)
    scatter = centred.T @ centred
    assert whole_.n == len(x) and np.allclose(whole_.mean, x.mean(axis=0))
    assert np.allclose(whole_.lam, np.linalg.eigvalsh(scatter), atol=1e-9 * np.linalg.norm(scatter))
    assert np.allclose(whole_.q.T @ whole_.q, np.eye(d), atol=1e-9)
    assert np.allclose(whole_.q @ np.diag(whole_.lam) @ whole_.q.T, scatter, atol=1e-9 * np.linalg.norm(scatter))


def test_a_rank_one_update_of_equal_eigenvalues():
    lam, q = rank_one(np.array([1.0, 1.0, 1.0]), np.eye(3), np.array([1.0, 2.0, 2.0]), 1.0)
    assert np.allclose(lam, [1, 1, 10]) and np.allclose(q @ np.diag(lam) @ q.T, np.eye(3) + np.outer([1, 2, 2], [1, 2, 2]))
    same, _ = rank_one(np.array([1.0, 2.0]), np.eye(2), np.zeros(2), 1.0)
    assert np.allclose(same, [1, 2])
