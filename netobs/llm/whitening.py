"""Embedding whitening by incremental eigendecomposition.

Every partition keeps the mean, the eigenvalues and the eigenvectors of the
scatter of the vectors it has seen. A new vector is one centred rank-one update:
in the present eigenbasis the matrix is a diagonal plus ``rho z z'``, components
that change nothing are deflated, the new eigenvalues are the roots of the
secular equation, one between two old ones, and the new vectors follow from them.
Spectra of partitions are combined two by two by as many rank-one updates as the
second has eigenvalues, and one for the distance of the means, in rounds of small
groups. What is left is rounding; a distributed Rayleigh-Ritz step over the fit
list, in the basis found, gives eigenvalues and vectors to double precision.

Only sums, means and d x d matrices travel, never vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netobs.llm.common import Scratch
from netobs.llm.topk import usable

COMPONENTS = 16
SCALE, SHIFT = 64.0, 1_000_000
LARGEST = float(1 << 52)  # components beyond stand for it, so that all are exact as doubles
GROUP = 8  # partial results that one task combines
ROUNDS = 40  # of the root finder at most; it ends when no root moves
ROWS = 4096  # vectors taken from a batch at once
EPS = np.finfo(float).eps


def secular_roots(d: np.ndarray, z2: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of diag(d) + rho z z' and the matrix d_i - root_j; ``d`` rises strictly, every z is not 0.

    Each root is written as a distance from the nearer of its two poles, so that
    the differences keep their digits. Steps match a rational function with the
    two poles to value and slope on either side; one that leaves its bracket is
    replaced by the bracket's middle.
    """
    k = len(d)
    ends = np.append(d[1:], d[-1] + rho * z2.sum())
    gap = ends - d
    middle = d[:, None] - (d + gap / 2)[None, :]
    with np.errstate(divide="ignore"):
        at_middle = 1 + rho * (z2[:, None] / middle).sum(axis=0)
    near_high = (at_middle < 0) & (np.arange(k) < k - 1)
    origin = np.where(near_high, ends, d)
    delta = d[:, None] - origin[None, :]
    low, high = np.where(near_high, -gap / 2, 0.0), np.where(near_high, 0.0, np.where(at_middle < 0, gap, gap / 2))
    low = np.where((at_middle < 0) & ~near_high, gap / 2, low)
    x = (low + high) / 2
    below = np.tri(k, dtype=bool).T  # poles up to the root's own
    weight = rho * z2[:, None]
    own, up = np.arange(k), np.minimum(np.arange(k) + 1, k - 1)
    last = np.arange(k) == k - 1
    with np.errstate(all="ignore"):
        for _ in range(ROUNDS):
            far = delta - x[None, :]
            term = weight / far
            f = 1 + term.sum(axis=0)
            low, high = np.where(f <= 0, x, low), np.where(f >= 0, x, high)
            slope = term / far
            left, right = np.where(below, slope, 0).sum(axis=0), np.where(below, 0, slope).sum(axis=0)
            a1, a2 = far[own, own], far[up, own]
            c = f - a1 * left - a2 * right
            b = a1 * a2 * f
            a = (a1 + a2) * f - a1 * a2 * (left + right)
            square = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - square) / (2 * c), 2 * b / (a + square))
            rest = f - a1 * left  # the last root has one pole only
            step = np.where(last, a1 * f / rest, step)
            new = x + step
            new = np.where((new > low) & (new < high), new, (low + high) / 2)
            noise = k * EPS * (1 + np.abs(term).sum(axis=0))
            open_ = (np.abs(f) > noise) & np.isfinite(new)
            x = np.where(open_, new, x)
            if not open_.any():
                break
    return origin + x, delta - x[None, :]


def rank_one(lam: np.ndarray, q: np.ndarray, v: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and vectors of q diag(lam) q' + rho v v', rho not negative."""
    z = q.T @ v
    length = float(np.sqrt(z @ z))
    added = rho * length * length
    if not added > 0 or not np.isfinite(added):
        return lam, q
    z, rho = z / length, added
    tiny = 8 * EPS * max(abs(lam[0]), abs(lam[-1]), rho)
    # Deflation: of equal eigenvalues one takes all of z, by a reflection of their vectors.
    if (lam[1:] - lam[:-1] <= tiny).any():
        q = q.copy()
        edges = [0, *(1 + np.flatnonzero(lam[1:] - lam[:-1] > tiny)), len(lam)]
        for a, b in zip(edges, edges[1:], strict=False):
            part = z[a:b]
            norm = np.sqrt(part @ part)
            if b - a > 1 and norm > 0:
                mirror = part.copy()
                sign = 1.0 if mirror[-1] >= 0 else -1.0
                mirror[-1] += sign * norm
                mirror /= np.sqrt(mirror @ mirror)
                q[:, a:b] -= 2 * np.outer(q[:, a:b] @ mirror, mirror)
                z[a:b] = 0
                z[b - 1] = -sign * norm
    # And components that z hardly has stay as they are.
    live = rho * np.abs(z) > tiny
    if not live.any():
        return lam, q
    d, zz = lam[live], z[live]
    roots, far = secular_roots(d, zz * zz, rho)
    # The z for which the computed roots are exact keeps the vectors orthogonal.
    k = len(d)
    ratio = -far
    if k > 1:
        poles = d[None, :] - d[:, None]
        below = np.arange(k)[None, :] < np.arange(k)[:, None]
        pairs = np.ones((k, k))
        pairs[:, :] = np.where(below, ratio / np.where(below, poles, 1), 1)
        above = np.arange(k)[None, :] > np.arange(k)[:, None]
        shifted = np.concatenate([ratio[:, :1], ratio[:, :-1]], axis=1)
        pairs = np.where(above, shifted / np.where(above, poles, 1), pairs)
        exact = np.abs(pairs.prod(axis=1) * ratio[:, -1])
    else:
        exact = np.abs(ratio[:, 0])
    exact = np.sqrt(exact) * np.where(zz < 0, -1, 1)
    w = exact[:, None] / far
    w /= np.sqrt((w * w).sum(axis=0))
    lam, q = lam.copy(), q if q.base is None else q.copy()
    turned = q[:, live] @ w
    q = q.copy()
    lam[live], q[:, live] = roots, turned
    order = np.argsort(lam, kind="stable")
    return lam[order], q[:, order]


class Spectrum:
    """Count, mean and eigendecomposition of the scatter of some vectors."""

    def __init__(self, n: int, mean: np.ndarray, lam: np.ndarray, q: np.ndarray):
        self.n, self.mean, self.lam, self.q = n, mean, lam, q

    @classmethod
    def nothing(cls, dim: int) -> "Spectrum":
        return cls(0, np.zeros(dim), np.zeros(dim), np.eye(dim))

    def add(self, x: np.ndarray) -> None:
        away = x - self.mean
        if self.n:
            self.lam, self.q = rank_one(self.lam, self.q, away, self.n / (self.n + 1))
        self.n += 1
        self.mean = self.mean + away / self.n

    def merge(self, other: "Spectrum") -> None:
        if not other.n:
            return
        if not self.n:
            self.n, self.mean, self.lam, self.q = other.n, other.mean, other.lam, other.q
            return
        away, n = other.mean - self.mean, self.n + other.n
        for value, vector in zip(other.lam, other.q.T, strict=True):
            if value > 0:
                self.lam, self.q = rank_one(self.lam, self.q, vector, float(value))
        self.lam, self.q = rank_one(self.lam, self.q, away, self.n * other.n / n)
        self.mean = self.mean + away * (other.n / n)
        self.n = n


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column without nulls."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def sliced(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for frame in frames:
        for a in range(0, len(frame), ROWS):
            yield frame.slice(a, ROWS)


def summed(x: np.ndarray) -> list[int]:
    """Exact sums of integer columns: halves of the numbers are added up apart."""
    high = x >> 26
    return [(int(h) << 26) + int(lo) for h, lo in zip(high.sum(axis=0), (x - (high << 26)).sum(axis=0), strict=True)]


def gathered(parts: DataFrame, scratch: Scratch, name: str, combine: Callable[[pd.DataFrame], dict]) -> pd.Series | None:
    """One row of all rows (part, ...), ``GROUP`` at a time; rows are combined in the order of ``part``."""
    schema = parts.schema.simpleString()[len("struct<") : -1]
    now = scratch.save(parts, f"{name}0")
    left = now.count()

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("part")
        row = combine(frame) | {"part": int(frame["part"].iloc[0])}
        return pd.DataFrame([row])[list(frame.columns)]

    turn, width = 0, 1
    while left > 1:
        turn, width = turn + 1, width * GROUP
        groups = now.groupBy(F.floor(F.col("part") / width))
        new = scratch.save(groups.applyInPandas(run, schema), f"{name}{turn}")
        scratch.drop(f"{name}{turn - 1}")
        now, left = new, new.count()
    rows = now.toPandas()
    scratch.drop(f"{name}{turn}")
    return rows.iloc[0] if len(rows) else None


def basis_of(fit: DataFrame, dim: int, scratch: Scratch) -> tuple[int, list[int], np.ndarray]:
    """Number of vectors, exact sums by dimension, and a basis near the eigenvectors."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        seen, total = Spectrum.nothing(dim), [0] * dim
        for frame in sliced(frames):
            x = matrix(frame.column("x"), dim)
            total = [a + b for a, b in zip(total, summed(x), strict=True)]
            for row in x.astype(float):
                seen.add(row)
        if seen.n:
            yield pa.RecordBatch.from_pylist([{
                "part": TaskContext.get().partitionId(), "n": seen.n, "total": [str(t) for t in total],
                "mean": seen.mean.tolist(), "lam": seen.lam.tolist(), "q": seen.q.ravel().tolist(),
            }])

    def combine(frame: pd.DataFrame) -> dict:
        spectra = [
            Spectrum(int(r.n), np.array(r.mean), np.array(r.lam), np.array(r.q).reshape(dim, dim))
            for r in frame[["n", "mean", "lam", "q"]].itertuples(index=False)
        ]
        first = spectra[0]
        for other in spectra[1:]:
            first.merge(other)
        total = reduce(lambda a, b: [str(int(x) + int(y)) for x, y in zip(a, b, strict=True)], frame["total"])
        return {"n": first.n, "total": list(total), "mean": first.mean.tolist(), "lam": first.lam.tolist(), "q": first.q.ravel().tolist()}

    parts = fit.mapInArrow(run, "part long, n long, total array<string>, mean array<double>, lam array<double>, q array<double>")
    row = gathered(parts, scratch, f"spectra{dim}-", combine)
    return int(row["n"]), [int(t) for t in row["total"]], np.array(row["q"]).reshape(dim, dim)


def projected_scatter(fit: DataFrame, mean: np.ndarray, basis: np.ndarray, scratch: Scratch, name: str) -> np.ndarray:
    """Sum of y y' over the fit list, y a centred vector in the basis."""
    dim, k = basis.shape
    sent = fit.sparkSession.sparkContext.broadcast((mean, basis))  # d x d

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, vectors = sent.value
        total, seen = np.zeros((k, k)), False
        for frame in sliced(frames):
            y = (matrix(frame.column("x"), dim) - centre) @ vectors
            total += y.T @ y
            seen = True
        if seen:
            yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "h": total.ravel().tolist()}])

    parts = fit.mapInArrow(run, "part long, h array<double>")
    row = gathered(parts, scratch, name, lambda frame: {"h": np.sum(np.stack(list(frame["h"])), axis=0).tolist()})
    return np.array(row["h"]).reshape(k, k)


class Whitening:
    """Sums, count, components (columns) and what they explain; ``error`` is the largest entry of whitened covariance minus identity."""

    def __init__(self, n: int, total: list[int], vectors: np.ndarray, values: np.ndarray, trace: float):
        self.n, self.total, self.vectors, self.values, self.trace = n, total, vectors, values, trace
        self.mean = np.array([t / n for t in total])
        self.error = 0.0

    def scaled(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)


def learn(fit: DataFrame, dim: int, most: int, scratch: Scratch) -> Whitening:
    """Components of the distinct vectors ``x`` of one length."""
    n, total, basis = basis_of(fit, dim, scratch)
    mean = np.array([t / n for t in total])
    basis = np.linalg.qr(basis)[0]
    for turn in range(2):  # the second is for a basis that rounding has spoilt
        h = projected_scatter(fit, mean, basis, scratch, f"ritz{dim}-{turn}-") / n
        values, turned = np.linalg.eigh((h + h.T) / 2)
        basis, values = (basis @ turned)[:, ::-1], values[::-1]
        above = values > dim * EPS * max(values[0], 0) * 8
        model = Whitening(n, total, basis[:, above][:, :most], values[above][:most], float(np.trace(h)))
        if not above.any():
            return model
        check = projected_scatter(fit, mean, model.scaled(), scratch, f"check{dim}-{turn}-") / n
        model.error = float(np.abs(check - np.eye(len(check))).max())
        if model.error < 1e-9:
            break
    return model


def deviations(x: np.ndarray, n: int, total: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2, exact; null beyond 64 bits."""
    most = n * max(1, int(np.abs(x).max(initial=0))) + max(map(abs, total))
    if most < 1 << 62:
        away = n * x - np.array(total, np.int64)
        if np.square(away.astype(float)).sum(axis=1).max(initial=0) < 1 << 62:
            return (away * away).sum(axis=1).tolist()
    exact = [sum((n * int(v) - t) ** 2 for v, t in zip(row, total, strict=True)) for row in x]
    return [d if d < 1 << 63 else None for d in exact]


def applied(rows: DataFrame, model: Whitening, dim: int, kind: str) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error)."""
    sent = rows.sparkSession.sparkContext.broadcast(model)  # d x components

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        vectors, k = m.scaled(), len(m.values)
        for frame in sliced(frames):
            x = matrix(frame.column("x"), dim)
            y = (x - m.mean) @ vectors
            again = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays(
                [
                    frame.column("vec_id").take(pa.array(again)), pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()),
                    pa.array(np.full(len(again), m.n)), pa.array(deviations(x, m.n, m.total), pa.int64()).take(pa.array(again)),
                    pa.array(y.ravel()), pa.array(np.tile(m.values / m.trace, len(x))), pa.array(np.full(len(again), m.error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, schema_of(kind))


def schema_of(kind: str) -> str:
    return f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, most: int = COMPONENTS, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every usable vector.

    A component c becomes floor(64 c) + 1000000. The fit takes each distinct
    vector once. Vectors that are null, empty or hold a null or non-finite
    component take no part; repeated rows and null keys stay as they are; vectors
    of each length have a fit of their own. There are at most ``most`` components
    and only those with an eigenvalue above rounding, so fewer than two distinct
    vectors have none and give no rows. A component beyond 2^52 / 64 counts as
    that; a deviation beyond 64 bits is null.
    """
    spark, kind = vectors.sparkSession, vectors.schema[key].dataType.simpleString()
    scratch = Scratch(spark, "whitening")

    def whole(c):
        c = F.floor(F.greatest(F.least(F.lit(SCALE) * c.cast("double"), F.lit(LARGEST)), F.lit(-LARGEST)))
        return c.cast("long") + SHIFT

    good = vectors.where(usable(F.col(vector)) & (F.size(vector) > 0))
    rows = good.select(F.col(key).alias("vec_id"), F.transform(vector, whole).alias("x"))
    fit = scratch.save(rows.select("x").distinct(), "fit")
    sizes = sorted(r[0] for r in fit.select(F.size("x")).distinct().collect())  # one row per length
    out = []
    for dim in sizes:
        model = learn(fit.where(F.size("x") == dim), dim, most, scratch)
        if len(model.values):
            out.append(applied(rows.where(F.size("x") == dim), model, dim, kind))
    scratch.drop("fit")
    return reduce(DataFrame.union, out) if out else spark.createDataFrame([], schema_of(kind))
