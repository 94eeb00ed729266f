"""Exact top-k inner products by columnar branch and bound.

Vectors stand in vertical layout, a row per dimension. Scores are accumulated a
block of dimensions at a time, the dimensions with the most mass first. What the
dimensions still to come can add is at most the product of the two remaining
norms; a candidate whose partial score and that bound stay under the query's k-th
best is dropped, and the survivors are compacted before the next block.

Queries and candidates meet in blocks: each block of queries goes to each block of
candidates. No block grows with the data, only their number does.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK, CANDIDATE_BLOCK = 2048, 8192
DIMENSIONS = 16  # accumulated between two rounds of dropping candidates
GROUP = 256  # queries scored together
EXACT = float(1 << 52)  # integers and their sums below it are exact in double


def usable(vector: Column) -> Column:
    """True for a vector without null or non-finite components (an empty one has none)."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~bad


def best(q: np.ndarray, qrow: np.ndarray, c: np.ndarray, crow: np.ndarray, cid: np.ndarray, k: int) -> pd.DataFrame:
    """The k best candidates of every query in one pair of blocks, rows of integers as doubles."""
    order = np.argsort(-np.square(c).sum(axis=0), kind="stable")
    q, cols = q[:, order], np.ascontiguousarray(c[:, order].T)
    edges = [*range(0, cols.shape[0], DIMENSIONS), cols.shape[0]]
    # Norms of what is left after each block, a little up for rounding.
    left_q = [np.sqrt(np.square(q[:, e:]).sum(axis=1)) * (1 + 1e-9) for e in edges[1:]]
    left_c = [np.sqrt(np.square(cols[e:]).sum(axis=0)) * (1 + 1e-9) for e in edges[1:]]
    seed = min(len(crow), max(4 * k, 512))
    out = []
    for g in range(0, len(qrow), GROUP):
        rows, own = q[g : g + GROUP], qrow[g : g + GROUP]
        first = rows @ cols[:, :seed]
        first[own[:, None] == crow[None, :seed]] = -np.inf
        bar = np.sort(first, axis=1)[:, -k] if seed >= k else np.full(len(own), -np.inf)
        score = rows[:, : edges[1]] @ cols[: edges[1]] if len(edges) > 1 else np.zeros((len(own), len(crow)))
        alive = own[:, None] != crow[None, :]
        if left_q:
            alive &= score + left_q[0][g : g + GROUP, None] * left_c[0][None, :] + 0.5 >= bar[:, None]
        at, to = np.nonzero(alive)
        part = score[at, to]
        for b in range(1, len(edges) - 1):
            for d in range(edges[b], edges[b + 1]):
                part += rows[at, d] * cols[d, to]
            keep = part + left_q[b][g + at] * left_c[b][to] + 0.5 >= bar[at]
            at, to, part = at[keep], to[keep], part[keep]
        rank = np.lexsort((cid[to], -part, at))
        at, to, part = at[rank], to[rank], part[rank]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        top = place < k
        out.append(pd.DataFrame({"query": own[at[top]], "vec_id": cid[to[top]], "score": part[top].astype(np.int64)}))
    return pd.concat(out)


def best_of_large(q: np.ndarray, qrow: np.ndarray, c: np.ndarray, crow: np.ndarray, cid: np.ndarray, k: int) -> pd.DataFrame:
    """The same with Python's integers, for components beyond what doubles add exactly.

    A score outside 64 bits counts as the nearest 64-bit integer.
    """
    whole = np.vectorize(int, otypes=[object])
    c = whole(c) if c.size else c
    rows = []
    for x, own in zip(q, qrow, strict=True):
        scores = c.dot(whole(x)) if x.size else np.zeros(len(cid), object)
        held = [max(-(1 << 63), min((1 << 63) - 1, int(s))) for s in scores]
        others = [(s, i) for s, i, r in zip(held, cid, crow, strict=True) if r != own]
        rows += [(own, i, s) for s, i in sorted(others, key=lambda r: (-r[0], r[1]))[:k]]
    return pd.DataFrame(rows, columns=["query", "vec_id", "score"])


def top_k(vectors: DataFrame, is_query: Column, k: int, scale: float = 256.0, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best candidates of every query, ties to the smaller id.

    Components become floor(scale * x). Vectors that are null or hold a null or
    non-finite component take no part, nor do rows with a null id; vectors of
    different lengths are not compared. A query's own row is not its candidate;
    other rows with its id are, and are queries of their own.
    """
    data = vectors.where(F.col(key).isNotNull() & usable(F.col(vector))).select(
        F.col(key).cast("long").alias("id"), is_query.alias("is_query"), F.size(vector).alias("dim"),
        F.transform(vector, lambda x: F.lit(float(scale)) * x.cast("double")).alias("v"),
        F.monotonically_increasing_id().alias("row"),
    )
    n, nq = data.agg(F.count("*"), F.count(F.when(F.col("is_query"), 1))).first()
    blocks, query_blocks = max(1, -(-n // CANDIDATE_BLOCK)), max(1, -(-nq // QUERY_BLOCK))
    number = F.xxhash64("row")
    queries = data.where("is_query").select(
        "dim", "id", "row", "v", F.pmod(number, F.lit(query_blocks)).alias("q"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("c")
    )
    candidates = data.select(
        "dim", "id", "row", "v", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("q"), F.pmod(number, F.lit(blocks)).alias("c")
    )

    def pair(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({"query": [], "query_id": [], "vec_id": [], "score": []}, dtype="int64")
        dim = int(q["dim"].iloc[0])
        a, b = (np.floor(np.concatenate([*x["v"], np.zeros(0)])).reshape(len(x), dim) for x in (q, c))
        most = np.sqrt(np.square(a).sum(axis=1).max()) * np.sqrt(np.square(b).sum(axis=1).max())
        search = best if most < EXACT else best_of_large
        found = search(a, q["row"].to_numpy(np.int64), b, c["row"].to_numpy(np.int64), c["id"].to_numpy(np.int64), k)
        return found.assign(query_id=found["query"].map(dict(zip(q["row"], q["id"], strict=True))))

    keys = ("dim", "q", "c")
    found = queries.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInPandas(pair, "query long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
