"""Ranked lexical search over FP-trees of documents.

Only the terms of the items matter, so every document becomes a vector over them
(with its whole length). A task sorts the vectors of some thousand documents, the
terms of each ordered by document frequency, so that documents with common
prefixes share a path of a trie: a node is a run of sorted documents. Every node
knows the largest tf of every term below it and the smallest m, which bound the
score of any document below. Each item searches the trie depth first, best bound
first, and leaves out what cannot reach its k-th best score; bounds are integers
made by the score's own formula, so nothing is lost to rounding. The bars are kept
from trie to trie of a task.

Items come in blocks of bounded text, each sent to all tasks; a block's documents
are scored against all of its items together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netobs.llm.bytewords import TERM, flat, spans, word_hashes
from netobs.llm.common import Scratch, batches, lean

ITEM_BYTES = 1 << 20  # of item texts in a block, about
DOCS, LEAF = 8192, 32  # documents of a trie; a node with more than LEAF of them is split
CELLS = 1 << 23  # nodes x terms of a trie
SALTS = 32
NONE = (1 << 63) - 1  # in place of a null id while sorting

BILLION = 1_000_000_000


def terms_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every term of the texts, in order."""
    data, edges = flat(texts)
    starts, ends, doc = spans(data, edges, TERM)
    return doc, word_hashes(data, starts, ends, lower=True)


def ranges(groups: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(groups, np.arange(n + 1))


def binaries(flat_values: np.ndarray, edges: np.ndarray) -> pa.Array:
    offsets = pa.py_buffer((edges * flat_values.itemsize).astype(np.int64))
    body = pa.py_buffer(np.ascontiguousarray(flat_values))
    return pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, offsets, body]).cast(pa.binary())


def vectors(docs: DataFrame, vocabulary: np.ndarray, key: str, text: str) -> DataFrame:
    """(doc_id, n, terms, tfs): all terms counted in ``n``, those of the sorted vocabulary listed by position."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)  # the terms of one block of items

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for frame in frames:
            for part in batches(frame):
                doc, hashes = terms_of(part.column("t"))
                n = np.bincount(doc, minlength=len(part))
                at = np.searchsorted(known, hashes)
                at[at == len(known)] = 0
                hit = known[at] == hashes if len(known) else np.zeros(len(hashes), bool)
                cells, tf = np.unique(doc[hit] * max(1, len(known)) + at[hit], return_counts=True)
                edges = ranges(cells // max(1, len(known)), len(part))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), pa.array(n, pa.int64()),
                        binaries((cells % max(1, len(known))).astype(np.uint32), edges), binaries(tf.astype(np.int64), edges),
                    ],
                    names=["doc_id", "n", "terms", "tfs"],
                )

    slim = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("t"))
    return slim.mapInArrow(lean(run), "doc_id long, n long, terms binary, tfs binary")


def frequencies(found: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each term of a vocabulary of ``size``: at most so many rows come to the driver."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for frame in frames:
            for x in frame.column("terms"):
                total[np.frombuffer(x.as_buffer(), np.uint32)] += 1  # a document has a term once
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "df"])

    rows = found.where("length(terms) > 0").select("terms").mapInArrow(lean(run), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toPandas()
    out = np.zeros(size, np.int64)
    out[rows["term"].to_numpy(np.int64)] = rows["df"].to_numpy(np.int64)
    return out


def weight(df: int, documents: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def part_of(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The factor of a term's weight in a score; grows with tf, falls with m, under a million."""
    return (BILLION * tf) // (1000 * tf + 12 * m)


class Trie:
    """Sorted documents of one task and the nodes over them.

    ``ranks``, ``tf`` hold the vectors one after another, ``edges`` where each
    begins; ranks stand for terms, 0 the most frequent. Node 0 is the root, the
    children of a node are ``kids[node]``, a range.
    """

    def __init__(self, ids: np.ndarray, m: np.ndarray, ranks: list[np.ndarray], tf: list[np.ndarray], terms: int):
        order = []
        for i, r in enumerate(ranks):
            by = np.argsort(r)
            ranks[i], tf[i] = r[by], tf[i][by]
        paths = [r.astype(">u4").tobytes() for r in ranks]  # compare like the sequences of ranks
        order = sorted(range(len(paths)), key=paths.__getitem__)
        self.ids, self.m = ids[order], m[order]
        self.ranks = np.concatenate([ranks[i] for i in order])
        tfs = np.concatenate([tf[i] for i in order])
        size = np.array([len(ranks[i]) for i in order])
        self.edges = np.concatenate([[0], np.cumsum(size)])
        self.part = part_of(tfs, np.repeat(self.m, size))
        leaf = LEAF
        while True:
            self.split(leaf)
            if len(self.low) * terms <= CELLS or len(self.low) == 1:
                break
            leaf *= 2
        owner = np.repeat(self.leaf_of, size)
        most = np.zeros((len(self.low), terms), np.int64)
        np.maximum.at(most, (owner, self.ranks), tfs)
        least = np.array([self.m[a:b].min() for a, b in zip(self.low, self.high, strict=True)])
        for node in range(len(self.low) - 1, -1, -1):  # children have larger numbers
            a, b = self.kids[node]
            if b > a:
                most[node] = most[a:b].max(axis=0)
        self.bounds = part_of(most, least[:, None]).astype(np.int32)

    def split(self, leaf: int) -> None:
        """Nodes of more than ``leaf`` documents get children by their next term; small children in a row share a leaf."""
        n = len(self.ids)
        self.low, self.high, self.kids = [0], [n], [(0, 0)]
        self.leaf_of = np.zeros(n, np.int64)
        at = 0
        while at < len(self.low):
            lo, hi = self.low[at], self.high[at]
            depth = self.common(lo, hi - 1)
            first = self.edges[lo:hi] + depth
            ended = first >= self.edges[lo + 1 : hi + 1]
            if hi - lo <= leaf or ended.all():
                self.leaf_of[lo:hi] = at
            else:
                step = np.where(ended, -1, self.ranks[np.minimum(first, len(self.ranks) - 1)].astype(np.int64))
                cuts = [lo, *(lo + 1 + np.flatnonzero(np.diff(step))), hi]
                begin = len(self.low)
                held = lo
                for a, b in zip(cuts, cuts[1:], strict=False):
                    if b - a > leaf or b - held > leaf:
                        if a > held:
                            self.add(held, a)
                        held = a
                    if b - a > leaf:
                        self.add(a, b)
                        held = b
                if hi > held:
                    self.add(held, hi)
                self.kids[at] = (begin, len(self.low))
            at += 1

    def add(self, lo: int, hi: int) -> None:
        self.low.append(int(lo))
        self.high.append(int(hi))
        self.kids.append((0, 0))

    def common(self, i: int, j: int) -> int:
        """Length of the path that two documents share, and so all between them."""
        a, b = self.ranks[self.edges[i] : self.edges[i + 1]], self.ranks[self.edges[j] : self.edges[j + 1]]
        n = min(len(a), len(b))
        unlike = np.flatnonzero(a[:n] != b[:n])
        return int(unlike[0]) if len(unlike) else n

    def search(self, ranks: np.ndarray, weights: np.ndarray, dense: np.ndarray, best: "Best") -> None:
        """Offer to ``best`` all documents that may be among an item's; ``dense`` holds its weights by rank."""
        stack = [(int(self.bounds[0][ranks] @ weights), 0)]
        while stack:
            bound, node = stack.pop()
            if bound < best.bar:
                continue
            a, b = self.kids[node]
            if b > a:
                under = self.bounds[a:b][:, ranks] @ weights
                for i in np.argsort(under, kind="stable"):
                    if under[i] >= best.bar:
                        stack.append((int(under[i]), a + int(i)))
            else:
                lo, hi = self.low[node], self.high[node]
                e = self.edges[lo]
                some = slice(e, self.edges[hi])
                score = np.add.reduceat(dense[self.ranks[some]] * self.part[some], self.edges[lo:hi] - e)
                best.offer(score, self.ids[lo:hi])


class Best:
    """The k best (score, id) so far; ``bar`` is what a new one must reach."""

    def __init__(self, k: int):
        self.k, self.bar = k, 1
        self.score, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def offer(self, score: np.ndarray, ids: np.ndarray) -> None:
        good = score >= self.bar
        if not good.any():
            return
        score, ids = np.concatenate([self.score, score[good]]), np.concatenate([self.ids, ids[good]])
        top = np.lexsort((ids, -score))[: self.k]
        self.score, self.ids = score[top], ids[top]
        if len(top) == self.k:
            self.bar = int(self.score[-1])


def items_of(rows: list, key: str, text: str) -> tuple[list, list[tuple[np.ndarray, np.ndarray]]]:
    """Ids of items and the hashes of their terms with how often each occurs."""
    doc, hashes = terms_of(pa.array([r[text] for r in rows], pa.string()))
    edges = ranges(doc, len(rows))
    return [r[key] for r in rows], [np.unique(hashes[a:b], return_counts=True) for a, b in zip(edges, edges[1:], strict=False)]


def searched(found: DataFrame, items: list, rank_of: np.ndarray, weights: np.ndarray, documents: int, length: int, k: int) -> DataFrame:
    """(item, doc_id, score): the k best documents of each task for each item (ranks, counts)."""
    sent = found.sparkSession.sparkContext.broadcast((items, rank_of, weights))  # one block of items

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, ranks, w = sent.value
        best = [Best(k) for _ in wanted]
        dense = np.zeros(len(w), np.int64)

        def search(rows: list[pa.RecordBatch]) -> None:
            columns = {c: [x for r in rows for x in r.column(c)] for c in ("terms", "tfs")}
            ids = np.concatenate([r.column("doc_id").fill_null(NONE).to_numpy() for r in rows])
            n = np.concatenate([r.column("n").to_numpy() for r in rows])
            m = np.array([75 + 25 * int(x) * documents // length for x in n], np.int64)
            trie = Trie(
                ids, m, [ranks[np.frombuffer(x.as_buffer(), np.uint32)] for x in columns["terms"]],
                [np.frombuffer(x.as_buffer(), np.int64) for x in columns["tfs"]], len(w),
            )
            for (terms, counts), b in zip(wanted, best, strict=True):
                if len(terms):
                    mine = counts * w[terms]
                    dense[terms] = mine
                    trie.search(terms, mine, dense, b)
                    dense[terms] = 0

        most = max(LEAF, min(DOCS, CELLS * LEAF // max(1, len(w)) // 4))
        held: list[pa.RecordBatch] = []
        for frame in frames:
            while len(frame):
                free = most - sum(map(len, held))
                held.append(frame.slice(0, free))
                frame = frame.slice(free)
                if sum(map(len, held)) == most:
                    search(held)
                    held = []
        if held:
            search(held)
        number = np.repeat(np.arange(len(best)), [len(b.ids) for b in best])
        ids = np.concatenate([b.ids for b in best]) if best else np.zeros(0, np.int64)
        score = np.concatenate([b.score for b in best]) if best else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(number, pa.int64()), pa.array(ids, pa.int64(), mask=ids == NONE), pa.array(score, pa.int64())], names=["item", "doc_id", "score"]
        )

    return found.where("length(terms) > 0").mapInArrow(lean(run), "item long, doc_id long, score long")


def ranked(hits: DataFrame, k: int) -> DataFrame:
    """The k best of each item, first of some tasks, then of all, so that no step sees all tasks' rows of an item at once."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    hits = hits.withColumn("salt", F.spark_partition_id() % SALTS)
    some = hits.withColumn("rank", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).where(F.col("rank") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k).drop("salt")


def search(
    docs: DataFrame, items: DataFrame, k: int = 20, key: str = "doc_id", text: str = "text",
    item_key: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every item, with a score above 0.

    Terms are runs of ASCII letters, digits and characters beyond ASCII, A-Z
    lower-cased, told apart by 64-bit hashes. Ties go to the smaller id, a null id
    last; repeated documents rank each on its own. Null and empty texts have no
    terms: such documents are not counted and such items have no rows. Rows of
    ``items`` that agree in key and text are one item; different texts under one
    key are ranked apart.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "fp-search")
    kind = items.schema[item_key].dataType.simpleString()
    asked = items.where(F.octet_length(item_text) > 0).select(F.col(item_key).alias("item_id"), F.col(item_text).alias("t")).distinct()
    asked = scratch.save(asked, "items")
    size = asked.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-size // ITEM_BYTES))
    paths = []
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item_id", "t"), F.lit(blocks)) == block).collect()  # about ITEM_BYTES of text
        ids, counted = items_of(rows, "item_id", "t")
        vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *(h for h, _ in counted)]))
        found = scratch.save(vectors(docs, vocabulary, key, text), f"vectors{block}")
        documents, length = found.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = frequencies(found, len(vocabulary))
        rank_of = np.empty(len(df), np.int64)
        rank_of[np.argsort(-df, kind="stable")] = np.arange(len(df))
        weights = np.zeros(len(df), np.int64)
        weights[rank_of] = [weight(int(x), documents) for x in df]
        wanted = [(rank_of[np.searchsorted(vocabulary, h)], c.astype(np.int64)) for h, c in counted]
        hits = scratch.save(searched(found, wanted, rank_of, weights, documents, length, k), f"hits{block}")
        names = spark.createDataFrame(list(enumerate(ids)), f"item long, item_id {kind}")
        scratch.save(ranked(hits, k).join(names, "item").select("item_id", "rank", "doc_id", "score"), f"ranked{block}")
        scratch.drop(f"vectors{block}", f"hits{block}")
        paths.append(scratch.path(f"ranked{block}"))
    return spark.read.schema(f"item_id {kind}, rank int, doc_id long, score long").parquet(*paths)
