"""Near-duplicate components by a chosen-path set similarity join.

A document's set is its distinct word shingles. Documents with equal sets are one
node. Every node has ``COORDINATES`` minwise tokens. A tree branches the nodes by
selected tokens: nodes that agree in a selected token share a branch. Branches
with few nodes to compare are compared exhaustively, larger ones select further
tokens and branch again. ``TREES`` independent trees, with ``BRANCHES`` tokens selected at
each step, give the recall: a pair of similarity 0.8 is missed by one tree with a
probability of 0.04 at the first step and under 0.08 at any depth, by all six
trees with 4e-9 and under 3e-7.

Only components are wanted, so pairs that are already connected are left alone.
Nodes of large branches are compared with one centre each first, those it leaves
apart with the other centres of their branches (stars: linear, however large the
branch). What then stays apart is compared inside a task, branch by branch, and
what a pair connects is known to the pairs after it; a task gives only pairs that
connect something, fewer than it has nodes. Where few members stay outside a very
large branch's largest component, each of them is compared with every member,
which is linear too; one with many of them branches again, which splits the unlike.
Full sets are looked at in the tasks that compare, pairs that sketches leave no
doubt about first. Clusters of up to ``CLUSTER`` nodes that the sketches connect
are one branch then, so their sets move once.
Sketches of the tokens turn pairs away (a pair of similarity 0.8 with a
probability of 1e-8, by the finer sketches of nodes that passed the first);
every link is confirmed on the full sets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netobs.llm import common
from netobs.llm.common import Scratch, batches, components, gathered, lean, spanning

COORDINATES, TREES, BRANCHES = 64, 6, 2
FULL, WORK = 1 << 16, 1 << 25  # a task compares a branch exhaustively up to this size and so many comparisons
CLUSTER = 1 << 10  # branches up to this size need no star, clusters up to it no trees
SMALL = 32  # larger branches with up to so many nodes outside their largest component are compared by a join
LEVELS = 16  # further steps; what is still large then is compared exhaustively too
PERCENT = 80
SKETCH = 0.5  # share of equal tokens under which a pair is turned away
FINE, FINE_SKETCH = 512, 0.7  # the same for longer sketches, of one byte a token, of nodes that may have links
SURE = 0.84  # share of equal tokens of the longer sketches from which a pair is nearly always a link
SIEVE = 1 << 23  # bits of the fixed-size filter over wanted documents

ODD = np.random.default_rng(20240229).integers(0, 1 << 63, (2, 72 + FINE), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text.

    Words are runs without white space, A-Z lower-cased. A text with fewer words
    than ``width`` is one shingle, one without words has none.
    """
    words = [t.encode().lower().split() if t else [] for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    flat = np.empty(int(sizes.sum()), object)
    flat[:] = [w for ws in words for w in ws]
    codes, distinct = pd.factorize(flat)
    hashed = pd.util.hash_array(np.asarray(distinct, object), categorize=False)[codes] if len(flat) else np.zeros(0, np.uint64)
    padded = np.concatenate([hashed, np.zeros(width, np.uint64)])
    rolled = sum(padded[i : i + len(hashed)] * ODD[0, i] for i in range(width)) if len(hashed) else hashed
    rolled = mixed(rolled)
    out, at = [], 0
    for size in sizes:
        if size >= width:
            out.append(np.unique(rolled[at : at + size - width + 1]))
        elif size:
            short = (hashed[at : at + size] * ODD[1, :size]).sum(dtype=np.uint64) + np.uint64(size)
            out.append(mixed(np.array([short], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += size
    return out


def minwise(sets: list[np.ndarray], first: int, n: int) -> np.ndarray:
    """The ``n`` minwise tokens from number ``first`` on, a row per set; 0 for an empty one."""
    sizes = np.array([len(x) for x in sets], np.int64)
    full = np.flatnonzero(sizes)
    tokens = np.zeros((len(sets), n), np.uint32)
    if len(full):
        flat = np.concatenate([sets[i] for i in full])
        starts = np.cumsum(sizes[full]) - sizes[full]
        for c in range(n):
            turned = (flat * ODD[0, first + c] + ODD[1, first + c]) >> np.uint64(32)
            tokens[full, c] = np.minimum.reduceat(turned.astype(np.uint32), starts)
    return tokens


def described(docs: DataFrame, width: int, key: str, text: str) -> DataFrame:
    """(doc_id, n, print, tokens) per row: set size, fingerprint of the set, minwise tokens."""
    kind = docs.schema[key].dataType

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for part in batches(frame):
                sets = shingle_sets(part.column("t").to_pylist(), width)
                sizes = np.array([len(x) for x in sets], np.int64)
                tokens = minwise(sets, 4, COORDINATES).view(np.int32)
                prints = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), pa.array(sizes), pa.array(prints, pa.binary()),
                        pa.ListArray.from_arrays(np.arange(0, tokens.size + 1, COORDINATES, dtype=np.int32), tokens.ravel()),
                    ],
                    names=["doc_id", "n", "print", "tokens"],
                )

    slim = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("t"))
    return slim.mapInArrow(lean(run), f"doc_id {kind.simpleString()}, n long, print binary, tokens array<int>")


def sieve_of(ids: DataFrame) -> np.ndarray:
    """A bit table of fixed size over the ids: at most ``SIEVE`` / 64 rows come to the driver."""
    slot = slot_of(F.col("doc_id"))
    bits = ids.select(F.shiftright(slot, 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int")).alias("b"))
    rows = bits.groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    table = np.zeros(SIEVE // 64, np.int64)
    table[rows["w"].to_numpy()] = rows["b"].to_numpy()
    return table.view(np.uint64)


def slot_of(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SIEVE))


def full_sets(docs: DataFrame, wanted: DataFrame, width: int, key: str, text: str) -> DataFrame:
    """(node, set, fine) of the wanted nodes (node, print, doc_id), made again from the texts.

    A bit table of fixed size lets most other documents go before anything is
    hashed or shuffled.
    """
    sieve = sieve_of(wanted)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            slot = frame.column("slot").to_numpy(zero_copy_only=False).astype(np.uint64)
            hit = (sieve[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1)
            for part in batches(frame.filter(pa.array(hit.astype(bool)))):
                made = shingle_sets(part.column("t").to_pylist(), width)
                fine = [x.tobytes() for x in minwise(made, 4 + COORDINATES, FINE).astype(np.uint8)]
                sets = [x.tobytes() for x in made]
                prints = [hashlib.blake2b(x, digest_size=16).digest() for x in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(x, pa.binary()) for x in (prints, sets, fine))],
                    names=["doc_id", "print", "set", "fine"],
                )

    slim = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("doc_id"), F.col(text).alias("t"))
    kind = docs.schema[key].dataType.simpleString()
    made = slim.withColumn("slot", slot_of(F.col("doc_id"))).mapInArrow(lean(run), f"doc_id {kind}, print binary, set binary, fine binary")
    joined = made.join(wanted.select("node", "print", "doc_id"), ["doc_id", "print"])
    return joined.groupBy("node").agg(F.first("set").alias("set"), F.first("fine").alias("fine"))  # repeated rows are equal


def first_branches(nodes: DataFrame) -> DataFrame:
    """(branch, node) of all trees' first step."""
    chosen = F.posexplode(F.slice("tokens", 1, TREES * BRANCHES)).alias("at", "token")
    return nodes.select("node", chosen).select(F.xxhash64("at", "token").alias("branch"), "node")


def next_branches(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(branch, node) one step on: every branch selects further tokens of its own."""
    rows = rows.select("branch", "node", F.explode(F.sequence(F.lit(0), F.lit(BRANCHES - 1))).alias("turn"))
    at = F.pmod(F.xxhash64("branch", "turn"), F.lit(COORDINATES)).cast("int")
    joined = rows.join(nodes.select("node", "tokens"), "node")
    return joined.select(F.xxhash64("branch", "turn", F.element_at("tokens", at + 1)).alias("branch"), "node")


def sketches(column: pa.Array) -> np.ndarray:
    """A sketch per row: the tokens, or the bytes of the finer ones."""
    if pa.types.is_list(column.type):
        return np.asarray(column.flatten()).reshape(-1, COORDINATES)
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, FINE)


def alike(a: np.ndarray, b: np.ndarray, least: float | None = None) -> np.ndarray:
    """Pairs of rows of sketches that aren't turned away."""
    return (a == b).mean(axis=1) >= (least or (FINE_SKETCH if a.shape[1] == FINE else SKETCH))


def finest(nodes: DataFrame) -> str:
    return "fine" if "fine" in nodes.columns else "tokens"


def sketched(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) that sizes and sketches don't turn away."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            a, b = (sketches(frame.column(x)) for x in ("ta", "tb"))
            out = pa.RecordBatch.from_arrays([frame.column("a"), frame.column("b")], names=["a", "b"])
            yield out.filter(pa.array(alike(a, b)))

    one = nodes.select(F.col("node").alias("a"), F.col(finest(nodes)).alias("ta"), F.col("n").alias("na"))
    two = nodes.select(F.col("node").alias("b"), F.col(finest(nodes)).alias("tb"), F.col("n").alias("nb"))
    pairs = edges.join(one, "a").join(two, "b")
    pairs = pairs.where(100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb"))
    return pairs.select("a", "b", "ta", "tb").mapInArrow(lean(run), "a long, b long")


def renamed(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The components of rows once (a, b) are connected."""
    ids, low = spanning(a, b)  # nodes of their own keep their names
    at = np.minimum(np.searchsorted(ids, root), len(ids) - 1)
    return np.where(ids[at] == root, low[at], root)


def similar(x: bytes, y: bytes) -> bool:
    """Two full sets have the wanted similarity."""
    p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    common = len(np.intersect1d(p, q, assume_unique=True))
    return 100 * common >= PERCENT * (len(p) + len(q) - common)


def linked(root: np.ndarray, at: np.ndarray, step: int, sets: np.ndarray) -> np.ndarray:
    """Rows of ``at`` that their full sets link with the row ``step`` on, but those that the ones before connect."""
    of: dict[int, int] = {}

    def top(x: int) -> int:
        while x in of:
            x = of[x]
        return x

    kept = []
    for i, x, y in zip(at.tolist(), root[at].tolist(), root[at + step].tolist(), strict=True):
        x, y = top(x), top(y)
        if x != y and similar(sets[i], sets[i + step]):
            of[max(x, y)] = min(x, y)
            kept.append(i)
    return np.array(kept, np.int64)


def within(rows: DataFrame, nodes: DataFrame, sets: DataFrame | None) -> DataFrame:
    """Pairs (a, b) that connect what is linked but apart in each branch (branch, node, root).

    Links are decided by sketches, with ``sets`` by full sets after them. A
    branch's rows come one after the other; row i is compared with row i + 1 of
    all branches at once, then with row i + 2, and so on.
    """
    columns = ["branch", "node", "root", "n", "sketch", *([] if sets is None else ["set"])]

    def pairs(held: dict[str, np.ndarray]) -> pa.RecordBatch:
        branch, node, root, n, sketch = (held[x] for x in columns[:5])
        starts = np.concatenate([[0], np.flatnonzero(np.diff(branch)) + 1])
        sizes = np.diff([*starts, len(branch)])
        end = np.repeat(np.cumsum(sizes), sizes)  # of each row's branch

        def still(left: np.ndarray) -> np.ndarray:
            """Those rows whose branches hold more than one component by now."""
            return left[np.repeat(np.minimum.reduceat(root, starts) != np.maximum.reduceat(root, starts), sizes)[left]] if len(left) else left

        ups, downs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for least in (None,) if "set" not in held else (SURE, None):
            left, step = still(np.arange(len(branch))), 1
            while len(left := left[left + step < end[left]]):
                at = left[root[left] != root[left + step]]
                low, high = np.minimum(n[at], n[at + step]), np.maximum(n[at], n[at + step])
                at = at[100 * low >= PERCENT * high]
                at = at[alike(sketch[at], sketch[at + step], least)]
                if "set" in held:
                    at = linked(root, at, step, held["set"])
                if len(at):
                    ups.append(node[at])
                    downs.append(node[at + step])
                    root = renamed(root, root[at], root[at + step])
                    left = still(left)
                step += 1
        ids, low = spanning(np.concatenate(ups), np.concatenate(downs))
        return pa.RecordBatch.from_arrays([pa.array(x[ids != low]) for x in (ids, low)], names=["a", "b"])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None
        for frame in frames:
            if not frame.num_rows:
                continue
            new = {x: frame.column(x).to_numpy(zero_copy_only=False) for x in columns if x != "sketch"}
            new["sketch"] = sketches(frame.column("sketch"))
            if held is not None:
                new = {x: np.concatenate([held[x], new[x]]) for x in new}
            cut = int(np.searchsorted(new["branch"] == new["branch"][-1], True))  # the last branch may go on
            yield pairs({x: v[:cut] for x, v in new.items()})
            held = {x: v[cut:] for x, v in new.items()}
        if held is not None:
            yield pairs(held)

    wide = rows.select("branch", "node", "root").join(nodes.select("node", "n", F.col(finest(nodes)).alias("sketch")), "node")
    wide = wide if sets is None else wide.join(sets.select("node", "set"), "node")
    return wide.select(*columns).repartition("branch").sortWithinPartitions("branch", "node").mapInArrow(lean(run), "a long, b long")


def confirmed(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            keep = [similar(x.as_buffer(), y.as_buffer()) for x, y in zip(frame.column("sa"), frame.column("sb"), strict=True)]
            out = pa.RecordBatch.from_arrays([frame.column("a"), frame.column("b")], names=["a", "b"])
            yield out.filter(pa.array(keep, pa.bool_()))

    one = sets.select(F.col("node").alias("a"), F.col("set").alias("sa"))
    two = sets.select(F.col("node").alias("b"), F.col("set").alias("sb"))
    return edges.join(one, "a").join(two, "b").select("a", "b", "sa", "sb").mapInArrow(lean(run), "a long, b long")


def whole_size() -> int:
    """Up to which size a branch is always compared inside one task."""
    return min(CLUSTER, FULL, math.isqrt(WORK))


class Linker:
    """Links nodes and keeps the components they make (``roots``: node, root)."""

    def __init__(self, nodes: DataFrame, scratch: Scratch, label: str, sets: DataFrame | None = None):
        self.nodes, self.scratch, self.label, self.sets, self.turn, self.known = nodes, scratch, label, sets, 0, 0
        empty = nodes.limit(0)
        self.roots = empty.select("node", F.col("node").alias("root"))

    def name(self) -> str:
        self.turn += 1
        return f"{self.label}{self.turn}"

    def rooted(self, rows: DataFrame, node: str = "node", root: str = "root") -> DataFrame:
        roots = self.roots.select(F.col("node").alias(node), F.col("root").alias("_r"))
        return rows.join(roots, node, "left").withColumn(root, F.coalesce("_r", node)).drop("_r")

    def apart(self, edges: DataFrame) -> DataFrame:
        """The edges between different components."""
        return self.rooted(self.rooted(edges, "a", "ra"), "b", "rb").where("ra <> rb").drop("ra", "rb")

    def take(self, edges: DataFrame) -> None:
        """Link the pairs that the sketches left: as they are, or after a look at their full sets."""
        self.link(edges if self.sets is None else confirmed(edges, self.sets))

    def link(self, pairs: DataFrame) -> None:
        found = self.scratch.save(pairs, self.name())
        n = found.count()
        if n:
            self.add(found, n)
            self.known = self.roots.count()

    def add(self, found: DataFrame, n: int) -> None:
        """Connect the components that the ``n`` found pairs (a, b) join; few of both are connected in one task."""
        if self.known + n <= common.FEW_EDGES:
            hung = self.roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
            self.roots = self.scratch.save(gathered(hung.union(found.select("a", "b"))), self.name())
            return
        joined = self.rooted(self.rooted(found, "a", "ra"), "b", "rb").where("ra <> rb")
        made = components(joined.select(F.col("ra").alias("a"), F.col("rb").alias("b")), self.scratch, self.name() + "_")
        made = made.select(F.col("node").alias("root"), F.col("root").alias("top"))
        moved = self.roots.join(made, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
        # Roots of earlier components are among their nodes; the others are new.
        fresh = made.join(self.roots, made["root"] == self.roots["node"], "left_anti").select(F.col("root").alias("node"), F.col("top").alias("root"))
        self.roots = self.scratch.save(moved.union(fresh), self.name())

    def run(self, rows: DataFrame) -> None:
        """Walk the trees from their first branches (branch, node) on."""
        for level in range(LEVELS + 1):
            rows = self.scratch.save(self.crowded(rows), self.name())
            if rows.isEmpty():
                return
            self.stars(rows.where(F.col("members") > whole_size()), level)
            rows = self.scratch.save(self.open(rows), self.name())
            if rows.isEmpty():
                return
            size, odd = F.col("members"), F.col("odd")
            sure = (size <= FULL) & (size * size <= WORK)
            self.link(within(rows.where(sure), self.nodes, self.sets))
            rows = rows.where(~sure)
            if rows.isEmpty():
                return
            rows = self.scratch.save(self.weighed(rows), self.name())
            fits = (size <= FULL) & (size * odd <= WORK)
            few = F.lit(True) if level == LEVELS else odd <= SMALL
            if not rows.where(fits).isEmpty():
                self.link(within(rows.where(fits), self.nodes, self.sets))
            rows = rows.where(~fits)
            if not rows.where(few).isEmpty():
                self.take(sketched(self.odd_pairs(rows.where(few)), self.nodes))
            rows = rows.where(~few)
            if rows.isEmpty():
                return
            rows = self.scratch.save(next_branches(rows.select("branch", "node"), self.nodes), self.name())

    def stars(self, rows: DataFrame, level: int) -> None:
        """Compare the nodes of branches with the branches' centres, the one centre that comes first for each node before the others."""
        if rows.isEmpty():
            return
        # One order of the nodes for all branches of a step, another in each step: few different centres.
        first = rows.groupBy("branch").agg(F.min(F.struct(F.xxhash64("node", F.lit(level)), "node")).alias("c"))
        centres = rows.join(first, "branch").groupBy(F.col("node").alias("a")).agg(F.sort_array(F.collect_set("c")).alias("c"))
        stars = self.scratch.save(centres.select("a", F.col("c.node").alias("c")), self.name())
        one = stars.select("a", F.element_at("c", 1).alias("b")).where("a <> b")
        self.take(sketched(self.apart(one) if level else one, self.nodes))
        rest = stars.where(F.size("c") > 1).select("a", F.explode(F.slice("c", F.lit(2), F.size("c") - 1)).alias("b")).where("a <> b")
        if not rest.isEmpty():
            self.take(sketched(self.apart(rest), self.nodes))

    def crowded(self, rows: DataFrame) -> DataFrame:
        """Rows (branch, node, members) of the branches with at least two nodes; ``rows`` hold a pair once."""
        return rows.join(rows.groupBy("branch").agg(F.count("*").alias("members")).where("members > 1"), "branch")

    def open(self, rows: DataFrame) -> DataFrame:
        """Rows (branch, node, members, root) of the branches that hold more than one component."""
        rows = self.rooted(rows)
        if self.known:  # stored, or the join with the roots runs for both uses
            rows = self.scratch.save(rows, self.name())
        seen = rows.groupBy("branch").agg(F.min("root").alias("low"), F.max("root").alias("high"))
        return rows.join(seen.where("low <> high").select("branch"), "branch")

    def weighed(self, rows: DataFrame) -> DataFrame:
        """Rows of open branches as they are by now, with ``main``, the branch's largest component, and ``odd``, the number of nodes outside it."""
        rows = self.rooted(rows.drop("root"))
        sizes = rows.groupBy("branch", "root").agg(F.count("*").alias("c"))
        seen = sizes.groupBy("branch").agg(F.max(F.struct("c", "root")).alias("m"), F.sum("c").alias("size"))
        seen = seen.select("branch", F.col("m.root").alias("main"), (F.col("size") - F.col("m.c")).alias("odd"))
        return rows.join(seen.where("odd > 0"), "branch")

    def odd_pairs(self, rows: DataFrame) -> DataFrame:
        """All pairs of a branch between different components: nodes outside the largest one against every node."""
        odd = rows.where("root <> main").select("branch", F.col("node").alias("x"), F.col("root").alias("rx"))
        pairs = odd.join(rows.select("branch", "node", "root"), "branch").where("rx <> root")
        return pairs.select(F.greatest("x", "node").alias("a"), F.least("x", "node").alias("b")).distinct()


def near_components(docs: DataFrame, width: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, print) for every row of ``docs``.

    ``component_id`` is the smallest key reachable over links of similarity 0.8
    or more. A row without shingles (null or blank text) is linked with nothing
    and is a component of its own; so is a row with a null key, whose
    ``component_id`` is null and which is kept. Rows that share a key are one
    document in two states: both carry their component.
    """
    scratch = Scratch(docs.sparkSession, "chosenpath")
    rows = scratch.save(described(docs, width, key, text), "rows")
    linked = rows.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    grouped = linked.groupBy("print").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("tokens").alias("tokens"))
    nodes = scratch.save(grouped.withColumn("node", F.monotonically_increasing_id()), "nodes")
    trees = scratch.save(first_branches(nodes), "trees")
    # By sketches: which nodes may be linked with anything, and in which clusters.
    rough = Linker(nodes, scratch, "rough")
    rough.run(trees)
    wanted = scratch.save(nodes.join(rough.roots, "node"), "wanted")
    exact = None
    if not wanted.isEmpty():
        sets = scratch.save(full_sets(docs, wanted, width, key, text), "sets")
        exact = Linker(scratch.save(wanted.drop("root").join(sets.select("node", "fine"), "node"), "fine"), scratch, "exact", sets)
        few = wanted.groupBy("root").count().withColumn("few", F.col("count") <= whole_size()).drop("count")
        inside = wanted.select("node", "root").join(few, "root")
        split = trees.join(inside.where("NOT few"), "node").select(F.xxhash64("branch", "root").alias("branch"), "node")
        exact.run(inside.where("few").select(F.xxhash64("root").alias("branch"), "node").union(split))
    roots = (exact or rough).roots.select("node", "root")
    named = nodes.select("node", "print", "doc_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = scratch.save(named.join(smallest, "root").select("print", "component_id"), "named")
    out = rows.drop("tokens").join(named, "print", "left")
    own = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    out = out.withColumn("component_id", own)
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"), F.col("print").alias("print", metadata={"width": width}))


def with_print(docs: DataFrame, width: int, key: str, text: str) -> DataFrame:
    """(row, key, print): whole rows with the fingerprints of their sets."""
    slim = docs.select(F.struct("*").alias("row"), F.col(key).alias("key"), F.col(text).alias("t"))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for part in batches(frame):
                sets = shingle_sets(part.column("t").to_pylist(), width)
                prints = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets]
                columns = [part.column("row"), part.column("key"), pa.array(prints, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "key", "print"])

    return slim.mapInArrow(lean(run), slim.drop("t").withColumn("print", F.lit(None).cast("binary")).schema)


def keep_one(docs: DataFrame, decided: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: one document of each component, with its columns; ``decided`` is from ``near_components``.

    Where rows that share a key are decided differently, each goes by its own
    shingles; only the texts of such rows are read again.
    """
    states = decided.groupBy(F.col("doc_id").alias("gone")).agg(F.max("kept").alias("some"), F.min("kept").alias("every"))
    rows = docs.select(F.struct("*").alias("row"), F.col(key).alias("key"))
    left = rows.join(states.where("NOT every"), F.col("key") == F.col("gone"), "left_anti").select("row.*")
    mixed = states.where("some AND NOT every").select(F.col("gone").alias("mixed"))
    if mixed.isEmpty():
        return left
    again = docs.join(mixed, F.col(key) == F.col("mixed"), "left_semi")
    again = with_print(again, decided.schema["print"].metadata["width"], key, text)
    out = decided.where("NOT kept").select(F.col("doc_id").alias("gone"), F.col("print").alias("its")).distinct()
    some = again.join(out, (F.col("key") == F.col("gone")) & (F.col("print") == F.col("its")), "left_anti")
    return left.union(some.select("row.*"))
