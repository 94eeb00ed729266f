"""Anchored windows: decisions that depend on the decision before, without a scan of the key.

A row becomes an anchor when there is none, or the last one is ``ttl`` or more
older; a reset takes the anchor away. Each decision needs the one before, but
over a slice of time the whole rule is a small function of the anchor that comes
in: which of the slice's first rows is the first anchor, and where the chain from
there ends. So

1. every slice of a key is summed up as that function, all slices at once,
2. a key's functions, one row per slice, are run through in order,
3. every slice marks its anchors, from the one that came in.

Rows are spread by (key, slice), so a key that never rests runs in as many tasks
as there are slices. Inside a task the successors of all rows come from one sorted
search and chains from pointer jumping; no row is handled by itself.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from netobs.plans.slices import SLICE, ordered_scan
from netobs.plans.stage import shared

NONE = -(1 << 62)  # no anchor


def whole_groups(batches: Iterator[pa.RecordBatch], head: str) -> Iterator[pa.Table]:
    """The rows again, cut only where a group begins."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        heads = np.flatnonzero(batch.column(head).to_numpy(zero_copy_only=False))
        if len(heads) and (heads[-1] or held):
            if len(done := [*held, batch.slice(0, heads[-1])]) and sum(map(len, done)):
                yield pa.Table.from_batches(done)
            held = [batch.slice(heads[-1])]
        elif len(batch):
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


class Slices:
    """Rows of some (key, slice) groups and the successor of every row that can be an anchor (``live``)."""

    def __init__(self, table: pa.Table, t: str, reset: str | None, width: int, ttl: int):
        def column(name: str) -> np.ndarray:
            return table[name].combine_chunks().to_numpy(zero_copy_only=False)

        self.heads = np.flatnonzero(column("_head"))
        self.ttl, self.n = ttl, len(table)
        resets = column(reset).astype(bool) if reset else np.zeros(self.n, bool)
        group = np.repeat(np.arange(len(self.heads)), np.diff(np.append(self.heads, self.n)))
        self.begin = column(SLICE).astype(np.int64)[self.heads] * width  # time at which each slice starts
        self.time = column(t).astype(np.int64)
        passed = np.cumsum(resets)
        self.before = passed[self.heads] - resets[self.heads]  # resets up to each group
        self.after = passed[np.append(self.heads[1:], self.n) - 1]
        self.rows = np.flatnonzero(~resets)
        self.group, self.live, self.seen = group[self.rows], self.time[self.rows], passed[self.rows]
        # One sorted line of all groups' times, far enough apart that no search leaves its group by the window.
        self.apart = width + ttl + 2
        self.line = self.group * self.apart + self.live - self.begin[self.group]
        self.end = np.searchsorted(self.group, np.arange(len(self.heads)), side="right")
        self.next = np.minimum(np.searchsorted(self.line, self.line + ttl), np.searchsorted(self.seen, self.seen, side="right"))
        self.next = np.where(self.next >= self.end[self.group], -1, self.next)

    def entries(self, anchors: np.ndarray) -> np.ndarray:
        """The first anchor of each group when ``anchors`` come in; -1 for none."""
        groups = np.arange(len(self.heads))
        need = np.where(anchors == NONE, 0, np.clip(anchors + self.ttl - self.begin, 0, self.apart - 1))
        at = np.minimum(np.searchsorted(self.line, groups * self.apart + need), np.searchsorted(self.seen, self.before, side="right"))
        first = np.searchsorted(self.group, groups)
        return np.where(np.maximum(at, first) >= self.end, -1, np.maximum(at, first))

    def exits(self) -> np.ndarray:
        """The anchor that a group ends with if a row is its first one."""
        last = np.where(self.next < 0, np.arange(len(self.live)), self.next)
        while (further := last[last] != last).any():
            last = np.where(further, last[last], last)
        return np.where(self.seen[last] == self.after[self.group], self.live[last], NONE)

    def functions(self) -> tuple[list, list, np.ndarray, np.ndarray]:
        """For each group: bounds of the first anchor's time and the anchor at the end, the end without such a row, whether a reset is in it."""
        exits = self.exits()
        uppers, ends = [], []
        other = np.full(len(self.heads), NONE)
        later = np.searchsorted(self.seen, self.before, side="right")  # the first row behind a reset
        first = np.searchsorted(self.group, np.arange(len(self.heads)))
        for g, (a, b) in enumerate(zip(first, np.minimum(np.maximum(later, first), self.end), strict=True)):
            if max(later[g], a) < self.end[g]:
                other[g] = exits[max(later[g], a)]
            # No anchor from before the slice can hold back rows beyond its first ttl.
            b = min(b, int(np.searchsorted(self.live[a:b], self.begin[g] + self.ttl)) + a + 1)
            turn = np.flatnonzero(np.append(np.diff(exits[a:b]) != 0, True))[: b - a]
            uppers.append(self.live[a:b][turn].tolist())
            ends.append(exits[a:b][turn].tolist())
        return uppers, ends, other, self.after > self.before

    def marked(self, anchors: np.ndarray) -> np.ndarray:
        """True for the rows that become anchors."""
        out = np.zeros(self.n, bool)
        at = self.entries(anchors)
        at = at[at >= 0]
        while len(at):
            out[self.rows[at]] = True
            at = self.next[at]
            at = at[at >= 0]
        return out


class Through:
    """The anchor that comes into each slice of a key, in order."""

    def __init__(self, ttl: int):
        self.ttl, self.anchor = ttl, NONE

    def __call__(self, uppers: list[int], ends: list[int], other: int, broken: bool) -> int:
        came = self.anchor
        at = 0 if came == NONE else bisect_left(uppers, came + self.ttl)
        if at < len(uppers):
            self.anchor = ends[at]
        elif broken:
            self.anchor = other
        return came


def anchored(
    df: DataFrame, keys: list[str], t: str, ttl: int, out: str, order: tuple[str, ...] = (),
    reset: str | None = None, strict: bool = False, width: int | None = None,
) -> DataFrame:
    """Add boolean ``out``: the row is an anchor of its key.

    ``t`` is a whole number; with ``strict`` an anchor must be more than ``ttl``
    older. ``order`` breaks ties. Null keys are a key like any other.
    """
    ttl, width = ttl + int(strict), width or 64 * max(1, ttl)
    sliced = shared(df.withColumn(SLICE, F.floor(F.col(t) / width)), *keys, SLICE)
    w = Window.partitionBy(*keys, SLICE).orderBy(t, *order)
    headed = sliced.withColumn("_head", F.row_number().over(w) == 1)
    slim = [*keys, SLICE]
    kinds = {f.name: f.dataType.simpleString() for f in headed.schema}

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "_head"):
            part = Slices(table, t, reset, width, ttl)
            uppers, ends, other, broken = part.functions()
            named = table.select(slim).take(pa.array(part.heads)).combine_chunks()
            longs = pa.list_(pa.int64())
            columns = [*named.columns, pa.array(uppers, longs), pa.array(ends, longs), pa.array(other), pa.array(broken)]
            yield from pa.table(columns, names=[*slim, "_uppers", "_ends", "_other", "_broken"]).to_batches()

    shape = ", ".join([*(f"`{c}` {kinds[c]}" for c in slim), "_uppers array<bigint>, _ends array<bigint>, _other bigint, _broken boolean"])
    functions = headed.select(*slim, t, *([reset] if reset else []), "_head").mapInArrow(summed, shape)
    came = ordered_scan(functions, keys, [SLICE], ["_uppers", "_ends", "_other", "_broken"], lambda: Through(ttl), "_came", "long")
    came = came.select(*[F.col(c).alias(f"_of_{c}") for c in slim], "_came")

    same = F.lit(True)
    for c in slim:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    joined = sliced.join(came, same).drop(*[f"_of_{c}" for c in slim])
    joined = joined.withColumn("_head", F.row_number().over(w) == 1)
    names = [*df.columns]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "_head"):
            part = Slices(table, t, reset, width, ttl)
            anchors = table["_came"].combine_chunks().to_numpy(zero_copy_only=False)[part.heads]
            kept = table.select(names).append_column(out, pa.array(part.marked(anchors)))
            yield from kept.combine_chunks().to_batches()

    done = StructType([*df.schema.fields]).add(out, "boolean")
    return joined.mapInArrow(mark, done)
