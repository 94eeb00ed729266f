"""Substring deduplication by fixed-block anchors.

A repeat is a run of ``window`` words that stands in two places. Of any such run
the first place holds one block of ``(window + 1) / 2`` words whose position in
its document is a multiple of that size, whole. So the non-overlapping blocks are
the reference, every rolling window of a block's size probes them, and a block
that some other place answers is an anchor. Anchors are extended: every window of
full size around them, at most half a window to each side, is confirmed by a
digest, and confirmed windows that touch are joined to maximal repeats.

No pairs are made. Probes meet by value in buckets of hashes, each task sends a
value once, and a bucket answers each sender which of its values live; a run with
a million copies costs what a million different runs cost.

Texts are written once, bucketed by chunk (some megabytes of documents), and stay
where they are: only hashes move. A probe has 32 bits besides those of its bucket,
which only decides what is looked at further; a digest has 64 bits and those of
its bucket.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from netobs.llm.bytewords import NOT_WHITE, OTHER_BASE, WORD_BASE, flat, spans, window_hashes, word_hashes
from netobs.llm.common import Scratch, batches, lean

WINDOW = 35
CHUNK, CHUNK_ROWS = 4 << 20, 1 << 16  # bytes and documents of a chunk, one document at least
PROBES = 4 << 20  # bytes of text whose probes share a bucket
BUCKET, BUCKETS = 16 << 20, 50_000  # bytes of text in a bucket of the stored table, and most buckets (chunks of one are read in turn)
LOW = np.uint64(32)


def chunked(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(chunk, doc_id, t): documents as they come, in chunks that no task shares."""
    kind = docs.schema[key].dataType.simpleString()

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held, rows = TaskContext.get().partitionId() << 20, 0, 0
        for frame in frames:
            for part in batches(frame, CHUNK // 4):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), chunk)), part.column("k"), part.column("t")], names=["chunk", "doc_id", "t"])
                held, rows = held + part.column("t").nbytes, rows + len(part)
                if held >= CHUNK or rows >= CHUNK_ROWS:
                    chunk, held, rows = chunk + 1, 0, 0

    slim = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    return slim.mapInArrow(lean(run), f"chunk long, doc_id {kind}, t string")


def stored(texts: DataFrame, scratch: Scratch, size: int) -> DataFrame:
    """The chunks as a table bucketed by chunk, so that what is grouped by chunk later need not move them."""
    name = f"netobs_{uuid.uuid4().hex}"
    buckets = min(max(1, -(-size // BUCKET)), BUCKETS)
    writer = texts.write.option("compression", "zstd").option("path", scratch.path("texts"))
    writer.bucketBy(buckets, "chunk").saveAsTable(name)
    return texts.sparkSession.table(name)


class Words:
    """Word hashes of the texts of a chunk, and where windows fit."""

    def __init__(self, texts: pa.Array):
        self.data, self.edges = flat(texts)
        starts, ends, self.doc = spans(self.data, self.edges, NOT_WHITE)
        self.hashes = word_hashes(self.data, starts, ends)
        self.count = np.bincount(self.doc, minlength=len(texts))
        self.first = np.cumsum(self.count) - self.count  # the first word of each document

    def windows(self, width: int, base: int = WORD_BASE) -> tuple[np.ndarray, np.ndarray]:
        """First words and hashes of all windows that lie in one document."""
        found = window_hashes(self.hashes, width, base)
        fits = np.flatnonzero(self.doc[: len(found)] == self.doc[width - 1 :]) if len(found) else np.zeros(0, np.int64)
        return fits, found[fits]

    def at_block(self, words: np.ndarray, block: int) -> np.ndarray:
        return (words - self.first[self.doc[words]]) % block == 0


def probe_keys(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket (upper half) and 32 bits of a hash, which the bucket does not depend on."""
    return (((hashes >> LOW) * np.uint64(buckets)) >> LOW << LOW) | (hashes & np.uint64(0xFFFFFFFF))


def by_bucket(bucket: np.ndarray, values: np.ndarray, flags: np.ndarray) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Values (sorted by bucket) and their flags as one binary per bucket."""
    edges = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]]) if len(bucket) else np.zeros(1, np.int64)

    def blobs(x: np.ndarray) -> pa.Array:
        offsets = pa.py_buffer((edges * x.itemsize).astype(np.int64))
        return pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, offsets, pa.py_buffer(np.ascontiguousarray(x))]).cast(pa.binary())

    return pa.array(bucket[edges[:-1]].astype(np.int64)), blobs(values), blobs(flags)


SENT = "chunk long, bucket long, vals binary, flags binary"
IS_BLOCK, AGAIN = 1, 2


def sent(chunk: int, bucket: np.ndarray, values: np.ndarray, flags: np.ndarray) -> pa.RecordBatch:
    number, a, b = by_bucket(bucket, values, flags)
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(number), chunk)), number, a, b], names=["chunk", "bucket", "vals", "flags"])


def in_chunks(frame: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Rows of each chunk in slices of bounded size."""
    chunk = frame.column("chunk").to_numpy()
    edges = [0, *(np.flatnonzero(np.diff(chunk)) + 1), len(chunk)]
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            for part in batches(frame.slice(a, b - a), CHUNK):
                yield int(chunk[a]), part


def probes(texts: DataFrame, window: int, buckets: int) -> DataFrame:
    """Every rolling window of a block's size, once for each chunk, those at a block's place flagged."""
    block = (window + 1) // 2

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for chunk, part in in_chunks(frame):
                words = Words(part.column("t"))
                at, hashes = words.windows(block)
                long = words.count[words.doc[at]] >= window  # shorter documents have no run to repeat
                at, keys = at[long], probe_keys(hashes[long], buckets)
                order = np.argsort(keys)
                at, keys = at[order], keys[order]
                new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
                if not len(new):
                    continue
                flags = np.bitwise_or.reduceat(np.where(words.at_block(at, block), IS_BLOCK, 0).astype(np.uint8), new)
                flags |= np.where(np.diff(np.append(new, len(keys))) > 1, AGAIN, 0).astype(np.uint8)
                keys = keys[new]
                yield sent(chunk, keys >> LOW, keys.astype(np.uint32), flags)

    return texts.select("chunk", "t").mapInArrow(lean(run), SENT)


def shared_values(table: DataFrame, kind: type, only: int) -> DataFrame:
    """(chunk, bucket, vals): of each sender's values those that occur twice at all, for values where some sender set the flag ``only``.

    With ``only``, senders hear of the values that they flagged themselves.
    """

    def run(frame: pa.Table) -> pa.Table:
        frame = frame.combine_chunks()
        blobs = [np.frombuffer(x.as_buffer(), kind) for x in frame["vals"]]
        sizes = np.array([len(x) for x in blobs], np.int64)
        values = np.concatenate(blobs)
        flags = np.concatenate([np.frombuffer(x.as_buffer(), np.uint8) for x in frame["flags"]])
        order = np.argsort(values, kind="stable")
        ranked = values[order]
        new = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        size, any_flag = np.diff(np.append(new, len(ranked))), np.bitwise_or.reduceat(flags[order], new)
        lives = (size > 1) | (any_flag & AGAIN > 0)
        if only:
            lives &= any_flag & only > 0
        kept = np.empty(len(values), bool)
        kept[order] = np.repeat(lives, size)
        if only:
            kept &= flags & only > 0
        edges = np.concatenate([[0], np.cumsum(sizes)])
        out = [values[a:b][kept[a:b]].tobytes() for a, b in zip(edges, edges[1:], strict=False)]
        some = [i for i, x in enumerate(out) if x]
        senders = frame.select(["chunk", "bucket"]).take(pa.array(some, pa.int64()))
        return senders.append_column("vals", pa.array([out[i] for i in some], pa.binary()))

    return table.groupBy("bucket").applyInArrow(run, "chunk long, bucket long, vals binary")


def told(table: pa.Table, kind: type) -> np.ndarray:
    """The values a chunk was told of, with their bucket in the upper half where they have 32 bits."""
    if not len(table):
        return np.zeros(0, np.uint64)
    blobs = [np.frombuffer(x.as_buffer(), kind) for x in table["vals"].combine_chunks()]
    values = np.concatenate(blobs).astype(np.uint64)
    if kind is np.uint32:
        values |= np.repeat(table["bucket"].to_numpy().astype(np.uint64) << LOW, [len(x) for x in blobs])
    return np.sort(values)


def among(values: np.ndarray, ranked: np.ndarray) -> np.ndarray:
    if not len(ranked):
        return np.zeros(len(values), bool)
    at = np.searchsorted(ranked, values)
    at[at == len(ranked)] = 0
    return ranked[at] == values


def around(words: Words, anchors: np.ndarray, window: int) -> np.ndarray:
    """First words of all windows that hold an anchor, a block's first word, and lie in its document."""
    reach = window - (window + 1) // 2
    doc = words.doc[anchors]
    low = np.maximum(anchors - reach, words.first[doc])
    high = np.minimum(anchors, words.first[doc] + words.count[doc] - window)
    step = np.zeros(len(words.hashes) + 1, np.int64)
    some = high >= low
    np.add.at(step, low[some], 1)
    np.add.at(step, high[some] + 1, -1)
    return np.flatnonzero(np.cumsum(step)[:-1] > 0)


def digests(texts: DataFrame, live: DataFrame, window: int, buckets: int) -> DataFrame:
    """Digests of the windows around the anchors, once for each chunk."""
    block = (window + 1) // 2

    def run(body: pa.Table, answer: pa.Table) -> pa.Table:
        known = told(answer, np.uint32)
        out = []
        if len(body) and len(known):
            words = Words(body["t"].combine_chunks())
            at, hashes = words.windows(block)
            own = words.at_block(at, block)
            at, hashes = at[own], hashes[own]
            starts = around(words, at[among(probe_keys(hashes, buckets), known)], window)
            if len(starts):
                value = window_hashes(words.hashes, window)[starts]
                bucket = (window_hashes(words.hashes, window, OTHER_BASE)[starts] >> LOW) * np.uint64(buckets) >> LOW
                order = np.lexsort((value, bucket))
                value, bucket = value[order], bucket[order]
                new = np.flatnonzero(np.concatenate([[True], (value[1:] != value[:-1]) | (bucket[1:] != bucket[:-1])]))
                flags = np.where(np.diff(np.append(new, len(value))) > 1, AGAIN, 0).astype(np.uint8)
                out.append(sent(int(body["chunk"][0].as_py()), bucket[new], value[new], flags))
        return pa.Table.from_batches(out, SHAPE)

    return texts.select("chunk", "t").groupBy("chunk").cogroup(live.groupBy("chunk")).applyInArrow(run, SENT)


SHAPE = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("vals", pa.binary()), ("flags", pa.binary())])


def runs(mask: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first, end) of the maximal runs of true words, counted from their document's first word."""
    padded = np.concatenate([[False], mask, [False]])
    first, end = np.flatnonzero(padded[1:] & ~padded[:-1]), np.flatnonzero(padded[:-1] & ~padded[1:])
    # A run goes on over a document's edge where the next one starts covered too.
    cuts = words.first[(words.count > 0)]
    cuts = cuts[(cuts > 0) & (cuts < len(mask))]
    cuts = cuts[mask[cuts] & mask[cuts - 1]]
    first, end = np.sort(np.concatenate([first, cuts])), np.sort(np.concatenate([end, cuts]))
    doc = words.doc[first]
    return doc, first - words.first[doc], end - words.first[doc]


def marked(texts: DataFrame, repeats: DataFrame, window: int, kind: str) -> DataFrame:
    """(doc_id, n_words, repeats, kept) of every document."""
    shape = StructType.fromDDL(f"doc_id {kind}, n_words long, repeats array<struct<first: long, end: long>>, kept string")
    arrow = to_arrow_schema(shape)

    def run(body: pa.Table, answer: pa.Table) -> pa.Table:
        if not len(body):
            return arrow.empty_table()
        known = told(answer, np.uint64)
        column = body["t"].combine_chunks()
        words = Words(column)
        covered = np.zeros(len(words.hashes), bool)
        if len(known):
            at, value = words.windows(window)
            step = np.zeros(len(covered) + 1, np.int64)
            hit = at[among(value, known)]
            step[hit] += 1  # every first word occurs once
            np.add.at(step, hit + window, -1)
            covered = np.cumsum(step)[:-1] > 0
        doc, first, end = runs(covered, words)
        edges = np.searchsorted(doc, np.arange(len(body) + 1))
        spread = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.StructArray.from_arrays([pa.array(first), pa.array(end)], names=["first", "end"]))
        kept = []
        for i, (a, b) in enumerate(zip(words.edges, words.edges[1:], strict=False)):
            parts = words.data[a:b].tobytes().split()
            for s in range(edges[i + 1] - 1, edges[i] - 1, -1):
                del parts[first[s] : end[s]]
            kept.append(b" ".join(parts).decode())
        columns = [body["doc_id"], pa.array(words.count, pa.int64()), spread.cast(arrow.field("repeats").type), pa.array(kept, arrow.field("kept").type)]
        return pa.Table.from_arrays(columns, schema=arrow)

    pairs = texts.select("chunk", "doc_id", "t").groupBy("chunk").cogroup(repeats.groupBy("chunk"))
    return pairs.applyInArrow(run, shape)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, repeats, kept) for every row of ``docs``.

    Words are runs without white space. ``repeats`` are the maximal runs of words
    (first, end) covered by windows of ``window`` words that also start anywhere
    else, overlapping ones of the same document included; ``kept`` is what is left,
    words joined by one space. Windows are judged on the input: all copies go.
    Null and empty texts have no words; a text shorter than a window is kept whole;
    repeated rows are documents of their own; a null key is one like any other.
    ``window`` is odd.
    """
    if window % 2 == 0 or window < 3:
        raise ValueError("a window has an odd number of words, 3 at least")
    spark = docs.sparkSession
    scratch = Scratch(spark, "anchors")
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(1, -(-size // PROBES))
    texts = stored(chunked(docs, key, text), scratch, size)
    live = scratch.save(shared_values(probes(texts, window, buckets), np.uint32, IS_BLOCK), "live")
    repeats = scratch.save(shared_values(digests(texts, live, window, buckets), np.uint64, 0), "repeats")
    scratch.drop("live")
    return marked(texts, repeats, window, docs.schema[key].dataType.simpleString())
