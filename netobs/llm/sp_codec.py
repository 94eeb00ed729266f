"""SentencePiece encoding and decoding by a batched Viterbi over a public vocabulary.

A text's ids are those of the segmentation with the highest sum of piece scores.
No piece continues behind a word start, so words are segmented on their own, and
words of equal length advance together: at every end position the substring keys
of all of them probe the sorted piece keys, and vectorised maxima store how the
best segmentation got there. Of equal sums the longer last piece wins. A
character outside the vocabulary costs ten more than the worst piece and becomes
the pieces of its UTF-8 bytes.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netobs.llm.common import batches, lean
from netobs.llm.id_cache import IdCache
from netobs.llm.pieces import SPACE, Lattice, Pieces, pieces_of, same_length

UNKNOWN = 10.0  # how much worse than the worst piece
WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def split_words(text: str) -> list[str]:
    """The words of a text with their word-start signs; together they are the text with a leading space."""
    return WORDS.findall(SPACE + text.replace(" ", SPACE)) if text else []


def viterbi(pieces: Pieces, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words, flat in their order, and how many each has."""
    ids: list[np.ndarray | None] = [None] * len(words)
    floor = pieces.scores.min() - UNKNOWN
    for length, at, group in same_length(words, 1 << 18):
        lattice, n = Lattice(pieces, group, length), len(group)
        best = np.full((length + 1, n), -np.inf)
        best[0] = 0
        size_of = np.ones((length + 1, n), np.int32)
        id_of = np.full((length + 1, n), -1, np.int32)
        for end in range(1, length + 1):
            single = np.zeros(n, bool)
            for size, rows, where in lattice.ending(end):
                score = best[end - size, rows] + pieces.scores[where]
                win = score > best[end, rows]
                rows, where = rows[win], where[win]
                best[end, rows], size_of[end, rows], id_of[end, rows] = score[win], size, pieces.ids[where]
                if size == 1:
                    single[rows] = True
            if length and not single.all():
                lone = np.flatnonzero(best[end - 1] + floor > best[end])
                best[end, lone], size_of[end, lone], id_of[end, lone] = best[end - 1, lone] + floor, 1, -1
        pos, row = np.full(n, length), np.arange(n)
        steps = []
        while (live := pos > 0).any():
            step = np.where(live, id_of[pos, row], -2)
            steps.append((step, pos.copy()))
            pos = np.where(live, pos - size_of[pos, row], 0)
        got = np.stack([s for s, _ in steps[::-1]], axis=1) if steps else np.zeros((n, 0), np.int32)
        ends = np.stack([p for _, p in steps[::-1]], axis=1) if steps else got
        unknown = (got == -1).any(axis=1)
        for i, word in enumerate(group):
            line = got[i]
            if unknown[i]:
                line = np.concatenate([
                    pieces.bytes[np.frombuffer(word[p - 1].encode(), np.uint8)] if x == -1 else [x]
                    for x, p in zip(line, ends[i], strict=True)
                ])
            ids[at[i]] = line[line >= 0]
    size = np.array([len(x) for x in ids], np.int64)
    return (np.concatenate(ids).astype(np.uint32) if len(ids) else np.zeros(0, np.uint32)), size


class Codec:
    """Encoder and decoder of one vocabulary, for texts in batches."""

    def __init__(self, path: str):
        self.pieces = pieces_of(path)
        self.cache = IdCache(lambda words: viterbi(self.pieces, words))
        written = [x.replace(SPACE, " ").encode() for x in self.pieces.text]
        for value, piece in enumerate(self.pieces.bytes):
            if piece >= 0:
                written[piece] = bytes([value])
        self.size = np.array([len(x) for x in written], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(written), np.uint8)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return self.cache.encode([split_words(t) for t in texts])

    def decode(self, ids: np.ndarray) -> str:
        size = self.size[ids]
        first = np.repeat(self.start[ids] - (np.cumsum(size) - size), size)
        text = self.flat[first + np.arange(len(first))].tobytes().decode("utf-8", "replace")
        return text.removeprefix(" ")


@lru_cache(maxsize=2)
def codec_of(path: str) -> Codec:
    """One copy for each Python worker."""
    return Codec(path)


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids) for every row; a null or empty text has no ids."""
    kind = docs.schema[key].dataType.simpleString()

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path)
        for frame in frames:
            for part in batches(frame):
                ids = codec.encode([t or "" for t in part.column("t").to_pylist()])
                edges = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([part.column("k"), pa.ListArray.from_arrays(edges, flat)], names=["doc_id", "ids"])

    slim = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return slim.mapInArrow(lean(run), f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """(doc_id, text, n_pieces, ids_crc32) for rows of (doc_id, ids)."""
    kind = encoded.schema[key].dataType.simpleString()

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path)
        for frame in frames:
            ids = [np.asarray(x.values, np.uint32) if x.is_valid else np.zeros(0, np.uint32) for x in frame.column("ids")]
            yield pa.RecordBatch.from_arrays(
                [
                    frame.column("k"), pa.array([codec.decode(x) for x in ids], pa.string()),
                    pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                ],
                names=["doc_id", "text", "n_pieces", "ids_crc32"],
            )

    slim = encoded.select(F.col(key).alias("k"), "ids")
    return slim.mapInArrow(lean(run), f"doc_id {kind}, text string, n_pieces long, ids_crc32 long")
