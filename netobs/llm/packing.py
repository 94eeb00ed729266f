"""Best-fit packing by exact complements.

Only lengths matter for the plan, and there are at most ``capacity`` of them: a
histogram of piece lengths comes to the driver, never the pieces. Starting with
the longest length left, a sequence's gap is filled exactly where that is
possible: by a single length, a pair or a triple whose sum the histogram of
available counts can serve. Where it is not, the best fitting length goes in and
the smaller gap is tried again. A combination is taken as often as the counts
allow, so the plan has a row for each combination, not for each sequence.

The plan numbers the pieces of each length; a piece finds its place by its length
and its number among the pieces of that length. Those numbers come from counts
per bucket, so a length that a third of all pieces have is never in one task.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netobs.llm.common import Scratch, batches, lean
from netobs.llm.id_cache import IdCache

CAPACITY = 2048
BUCKETS = 256  # parts that the pieces of a length are numbered in
WORDS = re.compile(r"[^ \t\n\x0b\x0c\r]+")
NO_SPACE = "\x1c\x1d\x1e\x1f"  # white space to str.split, not to the tokenizer
PLAIN = re.compile(r"[!-&(-~\xa1-\xac\xae-\xff]+")  # Latin-1 without space, apostrophe and controls
UNITS = re.compile(r"[^\W\d_]+|[\W\d_]+")
CACHED_UNITS = 600_000


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """One copy for each Python worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def units(word: str) -> list[str]:
    """Parts of a word that the tokenizer handles apart: runs of letters, and what is between them.

    That is safe without combining marks and without the apostrophe, which can
    bind to letters behind it; words with other characters stay whole.
    """
    return UNITS.findall(word) if PLAIN.fullmatch(word) else [word]


@lru_cache(maxsize=2)
def added_tokens(path: str) -> tuple[str, ...]:
    """The added tokens of the tokenizer file, lower-cased; the tokenizer matches them in raw text."""
    return tuple({t.content.lower() for t in tokenizer(path).get_added_tokens_decoder().values()})


def parts_of(word: str, added: tuple[str, ...]) -> list[str]:
    """What of a word goes to the tokenizer: lower-cased units where that is plain, as the tokenizer lower-cases too.

    A word that holds an added token, in any letter case, goes as it is: the
    match is on raw text, so neither its units nor its lower case give its ids.
    """
    lower = word.lower()
    if any(t in lower for t in added):
        return [word]
    try:
        word.encode("latin-1")
    except UnicodeEncodeError:
        return [word]  # final sigma, dotted I and the like are left to the tokenizer
    return units(lower)


@lru_cache(maxsize=2)
def word_ids(path: str) -> IdCache:
    """Token ids of texts, a word at a time; one cache for each Python worker.

    The tokenizer drops white space and never joins what it separates, so a
    text's ids are those of its words one after the other; no added token may
    hold white space. New words are encoded by their units, most of which other
    words have had before.
    """
    model, added, known = tokenizer(path), added_tokens(path), {}
    if any(len(t.split()) != 1 or t != t.strip() for t in added):
        raise ValueError(f"an added token of {path} holds white space")

    def make(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts = [parts_of(w, added) for w in words]
        wanted = set(chain.from_iterable(parts))
        if len(known) > CACHED_UNITS:
            known.clear()
        new = [u for u in wanted if u not in known]
        ids = [x.ids for x in model.encode_batch_fast(new, add_special_tokens=False)]
        ends = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids))) * 4
        data = np.fromiter(chain.from_iterable(ids), np.uint32, int(ends[-1]) // 4 if len(ids) else 0).tobytes()
        known.update((u, data[a:b]) for u, a, b in zip(new, [0, *ends.tolist()], ends.tolist(), strict=False))
        made = [b"".join([known[u] for u in us]) for us in parts]
        return np.frombuffer(b"".join(made), np.uint32), np.fromiter(map(len, made), np.int64, len(made)) // 4

    return IdCache(make)


def split_words(text: str) -> list[str]:
    """The words of a text as they are."""
    return WORDS.findall(text) if any(c in text for c in NO_SPACE) else text.split()


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every row: its ids and a closing 0, cut at ``capacity``.

    A null text counts as empty: one piece of length 1.
    """
    kind = docs.schema[key].dataType

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = word_ids(path)
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        for frame in frames:
            for part in batches(frame):
                rows: list[tuple] = []
                texts = [split_words(t or "") for t in part.column("t").to_pylist()]
                for k, ids in zip(part.column("k").to_pylist(), model.encode(texts), strict=True):
                    ids = np.append(ids, np.uint32(0)).astype("<u4")
                    for n, start in enumerate(range(0, len(ids), capacity)):
                        piece = ids[start : start + capacity]
                        rows.append((k, n, start, len(piece), zlib.crc32(piece.tobytes())))
                columns = list(zip(*rows, strict=True))
                types = [frame.schema.field("k").type, pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    slim = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return slim.mapInArrow(lean(run), f"doc_id {kind.simpleString()}, piece int, start long, length long, ids_crc32 long")


def combination(gap: int, left: np.ndarray) -> list[int] | None:
    """One to three available lengths that sum to ``gap``, longest first; ``left`` are counts by length."""
    if gap <= 0 or gap >= len(left):
        return None
    if left[gap]:
        return [gap]
    some = left[: gap + 1] > 0
    twice = left[: gap + 1] > 1
    first = np.flatnonzero(some)
    if not len(first):
        return None
    other = gap - first
    fits = (other >= 1) & (other <= first) & some[other] & ((other != first) | twice[other])
    if fits.any():
        a = int(first[fits][-1])
        return [a, gap - a]
    for a in first[::-1]:
        a = int(a)
        if 3 * a < gap:
            return None
        rest = gap - a
        second = first[(first <= a) & (first < rest)]
        third = rest - second
        fits = (third >= 1) & (third <= second) & some[third]
        if fits.any():
            for b in second[fits][::-1]:
                found = [a, int(b), int(rest - b)]
                if all(left[x] >= found.count(x) for x in found):
                    return found
    return None


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """[(times, {length: pieces of it in one sequence})] that uses up all counts.

    ``counts[l]`` is the number of pieces of length l, up to ``capacity``. Each
    entry uses up a length, or leaves fewer of it than one more sequence needs,
    so there are at most about ``capacity`` times log(``capacity``) entries.
    """
    left = counts.copy()
    out = []
    for longest in range(capacity, 0, -1):
        while left[longest]:
            trial, parts, gap = left.copy(), [longest], capacity - longest
            trial[longest] -= 1
            while gap:
                more = combination(gap, trial)
                if more is None:
                    fit = np.flatnonzero(trial[1 : gap + 1])
                    if not len(fit):
                        break
                    more = [int(fit[-1]) + 1]
                for x in more:
                    trial[x] -= 1
                parts += more
                gap -= sum(more)
            need = {x: parts.count(x) for x in dict.fromkeys(parts)}
            times = min(int(left[x]) // n for x, n in need.items())
            for x, n in need.items():
                left[x] -= times * n
            out.append((times, need))
    return out


def places(entries: list[tuple[int, dict[int, int]]], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Where the numbered pieces of each length go: runs by (length, first number), sorted.

    Piece number r of a length, in the run from ``first`` on with ``times``
    sequences, goes to sequence ``base`` + (r - first) % times, at ``offset`` +
    length * ((r - first) // times).
    """
    rows, used, base = [], np.zeros(capacity + 1, np.int64), 0
    for times, need in entries:
        offset = 0
        for length, n in need.items():
            rows.append((length, used[length], times, base, offset))
            used[length] += times * n
            offset += length * n
        base += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return {name: table[:, i] for i, name in enumerate(("length", "first", "times", "base", "offset"))}


def numbered(made: DataFrame) -> DataFrame:
    """Pieces with their number (``rank``) among those of their length."""
    made = made.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(BUCKETS)))
    sizes = made.groupBy("length", "bucket").agg(F.count("*").alias("n"))  # at most capacity x BUCKETS rows
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")
    sizes = sizes.select("length", "bucket", before.alias("before"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = made.withColumn("r", F.row_number().over(inside))
    return ranked.join(sizes, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("r") - 1)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every row."""
    scratch = Scratch(docs.sparkSession, "packing")
    made = scratch.save(pieces(docs, path, capacity, key, text), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for row in made.groupBy("length").count().collect():  # one row per length
        counts[row["length"]] = row["count"]
    where = places(plan(counts, capacity), capacity)
    order = where["length"] * (1 << 50) + where["first"]

    def place(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            length, rank = (frame.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(order, length * (1 << 50) + rank, side="right") - 1
            r, times = rank - where["first"][at], where["times"][at]
            columns = [frame.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            columns += [pa.array(where["base"][at] + r % times), pa.array(where["offset"][at] + length * (r // times))]
            yield pa.RecordBatch.from_arrays(
                columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            )

    kind = docs.schema[key].dataType.simpleString()
    return numbered(made).mapInArrow(
        place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
