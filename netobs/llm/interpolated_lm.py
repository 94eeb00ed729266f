"""Language-model scores by deleted interpolation of bigrams, unigrams and a uniform floor.

P(w | h) = l2 * c(hw)/c(h) + l1 * c(w)/N + l0 / (V + 1), where the weights depend
on the bucket (power of two) of the context's count c(h). The weights are learned
by expectation-maximisation on a held-out fold of the training documents against
the counts of the others; the scores then use the counts of all of them. The
context of a text's first word is the end of a text.

The counts cover the whole corpus and never come to one place. Documents are
gathered in chunks, each with its own small vocabulary. A chunk asks for the
counts of its distinct n-grams: requests go to buckets of the key's hash range,
each bucket adds up what the chunks contribute and answers every chunk in the
order it asked. An n-gram that is everywhere is one key per chunk. The number of
buckets follows the number of keys, so no bucket grows with the corpus.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from netobs.llm.common import Scratch, lean

CHUNK_TOKENS = 1 << 20
BUCKET_KEYS = 1 << 20  # distinct keys of chunks that one bucket adds up
MAIN, HELD, OTHER = 0, 1, 2  # counted for the weights' model; held out for the weights; not learned from
CONTEXTS = 64  # buckets of context counts, by power of two
STEPS = 4  # cells per octave in the histogram of held-out probabilities
END = b""  # no word is empty


def squeezed(a: np.ndarray) -> bytes:
    """Numbers as byte planes, compressed: sorted keys and small counts shrink well."""
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T) if len(a) else np.zeros(0, np.uint8)
    return len(a).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def spread(data: bytes, dtype) -> np.ndarray:
    n, size = int.from_bytes(data[:8], "little"), np.dtype(dtype).itemsize
    if not n:
        return np.zeros(0, dtype)
    planes = np.frombuffer(pa.decompress(data[8:], n * size, "zstd", asbytes=True), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(dtype).reshape(n)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def chunks(docs: DataFrame, role: Column, key: str, text: str) -> DataFrame:
    """(chunk, role, ids, sizes, tokens, words, n_words, n_pairs): documents of one role as word numbers.

    ``sizes`` are tokens per document with its end, ``words`` the 64-bit hashes of
    the chunk's vocabulary, the end first.
    """
    kind = docs.schema[key].dataType.simpleString()
    shape = StructType.fromDDL(
        f"chunk long, role int, ids array<{kind}>, sizes binary, tokens binary, words binary, n_words long, n_pairs long"
    )
    arrow = to_arrow_schema(shape)

    class Open:
        def __init__(self):
            self.ids: list = []
            self.sizes, self.tokens = array("q"), array("i")
            self.slot: dict[bytes, int] = {END: 0}

        def row(self, chunk: int, role: int) -> pa.RecordBatch:
            words = list(self.slot)
            hashes = pd.util.hash_array(np.array(words, object), categorize=False)
            tokens = np.frombuffer(self.tokens, np.int32)
            before = np.concatenate([[0], tokens[:-1]]).astype(np.int64)
            n_pairs = len(np.unique(before * len(words) + tokens))
            values = [chunk, role, self.ids, squeezed(np.frombuffer(self.sizes, np.int64)), squeezed(tokens), squeezed(hashes), len(words), n_pairs]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, arrow, strict=True)], schema=arrow)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 24
        opened = {r: Open() for r in (MAIN, HELD, OTHER)}
        for frame in frames:
            for k, r, body in zip(frame.column("k").to_pylist(), frame.column("r").to_pylist(), frame.column("t"), strict=True):
                words = (body.as_py() or "").encode().lower().split()
                now = opened[r]
                slot = now.slot
                now.tokens.extend([slot.setdefault(w, len(slot)) for w in words])
                now.tokens.append(0)
                now.ids.append(k)
                now.sizes.append(len(words) + 1)
                if len(now.tokens) >= CHUNK_TOKENS:
                    yield now.row(chunk, r)
                    chunk, opened[r] = chunk + 1, Open()
        for r, now in opened.items():
            if now.ids:
                yield now.row(chunk, r)
                chunk += 1

    slim = docs.select(F.col(key).alias("k"), role.cast("int").alias("r"), F.col(text).alias("t"))
    return slim.mapInArrow(lean(run), shape)


class Chunk:
    """A chunk's tokens with its distinct words and pairs, both in the order of their keys."""

    def __init__(self, tokens: bytes, words: bytes):
        self.tokens, hashes = spread(tokens, np.int32), spread(words, np.uint64)
        self.word_order = np.argsort(hashes, kind="stable")
        self.word_keys = hashes[self.word_order]
        before = np.concatenate([[0], self.tokens[:-1]]).astype(np.int64)
        codes, self.pair = np.unique(before * len(hashes) + self.tokens, return_inverse=True)
        self.before, self.after = codes // len(hashes), codes % len(hashes)
        keys = mixed(hashes[self.before] * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[self.after])
        self.pair_order = np.argsort(keys, kind="stable")
        self.pair_keys = keys[self.pair_order]

    def asked(self, pairs: bool) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys and how often the chunk has each."""
        if pairs:
            return self.pair_keys, np.bincount(self.pair, minlength=len(self.pair_keys))[self.pair_order]
        return self.word_keys, np.bincount(self.tokens, minlength=len(self.word_keys))[self.word_order]

    def answered(self, answers: pd.DataFrame, pairs: bool) -> tuple[np.ndarray, np.ndarray]:
        """Counts in the main and the held-out part, by word or pair number."""
        rows = answers[answers["pairs"] == pairs].sort_values("bucket")
        order = self.pair_order if pairs else self.word_order
        out = []
        for name in ("main", "held"):
            got = np.zeros(len(order), np.int64)
            got[order] = np.concatenate([spread(x, np.int64) for x in rows[name]])
            out.append(got)
        return out[0], out[1]


def counted(made: DataFrame, pairs: bool) -> DataFrame:
    """Answers (chunk, bucket, pairs, main, held) and, with chunk -1, each bucket's sums."""
    column = "n_pairs" if pairs else "n_words"
    total = made.agg(F.sum(column)).first()[0] or 0
    bits = max(3, int(total // BUCKET_KEYS).bit_length())

    def ask(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for row in frame.to_pylist():
                keys, n = Chunk(row["tokens"], row["words"]).asked(pairs)
                edges = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
                edges = [*edges, len(keys)]
                parts = [(b, x, y) for b, (x, y) in enumerate(zip(edges, edges[1:], strict=False)) if y > x]
                yield pa.RecordBatch.from_pydict({
                    "bucket": pa.array([b for b, _, _ in parts], pa.int32()), "chunk": [row["chunk"]] * len(parts),
                    "role": pa.array([row["role"]] * len(parts), pa.int32()),
                    "keys": pa.array([squeezed(keys[x:y]) for _, x, y in parts], pa.binary()),
                    "n": pa.array([squeezed(n[x:y]) for _, x, y in parts], pa.binary()),
                })

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        keys = [spread(x, np.uint64) for x in rows["keys"]]
        sizes = np.array([len(x) for x in keys])
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.concatenate([spread(x, np.int64) for x in rows["n"]])
        role = np.repeat(rows["role"].to_numpy(), sizes)
        main, held = (np.bincount(at, np.where(role == r, n, 0), len(distinct)).astype(np.int64) for r in (MAIN, HELD))
        cuts = np.cumsum(sizes)[:-1]
        out = pd.DataFrame({
            "chunk": rows["chunk"].to_numpy(), "bucket": rows["bucket"].to_numpy(), "pairs": pairs,
            "main": [squeezed(main[x]) for x in np.split(at, cuts)], "held": [squeezed(held[x]) for x in np.split(at, cuts)],
        })
        sums = {"n_main": main.sum(), "n_held": held.sum(), "v_main": (main > 0).sum(), "v_all": (main + held > 0).sum()}
        last = pd.DataFrame([{"chunk": -1, "bucket": int(rows["bucket"].iloc[0]), "pairs": pairs, **sums}])
        out = pd.concat([out, last], ignore_index=True)
        return out.astype({name: "Int64" for name in sums}).astype(object).where(out.notna(), None)

    asked = made.select("chunk", "role", "tokens", "words").mapInArrow(lean(ask), "bucket int, chunk long, role int, keys binary, n binary")
    return asked.groupBy("bucket").applyInPandas(
        answer, "chunk long, bucket int, pairs boolean, main binary, held binary, n_main long, n_held long, v_main long, v_all long"
    )


def contexts(count: np.ndarray) -> np.ndarray:
    """Bucket of a context's count: 0 for a new context, then by powers of two."""
    return np.where(count > 0, 1 + np.log2(np.maximum(count, 1)).astype(np.int64), 0)


def orders(chunk: Chunk, words: np.ndarray, pairs: np.ndarray, total: int, kinds: int):
    """For each distinct pair of the chunk: context bucket and the three estimates."""
    context = words[chunk.before]
    p2 = np.divide(pairs, context, out=np.zeros(len(pairs)), where=context > 0)
    return contexts(context), p2, words[chunk.after] / max(total, 1), 1.0 / (kinds + 1)


def cells(made: DataFrame, answers: DataFrame, total: int, kinds: int) -> DataFrame:
    """Histogram (context, cell2, cell1, n) of the held-out pairs; -1 stands for probability 0.

    At most CONTEXTS x (STEPS x 64)^2 cells however large the corpus, far fewer in fact.
    """

    def run(rows: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in rows.itertuples():
            chunk = Chunk(row.tokens, row.words)
            words, pairs = chunk.answered(got, False)[0], chunk.answered(got, True)[0]
            context, p2, p1, p0 = orders(chunk, words, pairs, total, kinds)
            with np.errstate(divide="ignore"):
                cell2, cell1 = (np.where(p > 0, np.rint(STEPS * -np.log2(p)), -1).astype(np.int64) for p in (p2, p1))
            n = np.bincount(chunk.pair, minlength=len(pairs))
            out.append(pd.DataFrame({"context": context, "cell2": cell2, "cell1": cell1, "n": n}))
        return pd.concat(out).groupby(["context", "cell2", "cell1"], as_index=False).sum()

    both = made.groupBy("chunk").cogroup(answers.groupBy("chunk"))
    found = both.applyInPandas(run, "context long, cell2 long, cell1 long, n long")
    return found.groupBy("context", "cell2", "cell1").agg(F.sum("n").alias("n"))


def learned_weights(histogram: pd.DataFrame, p0: float, rounds: int = 200) -> np.ndarray:
    """Weights (l2, l1, l0) per context bucket by expectation-maximisation.

    Every bucket also sees the pooled weights with the weight of ten tokens, so
    no weight is 0 and buckets without held-out data have weights too. A new
    context has no bigram estimate, and its bucket no l2.
    """

    def fit(rows: pd.DataFrame, prior: np.ndarray) -> np.ndarray:
        p = np.stack([np.where(rows["cell2"] < 0, 0, 2.0 ** (-rows["cell2"] / STEPS)),
                      np.where(rows["cell1"] < 0, 0, 2.0 ** (-rows["cell1"] / STEPS)),
                      np.full(len(rows), p0)], axis=1)
        n, now = rows["n"].to_numpy(float), prior
        for _ in range(rounds):
            share = p * now
            share *= (n / share.sum(axis=1))[:, None]
            now = share.sum(axis=0) + 10 * prior
            now /= now.sum()
        return now

    pooled = fit(histogram, np.full(3, 1 / 3))
    table = np.tile(pooled, (CONTEXTS, 1))
    for context, rows in histogram.groupby("context"):
        if context:
            table[int(context)] = fit(rows, pooled)
    low = np.array([0, pooled[1], pooled[2]]) / (pooled[1] + pooled[2])
    fresh = histogram[histogram["context"] == 0]
    table[0] = fit(fresh, low) if len(fresh) else low
    return table


def score(docs: DataFrame, role: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, role, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    ``role`` says what a row is for: MAIN and HELD rows are learned from, OTHER
    rows are only scored. Words are the runs without white space, A-Z lower-cased;
    the end of the text counts as a token, so a null or empty text has one. With
    nothing to learn from, all probability is the unknown word's and scores are 0.
    """
    scratch = Scratch(docs.sparkSession, "lm")
    made = scratch.save(chunks(docs, role, key, text), "chunks")
    answers = scratch.save(counted(made, False), "words").union(scratch.save(counted(made, True), "pairs"))
    sums = answers.where("chunk = -1 AND NOT pairs").agg(*[F.sum(x).alias(x) for x in ("n_main", "n_held", "v_main", "v_all")]).first()
    n_main, n_held, v_main, v_all = (int(x or 0) for x in sums)
    total = n_main + n_held
    answers = answers.where("chunk <> -1").select("chunk", "bucket", "pairs", "main", "held")
    held = made.where(F.col("role") == HELD).select("chunk", "tokens", "words")
    histogram = cells(held, answers.join(held.select("chunk"), "chunk", "left_semi"), n_main, v_main).toPandas()
    weights = learned_weights(histogram, 1.0 / (v_main + 1)) if total else np.tile([0.0, 0.0, 1.0], (CONTEXTS, 1))
    kind = docs.schema[key].dataType.simpleString()

    def run(rows: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in rows.itertuples():
            chunk = Chunk(row.tokens, row.words)
            words, pairs = sum(chunk.answered(got, False)), sum(chunk.answered(got, True))
            context, p2, p1, p0 = orders(chunk, words, pairs, total, v_all)
            w = weights[context]
            logs = np.log10(w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] * p0)[chunk.pair]
            base = np.log10((words + 1) / (total + v_all + 1))[chunk.tokens]
            sizes = spread(row.sizes, np.int64)
            first = np.cumsum(sizes) - sizes
            out.append(pd.DataFrame({
                "doc_id": list(row.ids), "role": row.role, "n_tokens": sizes,
                "n_known": np.add.reduceat((words > 0)[chunk.tokens].astype(np.int64), first), "train_tokens": total,
                "base_score": np.add.reduceat(base, first), "score": np.add.reduceat(logs, first),
            }))
        return pd.concat(out) if out else pd.DataFrame(columns=names)

    names = ["doc_id", "role", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    both = made.groupBy("chunk").cogroup(answers.groupBy("chunk"))
    return both.applyInPandas(
        run, f"doc_id {kind}, role int, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
