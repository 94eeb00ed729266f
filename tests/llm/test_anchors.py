"""Substring deduplication against brute force over all windows."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from netobs.llm import anchors, bytewords
from netobs.llm.anchors import remove_repeats
from tests.llm.common import docs, empty, messy

WHITE = " \t\n\x0b\x0c\r"


def words_of(text):
    return (text or "").translate(dict.fromkeys(map(ord, WHITE), " ")).split(" ")


def brute(rows, window):
    """(id, words, covered, kept) of each row, sorted."""
    split = [[w for w in words_of(t) if w] for _, t in rows]
    seen = Counter(tuple(ws[i : i + window]) for ws in split for i in range(len(ws) - window + 1))
    out = []
    for (i, _), ws in zip(rows, split, strict=True):
        gone = [any(seen[tuple(ws[s : s + window])] > 1 for s in range(max(0, k - window + 1), min(k, len(ws) - window) + 1)) for k in range(len(ws))]
        out.append((str(i), len(ws), sum(gone), " ".join(w for w, g in zip(ws, gone, strict=True) if not g)))
    return sorted(out)


def found(frame, window):
    out = []
    for r in remove_repeats(frame, window=window).collect():
        assert all(a.end < b.first for a, b in zip(r.repeats, r.repeats[1:], strict=False))
        out.append((str(r.doc_id), r.n_words, sum(x.end - x.first for x in r.repeats), r.kept))
    return sorted(out)


def corpus(seed, n, window):
    """Random words with passages of all lengths around a window's, at any place, and documents that repeat themselves."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(2000)}"
    passages = [[word() for _ in range(rng.choice([window - 1, window, window + 1, 3 * window]))] for _ in range(12)]
    rows = []
    for i in range(n):
        ws = [word() for _ in range(rng.randrange(0, 4 * window))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(ws) + 1)
            ws[at:at] = rng.choice(passages)
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(ws)))
    rows += [(n, "a b " * window), (n + 1, "x " * (window + 1)), (n + 2, "y " * window), (n + 3, rows[0][1]), (n + 4, rows[0][1])]
    return rows


@pytest.mark.parametrize(("seed", "window"), [(1, 35), (2, 5), (3, 11)])
@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, monkeypatch, seed, window, small):
    if small:  # many chunks and buckets
        monkeypatch.setattr(anchors, "CHUNK", 2000)
        monkeypatch.setattr(anchors, "PROBES", 3000)
        monkeypatch.setattr(anchors, "BUCKET", 9000)
    rows = corpus(seed, 90, window)
    assert found(docs(spark, rows), window) == brute(rows, window)


def test_messy_rows_and_nothing(spark):
    rows = messy(spark)
    plain = [(r.doc_id, r.text) for r in rows.collect()]
    assert found(rows, 5) == brute(plain, 5)
    assert found(rows, 35) == brute(plain, 35)
    assert remove_repeats(empty(spark)).count() == 0
    assert remove_repeats(empty(spark)).columns == ["doc_id", "n_words", "repeats", "kept"]


def test_a_third_of_all_rows_are_copies(spark):
    body = " ".join(f"c{i}" for i in range(60))
    rows = [(i, body if i % 3 == 0 else f"own{i} " * 40) for i in range(600)]
    assert found(docs(spark, rows), 35) == brute(rows, 35)


def test_texts_are_not_moved_again(spark):
    """What is grouped by chunk reads the stored table where it lies."""
    plan = remove_repeats(docs(spark, corpus(4, 20, 35)))._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("FlatMapCoGroups") :].split("FileScan")[1]
    assert "Bucketed: true" in scan
    assert plan.count("Exchange") == 1  # the answers


def test_a_window_is_odd(spark):
    with pytest.raises(ValueError, match="odd"):
        remove_repeats(empty(spark), window=4)


@pytest.mark.parametrize("segment", [16, 1 << 20])
def test_word_hashes_depend_on_the_word_alone(monkeypatch, segment):
    monkeypatch.setattr(bytewords, "SEGMENT", segment)
    bytewords.byte_powers.cache_clear()
    texts = ["one two", None, "", "  two\tone ", "averyveryverylongword one", "ONE", "é one"]
    data, edges = bytewords.flat(pa.array(texts)[0:])
    starts, ends, doc = bytewords.spans(data, edges, bytewords.NOT_WHITE)
    got = [data[a:b].tobytes().decode() for a, b in zip(starts, ends, strict=True)]
    assert got == [w for t in texts for w in (t or "").split()]
    assert list(doc) == [i for i, t in enumerate(texts) for _ in (t or "").split()]
    hashes = bytewords.word_hashes(data, starts, ends)
    assert len(set(zip(got, hashes.tolist(), strict=True))) == len(set(got)) == len(set(hashes.tolist()))
    lower = bytewords.word_hashes(data, starts, ends, lower=True)
    assert lower[got.index("ONE")] == lower[0] == hashes[0]
    window = bytewords.window_hashes(hashes, 2)
    assert len(window) == len(hashes) - 1 and len(np.unique(window)) == len(window)
    bytewords.byte_powers.cache_clear()
