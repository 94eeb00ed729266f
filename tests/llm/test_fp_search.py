"""Ranked search against the score formula written out."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from netobs.llm import fp_search
from tests.llm.common import docs, empty, messy

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return PATTERN.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, items, k):
    counted = [(i, Counter(terms(t))) for i, t in rows]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    total, size = sum(n for *_, n in counted), len(counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, n in counted:
            m = 75 + (25 * n * size) // total
            s = sum(math.floor(1000 * math.log((2 * size + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def found(frame, items, k, **names):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in fp_search.search(frame, items, k, **names).collect()), key=str)


def asked(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize(("docs_a_trie", "leaf", "cells", "block"), [(8192, 32, 1 << 23, 1 << 20), (50, 2, 1 << 23, 60), (64, 4, 900, 1 << 20)])
def test_against_brute_force(spark, monkeypatch, docs_a_trie, leaf, cells, block):
    monkeypatch.setattr(fp_search, "DOCS", docs_a_trie)
    monkeypatch.setattr(fp_search, "LEAF", leaf)
    monkeypatch.setattr(fp_search, "CELLS", cells)
    monkeypatch.setattr(fp_search, "ITEM_BYTES", block)
    rng = random.Random(docs_a_trie)
    word = lambda: f"t{int(rng.paretovariate(0.6)) % 300}"
    rows = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 3, 30, 200])))) for i in range(500)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)] + [(2000 + i, "T1, t2; t3") for i in range(60)]
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 3, 12])))) for i in range(20)] + [(50, "nowhere"), (51, "t1 t1 t2"), (52, "")]
    assert found(docs(spark, rows), asked(spark, items), 7) == brute(rows, items, 7)


def test_messy_rows_and_nothing(spark):
    rows = messy(spark)
    plain = [(r.doc_id, r.text) for r in rows.collect()]
    items = [(1, "The FOX"), (2, None), (3, ""), (4, "日本語"), (5, "word3 end"), (None, "one"), (6, "...")]
    assert found(rows, asked(spark, items), 4) == brute(plain, [x for x in items if x[1]], 4)
    assert found(rows, asked(spark, [(1, "fox"), (1, "fox")]), 3) == brute(plain, [(1, "fox")], 3)
    assert found(rows, asked(spark, []), 3) == [] and found(empty(spark), asked(spark, items), 3) == []
    clash = asked(spark, [(1, "fox")]).selectExpr("item_id AS doc_id", "text AS rank")
    assert found(rows, clash, 2, item_key="doc_id", item_text="rank") == brute(plain, [(1, "fox")], 2)


def test_bounds_hold_below_every_node():
    rng = np.random.default_rng(5)
    ranks = [np.unique(rng.integers(0, 40, rng.integers(1, 15))) for _ in range(300)]
    tf = [rng.integers(1, 9, len(r)) for r in ranks]
    trie = fp_search.Trie(np.arange(300), rng.integers(75, 500, 300), [r.copy() for r in ranks], [t.copy() for t in tf], 40)
    assert sorted(trie.ids) == list(range(300)) and len(trie.low) > 5
    for node, (lo, hi) in enumerate(zip(trie.low, trie.high, strict=True)):
        for d in range(lo, hi):
            some = slice(trie.edges[d], trie.edges[d + 1])
            assert (trie.bounds[node][trie.ranks[some]] >= trie.part[some]).all()
        a, b = trie.kids[node]
        if b > a:
            assert trie.low[a] == lo and trie.high[b - 1] == hi and all(trie.high[c] == trie.low[c + 1] for c in range(a, b - 1))
