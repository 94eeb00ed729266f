"""Exact and near duplicates against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from netobs.llm import chosen_path, naming
from netobs.llm.common import Scratch, components
from tests.llm.common import docs, empty, messy


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def test_exact_dedup_of_messy_rows(spark):
    rows = messy(spark)
    got = naming.exact_dedup(rows).collect()
    texts = [(r.doc_id, r.text) for r in rows.collect()]
    assert len(got) == len(texts)
    groups = defaultdict(list)
    for i, t in texts:
        groups[normal(t)].append((-len(t or ""), i is None, i or 0))
    by_sha = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    for r in got:
        members = by_sha[r.text_sha256]
        first = min(members)
        assert r.group_size == len(members)
        assert r.keep_id == (None if first[1] else first[2])
    assert sum(r.kept for r in got) == len(groups)


def test_exact_dedup_long_texts_differ_late(spark):
    base = "".join(chr(97 + i * i % 26) for i in range(70_000))
    rows = [(i, base) for i in range(3)] + [(i + 10, base[:-1] + c) for i, c in enumerate("XYX")] + [(20, base + " \n")]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in naming.exact_dedup(docs(spark, rows)).collect()}
    assert got[0] == (20, 4, False) and got[20] == (20, 4, True)
    assert got[10] == (10, 2, True) and got[11] == (11, 1, True) and got[12] == (10, 2, False)


def test_exact_dedup_blocks_and_their_order_count(spark):
    a, b = "a" * naming.BLOCK, "b" * naming.BLOCK
    rows = [(1, a + b + a), (2, a + a + b), (3, a + b + a), (4, a + b), (5, a + b + a + "c"), (6, b + a)]
    got = {r.doc_id: r.keep_id for r in naming.exact_dedup(docs(spark, rows)).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5, 6: 6}


def test_exact_dedup_of_nothing(spark):
    assert naming.exact_dedup(empty(spark)).count() == 0


def test_keep_first_returns_the_columns(spark):
    rows = messy(spark)
    kept = naming.keep_first(rows, naming.exact_dedup(rows))
    assert kept.columns == rows.columns
    texts = [normal(r.text) for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({normal(r.text) for r in rows.collect()})


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    if len(words) < width:
        return {tuple(words)}
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute(rows, width):
    """Component of every row with a key and a set, by comparing all."""
    sets = [(i, shingles(t, width)) for i, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if i is not None and j is not None and x and y and 100 * len(x & y) >= 80 * len(x | y):
                parent[root(a)] = root(b)
    low = {}
    for a, (i, x) in enumerate(sets):
        if i is not None and x:
            low[root(a)] = min(low.get(root(a), i), i)
    return [(i, len(x), low[root(a)] if i is not None and x else i) for a, (i, x) in enumerate(sets)]


def agree(spark, rows, width=4):
    got = chosen_path.near_components(docs(spark, rows), width).collect()
    want = brute(rows, width)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or 0)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == sorted(want, key=key)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)


def edited(words, rng, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**9)}"
    return " ".join(words)


@pytest.mark.parametrize("seed", [1, 2])
def test_near_components_against_brute_force(spark, seed):
    """Groups around several texts with few to many edits, chains, and a passage that all share."""
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(20)]
    rows = []
    for g in range(6):
        base = [f"g{g}w{rng.randrange(500)}" for _ in range(rng.choice([5, 30, 120]))] + passage
        for _ in range(rng.choice([2, 10, 45])):
            rows.append((len(rows), edited(base, rng, rng.randrange(4))))
    chain = [f"c{i}" for i in range(80)]
    for i in range(8):
        rows.append((len(rows), " ".join(chain[3 * i : 3 * i + 50])))
    rng.shuffle(rows)
    agree(spark, rows)


def test_near_components_messy_and_empty(spark):
    rows = [(r.doc_id, r.text) for r in messy(spark).collect()]
    agree(spark, rows)
    assert chosen_path.near_components(empty(spark)).count() == 0


def test_near_components_at_the_threshold(spark):
    words = [f"w{i}" for i in range(12)]
    # 9 shingles each; 8 common of 10 is 0.8, 7 common of 11 is not.
    rows = [(1, " ".join(words)), (2, " ".join([*words[1:], "z"])), (3, " ".join([*words[2:], "z", "y"]))]
    agree(spark, rows)


@pytest.mark.parametrize("levels", [0, 2])
def test_steps_beyond_the_last_level(spark, monkeypatch, levels):
    """Members that no step splits are compared one by one."""
    monkeypatch.setattr(chosen_path, "LEVELS", levels)
    monkeypatch.setattr(chosen_path, "SMALL", 2)
    monkeypatch.setattr(chosen_path, "FULL", 4)
    monkeypatch.setattr(chosen_path, "WORK", 8)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    agree(spark, [(i, edited(base, rng, rng.randrange(6))) for i in range(40)])


def test_keep_one_keeps_columns_and_null_keys(spark):
    rows = messy(spark)
    left = chosen_path.keep_one(rows, chosen_path.near_components(rows, 5))
    assert left.columns == rows.columns
    ids = [r.doc_id for r in left.collect()]
    assert 2 not in ids and 1 in ids and ids.count(None) == 3


def test_keep_one_decides_rows_that_share_a_key(spark):
    """One row with key 5 is a near copy of row 1, the other is not."""
    base = [f"w{i}" for i in range(60)]
    other = " ".join(f"other{i}" for i in range(40))
    rows = docs(spark, [(1, " ".join(base)), (5, " ".join([*base, "more"])), (5, other), (6, " ".join([*base, "end"])), (7, other + " x")])
    left = chosen_path.keep_one(rows, chosen_path.near_components(rows, 5))
    assert left.columns == rows.columns
    assert sorted((r.doc_id, r.text) for r in left.collect()) == [(1, " ".join(base)), (5, other)]


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(60)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"), "c").collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    assert got == {x: root(x) for e in edges for x in e if e[0] != e[1]}


@pytest.mark.parametrize("share", [0.78, 0.86])
def test_rows_of_a_large_group_grow_with_its_size(spark, share):
    """Sets of one group, all alike: pairs that a comparison gives are fewer than its nodes, linked or not."""
    rng, n, size = np.random.default_rng(3), 60, 400
    same = round(size * 2 * share / (1 + share))  # of equal sized sets with ``share`` of their union in common
    base = rng.integers(1, 1 << 62, same, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base, rng.integers(1, 1 << 62, size - same, dtype=np.uint64)])) for _ in range(n)]
    fine = chosen_path.minwise(sets, 4 + chosen_path.COORDINATES, chosen_path.FINE).astype(np.uint8)
    nodes = spark.createDataFrame([(i, len(x), bytearray(f.tobytes())) for i, (x, f) in enumerate(zip(sets, fine, strict=True))], "node long, n long, fine binary")
    stored = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(sets)], "node long, set binary")
    rows = spark.range(n).selectExpr("1L AS branch", "id AS node", "id AS root")
    got = chosen_path.within(rows, nodes, stored).collect()
    brute = sum(chosen_path.similar(sets[0].tobytes(), x.tobytes()) for x in sets[1:])
    assert len(got) == (n - 1 if brute else 0)


def steps(spark, made):
    """Shuffles and jobs that ``made`` runs, by the numbers that Spark gives them."""
    ids = lambda: (spark.sparkContext._jsc.sc().newShuffleId(), spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs())
    before = ids()
    made()
    return [b - a for a, b in zip(before, ids(), strict=True)]


def test_components_of_few_edges_take_no_shuffle(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(3000) if i % 1000] + [(7, 7)], "a long, b long")
    got = {}
    shuffles, jobs = steps(spark, lambda: got.update((r.node, r.root) for r in components(edges, Scratch(spark, "t"), "c").collect()))
    assert got == {i: i - (i - 1) % 1000 for i in range(1, 3001)}
    assert shuffles <= 2 and jobs <= 6  # the count's


def test_components_of_many_edges(spark, monkeypatch):
    monkeypatch.setattr("netobs.llm.common.FEW_EDGES", 0)
    test_components(spark)
    agree(spark, [(i, " ".join(f"w{j}" for j in range(i % 7, i % 7 + 30)) + " x" * (i % 3)) for i in range(30)])


def test_steps_of_a_large_group_are_few(spark):
    """One group of near copies beyond a whole branch's size, beside pairs and single texts."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, edited(base, rng, rng.randrange(4))) for i in range(chosen_path.CLUSTER + 200)]
    rows += [(5000 + i, " ".join(f"s{i // 2}x{j}" for j in range(30)) + " end" * (i % 2)) for i in range(60)]
    table, got = docs(spark, rows), []
    shuffles, _ = steps(spark, lambda: got.extend(chosen_path.near_components(table).collect()))
    assert len(got) == len(rows)
    assert shuffles < 24
