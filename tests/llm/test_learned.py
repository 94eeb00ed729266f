"""Quality, language and language-model scores: held-out accuracy, brute force, odd rows."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from netobs.llm import interpolated_lm as lm
from netobs.llm import langid, quality
from netobs.llm.common import fold, table
from netobs.llm.pieces import SPACE, pieces_of
from netobs.llm.queries import QUERIES
from tests.llm.common import docs, empty, messy

PIECES = str(public_tokenizers.path("piece_bpe_32k.model"))
SF = "/root/testdata/sf0.01"


def test_quality_on_the_held_out_fold(spark):
    scored = QUERIES["op1_quality_classifier"](spark, SF)
    assert scored.count() == table(spark, SF, "documents").count()
    rows = scored.join(table(spark, SF, "labels"), "doc_id").where("held_out").collect()
    right = [r.predicted == r.quality for r in rows]
    assert sum(right) / len(right) > 0.95
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


def test_quality_paths_are_rules():
    debug = """DecisionTreeClassificationModel
  If (feature 0 <= 1.5)
   If (feature 2 <= 0.25)
    Predict: 0.0
   Else (feature 2 > 0.25)
    Predict: 1.0
  Else (feature 0 > 1.5)
   Predict: 1.0
"""
    names = ("a", "b", "c")
    assert quality.paths(debug, names) == [
        (("a", "<=", 1.5),), (("a", "<=", 1.5), ("c", "<=", 0.25)), (("a", "<=", 1.5), ("c", ">", 0.25)), (("a", ">", 1.5),),
    ]


def test_compiled_score_against_rules_row_by_row(spark):
    """The model's column against its rules evaluated in plain Python, thresholds hit exactly among them."""
    docs_ = table(spark, SF, "documents")
    stats = quality.with_statistics(docs_, "doc_id", "text").persist()
    labels = quality.labels_of(table(spark, SF, "labels"))
    model = quality.learn(stats.join(labels, "k"))
    assert 1 < len(model.rules) and any(len(r) > 1 for r in model.rules)
    rows = [r.asDict() for r in stats.collect()]
    edge = dict(rows[0]) | {name: at for rule in model.rules for name, _, at in rule}
    frame = spark.createDataFrame([tuple(float(r[n]) for n in quality.NAMES) for r in (*rows, edge)], list(quality.NAMES))
    got = [r.score for r in frame.select(model.score().alias("score")).collect()]
    assert len(got) == len(rows) + 1
    for row, score in zip((*rows, edge), got, strict=True):
        total = model.intercept
        for rule, weight in model.rules.items():
            if all(row[name] <= at if sign == "<=" else row[name] > at for name, sign, at in rule):
                total += weight
        assert score == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-12)
    stats.unpersist()


def test_quality_of_messy_rows_and_without_labels(spark):
    rows = messy(spark)
    none = quality.with_statistics(empty(spark), "doc_id", "text").withColumn("label", F.lit(1))
    model = quality.learn(none)
    got = quality.with_score(rows, model)
    assert got.select("row.*").columns == rows.columns
    assert [r.score for r in got.collect()] == [0.5] * rows.count()
    one = quality.with_statistics(rows, "doc_id", "text").withColumn("label", F.lit(1))
    assert quality.with_score(rows, quality.learn(one)).where("score > 0.9").count() == rows.count()
    stats = quality.with_statistics(rows, "doc_id", "text").drop("k")
    assert all(v is not None and math.isfinite(v) for r in stats.collect() for v in r)


def test_labels_of_disagreeing_rows(spark):
    rows = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (None, 1), (3, None)], "doc_id long, quality int")
    assert {r.k: r.label for r in quality.labels_of(rows).collect()} == {1: 0, 2: 1}


def test_language_on_the_held_out_fold(spark):
    found = QUERIES["op9_language_id"](spark, SF)
    rows = found.join(table(spark, SF, "documents"), "doc_id").where("held_out").collect()
    right = [r.lang == r.lang_pred for r in rows]
    assert sum(right) / len(right) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_messy_rows(spark):
    model = langid.learn(table(spark, SF, "documents").limit(200), PIECES, rounds=1)
    rows = messy(spark)
    got = {r.doc_id: r for r in langid.identify(rows, model).collect()}
    assert langid.identify(rows, model).count() == rows.count()
    for i in (5, 6, 7, 8, None):
        if i is not None:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
    assert got[1].lang_pred == "en" and got[14].lang_pred in model.langs
    nothing = langid.learn(empty(spark), PIECES)
    assert {r.lang_pred for r in langid.identify(rows, nothing).collect()} == {"und"}


def test_number_signs_are_no_letters_and_marks_belong_to_theirs(spark):
    model = langid.learn(table(spark, SF, "documents").limit(200), PIECES, rounds=1)
    rows = [(1, "\u00bd"), (2, "\u00b2 \u2460 \u2167 12"), (3, "\u0301"), (4, "_"), (5, "x\u00bd")]
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs(spark, rows), model).collect()}
    assert [got[i] for i in (1, 2, 3, 4)] == ["und"] * 4 and got[5] in model.langs
    assert langid.words_of("\u0939\u093f\u0928\u094d\u0926\u0940 x\u0301y") == ["\u0939\u093f\u0928\u094d\u0926\u0940", "x\u0301y"]


def test_scores_do_not_depend_on_slices(spark, monkeypatch):
    texts = [r.text for r in table(spark, SF, "documents").limit(60).collect()]
    pieces = pieces_of(PIECES)
    prob = np.random.default_rng(3).random((len(pieces.keys) + 1, 2)) * 1e-3
    whole = langid.Scorer(["a", "b"], prob, PIECES, None).score(texts)
    monkeypatch.setattr(langid, "SLICE", 500)
    monkeypatch.setattr(langid, "CACHED_WORDS", 50)
    monkeypatch.setattr(langid, "CELLS", 64)
    small = langid.Scorer(["a", "b"], prob, PIECES, None)
    parts = [small.score(p) for p in langid.slices(texts)]
    assert len(parts) > 5
    assert [x for p in parts for x in p["lang_pred"]] == list(whole["lang_pred"])
    assert [x for p in parts for x in p["score"]] == pytest.approx(list(whole["score"]))


def test_every_labelled_language_is_learned(spark):
    """Languages of a single row beside a large one, and one whose runs of letters are all long."""
    rare = {f"r{i:02}": f"{chr(945 + i) * 3} {chr(945 + i) * 5}" for i in range(20)}
    rows = [(i, "the quick brown fox", "en") for i in range(3000)] + [(4000 + i, t, k) for i, (k, t) in enumerate(rare.items())]
    rows += [(5000, "日本語文章" * 30, "ja")]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), PIECES, most_rows=300, rounds=2)
    assert model.langs == sorted(["en", "ja", *rare])
    got = langid.identify(docs(spark, [(1, "日本語文章" * 20), (2, "fox"), (3, "ααα ααααα")]), model).collect()
    assert {r.doc_id: r.lang_pred for r in got} == {1: "ja", 2: "en", 3: "r00"}


def test_samples_are_bounded():
    assert langid.quotas({"a": 5000, "b": 9000, "c": 10}, 1000) == {"a": 495, "b": 495}
    assert langid.quotas({str(i): 300 for i in range(50)}, 1000) == {str(i): langid.LEAST_ROWS for i in range(50)}
    assert "".join(langid.learned_words("ab" * 100)) == "ab" * 100


def test_forward_sums_all_segmentations():
    """Against a sum over every way to cut short words, unknown characters too."""
    pieces = pieces_of(PIECES)
    rng = np.random.default_rng(1)
    prob = rng.random((len(pieces.keys) + 1, 2)) * 1e-3
    at = {pieces.text[int(i)]: n for n, i in enumerate(pieces.ids)}
    words = ["the", "tion", "ab", "q", "\U0001f9ff", "x\U0001f9ffy", "straße"]

    def total(text):
        if not text:
            return np.ones(2)
        out = np.zeros(2)
        for n in range(1, len(text) + 1):
            if text[:n] in at:
                out = out + prob[at[text[:n]]] * total(text[n:])
            elif n == 1:
                out = out + prob[-1] * total(text[1:])
        return out

    got = langid.log_likelihoods(words, prob, PIECES)
    for word, line in zip(words, got, strict=True):
        assert line == pytest.approx(np.log10(total(SPACE + word)))


def test_long_words_do_not_underflow():
    prob = np.full((len(pieces_of(PIECES).keys) + 1, 1), 1e-9)
    got = langid.log_likelihoods(["\U0001f9ff" * 500], prob, PIECES)
    assert got[0, 0] == pytest.approx(-9 * 501, rel=1e-3)


def tokens(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower) + [""]


def role():
    part = fold("doc_id", 7)
    return F.when(part == 2, lm.OTHER).when(part == 5, lm.HELD).otherwise(lm.MAIN)


def role_of(i):
    part = zlib.crc32(str("" if i is None else i).encode()) % 7
    return {2: lm.OTHER, 5: lm.HELD}.get(part, lm.MAIN)


@pytest.mark.parametrize("small", [False, True])
def test_scores_against_brute_force(spark, monkeypatch, small):
    """All counts recomputed; the learned weights are taken from the model and must sum to 1."""
    if small:
        monkeypatch.setattr(lm, "CHUNK_TOKENS", 500)
        monkeypatch.setattr(lm, "BUCKET_KEYS", 64)
    kept = []
    learn = lm.learned_weights
    monkeypatch.setattr(lm, "learned_weights", lambda *a: kept.append(learn(*a)) or kept[-1])
    rows = table(spark, SF, "documents").limit(150)
    data = [(r.doc_id, r.text) for r in rows.collect()]
    got = {r.doc_id: r for r in lm.score(docs(spark, data), role()).collect()}
    uni, bi, v = Counter(), Counter(), set()
    for i, t in data:
        if role_of(i) != lm.OTHER:
            ts = tokens(t)
            uni.update(ts)
            bi.update(zip([""] + ts[:-1], ts, strict=True))
            v.update(ts)
    n, weights = sum(uni.values()), kept[0]
    assert np.allclose(weights.sum(axis=1), 1) and weights[0, 0] == 0 and (weights[1:] > 0).all()
    for i, t in data:
        ts, r = tokens(t), got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ts), sum(x in v for x in ts), n)
        assert r.base_score == pytest.approx(sum(math.log10((uni[x] + 1) / (n + len(v) + 1)) for x in ts))
        want = 0.0
        for h, x in zip([""] + ts[:-1], ts, strict=True):
            w = weights[1 + int(math.log2(uni[h])) if uni[h] else 0]
            p2 = bi[h, x] / uni[h] if uni[h] else 0
            want += math.log10(w[0] * p2 + w[1] * uni[x] / n + w[2] / (len(v) + 1))
        assert r.score == pytest.approx(want)
    held = [r for r in got.values() if r.role == lm.OTHER]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_scores_of_messy_rows_and_nothing(spark):
    rows = messy(spark)
    got = lm.score(rows, role()).collect()
    assert len(got) == rows.count() and all(math.isfinite(r.score) for r in got)
    assert lm.score(empty(spark), role()).count() == 0
    alone = lm.score(docs(spark, [(1, "a b")]), F.lit(lm.OTHER)).first()
    assert (alone.n_tokens, alone.n_known, alone.train_tokens, alone.score, alone.base_score) == (3, 0, 0, 0, 0)


def test_weights_are_a_maximum():
    """No other mixture explains the held-out cells of a bucket better."""
    import pandas as pd

    rng = np.random.default_rng(2)
    cells = pd.DataFrame({"context": 3, "cell2": rng.integers(4, 60, 50), "cell1": rng.integers(4, 60, 50), "n": rng.integers(1, 4000, 50)})
    w = lm.learned_weights(cells, 1e-4)[3]

    def gain(w):
        p = np.stack([2.0 ** (-cells["cell2"] / lm.STEPS), 2.0 ** (-cells["cell1"] / lm.STEPS), np.full(50, 1e-4)], axis=1)
        return (cells["n"] * np.log(p @ w)).sum()

    for other in rng.dirichlet(np.ones(3), 200):
        assert gain(w) >= gain(other) - 0.02 * abs(gain(w))
