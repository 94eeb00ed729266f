"""Licence scans and the piece codec."""

from __future__ import annotations

import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from netobs.llm import licences, sp_codec
from netobs.llm.pieces import SPACE, pieces_of
from tests.llm.common import docs, empty, messy

PIECES = str(public_tokenizers.path("piece_bpe_32k.model"))
MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated\n"


def found(spark, rows, **kw):
    return {(r.doc_id, r.licence): r for r in licences.scan(docs(spark, rows), **kw).collect()}


def test_notices_in_lines_paragraphs_and_texts(spark):
    grant = licences.TEMPLATES["MIT grant"]
    words = grant.split()
    wrapped = "\n".join(" ".join(words[i : i + 9]) for i in range(0, len(words), 9))
    rows = [
        (1, "some prose here\nReleased under the MIT License.\nmore prose"), (2, "released UNDER the   mit licence and more of other things"),
        (3, wrapped), (4, f"Title\n\n{wrapped}\n\nand then some"), (5, "Released under the MIT License, please"), (6, None), (7, ""), (8, "MIT"),
    ]
    got = found(spark, rows)
    assert (got[1, "MIT notice"].dice, got[1, "MIT notice"].unit, got[1, "MIT notice"].unit_no) == (1.0, "line", 1)
    assert got[3, "MIT grant"].unit == "text" and got[3, "MIT grant"].dice == 1.0
    assert (got[4, "MIT grant"].unit, got[4, "MIT grant"].unit_no) == ("paragraph", 1)
    assert got[5, "MIT notice"].dice == pytest.approx(8 / 9)
    assert {i for i, _ in got} == {1, 3, 4, 5}


def test_sizes_prune_nothing_that_reaches_the_threshold(spark):
    """Every pair of unit and template, by definition."""
    rng = random.Random(1)
    pool = sorted(licences.TEMPLATES.values())
    rows = []
    for i in range(150):
        words = rng.choice(pool).split()
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = rng.choice(["x", "the", "License"])
        rows.append((i, " ".join(words + ["extra"] * rng.randrange(3))))
    got = {k: r.dice for k, r in found(spark, rows).items()}
    want = {}
    for i, text in rows:
        a = set(licences.grams_of(text))
        for name, template in licences.TEMPLATES.items():
            b = set(licences.grams_of(template))
            dice = 2 * len(a & b) / (len(a) + len(b)) if a else 0
            if dice >= licences.DICE:
                want[i, name] = dice
    assert got == pytest.approx(want) and len(want) > 100


def test_licences_in_messy_rows_and_nothing(spark):
    assert licences.scan(messy(spark)).count() == 0
    assert licences.scan(empty(spark)).count() == 0


WARRANTY = "You should have received a copy of the GNU General Public License along with this program."


def comment(*paragraphs, sign="#"):
    """Paragraphs as one comment block, wrapped, a lone sign between them."""
    out = []
    for p in paragraphs:
        words = p.split()
        out += [sign, *(f"{sign} " + " ".join(words[i : i + 11]) for i in range(0, len(words), 11))]
    return "\n".join(out[1:])


def test_notices_inside_lines_and_comments(spark):
    t = licences.TEMPLATES
    varied = t["ISC grant"].replace("this software", "this very fine piece of software").rstrip(".")
    rows = [
        (1, "This small tool is Released under the MIT License. Patches are welcome."), (2, "Copyright 2020 Example Corp. All rights reserved."),
        (3, comment("Copyright (C) 2020 Someone", t["GPL header"], t["GPL warranty"], WARRANTY) + "\nimport os\nprint(1)"),
        (4, comment("Copyright 2020 Someone", t["MIT grant"], t["MIT condition"], "THE SOFTWARE IS PROVIDED AS IS", sign="//").replace("\n//\n", "\n")),
        (5, f"Some words go before. {varied}. And some more words that go on for a while come after it here."),
        (6, "nothing of it is released under any of the terms, all of the rights stay"), (7, "so Released under the MIT"), (8, None), (9, "so it was Eleased " + t["GPL warranty"][5:]),
    ]
    assert not found(spark, rows[:2])
    got = found(spark, rows, inside=True)
    want = {(1, "MIT notice"), (2, "Reserved"), (3, "GPL header"), (3, "GPL warranty"), (4, "MIT grant"), (4, "MIT condition"), (5, "ISC grant"), (9, "GPL warranty")}
    assert set(got) == want
    assert (got[1, "MIT notice"].dice, got[1, "MIT notice"].unit, got[1, "MIT notice"].unit_no) == (1.0, "window", 4)
    assert (got[2, "Reserved"].dice, got[2, "Reserved"].unit) == (1.0, "sentence")
    assert (got[3, "GPL warranty"].dice, got[3, "GPL warranty"].unit) == (1.0, "comment")
    assert got[4, "MIT grant"].dice == got[4, "MIT condition"].dice == 1.0
    assert got[5, "ISC grant"].unit == "sentence"


def test_windows_against_brute_force(spark):
    """Every window of a template's size that starts with one of its bigrams, in one line without sentences."""
    rng = random.Random(3)
    pool = [x.replace(".", " ").replace("!", " ") for x in licences.TEMPLATES.values()]
    rows = []
    for i in range(80):
        words = ["so", "it", "is"] * rng.randrange(4) + rng.choice(pool).split() + rng.choice(pool).split()[: rng.randrange(1, 30)] + ["and", "the", "end"] * rng.randrange(3)
        for _ in range(rng.randrange(5)):
            words[rng.randrange(len(words))] = rng.choice(["x", "the", "License"])
        rows.append((i, " ".join(words)))
    want = {}
    for i, text in rows:
        words = licences.re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
        pairs = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
        for name, template in licences.TEMPLATES.items():
            b, span = set(licences.grams_of(template)), licences.template_words(template) - 1
            sets = [set(pairs), *(set(pairs[max(0, k) : max(0, k) + span]) for k in (min(k, len(pairs) - span) for k, g in enumerate(pairs) if g in b))]
            dice = max(2 * len(a & b) / (len(a) + len(b)) for a in sets)
            if dice >= licences.DICE:
                want[i, name] = dice
    got = {k: r.dice for k, r in found(spark, rows, inside=True).items()}
    assert got == pytest.approx(want) and len(want) > 60


def best_sum(text):
    """Highest score of any segmentation, and the ids it can have (plain dynamic program)."""
    p = pieces_of(PIECES)
    score = {p.text[int(i)]: float(s) for i, s in zip(p.ids, p.scores, strict=True)}
    floor = p.scores.min() - sp_codec.UNKNOWN
    best = [0.0]
    for e in range(1, len(text) + 1):
        options = [best[s] + score[text[s:e]] for s in range(max(0, e - p.longest), e) if text[s:e] in score]
        best.append(max(options + ([] if text[e - 1] in score else [best[e - 1] + floor])))
    return best[-1]


ODD_TEXT = st.text(alphabet=st.one_of(st.sampled_from("  the tion\n\t.é日"), st.characters(exclude_categories=["Cs"])), max_size=40)


@settings(max_examples=100, deadline=None)
@given(ODD_TEXT)
def test_round_trip_of_any_text(text):
    codec = sp_codec.codec_of(PIECES)
    ids = codec.encode([text])[0]
    assert codec.decode(ids) == text.replace(SPACE, " ")


def test_ids_have_the_highest_score():
    codec = sp_codec.codec_of(PIECES)
    p = codec.pieces
    score = {int(i): float(s) for i, s in zip(p.ids, p.scores, strict=True)}
    rng = random.Random(7)
    for _ in range(300):
        text = "".join(rng.choice("thesainor dlgé") for _ in range(rng.randrange(1, 14))) or "x"
        ids = [int(i) for i in codec.encode([text])[0]]
        whole = SPACE + text.replace(" ", SPACE)
        assert sum(score[i] for i in ids) == best_sum(whole)
        assert "".join(p.text[i] for i in ids) == whole


def test_encode_and_decode_tables(spark):
    rows = messy(spark)
    made = sp_codec.encode(rows, PIECES)
    back = sp_codec.decode(made, PIECES)
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r.doc_id, r.text) for r in back.collect()), key=key) == sorted(((r.doc_id, r.text or "") for r in rows.collect()), key=key)
    assert {r.n_pieces for r in back.where("text = ''").collect()} == {0}
    assert sp_codec.decode(sp_codec.encode(empty(spark), PIECES), PIECES).count() == 0


def test_cache_is_bounded(monkeypatch):
    from netobs.llm import id_cache

    monkeypatch.setattr(id_cache, "CACHED_WORDS", 50)
    codec = sp_codec.Codec(PIECES)
    for i in range(20):
        texts = [f"word{i * 30 + j} again" for j in range(30)]
        assert [codec.decode(x) for x in codec.encode(texts)] == texts
        assert len(codec.cache.slot) <= 90
