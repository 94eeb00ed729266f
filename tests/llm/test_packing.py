"""Packing against the tokenizer, and the plan's own rules."""

from __future__ import annotations

import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from netobs.llm import packing
from tests.llm.common import docs, empty, messy

PATH = str(public_tokenizers.path("word_bpe_49k.json"))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=60))
def test_plan_uses_every_piece_once(lengths):
    counts = np.bincount(lengths, minlength=41)
    used = np.zeros_like(counts)
    for times, need in packing.plan(counts, 40):
        assert times > 0 and sum(x * n for x, n in need.items()) <= 40
        for x, n in need.items():
            used[x] += times * n
    assert (used == counts).all()


def test_combinations_fill_exactly():
    rng = random.Random(4)
    for _ in range(300):
        left = np.zeros(61, np.int64)
        for _ in range(rng.randrange(1, 9)):
            left[rng.randrange(1, 60)] += 1
        gap = rng.randrange(1, 60)
        items = [x for x in range(61) for _ in range(left[x])]
        sums = {items[i] for i in range(len(items))}
        sums |= {items[i] + items[j] for i in range(len(items)) for j in range(i)}
        sums |= {items[i] + items[j] + items[k] for i in range(len(items)) for j in range(i) for k in range(j)}
        got = packing.combination(gap, left)
        assert (got is not None) == (gap in sums)
        if got:
            assert sum(got) == gap and all(left[x] >= got.count(x) for x in got)


def test_exact_complements_leave_no_gap():
    counts = np.zeros(101, np.int64)
    for parts, times in (((70, 30), 5000), ((62, 21, 17), 70), ((43, 39, 11, 7), 9)):
        for x in parts:
            counts[x] += times
    entries = packing.plan(counts, 100)
    assert sum(t for t, _ in entries) == 5079 and len(entries) < 20


def check(rows, texts, capacity):
    model = Tokenizer.from_file(PATH)
    want = sorted(
        (str(i), n, s, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)))
        for i, t in texts
        for ids in [[*model.encode(t or "", add_special_tokens=False).ids, 0]]
        for n, s in enumerate(range(0, len(ids), capacity))
        for part in [ids[s : s + capacity]]
    )
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for parts in places.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity


@pytest.mark.parametrize("capacity", [2048, 16])
def test_pieces_and_places(spark, capacity):
    rows = messy(spark)
    got = packing.pack(rows, PATH, capacity).collect()
    check(got, [(r.doc_id, r.text) for r in rows.collect()], capacity)


def test_hot_length_is_numbered_across_buckets(spark):
    rows = [(i, "one two three") for i in range(3000)]
    got = packing.pack(docs(spark, rows), PATH, 10).collect()
    check(got, rows, 10)
    assert len({r.sequence_id for r in got}) == 1500


def test_nothing(spark):
    assert packing.pack(empty(spark), PATH).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \t\n\r\x0b\x0c\x1c\x85\xa0 ́'sßİΣé\U0001f9ff<|endoftext|>aA1."), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_ids_by_word_are_the_ids_of_the_text(text):
    got = packing.word_ids(PATH).encode([packing.split_words(text)])[0]
    assert list(got) == Tokenizer_.encode(text, add_special_tokens=False).ids


Tokenizer_ = Tokenizer.from_file(PATH)


LITERALS = [
    "<|endoftext|>", "x<|endoftext|>y", "<|ENDOFTEXT|>", "'<|ENDOFTEXT|>", "x<|EndOfText|>Y", "Don<|endoftext|>'T stop", "É<|startoftext|>É",
    "<|endoftext|><|startoftext|>", "a <|endoftext|>\n<|endoftext|> b", "<|endoftext", "Σ<|endoftext|>Σ", "\x1c<|ENDOFTEXT|>\x1c<|endoftext|>",
]


@pytest.mark.parametrize("capacity", [2048, 3])
def test_added_tokens_in_texts(spark, capacity):
    """The tokenizer matches them in raw text: alone, inside a word, not in upper case."""
    assert Tokenizer_.encode("x<|endoftext|>y", add_special_tokens=False).ids == [343, 49407, 344]
    got = packing.word_ids(PATH).encode([packing.split_words(t) for t in LITERALS])
    assert [list(x) for x in got] == [Tokenizer_.encode(t, add_special_tokens=False).ids for t in LITERALS]
    rows = list(enumerate(LITERALS))
    check(packing.pack(docs(spark, rows), PATH, capacity).collect(), rows, capacity)
