"""Substrings of words looked up in a fixed public piece vocabulary, many words at once."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

SPACE = "▁"  # how the vocabulary writes the start of a word
BASE = np.uint64(0x9E3779B97F4A7C15)
NORMAL = 1  # model types of a piece: normal; user-defined pieces count alike
USER = 4
SIEVE_BITS = 20


class Pieces:
    """The pieces as sorted 64-bit substring keys, with ids and scores in that order.

    A key is the polynomial of the code points, so the key of any substring comes
    from two prefix values. A bit table over the keys' upper bits turns most
    probes away before the binary search.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        known = [
            i for i in range(self.size)
            if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))
        ]
        self.text = [model.id_to_piece(i) for i in range(self.size)]
        self.bytes = np.full(256, -1, np.int32)
        for i in range(self.size):
            if model.is_byte(i):
                self.bytes[int(self.text[i][3:5], 16)] = i
        if any(SPACE in self.text[i].lstrip(SPACE) for i in known):
            raise ValueError("a piece crosses the start of a word")
        keys = np.array([key_of(self.text[i]) for i in known], np.uint64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ids = keys[order], np.array(known, np.int32)[order]
        if len(np.unique(self.keys)) < len(keys):
            raise ValueError("two pieces share a key")
        self.scores = np.array([model.get_score(i) for i in known], np.float64)[order]
        self.lengths = np.array([len(self.text[i]) for i in known], np.int32)[order]
        self.longest = int(self.lengths.max())
        self.by_length = np.bincount(self.lengths, minlength=self.longest + 1) > 0
        self.sieve = np.zeros(1 << SIEVE_BITS, bool)
        self.sieve[sieve_slot(self.keys)] = True

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows whose key is a piece, and the pieces' positions in the sorted order."""
        rows = np.flatnonzero(self.sieve[sieve_slot(keys)])
        at = np.searchsorted(self.keys, keys[rows])
        at[at == len(self.keys)] = 0
        hit = self.keys[at] == keys[rows]
        return rows[hit], at[hit]


@lru_cache(maxsize=2)
def pieces_of(path: str) -> Pieces:
    """One copy for each Python worker; its size is that of the vocabulary file."""
    return Pieces(path)


def key_of(text: str) -> int:
    key = 0
    for ch in text:
        key = (key * int(BASE) + ord(ch) + 1) % (1 << 64)
    return key


def sieve_slot(keys: np.ndarray) -> np.ndarray:
    return ((keys ^ (keys >> np.uint64(29))) & np.uint64((1 << SIEVE_BITS) - 1)).astype(np.int64)


def code_points(words: list[str], length: int) -> np.ndarray:
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    return flat.reshape(len(words), length)


class Lattice:
    """All piece matches in words of one length, position by position."""

    def __init__(self, pieces: Pieces, words: list[str], length: int):
        self.pieces, self.n, self.length = pieces, len(words), length
        cps = code_points(words, length).astype(np.uint64)
        self.prefix = np.zeros((length + 1, self.n), np.uint64)
        for i in range(length):
            self.prefix[i + 1] = self.prefix[i] * BASE + cps[:, i] + np.uint64(1)
        self.powers = [np.uint64(pow(int(BASE), k, 1 << 64)) for k in range(pieces.longest + 1)]

    def ending(self, end: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(piece length, rows, piece positions) of the matches that end at ``end``, longest first."""
        for size in range(min(end, self.pieces.longest), 0, -1):
            if self.pieces.by_length[size]:
                rows, at = self.pieces.find(self.prefix[end] - self.prefix[end - size] * self.powers[size])
                yield size, rows, at


def same_length(words: list[str], most: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, list[str]]]:
    """Groups of words of equal length: (length, positions, words), at most ``most`` characters each."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(sizes, kind="stable")
    edges = np.flatnonzero(np.diff(sizes[order])) + 1
    for group in np.split(order, edges):
        if len(group):
            length = int(sizes[group[0]])
            step = max(1, most // max(1, length))
            for at in range(0, len(group), step):
                part = group[at : at + step]
                yield length, part, [words[i] for i in part]
