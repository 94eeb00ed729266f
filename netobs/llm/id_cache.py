"""Ids of texts made word by word, with the ids of recent words kept."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np

CACHED_WORDS = 1_000_000


class Slots(dict):
    """Numbers words as they come; ``new`` are those that came first since it was emptied."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = slot = len(self)
        self.new.append(word)
        return slot


class IdCache:
    """Looks words up; ``make`` gives new words' ids, flat, and how many each has.

    At most ``CACHED_WORDS`` words are kept, beyond those of the texts at hand.
    """

    def __init__(self, make: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]):
        self.make = make
        self.clear()

    def clear(self) -> None:
        self.slot = Slots()
        self.flat = np.zeros(0, np.uint32)
        self.start = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)

    def learn(self) -> None:
        flat, size = self.make(self.slot.new)
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, flat])
        self.slot.new = []

    def encode(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The ids of each text, given as its words."""
        if not texts:
            return []
        if len(self.slot) > CACHED_WORDS:
            self.clear()
        words = np.fromiter(map(len, texts), np.int64, len(texts))
        at = np.fromiter(map(self.slot.__getitem__, chain.from_iterable(texts)), np.int64, int(words.sum()))
        if self.slot.new:
            self.learn()
        size = self.size[at]
        ends = np.concatenate([[0], np.cumsum(size)])
        flat = self.flat[np.repeat(self.start[at] - ends[:-1], size) + np.arange(ends[-1])]
        return np.split(flat, ends[np.cumsum(words)][:-1])
