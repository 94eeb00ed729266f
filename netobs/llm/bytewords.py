"""Words of many texts at once, as positions and hashes in their UTF-8 bytes.

Everything is array arithmetic on one flat buffer. A word's hash is a polynomial
of its bytes, taken from prefix sums modulo 2^64 and mixed; a window's hash is a
polynomial of its words' hashes in the same way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from netobs.llm.common import WHITE

SEGMENT = 1 << 20  # bytes hashed together
BYTE_BASE, WORD_BASE, OTHER_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F
LENGTH = np.uint64(0xA0761D6478BD642F)
CODES = np.random.default_rng(20240611).integers(0, 1 << 63, 256, dtype=np.uint64)

NOT_WHITE = np.ones(256, bool)
NOT_WHITE[list(WHITE.encode())] = False
# Letters and digits of ASCII and every byte of other characters.
TERM = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the n + 1 edges between them; null counts as empty."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    edges = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8)[edges[0] : edges[-1]] if body is not None else np.zeros(0, np.uint8)
    return data, edges - edges[0]


def spans(data: np.ndarray, edges: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text number) of the maximal runs of ``inside`` bytes within each text."""
    mask = inside[data]
    first, last = mask.copy(), mask.copy()
    first[1:] &= ~mask[:-1]
    last[:-1] &= ~mask[1:]
    full = edges[1:] > edges[:-1]
    heads, tails = edges[:-1][full], edges[1:][full] - 1
    first[heads], last[tails] = mask[heads], mask[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(edges, starts, side="right") - 1


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(WORD_BASE)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(BYTE_BASE)
    return x ^ (x >> np.uint64(32))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


@lru_cache(maxsize=1)
def byte_powers() -> tuple[np.ndarray, np.ndarray]:
    return powers(BYTE_BASE, SEGMENT + 1), powers(pow(BYTE_BASE, -1, 1 << 64), SEGMENT + 1)


def segments(starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of words whose bytes span at most a segment; a longer word stands alone."""
    a = 0
    while a < len(starts):
        b = int(np.searchsorted(ends, starts[a] + SEGMENT, side="right"))
        yield a, max(b, a + 1)
        a = max(b, a + 1)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of every word; with ``lower``, A-Z count as a-z."""
    codes = CODES[LOWER] if lower else CODES
    up, down = byte_powers()
    out = np.empty(len(starts), np.uint64)
    for a, b in segments(starts, ends):
        lo, hi = int(starts[a]), int(ends[b - 1])
        if hi - lo > SEGMENT:
            word = data[lo:hi]
            word = LOWER[word] if lower else word
            out[a] = int.from_bytes(hashlib.blake2b(word.tobytes(), digest_size=8).digest(), "little")
            continue
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(codes[data[lo:hi]] * up[: hi - lo], dtype=np.uint64, out=sums[1:])
        s, e = starts[a:b] - lo, ends[a:b] - lo
        out[a:b] = mixed((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * LENGTH)
    return out


def window_hashes(words: np.ndarray, width: int, base: int = WORD_BASE) -> np.ndarray:
    """A hash of each run of ``width`` consecutive words, by its first word."""
    n = len(words)
    if n < width:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words * powers(base, n), dtype=np.uint64, out=sums[1:])
    down = powers(pow(base, -1, 1 << 64), n - width + 1)
    return mixed((sums[width:] - sums[: n - width + 1]) * down)
