"""Text helpers: sanitising, entropy, fingerprints of strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from netobs.functions.bytes import latin1

UNSAFE = "[^\\x20-\\x7E]|\\|"


def sanitize(raw: Column, max_len: int | None = None, lower: bool = False) -> Column:
    """Bytes to printable ASCII: other bytes and ``|`` become blanks."""
    text = F.regexp_replace(latin1(raw), UNSAFE, " ")
    if lower:
        text = F.lower(text)
    return text if max_len is None else F.substring(text, 1, max_len)


def sanitize_text(col: Column, max_len: int | None = None, lower: bool = False) -> Column:
    """``sanitize`` for a STRING column, one blank per UTF-8 byte."""
    return sanitize(F.encode(col, "UTF-8"), max_len, lower)


def until_nul(raw: Column) -> Column:
    """Bytes up to the first NUL, as text with one character per byte."""
    return F.substring_index(latin1(raw), "\x00", 1)


def entropy(s: Column) -> Column:
    """Shannon entropy in bits per character; 0 for the empty string.

    Counts each distinct character by how much shorter the text gets without
    it, so the cost is linear in the text for a fixed alphabet and no UDF runs.
    """
    n = F.length(s).cast("double")
    parts = F.transform(
        F.array_distinct(F.split(s, "")),
        lambda ch: (n - F.length(F.replace(s, ch, F.lit("")))) / n,
    )
    total = F.aggregate(
        F.filter(parts, lambda p: p > 0),
        F.lit(0.0),
        lambda acc, p: acc - p * F.log2(p),
    )
    return F.when(F.length(s) == 0, F.lit(0.0)).otherwise(total)


def md5_12(s: Column) -> Column:
    return F.substring(F.md5(s), 1, 12)


def find_ci(haystack: Column, needle: str) -> Column:
    """1-based position of ``needle`` ignoring case, 0 when absent (text, one char per byte)."""
    return F.instr(F.lower(haystack), needle.lower())
