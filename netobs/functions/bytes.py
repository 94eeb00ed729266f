"""Big-endian access to BINARY columns, written with built-in expressions only.

Offsets are zero based and may be Python ints or integer columns.  Reading past
the end gives NULL (``u8``..``u64``) or a shorter slice (``take``), so callers
guard with ``length`` exactly once, in a ``where`` or a ``when``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

IntLike = int | Column


def as_col(x: IntLike) -> Column:
    return F.lit(x) if isinstance(x, int) else x


def take(b: Column, off: IntLike, n: IntLike) -> Column:
    """``n`` bytes starting at ``off``; empty when ``n`` is not positive."""
    size = as_col(n) if isinstance(n, int) else F.greatest(n, F.lit(0))
    return F.substring(b, as_col(off) + 1, size)


def drop(b: Column, off: IntLike) -> Column:
    """Everything from ``off`` to the end."""
    return F.substring(b, as_col(off) + 1, F.length(b))


def uint(b: Column, off: IntLike, n: int) -> Column:
    """Unsigned big-endian integer of ``n`` <= 7 bytes as BIGINT."""
    return F.conv(F.hex(take(b, off, n)), 16, 10).cast("bigint")


def u8(b: Column, off: IntLike) -> Column:
    return uint(b, off, 1).cast("int")


def u16(b: Column, off: IntLike) -> Column:
    return uint(b, off, 2).cast("int")


def u24(b: Column, off: IntLike) -> Column:
    return uint(b, off, 3).cast("int")


def u32(b: Column, off: IntLike) -> Column:
    return uint(b, off, 4)


def s64(b: Column, off: IntLike) -> Column:
    """Eight bytes as a signed BIGINT (two's complement)."""
    return F.conv(F.hex(take(b, off, 8)), 16, -10).cast("bigint")


def be(x: Column, n: int) -> Column:
    """Non-negative integer to ``n`` big-endian bytes."""
    return F.unhex(F.lpad(F.hex(x.cast("bigint")), 2 * n, "0"))


def bits(x: Column, mask: int) -> Column:
    return x.bitwiseAND(F.lit(mask))


def shl(x: Column, n: IntLike) -> Column:
    """Shift left by a count that may be a column."""
    return F.call_function("shiftleft", x, as_col(n))


def shr(x: Column, n: IntLike) -> Column:
    return F.call_function("shiftright", x, as_col(n))


def blob(hexstr: str) -> Column:
    """Binary literal from hex text."""
    return F.lit(bytes.fromhex(hexstr))


def zeros(n: IntLike) -> Column:
    return F.unhex(F.repeat(F.lit("00"), as_col(n)))


def latin1(b: Column) -> Column:
    """One character per byte."""
    return F.decode(b, "ISO-8859-1")


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """Evaluate ``x`` once and use it several times inside ``f``."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def varint_size(b: Column, pos: IntLike) -> Column:
    """Length in bytes of the variable-length integer at ``pos`` (1, 2, 4 or 8)."""
    return shl(F.lit(1), shr(u8(b, pos), 6))


def varint_value(b: Column, pos: IntLike) -> Column:
    """Variable-length integer: top two bits give the width; NULL if cut short."""
    p = as_col(pos)
    first = u8(b, p)
    kind = F.shiftright(first, 6)
    fits = p + varint_size(b, p) <= F.length(b)
    low = bits(first, 63).cast("bigint")
    return F.when(
        (p >= 0) & (p < F.length(b)) & fits,
        F.when(kind == 0, low)
        .when(kind == 1, bits(u16(b, p), 16383).cast("bigint"))
        .when(kind == 2, u32(b, p).bitwiseAND(F.lit(1073741823)))
        .otherwise(F.shiftleft(low, 56) + uint(b, p + 1, 7)),
    )


def varint(b: Column, pos: IntLike) -> Column:
    """``STRUCT<v, n>``: ``varint_value`` and ``varint_size`` at ``pos``, the first byte read once."""
    p = as_col(pos)

    def of(first):
        size = shl(F.lit(1), shr(first, 6))
        low = bits(first, 63).cast("bigint")
        value = (
            F.when(first < 64, low)
            .when(first < 128, bits(u16(b, p), 16383).cast("bigint"))
            .when(first < 192, u32(b, p).bitwiseAND(F.lit(1073741823)))
            .otherwise(F.shiftleft(low, 56) + uint(b, p + 1, 7))
        )
        return F.struct(F.when((p >= 0) & (p + size <= F.length(b)), value).alias("v"), size.alias("n"))

    return let(u8(b, p), of)


def walk(
    steps: IntLike,
    init: Column,
    step: Callable[[Column], Column],
    done: Callable[[Column], Column],
) -> Column:
    """Bounded state walk: apply ``step`` until ``done`` or ``steps`` rounds.

    The state is a struct; ``steps`` is derived from the input length, so the
    walk covers the whole input and still always ends.
    """
    return F.aggregate(
        F.sequence(F.lit(1), F.greatest(as_col(steps), F.lit(1))),
        init,
        lambda s, _i: F.when(done(s), s).otherwise(step(s)),
    )
