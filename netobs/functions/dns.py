"""Name decoding: DNS labels and pointers, NetBIOS half-ASCII, DHCPv6 FQDN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from netobs.functions.bytes import IntLike, as_col, bits, latin1, let, take, u8, u16, walk

# Protocol limits: a name has at most 255 octets, so at most 127 labels with as
# many pointers before them, and its end.
NAME_MAX = 255
NAME_STEPS = 255


def dns_name(b: Column, start: IntLike, max_len: int = NAME_MAX) -> Column:
    """Dotted lower-case name at ``start``; follows pointers.

    After a pointer chain ends, reading resumes behind the first pointer until
    the next zero label, which is harmless for question names because the next
    byte is the high byte of QTYPE.
    """
    n = F.length(b)

    def state(pos, resume, out, done):
        return F.struct(
            pos.cast("int").alias("pos"),
            resume.cast("int").alias("resume"),
            out.alias("out"),
            done.alias("done"),
        )

    def finish(s):
        return state(s["pos"], s["resume"], s["out"], F.lit(True))

    def step(s):
        pos = s["pos"]

        def with_len(ln):
            label = F.regexp_replace(latin1(take(b, pos + 1, ln)), "[^A-Za-z0-9_-]", ".")
            joined = F.concat(s["out"], F.when(s["out"] != "", F.lit(".")).otherwise(F.lit("")), F.lower(label))
            target = bits(u16(b, pos), 16383)
            back = F.when(s["resume"] == -1, pos + 2).otherwise(s["resume"])
            return (
                F.when(
                    ln == 0,
                    F.when(s["resume"] == -1, finish(s)).otherwise(
                        state(s["resume"], F.lit(-1), s["out"], F.lit(False))
                    ),
                )
                .when(
                    bits(ln, 192) == 192,
                    F.when(pos + 1 >= n, finish(s)).otherwise(state(target, back, s["out"], F.lit(False))),
                )
                .when((ln > 63) | (pos + 1 + ln > n), finish(s))
                .otherwise(state(pos + 1 + ln, s["resume"], joined, F.lit(False)))
            )

        return F.when(pos >= n, finish(s)).otherwise(let(u8(b, pos), with_len))

    init = state(as_col(start), F.lit(-1), F.lit(""), F.lit(False))
    out = walk(F.least(n + 1, F.lit(NAME_STEPS)), init, step, lambda s: s["done"])
    return F.substring(out["out"], 1, max_len)


def dns_qtype(b: Column, start: IntLike) -> Column:
    """Type of the first question, 0 when it cannot be read."""
    n = F.length(b)

    def state(pos, ok, done):
        return F.struct(pos.cast("int").alias("pos"), ok.alias("ok"), done.alias("done"))

    def step(s):
        pos = s["pos"]

        def with_len(ln):
            return (
                F.when(ln == 0, state(pos + 1, F.lit(True), F.lit(True)))
                .when(bits(ln, 192) == 192, state(pos + 2, pos + 2 <= n, F.lit(True)))
                .when((ln > 63) | (pos + 1 + ln > n), state(pos, F.lit(False), F.lit(True)))
                .otherwise(state(pos + 1 + ln, F.lit(True), F.lit(False)))
            )

        return F.when(pos >= n, state(pos, F.lit(True), F.lit(True))).otherwise(let(u8(b, pos), with_len))

    init = state(as_col(start), as_col(start) < n, F.lit(False))
    end = walk(F.floor(n / 2).cast("int") + 1, init, step, lambda s: s["done"])
    return let(end, lambda e: F.when(e["ok"] & (e["pos"] + 4 <= n), u16(b, e["pos"])).otherwise(F.lit(0)))


def netbios_name(enc: Column) -> Column:
    """32 half-ASCII bytes (``A``..``P`` pairs) to the host name."""
    pairs = F.regexp_extract(latin1(enc), "^((?:[A-P]{2}){0,16})", 1)
    digits = F.translate(pairs, "ABCDEFGHIJKLMNOP", "0123456789ABCDEF")
    kept = F.regexp_extract(digits, "^((?:(?!00|20)[0-9A-F]{2})*)", 1)
    return F.rtrim(F.regexp_replace(latin1(F.unhex(kept)), "[^\\x20-\\x7E]|\\|", " "))


def dhcp6_name(b: Column, max_len: int = NAME_MAX) -> Column:
    """Uncompressed labels; NULL when malformed, empty or longer than ``max_len``."""
    n = F.length(b)

    def state(pos, out, ok, done):
        return F.struct(pos.cast("int").alias("pos"), out.alias("out"), ok.alias("ok"), done.alias("done"))

    def step(s):
        pos = s["pos"]

        def with_len(ln):
            label = F.regexp_replace(latin1(take(b, pos + 1, ln)), "[^\\x20-\\x7E]|\\|", "_")
            joined = F.concat(s["out"], F.when(s["out"] != "", F.lit(".")).otherwise(F.lit("")), label)
            return (
                F.when(ln == 0, state(pos, s["out"], F.lit(True), F.lit(True)))
                .when((ln > 63) | (pos + 1 + ln > n), state(pos, s["out"], F.lit(False), F.lit(True)))
                .otherwise(state(pos + 1 + ln, joined, F.lit(True), F.lit(False)))
            )

        return F.when(pos >= n, state(pos, s["out"], F.lit(True), F.lit(True))).otherwise(
            let(u8(b, pos), with_len)
        )

    init = state(F.lit(0), F.lit(""), F.lit(True), F.lit(False))
    end = walk(n, init, step, lambda s: s["done"])
    return let(
        end,
        lambda e: F.when(e["ok"] & (e["out"] != "") & (F.length(e["out"]) <= max_len), e["out"]),
    )
