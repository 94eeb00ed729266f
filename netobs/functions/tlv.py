"""Type-length-value walks used by TCP options, LLDP, DHCP, DHCPv6 and NDP.

Each walk yields ``ARRAY<STRUCT<t, v>>`` in wire order and stops where the
format says so: at an end marker, a zero length or an element that overruns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from netobs.functions.bytes import bits, let, take, u8, u16, walk

TLV_ARRAY = "array<struct<t:int,v:binary>>"


def _elements(
    b: Column, min_size: int, head: Callable[[Column], tuple[Column, Column, Column, Column, Column]]
) -> Column:
    """``head(pos)`` gives ``(stop, skip, type, value_offset, value_length)``."""
    n = F.length(b)

    def state(pos, out, done):
        return F.struct(pos.cast("int").alias("pos"), out.cast(TLV_ARRAY).alias("out"), done.alias("done"))

    def step(s):
        pos = s["pos"]
        stop, skip, typ, voff, vlen = head(pos)
        item = F.struct(typ.cast("int").alias("t"), take(b, voff, vlen).alias("v"))
        return (
            F.when(stop, state(pos, s["out"], F.lit(True)))
            .when(skip, state(pos + 1, s["out"], F.lit(False)))
            .when(voff + vlen > n, state(pos, s["out"], F.lit(True)))
            .otherwise(state(voff + vlen, F.concat(s["out"], F.array(item)), F.lit(False)))
        )

    init = state(F.lit(0), F.array(), F.lit(False))
    steps = F.floor(F.coalesce(n, F.lit(0)) / min_size).cast("int") + 1
    return walk(steps, init, step, lambda s: s["done"])["out"]


def tlv16(b: Column) -> Column:
    """7-bit type, 9-bit length (LLDP); type 0 ends the list."""
    n = F.length(b)

    def head(pos):
        typ = F.shiftright(u8(b, pos), 1)
        return (pos + 2 > n) | (typ == 0), F.lit(False), typ, pos + 2, bits(u16(b, pos), 511)

    return _elements(b, 2, head)


def opt8(b: Column) -> Column:
    """8-bit code, 8-bit length (DHCP); 0 pads, 255 ends."""
    n = F.length(b)

    def head(pos):
        code = u8(b, pos)
        stop = (pos >= n) | (code == 255) | ((code != 0) & (pos + 1 >= n))
        return stop, code == 0, code, pos + 2, u8(b, pos + 1)

    return _elements(b, 1, head)


def opt16(b: Column) -> Column:
    """16-bit code, 16-bit length (DHCPv6)."""
    n = F.length(b)

    def head(pos):
        return pos + 4 > n, F.lit(False), u16(b, pos), pos + 4, u16(b, pos + 2)

    return _elements(b, 4, head)


def ndp_opts(b: Column) -> Column:
    """8-bit type, length in units of eight bytes; ``v`` is the whole option."""
    n = F.length(b)

    def head(pos):
        units = u8(b, pos + 1)
        return (pos + 2 > n) | (units == 0), F.lit(False), u8(b, pos), pos, units * 8

    return _elements(b, 8, head)


def first_of(opts: Column, typ: int, min_len: int = 0) -> Column:
    hits = F.filter(opts, lambda o: (o["t"] == typ) & (F.length(o["v"]) >= min_len))
    return F.get(hits, F.lit(0))["v"]


def last_of(opts: Column, typ: int, min_len: int = 0) -> Column:
    hits = F.filter(opts, lambda o: (o["t"] == typ) & (F.length(o["v"]) >= min_len))
    return F.get(hits, F.size(hits) - 1)["v"]


def tcp_options(opts: Column) -> Column:
    """``STRUCT<mss, wscale, opts>`` of a TCP option block.

    ``opts`` lists the kinds in order: ``M*`` MSS, ``W*`` window scale, ``S``
    SACK permitted, ``T`` timestamps, ``N`` padding, ``E`` end, ``?`` other.
    A kind needs its exact length, else it counts as other.  NULL when absent.
    """
    n = F.length(opts)
    null_int = F.lit(None).cast("int")

    def state(pos, mss, wscale, text, done):
        return F.struct(
            pos.cast("int").alias("pos"),
            mss.cast("int").alias("mss"),
            wscale.cast("int").alias("wscale"),
            text.alias("text"),
            done.alias("done"),
        )

    def step(s):
        pos, text = s["pos"], s["text"]

        def add(token):
            return F.concat(text, F.when(text == "", F.lit("")).otherwise(F.lit(",")), token)

        def stop(t=None):
            return state(pos, s["mss"], s["wscale"], text if t is None else t, F.lit(True))

        def with_kind(kind):
            def with_len(ln):
                is_mss = (kind == 2) & (ln == 4)
                is_ws = (kind == 3) & (ln == 3)
                token = (
                    F.when(is_mss, F.lit("M*"))
                    .when(is_ws, F.lit("W*"))
                    .when((kind == 4) & (ln == 2), F.lit("S"))
                    .when((kind == 8) & (ln == 10), F.lit("T"))
                    .otherwise(F.lit("?"))
                )
                return F.when((ln < 2) | (pos + ln > n), stop()).otherwise(
                    state(
                        pos + ln,
                        F.when(is_mss, u16(opts, pos + 2)).otherwise(s["mss"]),
                        F.when(is_ws, u8(opts, pos + 2)).otherwise(s["wscale"]),
                        add(token),
                        F.lit(False),
                    )
                )

            return (
                F.when(kind == 0, stop(add(F.lit("E"))))
                .when(kind == 1, state(pos + 1, s["mss"], s["wscale"], add(F.lit("N")), F.lit(False)))
                .when(pos + 1 >= n, stop())
                .otherwise(let(u8(opts, pos + 1), with_len))
            )

        return F.when(pos >= n, stop()).otherwise(let(u8(opts, pos), with_kind))

    init = state(F.lit(0), null_int, null_int, F.lit(""), F.lit(False))
    end = walk(F.coalesce(n, F.lit(0)) + 1, init, step, lambda s: s["done"])
    return let(
        end,
        lambda e: F.struct(
            e["mss"].alias("mss"),
            e["wscale"].alias("wscale"),
            F.when(e["text"] != "", e["text"]).alias("opts"),
        ),
    )
