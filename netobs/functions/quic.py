"""QUIC v1 Initial packets: header walk, key schedule, decryption, CRYPTO frames.

Every stage maps an array of structs to the next one, so a datagram with
several coalesced packets stays one row and nothing is shuffled.  Cryptography
uses Spark's own ``sha2``, ``aes_encrypt`` and ``try_aes_decrypt``.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from netobs.functions.bytes import (
    as_col,
    be,
    bits,
    blob,
    drop,
    latin1,
    let,
    s64,
    shl,
    shr,
    take,
    u8,
    u24,
    u32,
    uint,
    varint,
    varint_size,
    varint_value,
    walk,
    zeros,
)

# Version 1 salt and protocol limits.
V1_SALT = "38762cf7f55934b34d179ae6a4c80cadccbb7f0a"
MIN_DATAGRAM = 1200
MAX_CID = 20
MAX_HELLO = (1 << 24) + 3  # a handshake message: four bytes, then a 24-bit length

INITIALS = "array<struct<off:int,span:int,dcid:binary,pn_off:int>>"
FRAGMENTS = "array<struct<off:int,bytes:binary>>"


# -- header walk --------------------------------------------------------------


def _initial_at(b: Column, off: Column) -> Column:
    """``STRUCT<off, span, dcid, pn_off>`` of the Initial at ``off`` or NULL."""
    n = F.length(b)

    def with_dcid(dlen):
        s_pos = off + 6 + dlen
        ok = (dlen <= MAX_CID) & (s_pos < n)
        return F.when(ok, let(u8(b, s_pos), lambda slen: with_scid(dlen, s_pos, slen)))

    def with_scid(dlen, s_pos, slen):
        t_pos = s_pos + 1 + slen
        ok = (slen <= MAX_CID) & (t_pos <= n)
        return F.when(
            ok,
            let(varint(b, t_pos), lambda tok: with_token(dlen, t_pos + tok["n"], tok["v"])),
        )

    def with_token(dlen, after, tok_len):
        return F.when(
            tok_len.isNotNull() & (tok_len <= n - after),
            let((after + tok_len).cast("int"), lambda l_pos: with_length(dlen, l_pos)),
        )

    def with_length(dlen, l_pos):
        return let(
            varint(b, l_pos),
            lambda ln: F.when(
                ln["v"].isNotNull() & (ln["v"] <= n - (l_pos + ln["n"])),
                F.struct(
                    off.cast("int").alias("off"),
                    (l_pos + ln["n"] + ln["v"] - off).cast("int").alias("span"),
                    take(b, off + 6, dlen).alias("dcid"),
                    (l_pos + ln["n"] - off).cast("int").alias("pn_off"),
                ),
            ),
        )

    first = u8(b, off)
    ok = (n - off >= 7) & (bits(first, 240) == 192) & (u32(b, off + 1) == 1)
    return F.when(ok, let(u8(b, off + 5), with_dcid))


def quic_initials(b: Column) -> Column:
    """Coalesced v1 Initial packets of a datagram, in order."""
    # Bound, as every reference to a column of a row copies the datagram.
    found = F.when(F.length(b) >= MIN_DATAGRAM, let(b, _initials_of))
    return F.coalesce(found, F.array().cast(INITIALS))


def _initials_of(b: Column) -> Column:
    def state(pos, out, done):
        return F.struct(pos.cast("int").alias("pos"), out.cast(INITIALS).alias("out"), done.alias("done"))

    def step(s):
        return F.when(
            s["pos"] >= F.length(b), state(s["pos"], s["out"], F.lit(True))
        ).otherwise(
            let(
                _initial_at(b, s["pos"]),
                lambda p: F.when(p.isNull(), state(s["pos"], s["out"], F.lit(True))).otherwise(
                    state(s["pos"] + p["span"], F.concat(s["out"], F.array(p)), F.lit(False))
                ),
            )
        )

    init = state(F.lit(0), F.array(), F.lit(False))
    # The shortest Initial takes nine bytes, which bounds how many can follow each other.
    steps = F.floor(F.length(b) / 9).cast("int") + 1
    none = F.array().cast(INITIALS)

    def after_first(p):
        """Mostly nothing follows the first packet; the walk is for datagrams where something may."""
        alone = F.when(p["span"] < F.length(b), _initial_at(b, p["span"]).isNull()).otherwise(F.lit(True))
        return (
            F.when(p.isNull(), none)
            .when(alone, F.array(p).cast(INITIALS))
            .otherwise(walk(steps, init, step, lambda s: s["done"])["out"])
        )

    return let(_initial_at(b, F.lit(0)), after_first)


# -- key schedule -------------------------------------------------------------


def _sha256(x: Column) -> Column:
    return F.unhex(F.sha2(x, 256))


def _pads(key: Column) -> Column:
    """Inner and outer HMAC blocks of a 32-byte key."""

    def pads(words: Column) -> Column:
        def xored(pad: int) -> Column:
            mask = F.lit(int.from_bytes(bytes([pad]) * 8, "big"))
            text = [F.lpad(F.hex(words[i].bitwiseXOR(mask)), 16, "0") for i in range(4)]
            return F.concat(F.unhex(F.concat(*text)), F.lit(bytes([pad]) * 32))

        return F.struct(xored(0x36).alias("i"), xored(0x5C).alias("o"))

    return let(F.array(*[s64(key, 8 * i) for i in range(4)]), pads)


def _hmac(pads: Column, data: Column) -> Column:
    return _sha256(F.concat(pads["o"], _sha256(F.concat(pads["i"], data))))


def _label(name: str, size: int) -> Column:
    """Expand-label info for the first output block."""
    full = b"tls13 " + name.encode()
    return F.lit(size.to_bytes(2, "big") + bytes([len(full)]) + full + b"\x00\x01")


def _salt_pads() -> Column:
    key = bytes.fromhex(V1_SALT).ljust(hashlib.sha256().block_size, b"\x00")
    return F.struct(
        F.lit(bytes(x ^ 0x36 for x in key)).alias("i"), F.lit(bytes(x ^ 0x5C for x in key)).alias("o")
    )


def quic_client_keys(dcid: Column) -> Column:
    """``STRUCT<key, iv, hp>`` protecting a client's Initial packets."""

    def expand(pads):
        return F.struct(
            take(_hmac(pads, _label("quic key", 16)), 0, 16).alias("key"),
            take(_hmac(pads, _label("quic iv", 12)), 0, 12).alias("iv"),
            take(_hmac(pads, _label("quic hp", 16)), 0, 16).alias("hp"),
        )

    initial = _hmac(_salt_pads(), dcid)
    return let(
        let(initial, lambda prk: let(_pads(prk), lambda p: _hmac(p, _label("client in", 32)))),
        lambda secret: let(_pads(secret), expand),
    )


def header_mask(hp: Column, sample: Column) -> Column:
    """Five mask bytes: first ECB block of the sample."""
    return take(F.aes_encrypt(sample, hp, F.lit("ECB"), F.lit("PKCS")), 0, 5)


def nonce(iv: Column, pn: Column) -> Column:
    """IV with the low 32 bits of the packet number folded into its tail."""
    low = u32(iv, 8).bitwiseXOR(pn.bitwiseAND(F.lit(4294967295)))
    return F.concat(take(iv, 0, 8), be(low, 4))


def quic_packet_number(expected: Column, truncated: Column, pn_len: Column) -> Column:
    """Full packet number nearest to ``expected`` (largest seen + 1, or 0)."""
    win = shl(F.lit(1).cast("bigint"), (pn_len * 8).cast("int"))
    half = F.shiftright(win, 1)
    cand = expected - expected % win + truncated
    return (
        F.when(cand + half <= expected, cand + win)
        .when((cand > expected + half) & (cand >= win), cand - win)
        .otherwise(cand)
    )


def nearest_number(expected: int, truncated: int, size: int) -> int:
    """``quic_packet_number`` of plain integers, ``size`` in bytes."""
    window = 1 << (8 * size)
    number = expected - expected % window + truncated
    if number + window // 2 <= expected:
        return number + window
    if number > expected + window // 2 and number >= window:
        return number - window
    return number


def quic_unprotect(packet: Column, dcid: Column, pn_off: Column) -> Column:
    """Remove header protection.

    ``STRUCT<keys, pn, pn_len, aad, body>`` or NULL when the packet is too
    short or its reserved bits are set.
    """

    def with_mask(keys, mask):
        first = u8(packet, 0).bitwiseXOR(bits(u8(mask, 0), 15))

        def with_first(f):
            pn_len = bits(f, 3) + 1

            def with_pn(pn):
                size = bits(f, 3) + 1
                pn_bytes = F.right(F.hex(be(pn, 4)), size * 2)
                aad = F.concat(
                    be(f, 1), take(packet, F.lit(1), pn_off - 1), F.unhex(pn_bytes)
                )
                return F.struct(
                    keys.alias("keys"),
                    pn.alias("pn"),
                    size.cast("int").alias("pn_len"),
                    aad.alias("aad"),
                    drop(packet, pn_off + size).alias("body"),
                )

            shift = (F.lit(4) - pn_len) * 8
            masked = u32(packet, pn_off).bitwiseXOR(uint(mask, 1, 4))
            return F.when(
                (bits(f, 12) == 0) & (F.length(packet) - pn_off - pn_len > 16),
                let(shr(masked, shift.cast("int")), with_pn),
            )

        return let(first, with_first)

    ok = F.length(packet) >= pn_off + 20
    return F.when(
        ok,
        let(
            quic_client_keys(dcid),
            lambda k: let(header_mask(k["hp"], take(packet, pn_off + 4, 16)), lambda m: with_mask(k, m)),
        ),
    )


def quic_unprotect_at(b: Column, initial: Column) -> Column:
    """``quic_unprotect`` of one of ``quic_initials(b)``; the packet is cut out once."""
    return let(take(b, initial["off"], initial["span"]), lambda p: quic_unprotect(p, initial["dcid"], initial["pn_off"]))


def quic_open(u: Column, pn: Column | None = None) -> Column:
    """Authenticated plaintext of an unprotected packet, NULL when it does not verify."""
    number = u["pn"] if pn is None else pn
    return F.try_aes_decrypt(
        F.concat(nonce(u["keys"]["iv"], number), u["body"]),
        u["keys"]["key"],
        F.lit("GCM"),
        F.lit("DEFAULT"),
        u["aad"],
    )


WINDOWS = 3  # of a truncated number that a packet is tried under, from its own on


def quic_open_any(u: Column, windows: int = WINDOWS) -> Column:
    """``STRUCT<full, plain>`` of the first number under which a packet verifies, NULL when none does.

    A packet verifies under one number only, so a state that knows the largest
    number can choose afterwards without decrypting.
    """

    def tried(k: int) -> Column:
        full = u["pn"] + F.lit(k).cast("bigint") * shl(F.lit(1).cast("bigint"), u["pn_len"] * 8)
        return let(
            quic_open(u, full),
            lambda plain: F.when(plain.isNotNull(), F.struct(full.cast("bigint").alias("full"), plain.alias("plain"))),
        )

    return F.coalesce(*[tried(k) for k in range(windows)])


def quic_decrypt_initial(packet: Column, dcid: Column, pn_off: Column) -> Column:
    return let(quic_unprotect(packet, dcid, pn_off), lambda u: F.when(u.isNotNull(), quic_open(u)))


# -- frames -------------------------------------------------------------------


def crypto_fragments(plain: Column, limit: Column | int = MAX_HELLO) -> Column:
    """CRYPTO frames as ``ARRAY<STRUCT<off, bytes>>`` in frame order.

    Padding, PING and ACK frames are skipped; the walk ends at anything else or
    at a frame that does not fit the packet or ``limit``.
    """
    return F.when(plain.isNotNull(), let(plain, lambda p: _fragments_of(p, as_col(limit))))


def _fragments_of(plain: Column, cap: Column) -> Column:
    n = F.length(plain)

    def state(pos, out, skip, done):
        return F.struct(
            pos.cast("int").alias("pos"),
            out.cast(FRAGMENTS).alias("out"),
            skip.cast("bigint").alias("skip"),
            done.alias("done"),
        )

    def stop(s):
        return state(s["pos"], s["out"], F.lit(0), F.lit(True))

    def step(s):
        pos = s["pos"]

        def crypto(after):
            def with_off(o):
                l_pos = after + varint_size(plain, after)
                return let(
                    F.struct(
                        varint_value(plain, l_pos).alias("v"),
                        (l_pos + varint_size(plain, l_pos)).alias("at"),
                    ),
                    lambda ln: F.when(
                        o.isNull()
                        | ln["v"].isNull()
                        | (o + ln["v"] > cap)
                        | (ln["v"] > n - ln["at"]),
                        stop(s),
                    ).otherwise(
                        state(
                            ln["at"] + ln["v"],
                            F.concat(
                                s["out"],
                                F.array(
                                    F.struct(
                                        o.cast("int").alias("off"),
                                        take(plain, ln["at"], ln["v"].cast("int")).alias("bytes"),
                                    )
                                ),
                            ),
                            F.lit(0),
                            F.lit(False),
                        )
                    ),
                )

            return let(varint_value(plain, after), with_off)

        def ack(after, ecn):
            # largest, delay, range count, first range, then two integers per range (+3 with ECN)
            p1 = after + varint_size(plain, after)
            return let(
                p1 + varint_size(plain, p1),
                lambda p2: let(
                    varint_value(plain, p2),
                    lambda cnt: F.when(cnt.isNull(), stop(s)).otherwise(
                        state(
                            p2 + varint_size(plain, p2),
                            s["out"],
                            cnt * 2 + F.when(ecn, F.lit(4)).otherwise(F.lit(1)),
                            F.lit(False),
                        )
                    ),
                ),
            )

        def skip_one():
            return F.when(varint_value(plain, pos).isNull(), stop(s)).otherwise(
                state(pos + varint_size(plain, pos), s["out"], s["skip"] - 1, F.lit(False))
            )

        def padding():
            """The end of a run of zero bytes, in one step."""
            return let(
                latin1(drop(plain, pos)),
                lambda rest: state(
                    pos + F.length(rest) - F.length(F.ltrim(rest, F.lit("\x00"))), s["out"], F.lit(0), F.lit(False)
                ),
            )

        def with_type(t):
            after = pos + varint_size(plain, pos)
            return (
                F.when(t.isNull(), stop(s))
                .when(u8(plain, pos) == 0, padding())
                .when(t <= 1, state(after, s["out"], F.lit(0), F.lit(False)))
                .when(t <= 3, ack(after, t == 3))
                .when(t == 6, crypto(after))
                .otherwise(stop(s))
            )

        return (
            F.when(pos >= n, stop(s))
            .when(s["skip"] > 0, skip_one())
            .otherwise(let(varint_value(plain, pos), with_type))
        )

    init = state(F.lit(0), F.array(), F.lit(0), F.lit(False))
    none = F.array().cast(FRAGMENTS)

    def zeros_first():
        """How many zero bytes stand at the start; mostly none."""
        rest = latin1(plain)
        return F.when(u8(plain, 0) == 0, F.length(rest) - F.length(F.ltrim(rest, F.lit("\x00")))).otherwise(F.lit(0))

    def padded_from(pos):
        """Only zero bytes from ``pos`` on, compared as a whole."""
        return drop(plain, pos) == F.substring(F.lit(bytes(1 << 16)), F.lit(1), n - pos)

    def one_frame(at):
        """A single CRYPTO frame with padding before and behind it, as most packets have; else the walk."""

        def with_off(o):
            l_pos = at + 1 + o["n"]
            return let(
                let(varint(plain, l_pos), lambda ln: F.struct(o["v"].alias("o"), ln["v"].alias("v"), (l_pos + ln["n"]).alias("at"))),
                lambda f: F.when(
                    f["o"].isNotNull() & f["v"].isNotNull() & (f["o"] + f["v"] <= cap) & (f["v"] <= n - f["at"]),
                    let(
                        (f["at"] + f["v"]).cast("int"),
                        lambda end: F.when(
                            padded_from(end),
                            F.array(F.struct(f["o"].cast("int").alias("off"), take(plain, f["at"], f["v"].cast("int")).alias("bytes"))),
                        ),
                    ),
                ),
            )

        simple = F.when(u8(plain, at) == 6, let(varint(plain, at + 1), with_off))
        return F.when(at >= n, none).otherwise(
            F.coalesce(simple.cast(FRAGMENTS), walk(n, init, step, lambda s: s["done"])["out"])
        )

    return let(zeros_first(), one_frame)


def assemble_hello(frags: Column, cap: Column | int = MAX_HELLO) -> Column:
    """Contiguous ClientHello (``4 + length`` bytes) from fragments, else NULL.

    Later fragments overwrite earlier ones; ``overlay`` keeps bytes and a
    presence mask side by side. A fragment alone is compared as it is.
    """
    return let(frags, lambda f: F.when(F.size(f) == 1, _lone_hello(f[0], cap)).when(F.size(f) > 1, _overlaid_hello(f, cap)))


def _lone_hello(frag: Column, cap: Column | int) -> Column:
    def of(b):
        total = u24(b, 1) + 4
        whole = (frag["off"] == 0) & (F.length(b) >= 4) & (u8(b, 0) == 1) & (total <= F.length(b)) & (total <= as_col(cap))
        return F.when(whole, take(b, 0, total))

    return let(frag["bytes"], of)


def _overlaid_hello(frags: Column, cap: Column | int) -> Column:
    size = F.coalesce(
        F.array_max(F.transform(frags, lambda f: f["off"] + F.length(f["bytes"]))), F.lit(0)
    )

    def place(acc, f):
        ln = F.length(f["bytes"])
        return F.when(ln == 0, acc).otherwise(
            F.struct(
                F.overlay(acc["buf"], f["bytes"], f["off"] + 1, ln).alias("buf"),
                F.overlay(acc["seen"], F.repeat(F.lit("1"), ln), f["off"] + 1, ln).alias("seen"),
            )
        )

    def finish(acc):
        buf, seen = acc["buf"], acc["seen"]
        total = u24(buf, 1) + 4
        whole = (
            (F.length(buf) >= 4)
            & (F.substring(seen, 1, 4) == "1111")
            & (u8(buf, 0) == 1)
            & (total <= F.length(buf))
            & (total <= as_col(cap))
            & (F.substring(seen, F.lit(1), total) == F.repeat(F.lit("1"), total))
        )
        return F.when(whole, take(buf, 0, total))

    def build(n):
        return F.aggregate(
            frags,
            F.struct(zeros(n).alias("buf"), F.repeat(F.lit("0"), n).alias("seen")),
            place,
            finish,
        )

    return let(size, build)


def as_tls_record(hello: Column) -> Column:
    """Prefix a bare handshake message with a TLS record header."""
    return F.concat(blob("160301"), be(F.least(F.length(hello), F.lit(65535)), 2), hello)


def stateless_hello(initials: Column) -> Column:
    """First ClientHello that a single packet carries completely, as a TLS record."""
    hellos = F.transform(
        initials,
        lambda i: F.when(
            i["plain"].isNotNull() & (F.length(i["plain"]) >= 4),
            let(
                F.length(i["plain"]),
                lambda cap: assemble_hello(crypto_fragments(i["plain"], cap), cap),
            ),
        ),
    )
    usable = F.filter(hellos, lambda h: h.isNotNull())
    return let(F.get(usable, F.lit(0)), lambda h: F.when(h.isNotNull(), as_tls_record(h)))
