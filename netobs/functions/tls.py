"""TLS ClientHello fields and the JA4-like client fingerprint."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from netobs.functions.bytes import as_col, bits, let, take, u8, u16, walk
from netobs.functions.text import md5_12, sanitize

EXT_ARRAY = "array<struct<t:int,off:int,len:int>>"


def is_grease(v: Column) -> Column:
    """Reserved noise value: both bytes equal and ending in ``A``."""
    return (bits(v, 15) == 10) & (F.shiftright(v, 8) == bits(v, 255))


def tls_version(v: Column) -> Column:
    # Protocol version codes and their two-letter text.
    return (
        F.when(v == 772, F.lit("13"))
        .when(v == 771, F.lit("12"))
        .when(v == 770, F.lit("11"))
        .when(v == 769, F.lit("10"))
        .when(v == 768, F.lit("s3"))
        .otherwise(F.lit("00"))
    )


def _u16_list(b: Column, off: Column, count: Column) -> Column:
    return F.when(
        count > 0,
        F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: u16(b, off + i * 2)),
    ).otherwise(F.array().cast("array<int>"))


def _extensions(b: Column, start: Column, end: Column) -> Column:
    """Extension headers as ``(t, off, len)``; the last one may overrun ``end``."""

    def state(pos, out):
        return F.struct(pos.cast("int").alias("pos"), out.cast(EXT_ARRAY).alias("out"))

    def step(s):
        pos = s["pos"]
        return let(
            u16(b, pos + 2),
            lambda ln: state(
                pos + 4 + ln,
                F.concat(
                    s["out"],
                    F.array(
                        F.struct(
                            u16(b, pos).alias("t"),
                            (pos + 4).cast("int").alias("off"),
                            ln.cast("int").alias("len"),
                        )
                    ),
                ),
            ),
        )

    steps = F.floor(F.greatest(end - start, F.lit(0)) / 4).cast("int") + 1
    return walk(steps, state(start, F.array()), step, lambda s: s["pos"] + 4 > end)["out"]


def tls_client_hello(b: Column) -> Column:
    """Parsed ClientHello of a record payload, NULL when it is not one.

    ``STRUCT<version, ciphers, ext_ids, has_sni, sni, has_alpn, alpn>``.
    Ciphers and extension ids exclude noise values; ids also exclude the name
    and protocol extensions, which the fingerprint encodes elsewhere.
    """
    # Bound, as every reference to a column of a row copies the record.
    is_hello = (F.length(b) >= 44) & (u8(b, 0) == 22) & (u8(b, 5) == 1)
    return F.when(is_hello, let(b, _client_hello))


def _client_hello(b: Column) -> Column:
    n = F.length(b)
    empty = F.array().cast(EXT_ARRAY)

    def at_ciphers(p):
        clen = u16(b, p)
        return F.when((p + 2 <= n) & (p + 2 + clen <= n), let(p + 2 + clen, lambda q: at_compression(p, q)))

    def at_compression(p, q):
        return F.when(q + 1 <= n, let(q + 1 + u8(b, q), lambda r: at_extensions(p, r)))

    def at_extensions(p, r):
        return F.when(
            r + 2 <= n,
            let(F.least(r + 2 + u16(b, r), n), lambda end: body(p, r + 2, end)),
        )

    def body(p, start, end):
        raw_ciphers = _u16_list(b, p + 2, F.floor(u16(b, p) / 2).cast("int"))
        ciphers = F.filter(raw_ciphers, lambda c: ~is_grease(c))

        def with_ext(exts):
            fit = F.filter(exts, lambda e: e["off"] + e["len"] <= end)
            named = F.struct(
                F.filter(fit, lambda e: (e["t"] == 0) & (e["len"] >= 5)).alias("sni"),
                F.filter(fit, lambda e: (e["t"] == 16) & (e["len"] >= 3)).alias("alpn"),
                F.filter(fit, lambda e: (e["t"] == 43) & (e["len"] >= 3)).alias("versions"),
            )
            return let(named, lambda of: fields(exts, of["sni"], of["alpn"], of["versions"]))

        def fields(exts, sni_ext, alpn_ext, version_ext):
            ids = F.filter(
                F.transform(exts, lambda e: e["t"]), lambda t: (t != 0) & (t != 16) & ~is_grease(t)
            )
            names = F.transform(
                F.filter(
                    sni_ext,
                    lambda e: (u8(b, e["off"] + 2) == 0)
                    & (e["off"] + 5 + u16(b, e["off"] + 3) <= end)
                    & (u16(b, e["off"] + 3) < 256),
                ),
                lambda e: sanitize(take(b, e["off"] + 5, u16(b, e["off"] + 3))),
            )
            protos = F.transform(
                F.filter(
                    alpn_ext,
                    lambda e: (u16(b, e["off"]) > 0)
                    & (u8(b, e["off"] + 2) < 32)
                    & (e["off"] + 3 + u8(b, e["off"] + 2) <= end),
                ),
                lambda e: sanitize(take(b, e["off"] + 3, u8(b, e["off"] + 2))),
            )
            offered = F.transform(
                version_ext,
                lambda e: F.array_max(
                    F.filter(
                        _u16_list(
                            b,
                            e["off"] + 1,
                            F.least(
                                F.floor(u8(b, e["off"]) / 2).cast("int"),
                                F.floor((end - e["off"] - 1) / 2).cast("int"),
                            ),
                        ),
                        lambda v: ~is_grease(v) & (v > 0),
                    )
                ),
            )
            best = F.filter(offered, lambda v: v.isNotNull())
            return F.struct(
                F.coalesce(F.get(best, F.size(best) - 1), u16(b, 9)).alias("version"),
                ciphers.alias("ciphers"),
                ids.alias("ext_ids"),
                (F.size(sni_ext) > 0).alias("has_sni"),
                F.get(F.filter(names, lambda s: s != ""), F.lit(0)).alias("sni"),
                (F.size(alpn_ext) > 0).alias("has_alpn"),
                F.get(F.filter(protos, lambda s: s != ""), F.lit(0)).alias("alpn"),
            )

        return let(F.coalesce(_extensions(b, start, end), empty), with_ext)

    return let(as_col(44) + u8(b, 43), lambda p: F.when(p < n + 1, at_ciphers(p)))


def hex_list(ids: Column) -> Column:
    return F.array_join(
        F.transform(ids, lambda v: F.lpad(F.lower(F.hex(v.cast("bigint"))), 4, "0")), ","
    )


def _two_digits(n: Column) -> Column:
    return F.lpad(F.least(n, F.lit(99)).cast("string"), 2, "0")


def ja4_like(hello: Column, compat: bool = True) -> Column:
    """Client fingerprint ``a_b_c`` over a ``tls_client_hello`` struct.

    Ciphers are hashed in wire order and extension ids sorted, both with MD5 cut
    to 12 digits.  With ``compat`` an offered but empty protocol list counts as
    the text ``none``, so its end characters are ``n`` and ``e``.
    """
    shown = F.when(hello["has_alpn"], F.coalesce(hello["alpn"], F.lit("none" if compat else "")))
    first = F.when(F.length(shown) > 0, F.substring(shown, 1, 1)).otherwise(F.lit("0"))
    last = F.when(F.length(shown) > 0, F.right(shown, F.lit(1))).otherwise(F.lit("0"))
    head = F.concat(
        F.lit("t"),
        tls_version(hello["version"]),
        F.when(hello["has_sni"], F.lit("d")).otherwise(F.lit("i")),
        _two_digits(F.size(hello["ciphers"])),
        _two_digits(F.size(hello["ext_ids"])),
        first,
        last,
    )
    return F.concat_ws(
        "_",
        head,
        md5_12(hex_list(hello["ciphers"])),
        md5_12(hex_list(F.array_sort(hello["ext_ids"]))),
    )


def hello_complete(b: Column) -> Column:
    """True when the whole handshake message is inside this payload."""
    n = F.length(b)
    return F.coalesce(
        (n >= 9) & (u8(b, 0) == 22) & (u8(b, 5) == 1) & (u16(b, 6) * 256 + u8(b, 8) <= n - 9), F.lit(False)
    )
