"""Prefix tables as disjoint intervals: one look-up says all about an address.

The prefixes of a table are flattened into sorted intervals that do not overlap.
Each knows whether any prefix covers it, on which interfaces it is direct, and on
which a learned global prefix shares its first 48 bits. Some of the intervals'
starts cut the address space into ranges; an address finds its range by bisection
inside the projection and its interval among the few of that range, in one
broadcast join. Nothing of the packets is shuffled.

That is for tables of at most ``MOST`` prefixes, which is counted first. A larger
one meets the distinct addresses of the packets instead, masked to every length
in use, in one equi-join; the answers come back to the rows by address.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netobs.functions.addr import mask_ip
from netobs.functions.bytes import bits, u8

MOST = 16_384  # prefixes that are flattened on the driver and broadcast
RANGES = 64
NEAR = 48  # bits that make a global address a sibling

Mark = tuple[str, str | None]  # what covers an interval: any prefix, or one of an interface


def marks_of(kind: str, family: int, iface: str | None, lo: int, hi: int) -> Iterator[tuple[Mark, int, int]]:
    """The spans that a prefix marks."""
    yield ("any", None), lo, hi
    if kind == "learned":
        yield ("direct", iface), lo, hi
        if family == 6 and lo >> 125 == 1:  # 2000::/3
            size = 128 - NEAR
            yield ("near", iface), lo >> size << size, (lo >> size << size) + (1 << size) - 1


def flattened(prefixes: list[tuple]) -> list[tuple[int, int, int, frozenset[Mark]]]:
    """(family, first, last, marks) of the disjoint intervals that some prefix (kind, family, iface, lo, hi) covers."""
    out = []
    for family in (4, 6):
        edges: dict[int, list[tuple[Mark, int]]] = {}
        for kind, f, iface, lo, hi in prefixes:
            if f == family:
                for mark, first, last in marks_of(kind, f, iface, int.from_bytes(lo), int.from_bytes(hi)):
                    edges.setdefault(first, []).append((mark, 1))
                    edges.setdefault(last + 1, []).append((mark, -1))
        active: Counter[Mark] = Counter()
        since, marks = None, frozenset()
        for at in sorted(edges):
            for mark, step in edges[at]:
                active[mark] += step
            now = frozenset(m for m, n in active.items() if n > 0)
            if now != marks:
                if marks:
                    out.append((family, since, at - 1, marks))
                since, marks = at, now
    return out


def ordered(ip: Column) -> Column:
    """An address with its family in front, so that bytes sort by both; NULL for other lengths."""
    return F.when(F.length(ip).isin(4, 16), F.concat(F.when(F.length(ip) == 4, F.lit(b"\x04")).otherwise(F.lit(b"\x06")), ip))


def key_of(family: int, address: int) -> bytes:
    return bytes([family]) + address.to_bytes(4 if family == 4 else 16)


def bisected(name: str, starts: list[bytes], below: int = 0) -> str:
    """SQL that counts the sorted ``starts`` not above the column ``name``, by halves."""
    if not starts:
        return str(below)
    mid = len(starts) // 2
    left, right = bisected(name, starts[:mid], below), bisected(name, starts[mid + 1 :], below + mid + 1)
    return f"CASE WHEN {name} < X'{starts[mid].hex()}' THEN {left} ELSE {right} END"


class Lookup:
    """Adds to rows what a prefix table says about an address: ``any``, ``direct`` and ``near`` (interfaces)."""

    SHAPE = "range int, lo binary, hi binary, any boolean, direct array<string>, near array<string>"

    def __init__(self, table: DataFrame):
        self.table = table.select("kind", "family", "iface", "lo", "hi", "prefix_len").distinct()
        rows = self.table.limit(MOST + 1).collect()  # so many at most
        self.small = len(rows) <= MOST
        if self.small:
            self._flatten(table, [tuple(r)[:5] for r in rows])
        else:
            self.lengths = sorted({(r["family"], r["prefix_len"]) for r in table.select("family", "prefix_len").distinct().collect()} | {(6, NEAR)})
        learned = {(r[0], r[2], r[1]) for r in rows} if self.small else {
            ("learned", *r) for r in table.where("kind = 'learned'").select("iface", "family").distinct().collect()
        }  # one row per interface and family
        self.known = sorted((f, i) for k, i, f in learned if k == "learned" and i is not None)

    def _flatten(self, table: DataFrame, prefixes: list[tuple]) -> None:
        spans = flattened(prefixes)
        keys = [key_of(f, lo) for f, lo, _, _ in spans]
        step = max(1, -(-len(keys) // RANGES))
        self.starts = keys[step::step]
        rows = []
        for n, (family, lo, hi, marks) in enumerate(spans):
            ifaces = {k: sorted(i for m, i in marks if m == k and i is not None) for k in ("direct", "near")}
            rows.append((n // step, bytearray(keys[n]), bytearray(key_of(family, hi)), ("any", None) in marks, ifaces["direct"], ifaces["near"]))
        self.intervals = table.sparkSession.createDataFrame(rows, self.SHAPE)

    def knows(self, ip: Column, iface: Column) -> Column:
        """True when a prefix of the address's family was learned on the interface."""
        out = F.lit(False)
        for family, width in ((4, 4), (6, 16)):
            names = [i for f, i in self.known if f == family]
            if names:
                out = out | ((F.length(ip) == width) & iface.isin(*names))
        return out

    def add(self, df: DataFrame, found: dict[str, str]) -> DataFrame:
        """Add a struct ``(any, direct, near)`` for each address column."""
        marked = self._by_interval(df, found) if self.small else self._by_address(df, found)
        none = F.from_json(F.lit('{"any": false, "direct": [], "near": []}'), "any boolean, direct array<string>, near array<string>")
        return marked.withColumns({out: F.coalesce(out, none) for out in found.values()})

    def _by_interval(self, df: DataFrame, found: dict[str, str]) -> DataFrame:
        for ip, out in found.items():
            spans = F.broadcast(
                self.intervals.select(
                    F.col("range").alias("_range"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.struct("any", "direct", "near").alias(out)
                )
            )
            keyed = df.withColumn("_at", ordered(F.col(ip)))
            keyed = keyed.withColumn("_in", F.expr(bisected("_at", self.starts)))
            on = (F.col("_in") == F.col("_range")) & (F.col("_at") >= F.col("_lo")) & (F.col("_at") <= F.col("_hi"))
            df = keyed.join(spans, on, "left").drop("_at", "_in", "_range", "_lo", "_hi")
        return df

    def _by_address(self, df: DataFrame, found: dict[str, str]) -> DataFrame:
        at = F.col("_ip")
        masks = [
            F.struct(F.lit(size).alias("prefix_len"), F.when(F.length(at) == (4 if family == 4 else 16), mask_ip(at, size)).alias("lo"))
            for family, size in self.lengths
        ]
        seen = df.select(F.explode(F.array(*[F.col(ip) for ip in found])).alias("_ip")).where(at.isNotNull()).distinct()
        tried = seen.select("_ip", F.inline(F.array(*masks))).where(F.col("lo").isNotNull())
        learned = F.col("kind") == "learned"
        nets = self.table.select("prefix_len", "lo", F.lit(True).alias("any"), F.when(learned, F.col("iface")).alias("direct"), F.lit(None).cast("string").alias("near"))
        global_ = learned & (F.col("family") == 6) & (bits(u8(F.col("lo"), 0), 224) == 32)
        near = self.table.where(global_).select(
            F.lit(NEAR).alias("prefix_len"), mask_ip(F.col("lo"), NEAR).alias("lo"), F.lit(False).alias("any"),
            F.lit(None).cast("string").alias("direct"), F.col("iface").alias("near"),
        )
        hits = tried.join(nets.unionByName(near), ["prefix_len", "lo"]).groupBy("_ip").agg(
            F.struct(F.max("any").alias("any"), F.collect_set("direct").alias("direct"), F.collect_set("near").alias("near")).alias("_hit")
        )  # interfaces of one address
        for ip, out in found.items():
            mine = hits.select(F.col("_ip").alias(f"_{ip}"), F.col("_hit").alias(out))
            df = df.join(mine, F.col(ip) == F.col(f"_{ip}"), "left").drop(f"_{ip}")
        return df
