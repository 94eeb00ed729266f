"""Round trips through WARC archives, and the splittable reader's corner cases."""

from __future__ import annotations

import base64
import gzip
import hashlib

import pytest

from netobs.llm import warc
from netobs.llm.common import Scratch

PAGES = "page_id long, url string, html string, k string, path string, sha string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y", "z") for i, u, h in rows], PAGES)


ROWS = [
    (1, "http://a.example/1", "<p>one</p>"), (2, "http://a.example/2", "<p>one</p>"), (3, None, None), (4, "u\r\nv w", ""),
    (5, "http://b.example", "é" * 70000), (9, "http://b.example", "<p>one</p>"), (None, "http://n.example", "alone"),
    (None, "http://n.example", "<p>one</p>"), (7, "http://c.example", "HTTP\r\n\r\nWARC/1.1\r\n\r\n"), (9, "http://b.example", "<p>one</p>"),
]


def sha1(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def expected(rows, least=0):
    out = []
    for i, _, h in rows:
        same = [j for j, _, x in rows if (x or "") == (h or "") and j is not None]
        size = len((h or "").encode())
        again = bool(same) and i != max(same) and size >= least
        out.append((str(i), "revisit" if again else "response", f"urn:page:{max(same)}" if again else None, size, sha1(h), h or ""))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 1, 1000])
def test_round_trip(spark, least):
    got = warc.round_trip(pages(spark, ROWS), least).collect()
    rows = []
    by_id = {r.record_id: r for r in got if r.record_type == "response"}
    for r in got:
        source = r if r.record_type == "response" else by_id[r.refers_to]
        rows.append((
            r.record_id.removeprefix("urn:page:") or "None", r.record_type, r.refers_to, r.payload_bytes, r.digest,
            bytes(source.payload).decode(),
        ))
        assert source.payload_bytes == r.payload_bytes
    assert sorted(rows, key=str) == expected(ROWS, least)


@pytest.mark.parametrize("split", [37, 1000, 1 << 20])
def test_every_record_is_read_once_whatever_the_ranges(spark, split):
    rows = [(i, f"http://e.example/{i}", f"{i} " * (i % 90)) for i in range(120)]
    scratch = Scratch(spark, "test")
    files = scratch.save(warc.write_archives(warc.records_of(pages(spark, rows)), scratch.path("w"), file_bytes=5000), "files")
    assert sum(f.records for f in files.collect()) == 120 and files.count() > 1
    got = warc.read_archives(files, split).collect()
    assert sorted(r.record_id for r in got) == sorted(f"urn:page:{i}" for i, _, _ in rows)


class Bytes:
    def __init__(self, data):
        self.data = data

    def read_at(self, n, at):
        return self.data[at : at + n]


def test_false_magic_and_other_members_are_passed_over():
    def record(i):
        return gzip.compress(warc.record_bytes({"record_id": f"r{i}", "uri": "u", "refers_to": None, "digest": "D", "payload_bytes": 3, "payload": b"abc"}, "d"))

    junk = b"\x1f\x8b\x08 no member" + gzip.compress(b"not a record") + warc.MAGIC
    data = record(1) + junk + record(2) + b"\0" * 40 + record(3)
    for split in (1, 7, 50, 10**6):
        found = [warc.parsed(c)["record_id"] for s in range(0, len(data), split) for _, c in warc.members(Bytes(data), len(data), s, s + split)]
        assert found == ["r1", "r2", "r3"]
    cut = data[:-5]
    assert [warc.parsed(c)["record_id"] for _, c in warc.members(Bytes(cut), len(cut), 0, len(cut))] == ["r1", "r2"]


def test_no_pages(spark):
    assert warc.round_trip(pages(spark, ROWS[:0])).count() == 0


def test_base32(spark):
    from pyspark.sql import functions as F

    rows = [(None, None, "x" * i) for i in range(50)]
    got = pages(spark, rows).select("html", warc.base32_sha1(F.encode("html", "UTF-8")).alias("d")).collect()
    assert all(r.d == sha1(r.html) for r in got)
