"""WARC archives: written by the tasks that hold the pages, read back by byte ranges.

Every record is a gzip member of its own. A reading task gets a byte range of a
file, looks for the gzip magic, takes a candidate for a record only if it decodes
to a WARC header, and owns the records that start inside its range, to their ends
beyond it. Files are reached through the Arrow file system of the folder's URI.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netobs.llm.common import Scratch, lean

MAGIC = b"\x1f\x8b\x08"
FILE_BYTES = 256 << 20  # a task starts its next file beyond this size
SPLIT_BYTES = 16 << 20
STEP = 1 << 20
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
WRITTEN = "path string, length long, records long"
READ = "path string, at long, record_id string, record_type string, uri string, refers_to string, digest string, payload_bytes long, payload binary"


def base32_sha1(data: Column) -> Column:
    """SHA-1 in bare upper-case base32: 40 hex digits are 8 groups of 20 bits, 4 letters each."""
    digest = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*groups)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def revisits(pages: DataFrame, least_bytes: int = 0, key: str = "page_id", text: str = "html") -> DataFrame:
    """(key, sha, refers_to): rows whose payload equals that of a row with a larger key.

    Payloads under ``least_bytes`` refer to nothing. Null keys come before all
    others; rows that repeat the largest key refer to nothing either.
    """
    body = payload(F.col(text))
    slim = pages.select(F.col(key).alias("k"), F.sha2(body, 256).alias("sha"), F.octet_length(body).alias("size"))
    slim = slim.where(F.col("size") >= least_bytes).groupBy("k", "sha").agg(F.lit(1)).select("k", "sha")
    last = slim.groupBy("sha").agg(F.max("k").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    both = slim.join(last.select("sha", "refers_to"), "sha")
    return both.where(~F.col("k").eqNullSafe(F.col("refers_to")))


def payload(html: Column) -> Column:
    return F.encode(F.coalesce(html, F.lit("")), "UTF-8")


def urn(key: Column) -> Column:
    return F.concat(F.lit("urn:page:"), F.coalesce(key.cast("string"), F.lit("")))


def records_of(pages: DataFrame, least_bytes: int = 0, key: str = "page_id", uri: str = "url", text: str = "html") -> DataFrame:
    """(record_id, uri, refers_to, digest, payload_bytes, payload) per page; a revisit has no payload."""
    body = payload(F.col(text))
    wide = pages.select(F.col(key).alias("k"), F.col(uri).alias("uri"), body.alias("payload"), F.sha2(body, 256).alias("sha"))
    again = revisits(pages, least_bytes, key, text).select(F.col("k").alias("k2"), F.col("sha").alias("sha2"), "refers_to")
    on = F.col("k").eqNullSafe(F.col("k2")) & (F.col("sha") == F.col("sha2"))
    joined = wide.join(again, on, "left")
    visit = F.col("k2").isNotNull() | F.col("sha2").isNotNull()
    return joined.select(
        urn(F.col("k")).alias("record_id"),
        F.regexp_replace(F.coalesce("uri", urn(F.col("k"))), r"[\x00-\x20\x7f]", "_").alias("uri"),
        F.when(visit, urn(F.col("refers_to"))).alias("refers_to"),
        base32_sha1(F.col("payload")).alias("digest"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.when(~visit, F.col("payload")).alias("payload"),
    )


def record_bytes(row: dict, date: str) -> bytes:
    """One record: WARC header, then the HTTP response, without its body in a revisit."""
    visit = row["refers_to"] is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n"
    block = http.encode() + (b"" if visit else row["payload"])
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if visit else 'response'}", f"WARC-Record-ID: <{row['record_id']}>",
        f"WARC-Date: {date}", f"WARC-Target-URI: {row['uri']}", f"WARC-Payload-Digest: sha1:{row['digest']}",
    ]
    if visit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{row['refers_to']}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(records: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write records into files under ``folder``; (path, length, records) per file.

    Save the result: the rows that a committed task returned are the files that
    count. A task that is run again writes files of other names.
    """

    def write(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        done: list[tuple[str, int, int]] = []
        out, path, n = None, "", 0
        for frame in frames:
            for row in frame.to_pylist():
                if out is None:
                    path = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                    out, n = store.open_output_stream(f"{root}/{path}", compression=None), 0
                press = zlib.compressobj(6, zlib.DEFLATED, 31)
                out.write(press.compress(record_bytes(row, date)) + press.flush())
                n += 1
                if out.tell() >= file_bytes:
                    done.append((f"{folder}/{path}", out.tell(), n))
                    out.close()
                    out = None
        if out is not None:
            done.append((f"{folder}/{path}", out.tell(), n))
            out.close()
        yield pa.RecordBatch.from_pylist([dict(zip(("path", "length", "records"), x, strict=True)) for x in done], schema=pa.schema(
            [("path", pa.string()), ("length", pa.int64()), ("records", pa.int64())]))

    return records.mapInArrow(lean(write), WRITTEN)


class Window:
    """Bytes of a file from some place on, read in steps as they are needed."""

    def __init__(self, file, size: int, start: int):
        self.file, self.size, self.start, self.data = file, size, start, b""

    def more(self, step: int = STEP) -> bool:
        at = self.start + len(self.data)
        if at >= self.size:
            return False
        self.data += self.file.read_at(min(step, self.size - at), at)
        return True

    def drop_before(self, at: int) -> None:
        self.data, self.start = self.data[at - self.start :], at


def member(window: Window, at: int) -> tuple[bytes, int] | None:
    """Content and end of the gzip member at ``at``, if it is whole and starts a WARC record."""
    inflate, out, place, checked = zlib.decompressobj(31), [], at - window.start, False
    while True:
        try:
            out.append(inflate.decompress(window.data[place : place + STEP]))
        except zlib.error:
            return None
        place = min(place + STEP, len(window.data))
        if not checked and sum(map(len, out)) >= 7:
            if not b"".join(out).startswith(b"WARC/1."):
                return None
            checked = True
        if inflate.eof:
            return (b"".join(out), window.start + place - len(inflate.unused_data)) if checked else None
        if place >= len(window.data) and not window.more():
            return None


def members(file, size: int, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of the records that start in [start, end)."""
    window, at = Window(file, size, start), start
    while at < end:
        while len(window.data) - (at - window.start) < len(MAGIC) and window.more():
            pass
        found = window.data.find(MAGIC, at - window.start)
        if found < 0:
            at = max(at, window.start + len(window.data) - len(MAGIC) + 1)
            window.drop_before(at)
            if not window.more():
                return
            continue
        at = window.start + found
        if at >= end:
            return
        window.drop_before(at)
        got = member(window, at)
        if got is None:
            at += 1
            continue
        yield at, got[0]
        at = got[1]
        window.drop_before(at)


def parsed(content: bytes) -> dict:
    """Fields of a record; the payload is what follows the HTTP header."""
    head, _, block = content.partition(b"\r\n\r\n")
    fields = dict(
        (k.strip().lower(), v.strip())
        for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    )
    block = block[: int(fields.get("content-length", 0))]
    http, _, body = block.partition(b"\r\n\r\n")
    size = len(body)
    visit = fields.get("warc-type") == "revisit"
    if visit:
        for line in http.decode("latin-1").split("\r\n"):
            if line.lower().startswith("content-length:"):
                size = int(line.split(":", 1)[1])

    def bare(name: str) -> str | None:
        return fields[name].strip("<>") if name in fields else None

    return {
        "record_id": bare("warc-record-id"), "record_type": fields.get("warc-type"), "uri": fields.get("warc-target-uri"),
        "refers_to": bare("warc-refers-to"), "digest": fields.get("warc-payload-digest", "").removeprefix("sha1:") or None,
        "payload_bytes": size, "payload": None if visit else body,
    }


def read_archives(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Records of the files (path, length), each file read by ranges of ``split_bytes``."""
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(split_bytes).cast("long")))
    ranges = files.select("path", "length", starts.alias("start"))
    # One range per row of work: dealt out evenly, not by the few files they come from.
    ranges = ranges.repartition(F.col("path"), F.col("start"))

    def read(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("path", pa.string()), ("at", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()),
            ("uri", pa.string()), ("refers_to", pa.string()), ("digest", pa.string()), ("payload_bytes", pa.int64()),
            ("payload", pa.binary()),
        ])
        for frame in frames:
            for row in frame.to_pylist():
                store, path = fs.FileSystem.from_uri(row["path"])
                rows, held = [], 0
                with store.open_input_file(path) as file:
                    for at, content in members(file, row["length"], row["start"], row["start"] + split_bytes):
                        rows.append({"path": row["path"], "at": at, **parsed(content)})
                        held += len(content)
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return ranges.mapInArrow(lean(read), READ)


def round_trip(pages: DataFrame, least_bytes: int = 0, key: str = "page_id", uri: str = "url", text: str = "html") -> DataFrame:
    """Write the pages as archives in the shared folder and return the records read back."""
    scratch = Scratch(pages.sparkSession, "warc")
    records = records_of(pages, least_bytes, key, uri, text)
    files = scratch.save(write_archives(records, scratch.path("archives")), "files")
    return read_archives(files)
