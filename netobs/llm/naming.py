"""Exact deduplication by block naming.

A text without its white space, in UTF-8, is cut into blocks of ``BLOCK`` bytes.
Equal blocks get the same integer name: the distinct blocks are sorted and
numbered. Then adjacent names are paired and the distinct pairs sorted and
numbered in turn, until every document is left with one name. Texts of one size
pass through equally many rounds, so (size, name) identifies a text and no hash
decides anything. Names come from sorted partitions, so they are the same when a
lost partition is made again.

Every task names its own blocks first and sends each distinct one only once, so
a block that a third of all documents share travels once per task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from netobs.llm.common import WHITE, Scratch, lean

BLOCK = 1024
CHUNK_BYTES, CHUNK_ROWS = 16 << 20, 1 << 16
DELETE = dict.fromkeys(map(ord, WHITE))


def cut(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Document rows (rid, doc_id, cp, size, sha, local) and block rows (chunk, at, block) of all chunks.

    A chunk is some of a task's documents. ``local`` holds the positions of the
    document's blocks among the chunk's distinct blocks. Row ids are unique once
    the result is written.
    """
    kind = docs.schema[key].dataType
    shape = StructType.fromDDL(
        f"chunk long, at int, block binary, rid long, doc_id {kind.simpleString()}, cp long, size long, sha string, local binary"
    )
    arrow = to_arrow_schema(shape)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 20
        seen: dict[bytes, int] = {}
        rows: dict[str, list] = {name: [] for name in ("rid", "doc_id", "cp", "size", "sha", "local")}

        def batch(n: int, **columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(columns.get(f.name, [None] * n), f.type) for f in arrow], schema=arrow
            )

        def flush() -> Iterator[pa.RecordBatch]:
            n = len(rows["rid"])
            yield batch(n, chunk=[chunk] * n, **rows)
            blocks = list(seen)
            for at in range(0, len(blocks), 4096):
                part = blocks[at : at + 4096]
                yield batch(len(part), chunk=[chunk] * len(part), at=range(at, at + len(part)), block=part)

        held = 0
        for frame in frames:
            for k, body in zip(frame.column(0).to_pylist(), frame.column(1), strict=True):
                body = body.as_py() or ""
                data = body.translate(DELETE).encode()
                local = [seen.setdefault(data[i : i + BLOCK], len(seen)) for i in range(0, len(data), BLOCK)]
                rows["rid"].append((chunk << 20) + len(rows["rid"]))
                rows["doc_id"].append(k)
                rows["cp"].append(len(body))
                rows["size"].append(len(data))
                rows["sha"].append(hashlib.sha256(data).hexdigest())
                rows["local"].append(np.array(local, np.int32).tobytes())
                held += len(data)
                if held >= CHUNK_BYTES or len(rows["rid"]) >= CHUNK_ROWS:
                    yield from flush()
                    chunk, held = chunk + 1, 0
                    seen.clear()
                    for column in rows.values():
                        column.clear()
        if rows["rid"]:
            yield from flush()

    slim = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return slim.mapInArrow(lean(run), shape)


def named_documents(documents: DataFrame, names: DataFrame) -> DataFrame:
    """(rid, n, pos, name): the names of a chunk's blocks put back into its documents."""

    def put(docs: pd.DataFrame, named: pd.DataFrame) -> pd.DataFrame:
        name = np.zeros(len(named), np.int64)
        name[named["at"].to_numpy()] = named["name"].to_numpy()
        local = [np.frombuffer(x, np.int32) for x in docs["local"]]
        n = np.array([len(x) for x in local], np.int64)
        flat = np.concatenate(local) if len(local) else np.zeros(0, np.int32)
        first = np.repeat(np.cumsum(n) - n, n)
        return pd.DataFrame({
            "rid": np.repeat(docs["rid"].to_numpy(np.int64), n), "n": np.repeat(n, n),
            "pos": np.arange(len(flat)) - first, "name": name[flat],
        })

    both = documents.groupBy("chunk").cogroup(names.groupBy("chunk"))
    return both.applyInPandas(put, "rid long, n long, pos long, name long")


def numbered(distinct: DataFrame, *by: str) -> DataFrame:
    """A number for each of the distinct rows, from their sorted order within partitions."""
    return distinct.sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id())


def identities(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(rid, doc_id, cp, size, sha, name): (size, name) is equal exactly for equal normalised texts.

    One row per row of ``docs``, null or repeated keys too; a null text counts as
    empty, and all empty texts share one identity.
    """
    cuts = scratch.save(cut(docs, key, text), "cuts")
    blocks = cuts.where("block IS NOT NULL").select("chunk", "at", "block")
    documents = cuts.where("rid IS NOT NULL")
    # Each chunk holds a block once: at most one row per chunk meets in a partition.
    spread = blocks.repartition("block").sortWithinPartitions("block", "chunk").withColumn("m", F.monotonically_increasing_id())
    names = spread.select("chunk", "at", F.min("m").over(Window.partitionBy("block")).alias("name"))
    level = scratch.save(named_documents(documents, scratch.save(names, "names0")), "level0")
    done, turn = None, 0
    while True:
        whole = level.where("n = 1").select("rid", "name")
        done = whole if done is None else done.union(whole)
        level = level.where("n > 1")
        if level.isEmpty():
            break
        turn += 1
        pairs = level.groupBy("rid", F.shiftright("pos", 1).alias("pos")).agg(
            F.shiftright(F.max("n") + 1, 1).alias("n"),
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"),
        )
        pairs = scratch.save(pairs, f"pairs{turn}")
        names = scratch.save(numbered(pairs.select("a", "b").distinct(), "a", "b"), f"names{turn}")
        level = scratch.save(pairs.join(names, ["a", "b"]).select("rid", "n", "pos", "name"), f"level{turn}")
        scratch.drop(f"pairs{turn}", f"names{turn}")
    slim = documents.select("rid", "doc_id", "cp", "size", "sha")
    return slim.join(done, "rid", "left").withColumn("name", F.coalesce("name", F.lit(-1)))


def groups(ids: DataFrame) -> DataFrame:
    """One row per document: (rid, doc_id, cp, sha, keep_id, keep_rid, group_size).

    Of equal texts the row with the most code points stays, then the smallest
    key (null last), then the first of repeated rows.
    """
    first = F.min(F.struct(-F.col("cp"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("rid")))
    kept = ids.groupBy("size", "name").agg(F.count("*").alias("group_size"), first.alias("first"))
    kept = kept.select("size", "name", "group_size", F.col("first.doc_id").alias("keep_id"), F.col("first.rid").alias("keep_rid"))
    return ids.join(kept, ["size", "name"])


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of ``docs``."""
    scratch = Scratch(docs.sparkSession, "naming")
    ids = scratch.save(identities(docs, scratch, key, text), "ids")
    return groups(ids).select(
        "doc_id", "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"),
        F.col("sha").alias("text_sha256"), "cp",
    )


def keep_first(docs: DataFrame, decided: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns; ``decided`` is from ``exact_dedup``."""
    body = F.coalesce(F.col(text), F.lit(""))
    marked = docs.select(
        F.struct("*").alias("row"), F.col(key).alias("key"),
        F.sha2(F.translate(body, WHITE, ""), 256).alias("sha"), F.length(body).cast("long").alias("cp"),
    )
    rows = decided.groupBy(F.col("doc_id").alias("key2"), F.col("text_sha256").alias("sha2"), F.col("cp").alias("cp2"))
    kept = rows.agg(F.max("kept").alias("kept"), F.count("*").alias("n")).where("kept")
    on = F.col("key").eqNullSafe(F.col("key2")) & (F.col("sha") == F.col("sha2")) & (F.col("cp") == F.col("cp2"))
    left = marked.join(kept, on)
    once = left.where("n = 1").select("row.*")
    # Rows that agree in key and text: one of them stays.
    again = left.where("n > 1").dropDuplicates(["key2", "sha", "cp"]).select("row.*")
    return once.union(again)
