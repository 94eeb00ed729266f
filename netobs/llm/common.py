"""What the corpus operators share: tables, folds, scratch tables, components."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\x0c\r"  # the white space of all contracts: [\x20\x09-\x0D]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: str | Column, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; a null key counts as empty text."""
    key = F.col(key) if isinstance(key, str) else key
    return (F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % folds).cast("int")


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share.

    Only a local session may do without: it gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="netobs-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Scratch:
    """Intermediate tables in the shared folder.

    Writing a table cuts the lineage: what reads it survives lost executors
    without running what made it again, and sees one set of rows however often
    it reads. ``drop`` removes tables that nothing will read any more.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(self.path(name))
        return self.read(name, df)

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(conf).delete(path, True)


def batches(frame: pa.RecordBatch, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of about ``most`` bytes of text (column ``t``), one row at least."""
    sizes = pc.fill_null(pc.binary_length(frame.column("t")), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes) // most
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1), len(sizes)]
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            yield frame.slice(a, b - a)


FEW_EDGES = 1 << 16


def release() -> None:
    """Give free memory back: workers are kept, and other steps need theirs beside them."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
    if trim is not None:
        trim(0)


def lean(run: Callable) -> Callable:
    """A function over a task's batches that gives its memory back at the end."""

    @functools.wraps(run)
    def whole(frames):
        try:
            yield from run(frames)
        finally:
            release()

    return whole


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of the pairs (a, b), sorted, and the smallest node of each one's component."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v, low, before = at[: len(a)], at[len(a) :], np.arange(len(ids)), None
    while before is None or (before != low).any():
        before = low.copy()
        least = np.minimum(low[u], low[v])
        for ends in (u, v, before[u], before[v]):
            np.minimum.at(low, ends, least)
        low = low[low]
    return ids, ids[low]


def gathered(edges: DataFrame) -> DataFrame:
    """Components (node, root) of at most ``FEW_EDGES`` edges (a, b), root the smallest node, in one task."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(f.column("a").to_numpy(), f.column("b").to_numpy()) for f in frames]
        if held:
            found = spanning(*(np.concatenate(x) for x in zip(*held, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["node", "root"])

    return edges.select("a", "b").coalesce(1).mapInArrow(lean(run), "node long, root long")


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Connected components of ``edges`` (a, b): rows (node, root) for all their nodes, root the smallest.

    Alternates two steps until nothing changes: every node tells its neighbours
    above it the smallest node it knows (large star), then neighbours below are
    hung on the smallest (small star). Each step is an aggregation and a join,
    so no component is ever gathered in one place; the number of rounds grows
    with the logarithm of the longest chain. Up to ``FEW_EDGES`` edges, which are
    counted first, are not worth a shuffle: one task connects them.
    """
    links = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    now = scratch.save(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), f"{name}0")
    if now.count() <= FEW_EDGES:
        return scratch.save(gathered(now), f"{name}1")
    now = now.distinct()
    turn, before = 0, None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        turn += 1
        new = scratch.save(small.where("a <> b").distinct(), f"{name}{turn}")
        after = new.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        scratch.drop(f"{name}{turn - 1}")
        now, same, before = new, before == after, after
        if same:
            roots = now.select("b").distinct()
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.select("b", "b"))
