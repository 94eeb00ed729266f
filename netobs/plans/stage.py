"""Evaluate-once projection steps.

Catalyst pushes filters through projections by copying the projected
expression into the filter, and merges neighbouring projections the same way.
For decoders, where every field builds on the one before, the copies multiply.
``stage`` adds columns through an ``inline`` generator instead: its outputs are
new attributes, so each expression is evaluated once, in the order written, and
rows that fail ``where`` produce nothing.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def stage(
    df: DataFrame,
    new: dict[str, Column],
    where: Column | None = None,
    drop: Iterable[str] = (),
) -> DataFrame:
    """Add or replace columns; keep rows for which ``where`` is true."""
    gone = {*drop, *new}
    row = F.array(F.struct(*[c.alias(n) for n, c in new.items()]))
    return df.select(
        *[c for c in df.columns if c not in gone],
        F.inline(row if where is None else F.when(where, row)),
    )


def shared(df: DataFrame, *keys: str | Column, plain: tuple[str, ...] = ()) -> DataFrame:
    """One exchange that several branches of a plan read.

    The columns come out of a generator, so no filter of a branch moves below
    the exchange; the branches then have the same child and Spark reuses it.
    What is upstream, decoding for instance, runs once.  ``plain`` keys stay as
    they are, so that windows over them need no other exchange; no branch may
    filter by them.
    """
    return stage(df.repartition(*keys), {c: F.col(c) for c in df.columns if c not in plain}).select(*df.columns)


def work_folder(spark: SparkSession) -> str:
    """A new name in the shared folder for intermediate tables: the cluster's checkpoint folder.

    Only a local session, as in tests, may do without: it gets a folder of its
    own. On a cluster every executor would write to its own disk, so there the
    setting is needed.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="netobs-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/netobs-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Remove an intermediate table that nothing will read any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def move(spark: SparkSession, path: str, to: str) -> None:
    """Give a table, or a part of one, another place; a part that no row fell into has none."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    source, target = hadoop.Path(path), hadoop.Path(to)
    files = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(target.getParent())
    if files.exists(source) and not files.rename(source, target):
        raise OSError(f"cannot move {path} to {to}")


def materialize(df: DataFrame, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts the lineage, survives lost executors and lets the readers push filters
    into the scan.
    """
    path = work_folder(df.sparkSession)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
