"""Keeping keyed, time-ordered work spread out.

Two tools replace "collect the key and loop":

``time_slices``
    Most stateful rules look back a bounded time.  Rows are partitioned by
    ``(key, slice of event time)`` and rows near the end of a slice are copied
    into the following ones as context.  A hot key is cut into as many tasks as
    there are slices, and results do not change.

``ordered_scan``
    Rules that are true recurrences stream through the rows of each key in
    order, inside the tasks, keeping one small state and one Arrow batch in
    memory.  Callers pass slim, pre-reduced rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SLICE, CONTEXT = "_slice", "_context"
NULL_SALTS = 1024


def seconds(ts: str = "ts") -> Column:
    return F.unix_seconds(F.col(ts))


def micros(ts: str = "ts") -> Column:
    return F.unix_micros(F.col(ts))


def time_slices(df: DataFrame, t: Column, width: int, lookback: int, only: Column | None = None) -> DataFrame:
    """Add ``_slice`` and ``_context``.

    ``t`` is an integer time, ``width`` and ``lookback`` are in its unit.  A row
    at ``t`` is copied, marked as context, into every later slice that starts
    less than or exactly ``lookback`` after it.  ``only`` limits the copies to
    rows that later rows look back to.
    """
    home = F.floor(t / width)
    last = F.floor((t + lookback) / width)
    if only is not None:
        last = F.when(only, last).otherwise(home)
    return df.withColumn(SLICE, F.explode(F.sequence(home, last))).withColumn(
        CONTEXT, F.col(SLICE) != home
    )


def drop_slices(df: DataFrame) -> DataFrame:
    return df.where(~F.col(CONTEXT)).drop(SLICE, CONTEXT)


def first_rows(df: DataFrame, keys: list[str], order: list[str], n: int = 1) -> DataFrame:
    """First ``n`` rows per key; Spark cuts groups before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def asof_within(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    value: list[str],
    max_age: int,
    out: str,
    tie_left_first: bool = True,
    width: int | None = None,
    salts: int = 1,
) -> DataFrame:
    """Last ``right`` row of the key not older than ``max_age`` seconds.

    Both sides carry ``ts`` and ``seq``.  Adds ``out``, a struct of ``value``
    and ``sec`` (NULL when there is none).  A left row and a right row with the
    same ``(ts, seq)`` are ordered by ``tie_left_first``.  Age counts whole
    seconds.  Left rows are shuffled once and never copied; right rows are
    copied into the next time slice and to every salt.  Left rows with a NULL
    key cannot match and are spread over many partitions.
    """
    width = width or max(max_age, 60)
    payload = [c for c in left.columns if c not in keys]
    rt = right.select(
        *[F.col(k) for k in keys],
        "ts",
        "seq",
        F.struct(*[F.col(v) for v in value], seconds().alias("sec")).alias(out),
    )
    rt = time_slices(rt, seconds(), width, max_age).drop(CONTEXT).withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    )
    spread = F.when(F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False)), F.lit(NULL_SALTS)).otherwise(
        F.lit(salts)
    )
    lt = left.withColumn(SLICE, F.floor(seconds() / width)).withColumn(
        "_salt", F.pmod(F.xxhash64("ts", "seq"), spread).cast("int")
    )
    both = (
        lt.withColumn("_side", F.lit(0 if tie_left_first else 1))
        .withColumn(out, F.lit(None).cast(rt.schema[out].dataType))
        .unionByName(
            rt.withColumn("_side", F.lit(1 if tie_left_first else 0)), allowMissingColumns=True
        )
    )
    left_side = 0 if tie_left_first else 1
    w = (
        Window.partitionBy(*keys, SLICE, "_salt")
        .orderBy("ts", "seq", "_side")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    hit = both.withColumn("_hit", F.last(out, ignorenulls=True).over(w)).where(
        F.col("_side") == left_side
    )
    fresh = seconds() - F.col("_hit.sec") <= max_age
    return hit.select(*keys, *payload, F.when(fresh, F.col("_hit")).alias(out))


def ordered_scan(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    inputs: list[str],
    step: Callable[[], Callable[..., object]],
    out: str,
    out_type: str,
) -> DataFrame:
    """Run a state machine over each key's rows in order and add column ``out``.

    ``step()`` makes a fresh machine; it is called with the ``inputs`` values of
    a row and returns the value of ``out``.  Spark shuffles by key and sorts;
    a window marks the first row of each key, and the tasks stream Arrow batches,
    so a key of any length uses constant memory.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    marked = df.withColumn("_head", F.row_number().over(w) == 1)
    schema = StructType.fromDDL(", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema))
    schema = schema.add(out, out_type)
    out_arrow = pa.field(out, _arrow_type(out_type))
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = None
        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in inputs]
            heads = batch.column(batch.schema.get_field_index("_head")).to_pylist()
            result = []
            for head, *args in zip(heads, *cols):
                if head:
                    machine = step()
                result.append(machine(*args))
            kept = batch.select(names)
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(result, out_arrow.type)],
                schema=pa.schema([*kept.schema, out_arrow]),
            )

    return marked.mapInArrow(run, schema)


def _arrow_type(ddl: str) -> pa.DataType:
    types = {"boolean": pa.bool_(), "long": pa.int64(), "integer": pa.int32(), "binary": pa.binary(),
             "string": pa.string()}
    return types[ddl]
