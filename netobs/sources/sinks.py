"""Fan-out of telemetry to files, Kafka and the console, batch or streaming."""

from __future__ import annotations

import threading
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from netobs.plans.stage import discard, work_folder


@dataclass(frozen=True)
class Sink:
    """One destination: ``text`` and ``parquet`` take a path, ``kafka`` a topic."""

    kind: str
    target: str = ""
    options: dict[str, str] = field(default_factory=dict)
    exclusive: bool = False  # a remote sink that turns the console off

    def __post_init__(self):
        if self.kind not in ("text", "parquet", "kafka", "console"):
            raise ValueError(f"unknown sink kind: {self.kind}")


def effective_sinks(sinks: list[Sink]) -> list[Sink]:
    """The console is added when there is no sink, or beside a shared Kafka sink."""
    remote = [s for s in sinks if s.kind == "kafka"]
    local = [s for s in sinks if s.kind in ("text", "parquet")]
    shown = (remote and not any(s.exclusive for s in remote)) or (not remote and not local)
    if shown and not any(s.kind == "console" for s in sinks):
        return [*sinks, Sink("console")]
    return list(sinks)


CONSOLE_ROWS = 1000  # what a console shows of a batch; files and Kafka get all rows


def _write_one(df: DataFrame, sink: Sink) -> None:
    if sink.kind == "text":
        df.select(F.col("line").alias("value")).write.mode("append").options(**sink.options).text(
            sink.target
        )
    elif sink.kind == "parquet":
        df.write.mode("append").options(**sink.options).parquet(sink.target)
    elif sink.kind == "kafka":
        df.select(F.col("line").alias("value")).write.format("kafka").option(
            "topic", sink.target
        ).options(**sink.options).save()
    else:
        df.select("line").show(CONSOLE_ROWS, truncate=False)


def write_telemetry(df: DataFrame, sinks: list[Sink] | None = None) -> None:
    """Write a table with a ``line`` column to every sink.

    For several sinks the table is computed once, into the shared folder, and
    removed from there afterwards.
    """
    chosen = effective_sinks(sinks or [])
    if len(chosen) == 1:
        _write_one(df, chosen[0])
        return
    spark, path = df.sparkSession, work_folder(df.sparkSession)
    try:
        df.write.parquet(path)
        once = spark.read.schema(df.schema).parquet(path)
        for sink in chosen:
            _write_one(once, sink)
    finally:
        discard(spark, path)


class Ledger:
    """Which sinks have which batches of a stream, as marker files beside its checkpoint."""

    KEPT = 100  # batches

    def __init__(self, spark: SparkSession, checkpoint: str):
        jvm = spark.sparkContext._jvm
        self.path = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join([checkpoint.rstrip("/"), "delivered", *parts]))
        self.fs = self.path().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def has(self, batch: int, sink: str) -> bool:
        return self.fs.exists(self.path(str(batch), sink))

    def total(self, batch: int, lines: int) -> int:
        """Lines up to this batch, which has ``lines``."""
        before = self.path(str(batch - 1))
        names = [f.getPath().getName() for f in self.fs.listStatus(before)] if self.fs.exists(before) else []
        total = max((int(n.removeprefix("total-")) for n in names if n.startswith("total-")), default=0) + lines
        self.add(batch, f"total-{total}")
        return total

    def add(self, batch: int, sink: str) -> None:
        self.fs.create(self.path(str(batch), sink), True).close()
        self.fs.delete(self.path(str(batch - self.KEPT)), True)


def stream_telemetry(df: DataFrame, sinks: list[Sink], checkpoint: str, stop_at: int | None = None, **trigger) -> StreamingQuery:
    """Stream to every sink; each micro-batch is computed once and written to all.

    Rules with memory belong into ``df`` (``netobs.streaming``), where their state
    crosses micro-batches. A ledger remembers which sink has which batch, so a
    batch that fails between two sinks goes only to those still without it when it
    is run again. File sinks put each batch into its own ``batch=`` folder and
    overwrite it; to Kafka and the console a batch goes twice only if the driver
    is lost between the end of a write and its mark. The batch is held in
    executor memory while it is written; what a lost executor held is computed
    again from the source. With ``stop_at`` the stream ends itself once so many
    lines are delivered, restarts counted.
    """
    chosen = effective_sinks(sinks)
    spark, started = df.sparkSession, {}

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        ledger = Ledger(spark, checkpoint)
        missing = [(f"{n}-{s.kind}", s) for n, s in enumerate(chosen) if not ledger.has(batch_id, f"{n}-{s.kind}")]
        rows = batch.persist() if len(missing) > 1 or stop_at is not None else batch
        try:
            for name, sink in missing:
                if sink.kind in ("text", "parquet"):
                    out = rows.select(F.col("line").alias("value")) if sink.kind == "text" else rows
                    out.write.mode("overwrite").format(sink.kind).options(**sink.options).save(
                        f"{sink.target}/batch={batch_id}"
                    )
                else:
                    _write_one(rows, sink)
                ledger.add(batch_id, name)
            if stop_at is not None and ledger.total(batch_id, rows.count()) >= stop_at and "query" in started:
                threading.Thread(target=started["query"].stop, daemon=True).start()  # not from within its own batch
        finally:
            if rows is not batch:
                rows.unpersist()

    writer = df.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    started["query"] = writer.trigger(**(trigger or {"availableNow": True})).start()
    return started["query"]
