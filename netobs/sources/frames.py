"""Frame tables and streams, interface selection, capture counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netobs.schemas import FRAME, LINK_TYPES, STATS


def supported_frames(df: DataFrame) -> DataFrame:
    """Frames of the supported link types."""
    return df.where(F.col("link_type").isin(*LINK_TYPES))


def read_frames(
    spark: SparkSession, path: str, stream: bool = False, fmt: str = "parquet", **options: str
) -> DataFrame:
    """Frames from a table or file stream with the FRAME schema.

    ``fmt`` is any Spark file format; ``options`` go to the reader, for example
    ``maxFilesPerTrigger`` on a stream.
    """
    reader = spark.readStream if stream else spark.read
    return supported_frames(reader.format(fmt).schema(FRAME).options(**options).load(path))


def frames_from_kafka(
    spark: SparkSession, servers: str, topic: str, stream: bool = True, **options: str
) -> DataFrame:
    """Frames from Kafka: value is the frame, headers name interface and link type.

    Needs the Kafka connector on the class path.
    """
    reader = spark.readStream if stream else spark.read
    raw = (
        reader.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("includeHeaders", "true")
        .options(**options)
        .load()
    )

    def header(name: str):
        hit = F.filter("headers", lambda h: h["key"] == name)
        return F.decode(F.get(hit, F.lit(0))["value"], "UTF-8")

    return supported_frames(
        raw.select(
            F.col("timestamp").alias("ts"),
            # offsets restart per partition, so the partition goes into the tie-break
            (F.shiftleft(F.col("partition").cast("bigint"), 48) + F.col("offset")).alias("seq"),
            header("iface").alias("iface"),
            F.coalesce(header("link_type"), F.lit("ethernet")).alias("link_type"),
            header("aux_vlan").cast("int").alias("aux_vlan"),
            F.col("value").alias("data"),
        )
    )


def parse_ifaces(spec: str, sensor: bool = False) -> list[str] | None:
    """Interface names of a comma list; ``None`` means all.

    ``any`` is skipped when it follows an explicit interface; a sensor needs
    explicit interfaces.
    """
    if sensor and spec.lower() == "any":
        raise ValueError("sensor mode needs an explicit interface, not 'any'")
    chosen: list[str] = []
    every = False
    for name in [p for p in spec.split(",") if p]:
        if name.lower() == "any":
            every = every or not chosen
        else:
            chosen.append(name)
    if not chosen and not every:
        raise ValueError("no interface given")
    return None if every else chosen


def select_ifaces(df: DataFrame, spec: str = "any", sensor: bool = False) -> DataFrame:
    names = parse_ifaces(spec, sensor)
    return df if names is None else df.where(F.col("iface").isin(*names))


def read_capture_stats(
    spark: SparkSession, path: str, stream: bool = False, fmt: str = "parquet", **options: str
) -> DataFrame:
    """Per-interface packet and drop counters, one row per poll."""
    reader = spark.readStream if stream else spark.read
    return reader.format(fmt).schema(STATS).options(**options).load(path)
