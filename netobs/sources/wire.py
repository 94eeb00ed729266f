"""Pipe-delimited records: read, split the sensor envelope, type, format."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netobs.plans.stage import stage
from netobs.schemas import PLACEHOLDERS, RECORDS


def read_wire(
    spark: SparkSession, path: str, stream: bool = False, **options: str
) -> DataFrame:
    """Lines of text files as ``(line, ...)`` with the parsed columns of ``parse_wire``."""
    reader = spark.readStream if stream else spark.read
    return parse_wire(reader.options(**options).text(path).withColumnRenamed("value", "line"))


def split_observation(df: DataFrame, line: str = "line") -> DataFrame:
    """Envelope columns ``sensor_name, iface, vlan`` and the bare ``record``.

    Lines without an envelope keep NULL in the three context columns.
    """
    text = F.rtrim(F.col(line), F.lit("\r\n"))
    df = stage(
        df.drop("sensor_name", "iface", "vlan", "record"),
        {"_t": text, "_p": F.when(text.startswith("OBS|"), F.split(text, "\\|", 5))},
    )
    wrapped = F.size("_p") == 5
    part = [F.when(wrapped, F.get("_p", F.lit(i))) for i in range(5)]
    return stage(
        df,
        {
            "sensor_name": part[1],
            "iface": part[2],
            "vlan": part[3],
            "record": F.coalesce(part[4], F.col("_t")),
        },
        drop=("_t", "_p"),
    )


def parse_wire(df: DataFrame, line: str = "line") -> DataFrame:
    """Add ``sensor_name, iface, vlan, tag, mac, fields, routed, reject``.

    ``fields`` holds the values after the MAC.  ``routed`` is read from its
    position: one value more than the tag defines, equal to ``routed``.
    ``reject`` names what is wrong with a line, NULL when it is well formed.
    """
    width = F.create_map(
        *[x for t, cols in RECORDS.items() for x in (F.lit(t), F.lit(len(cols) + 2))]
    )
    obs = stage(split_observation(df, line), {"_f": F.split("record", "\\|")})
    obs = stage(obs, {"tag": F.col("_f")[0], "_w": F.try_element_at(width, F.col("_f")[0])})
    n, w = F.size("_f"), F.col("_w")
    routed = F.coalesce((n == w + 1) & (F.element_at("_f", -1) == "routed"), F.lit(False))
    return stage(
        obs,
        {
            "mac": F.get("_f", F.lit(1)),
            "fields": F.slice("_f", F.lit(3), F.greatest(F.coalesce(w, n) - 2, F.lit(0))),
            "routed": routed,
            "reject": F.when(w.isNull(), F.lit("unknown tag")).when(
                (n != w) & ~routed, F.lit("field count")
            ),
        },
        drop=("_f", "_w"),
    )


def _typed(tag: str, i: int, name: str, dtype: str) -> Column:
    raw = F.get("fields", F.lit(i))
    hole = PLACEHOLDERS.get((tag, name))
    value = raw if hole is None else F.when(raw != hole, raw)
    return value.try_cast(dtype).alias(name)


def _bad_value(tag: str) -> Column:
    """True when a numeric field does not parse."""
    bad = F.lit(False)
    for i, (_, dtype) in enumerate(RECORDS[tag]):
        if dtype != "string":
            raw = F.get("fields", F.lit(i))
            bad = bad | raw.try_cast(dtype).isNull()
    return bad


def _context(df: DataFrame) -> list[str]:
    return [c for c in ("ts", "seq", "sensor_name", "iface", "vlan") if c in df.columns]


def to_typed(wire: DataFrame, tag: str) -> DataFrame:
    """Well-formed rows of one tag as its typed record table."""
    rows = wire.where((F.col("tag") == tag) & F.col("reject").isNull() & ~_bad_value(tag))
    cols = [_typed(tag, i, n, t) for i, (n, t) in enumerate(RECORDS[tag])]
    return rows.select(*_context(rows), "mac", *cols, "routed")


def by_tag(made: Callable[[str, Callable[[str], Column]], Column]) -> Column:
    """What ``made(tag, of)`` gives for a parsed line of each tag, NULL for a line that fits no table.

    ``of`` finds a typed value by its name, as in ``wire_body``. Lines of all tags
    are typed in one pass, where a table for each tag reads them all.
    """
    out = None
    for tag, columns in RECORDS.items():
        typed = {n: _typed(tag, i, n, t) for i, (n, t) in enumerate(columns)}
        value = F.when(~_bad_value(tag), made(tag, lambda name, typed=typed: typed[name] if name in typed else F.col(name)))
        fits = F.col("reject").isNull() & (F.col("tag") == tag)
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def rejects(wire: DataFrame) -> DataFrame:
    """Lines that fit no record table, with the reason."""
    bad = F.lit(None).cast("string")
    for tag in RECORDS:
        bad = F.when((F.col("tag") == tag) & _bad_value(tag), F.lit("bad value")).otherwise(bad)
    keep = [*_context(wire), "record"]
    return (
        wire.withColumn("reason", F.coalesce("reject", bad))
        .where(F.col("reason").isNotNull())
        .select(*keep, "reason")
    )


def _shown(tag: str, name: str, dtype: str, col: Column) -> Column:
    text = F.format_string("%.2f", col) if dtype == "double" else col.cast("string")
    hole = PLACEHOLDERS.get((tag, name), "")
    return F.when(col.isNull(), F.lit(hole)).otherwise(text)


def wire_body(tag: str, of: Callable[[str], Column] = F.col) -> Column:
    """One record as text, without the routed marker and the line end; ``of`` finds a column by name."""
    fields = [_shown(tag, n, t, of(n)) for n, t in RECORDS[tag]]
    return F.concat_ws("|", F.lit(tag), F.coalesce(of("mac"), F.lit("")), *fields)


def with_marker(body: Column, routed: Column) -> Column:
    return F.concat_ws("|", body, F.when(routed, F.lit("routed")))


def wire_line(tag: str) -> Column:
    """One record as text without the line end."""
    return with_marker(wire_body(tag), F.col("routed"))


def format_wire(df: DataFrame, tag: str) -> DataFrame:
    """Add ``line`` to a typed record table."""
    return df.withColumn("line", wire_line(tag))


def wrap_observation(df: DataFrame, sensor: str | None = None, line: str = "line") -> DataFrame:
    """Put the sensor envelope around ``line``; uses the row's context columns."""
    name = F.lit(sensor) if sensor else F.col("sensor_name")
    iface = F.when(F.length("iface") > 0, F.col("iface")).otherwise(F.lit("unknown"))
    text = F.concat_ws(
        "|", F.lit("OBS"), name, F.coalesce(iface, F.lit("unknown")),
        F.coalesce(F.col("vlan"), F.lit("0")), F.col(line),
    )
    return df.withColumn(line, text)
