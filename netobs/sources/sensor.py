"""Sensor identity: a stable name on every row, several sensors as one union."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAME = re.compile(r"[A-Za-z0-9._-]{1,63}")


def check_sensor(
    sensor: bool, name: str | None = None, iface: str = "any", inside: tuple[str, ...] = ()
) -> None:
    """Argument rules of sensor mode."""
    if not sensor:
        if name or inside:
            raise ValueError("a sensor name or inside prefixes need sensor mode")
        return
    if not name or not NAME.fullmatch(name):
        raise ValueError("sensor mode needs a name of 1 to 63 letters, digits, '.', '_' or '-'")
    if iface.lower() == "any":
        raise ValueError("sensor mode needs an explicit interface, not 'any'")


def sensor_context(df: DataFrame, name: str) -> DataFrame:
    if not NAME.fullmatch(name or ""):
        raise ValueError("sensor name must be 1 to 63 letters, digits, '.', '_' or '-'")
    return df.withColumn("sensor_name", F.lit(name))


def union_sensors(tables: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
