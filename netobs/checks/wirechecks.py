"""Wire records, sensor envelope, sinks' input, interface selection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netobs.checks.common import udp_frames
from netobs.checks.registry import PK, WIRE, query
from netobs.operators.dedup import dedup_records, dedup_wire
from netobs.checks import derived as g
from netobs.plans.stage import stage
from netobs.schemas import PLACEHOLDERS, RECORDS
from netobs.sources.frames import select_ifaces, supported_frames
from netobs.sources.sensor import sensor_context, union_sensors
from netobs.sources.wire import (
    by_tag,
    format_wire,
    parse_wire,
    rejects,
    split_observation,
    to_typed,
    wire_body,
    with_marker,
    wrap_observation,
)

KINDS = {"DNS": "view", "SYN": "click", "TLS": "purchase", "DHCP": "signup", "ARP": "error"}


def typed_all(spark, sf) -> dict[str, DataFrame]:
    lines = parse_wire(g.wire(spark, sf))
    return {tag: to_typed(lines, tag) for tag in KINDS}


ACTIVITY_SQL = """, keyed AS (
  SELECT seq, ts_s, dev, mac, CASE event_type WHEN 'view' THEN 'DNS' WHEN 'click' THEN 'SYN' WHEN 'purchase' THEN 'TLS'
         WHEN 'signup' THEN 'DHCP' ELSE 'ARP' END AS tag,
         CASE WHEN k % 2 = 0 THEN 'sensor-' || (dev % 3) END AS sensor_name, k % 10 = 9 AS routed,
         CASE event_type WHEN 'view' THEN 'host' || k WHEN 'click' THEN CAST(dport AS VARCHAR)
              WHEN 'purchase' THEN 'shop' || k WHEN 'error' THEN dst_ip ELSE '' END AS what FROM pk),
kept AS (
  SELECT *, lag(ts_s) OVER (PARTITION BY tag, sensor_name, mac, what, routed ORDER BY seq) AS prev,
         row_number() OVER (PARTITION BY tag, sensor_name, mac, what, routed ORDER BY seq) AS rn FROM keyed),
arp AS (
  SELECT tag, sensor_name, mac, what, routed, ts_s, rn, ts_s AS anchor FROM kept WHERE tag = 'ARP' AND rn = 1
  UNION ALL
  SELECT e.tag, e.sensor_name, e.mac, e.what, e.routed, e.ts_s, e.rn,
         CASE WHEN e.ts_s - s.anchor >= 900 THEN e.ts_s ELSE s.anchor END
  FROM arp AS s JOIN kept AS e ON e.tag = 'ARP' AND e.sensor_name IS NOT DISTINCT FROM s.sensor_name AND e.mac = s.mac
    AND e.what = s.what AND e.routed = s.routed AND e.rn = s.rn + 1),
left_over AS (
  SELECT tag, mac FROM kept WHERE tag <> 'ARP' AND (prev IS NULL OR ts_s - prev >= 35)
  UNION ALL
  SELECT DISTINCT ON (sensor_name, mac, what, routed, anchor) tag, mac FROM arp)
SELECT tag, mac, count(*) AS records FROM left_over GROUP BY tag, mac"""


@query("device_activity", ACTIVITY_SQL)
def _device_activity(spark, sf):
    """Records per device and tag after deduplication."""
    kept = dedup_wire(parse_wire(g.wire(spark, sf)))
    return kept.groupBy("tag", "mac").agg(F.count("*").alias("records"))


@query(
    "typed_dedup",
    """, keyed AS (
  SELECT *, CASE WHEN k % 2 = 0 THEN 'sensor-' || (dev % 3) END AS sensor FROM pk WHERE event_type = 'purchase'),
kept AS (
  SELECT *, lag(ts_s) OVER (PARTITION BY sensor, dev, k ORDER BY seq) AS prev FROM keyed)
SELECT seq, mac, 'shop' || k || '.example.com' AS sni FROM kept WHERE prev IS NULL OR ts_s - prev >= 35""",
)
def _typed_dedup(spark, sf):
    """The record-table form of the same rule."""
    tls = to_typed(parse_wire(g.wire(spark, sf)), "TLS")
    return dedup_records(tls, "TLS").select("seq", "mac", "sni")


@query(
    "wire_parse",
    """SELECT seq, split_part(record, '|', 1) AS tag, mac, CAST(k % 10 = 9 AS INTEGER) AS routed,
       len(string_split(record, '|')) - 2 - CAST(k % 10 = 9 AS INTEGER) AS n_fields,
       split_part(record, '|', 3) AS first_field FROM wire""",
    WIRE,
)
def _wire_parse(spark, sf):
    return parse_wire(g.wire(spark, sf)).select(
        "seq", "tag", "mac", F.col("routed").cast("int"), F.size("fields").alias("n_fields"),
        F.col("fields")[0].alias("first_field"),
    )


@query(
    "obs_split",
    """SELECT seq, CASE WHEN k % 2 = 0 THEN 'sensor-' || (dev % 3) END AS sensor_name,
       CASE WHEN k % 2 = 0 THEN 'lan3' END AS iface,
       CASE WHEN k % 4 = 0 THEN '0' WHEN k % 4 = 2 THEN '100/20' END AS vlan, record FROM wire""",
    WIRE,
)
def _obs_split(spark, sf):
    return split_observation(g.wire(spark, sf)).select("seq", "sensor_name", "iface", "vlan", "record")


@query(
    "obs_wrap",
    """SELECT seq, 'OBS|sensor-north|' || CASE WHEN k % 2 = 0 THEN 'lan3' ELSE 'unknown' END || '|'
       || CASE WHEN k % 4 = 2 THEN '100/20' ELSE '0' END || '|' || record AS line FROM wire""",
    WIRE,
)
def _obs_wrap(spark, sf):
    df = split_observation(g.wire(spark, sf)).withColumn("line", F.col("record"))
    return wrap_observation(df, "sensor-north").select("seq", "line")


@query("wire_format", "SELECT seq, record AS line FROM wire", WIRE)
def _wire_format(spark, sf):
    """Typed tables formatted again give the records they came from."""
    parts = [format_wire(df, tag).select("seq", "line") for tag, df in typed_all(spark, sf).items()]
    return reduce(DataFrame.unionByName, parts)


TYPED_SQL = {
    "DNS": "'host' || k || '.example.com' AS query_domain",
    "SYN": "64 AS ttl, 61000 AS \"window\", 6 AS wscale, 1440 AS mss, 'M*,N,W*,S,T' AS opts, dport AS dst_port",
    "TLS": "dst_ip, 443 AS dst_port, 'shop' || k || '.example.com' AS sni, "
    "'t13d0302h2_aaaaaaaaaaaa_bbbbbbbbbbbb' AS ja4, 'h2' AS alpn",
    "DHCP": "'host-' || dev AS hostname, 'MSFT 5.0' AS vendor_class, '1,3,6,15' AS prl",
}


def _register_typed(tag: str) -> None:
    sql = (
        f"SELECT seq, mac, src_ip, {TYPED_SQL[tag]}, CAST(k % 10 = 9 AS INTEGER) AS routed "
        f"FROM pk WHERE event_type = '{KINDS[tag]}'"
    )

    @query(f"typed_{tag.lower()}", sql)
    def _typed(spark, sf):
        df = to_typed(parse_wire(g.wire(spark, sf)), tag)
        return df.drop("ts", "sensor_name", "iface", "vlan").withColumn("routed", F.col("routed").cast("int"))


for _tag in TYPED_SQL:
    _register_typed(_tag)


def _field_sql(tag: str, i: int, name: str, kind: str) -> tuple[str, str]:
    """A field's text in SQL, and what it adds to the sum of numbers."""
    hole = PLACEHOLDERS.get((tag, name))
    if kind == "string":
        sql, number = "'v' || k", "0"
    elif kind == "double":
        sql, number = "printf('%.2f', k / 4.0)", "k / 4.0"
    else:
        sql, number = f"CAST(k + {i} AS VARCHAR)", f"k + {i}"
    if hole is None:
        return sql, number
    return f"CASE WHEN k % 5 = 0 THEN '{hole}' ELSE {sql} END", f"CASE WHEN k % 5 = 0 THEN 0 ELSE {number} END"


def _field_column(tag: str, i: int, name: str, kind: str) -> Column:
    """The same text as a column."""
    k, hole = F.col("k"), PLACEHOLDERS.get((tag, name))
    if kind == "string":
        text = F.concat(F.lit("v"), k.cast("string"))
    elif kind == "double":
        text = F.format_string("%.2f", k / F.lit(4.0))
    else:
        text = (k + i).cast("string")
    return text if hole is None else F.when(k % 5 == 0, F.lit(hole)).otherwise(text)


def _all_tags_sql() -> str:
    parts = []
    for tag, columns in RECORDS.items():
        fields = [_field_sql(tag, i, n, t) for i, (n, t) in enumerate(columns)]
        line = " || '|' || ".join([f"'{tag}'", "mac", *(f"({sql})" for sql, _ in fields)])
        total = " + ".join(["CAST(0 AS DOUBLE)", *(f"({number})" for _, number in fields)])
        parts.append(f"SELECT seq, '{tag}' AS tag, {line} || CASE WHEN k % 10 = 9 THEN '|routed' ELSE '' END AS line, {total} AS total FROM pk")
    return ", a AS (" + " UNION ALL ".join(parts) + ") SELECT * FROM a"


@query("typed_round_trip", _all_tags_sql())
def _typed_round_trip(spark, sf):
    """Lines of all eighteen tags, typed and formatted again; absent values stand in one row of five."""
    tail = F.when(F.col("k") % 10 == 9, F.lit("|routed")).otherwise(F.lit(""))
    lines = [
        F.concat(F.concat_ws("|", F.lit(tag), "mac", *[_field_column(tag, i, n, t) for i, (n, t) in enumerate(cols)]), tail)
        for tag, cols in RECORDS.items()
    ]
    wire = parse_wire(g.spread(g.pk(spark, sf)).select("ts", "seq", F.explode(F.array(*lines)).alias("line")))

    def again(tag, of):
        numbers = [F.coalesce(of(n).cast("double"), F.lit(0.0)) for n, t in RECORDS[tag] if t != "string"]
        total = reduce(lambda a, b: a + b, numbers, F.lit(0.0))
        return F.struct(with_marker(wire_body(tag, of), F.col("routed")).alias("line"), total.alias("total"))

    typed = stage(wire.drop("line"), {"made": by_tag(again)}).where(F.col("made").isNotNull())
    return typed.select("seq", "tag", "made.line", "made.total")


@query(
    "wire_rejects",
    """SELECT seq, CASE k % 3 WHEN 0 THEN 'unknown tag' WHEN 1 THEN 'field count' ELSE 'bad value' END AS reason
FROM pk WHERE k % 3 < 2 OR event_type = 'click'""",
)
def _wire_rejects(spark, sf):
    """Damaged lines: an unknown tag, a missing field, a port that is no number."""
    p = g.pk(spark, sf).join(g.wire(spark, sf).select("seq", "line"), "seq")
    bare = F.regexp_replace(F.regexp_replace("line", r"\|routed$", ""), r"^OBS(\|[^|]*){3}\|", "")
    port = F.concat(F.regexp_replace(bare, r"\|[^|]*$", ""), F.lit("|x"))
    k = F.col("k")
    line = (
        F.when(k % 3 == 0, F.concat(F.lit("X"), bare))
        .when(k % 3 == 1, F.regexp_replace(bare, r"\|[^|]*$", ""))
        .otherwise(F.when(F.col("event_type") == "click", port).otherwise(bare))
    )
    return rejects(parse_wire(p.select("ts", "seq", line.alias("line")))).select("seq", "reason")


@query(
    "iface_select",
    """SELECT 'eth' || (dev % 4) AS iface, count(*) AS frames, CAST(sum(42 + 10 + k) AS BIGINT) AS bytes
FROM pk WHERE dev % 4 IN (0, 2) GROUP BY 1""",
)
def _iface_select(spark, sf):
    p = g.pk(spark, sf)
    frames = udp_frames(p, F.col("sport"), F.lit(9999), F.repeat(F.lit("ab"), F.col("k") + 10))
    named = frames.join(p.select("seq", "dev"), "seq").withColumn(
        "iface", F.concat(F.lit("eth"), (F.col("dev") % 4).cast("string"))
    )
    chosen = select_ifaces(supported_frames(named), "eth0,eth2,any")
    return chosen.groupBy("iface").agg(
        F.count("*").alias("frames"), F.sum(F.length("data")).cast("bigint").alias("bytes")
    )


@query(
    "sensor_union",
    """SELECT CASE WHEN event_type IN ('view', 'click') THEN 'sensor-a' ELSE 'sensor-b' END AS sensor_name, count(*) AS n
FROM pk GROUP BY 1""",
)
def _sensor_union(spark, sf):
    tables = typed_all(spark, sf)
    names = {"DNS": "sensor-a", "SYN": "sensor-a"}
    both = union_sensors([sensor_context(df, names.get(tag, "sensor-b")) for tag, df in tables.items()])
    return both.groupBy("sensor_name").agg(F.count("*").alias("n"))

