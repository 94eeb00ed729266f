"""Registry of queries and of the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# ``events`` on a clock of 0.7 s per row, and the same rows read as packets.
PULSE = """pulse AS (
  SELECT event_id AS seq, event_id * 700000 AS ts_us, (event_id * 7) // 10 AS ts_s,
         user_id % 20 AS dev, user_id % 7 AS ipk, event_type, value,
         CAST(json_extract(props, '$.k') AS INTEGER) AS k
  FROM events)"""
PK = (
    PULSE
    + """, pk AS (
  SELECT seq, ts_us, ts_s, dev, ipk, event_type, k,
         '02:00:00:00:00:' || printf('%02x', dev) AS mac,
         printf('192.168.%d.%d', dev % 4, dev + 10) AS src_ip,
         printf('%d.%d.113.%d', CASE WHEN k < 30 THEN 10 WHEN k < 60 THEN 203 ELSE 198 END, k % 5, k) AS dst_ip,
         CAST((seq * 37) % 60000 + 1024 AS INTEGER) AS sport,
         [80, 443, 53, 8080, 5353, 1900, 67, 22][k % 8 + 1] AS dport,
         CASE WHEN k % 3 = 0 THEN 17 ELSE 6 END AS proto,
         [0, 20, 30, 100][k % 4 + 1] AS outer_vlan,
         CASE WHEN k % 4 = 3 THEN 20 ELSE 0 END AS inner_vlan
  FROM pulse)"""
)
WIRE = (
    PK
    + """, rec AS (
  SELECT *, CASE event_type
    WHEN 'view' THEN 'DNS|' || mac || '|' || src_ip || '|host' || k || '.example.com'
    WHEN 'click' THEN 'SYN|' || mac || '|' || src_ip || '|64|61000|6|1440|M*,N,W*,S,T|' || dport
    WHEN 'purchase' THEN 'TLS|' || mac || '|' || src_ip || '|' || dst_ip || '|443|shop' || k
         || '.example.com|t13d0302h2_aaaaaaaaaaaa_bbbbbbbbbbbb|h2'
    WHEN 'signup' THEN 'DHCP|' || mac || '|' || src_ip || '|host-' || dev || '|MSFT 5.0|1,3,6,15'
    ELSE 'ARP|' || mac || '|' || src_ip || '|' || dst_ip || '|request' END
    || CASE WHEN k % 10 = 9 THEN '|routed' ELSE '' END AS record FROM pk),
wire AS (
  SELECT *, CASE WHEN k % 2 = 0 THEN 'OBS|sensor-' || (dev % 3) || '|lan3|'
    || CASE k % 4 WHEN 0 THEN '0' WHEN 2 THEN '100/20' ELSE '20' END || '|' ELSE '' END || record AS line
  FROM rec)"""
)


def query(name: str, sql: str | None = None, base: str = PK):
    """Register a query; ``sql`` is its body after the common table expressions."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = fn
        if sql is not None:
            body = sql.strip()
            if not base:
                ORACLES[name] = body
            elif body.startswith(","):
                ORACLES[name] = f"WITH RECURSIVE {base}{body}"
            else:
                ORACLES[name] = f"WITH {base} {body}"
        return fn

    return add
