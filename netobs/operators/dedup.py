"""Suppression of repeated records over sliding and fixed windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netobs.plans.recurrence import anchored
from netobs.plans.slices import SLICE, drop_slices, first_rows, seconds, time_slices
from netobs.plans.stage import stage
from netobs.schemas import record_columns

DEFAULT_TTL = 35
# Shortest refresh window of discovery records, in seconds.
REFRESH_FLOORS = {"ARP": 900, "NDP": 900, "RA": 1800}

# Key columns of each record table beside the device MAC; ``routed`` is part of
# every key except LLDP's.  TCPLVL keys time and state records differently.
KEYS: dict[str, list[str]] = {
    "SYN": ["src_ip", "dst_port"],
    "SYNACK": ["src_ip", "src_port"],
    "TCPLVL": ["src_ip", "dst_port", "state_event"],
    "TLS": ["src_ip", "sni", "ja4"],
    "QUIC": ["src_ip"],
    "HTTP": ["src_ip", "user_agent"],
    "DNS": ["src_ip", "query_domain"],
    "DNSEXT": ["src_ip", "query_domain"],
    "ALERT": ["src_ip"],
    "DHCP": ["src_ip", "hostname", "vendor_class", "prl"],
    "DHCP6": ["src_ip", "msg_type", "duid_type", "vendor_class", "oro", "fqdn"],
    "MDNS": ["src_ip", "qname"],
    "NBNS": ["src_ip", "netbios_name"],
    "LLDP": ["sysname", "sysdesc"],
    "L7": ["src_ip", "payload"],
    "ARP": ["sender_ip", "target_ip", "op"],
    "NDP": ["src_ip", "type", "target_ip", "flags"],
    "RA": ["src_ip", "hop_limit", "flags", "router_lifetime", "prefix", "prefix_len", "mtu"],
}


def dedup_keys(tag: str, columns: list[str]) -> list[str]:
    """All key columns of a record table; sensors never share state."""
    own = ["sensor_name"] if "sensor_name" in columns else []
    routed = [] if tag == "LLDP" else ["routed"]
    return [*own, "mac", *KEYS[tag], *routed]


def _with_sec(df: DataFrame, sec: Column | None) -> DataFrame:
    return df.withColumn("_sec", seconds() if sec is None else sec)


def dedup_sliding(
    df: DataFrame,
    keys: list[str],
    ttl: int = DEFAULT_TTL,
    order: tuple[str, ...] = ("ts", "seq"),
    sec: Column | None = None,
    width: int | None = None,
) -> DataFrame:
    """Keep a row when its key was not seen in the ``ttl`` seconds before it.

    Suppressed rows refresh the window, so the test is the gap to the previous
    row of the key.  Only the first row per key and second can be kept, so the
    rest is cut before the shuffle; a key then holds at most one row per second
    and is further cut into time slices.
    """
    if ttl <= 0:
        return df
    width = width or max(64 * ttl, 3600)
    slim = first_rows(_with_sec(df, sec), [*keys, "_sec"], list(order))
    sliced = time_slices(slim, F.col("_sec"), width, ttl - 1)
    w = Window.partitionBy(*keys, SLICE).orderBy("_sec")
    prev = F.lag("_sec").over(w)
    kept = sliced.withColumn("_keep", prev.isNull() | (F.col("_sec") - prev >= ttl))
    return drop_slices(kept).where("_keep").drop("_keep", "_sec")


def dedup_refresh(
    df: DataFrame,
    keys: list[str],
    ttl: int,
    order: tuple[str, ...] = ("ts", "seq"),
    sec: Column | None = None,
    width: int | None = None,
) -> DataFrame:
    """Keep the first row of a key, then the first one ``ttl`` seconds or more after the last kept.

    Each decision depends on the one before (``anchored``).  At most one row per
    key and second is looked at, the others being cut before the shuffle.
    """
    if ttl <= 0:
        return df
    slim = first_rows(_with_sec(df, sec), [*keys, "_sec"], list(order))
    marked = anchored(slim, keys, "_sec", ttl, "_keep", width=width)
    return marked.where("_keep").drop("_keep", "_sec")


def refresh_ttl(tag: str, ttl: int) -> int:
    """The general window lengthens but never shortens a discovery window."""
    return max(ttl, REFRESH_FLOORS[tag]) if ttl > 0 else ttl


def dedup_records(df: DataFrame, tag: str, ttl: int = DEFAULT_TTL, enabled: bool = True) -> DataFrame:
    """Suppress repeats of one record table by its own key and window."""
    if not enabled or ttl <= 0:
        return df
    keys = dedup_keys(tag, df.columns)
    if tag in REFRESH_FLOORS:
        return dedup_refresh(df, keys, refresh_ttl(tag, ttl))
    return dedup_sliding(df, keys, ttl)


def wire_signature() -> Column:
    """Key fields of a parsed wire record as one text, by tag."""
    out = F.lit(None).cast("string")
    for tag, names in KEYS.items():
        at = [record_columns(tag).index(n) for n in names]
        out = F.when(
            F.col("tag") == tag, F.concat_ws("|", *[F.get("fields", F.lit(i)) for i in at])
        ).otherwise(out)
    return out


def dedup_wire(wire: DataFrame, ttl: int = DEFAULT_TTL) -> DataFrame:
    """Suppress repeats among parsed wire records of all tags in one pass.

    Tags with a sliding window share one shuffle; each discovery tag has its
    fixed window.
    """
    rows = stage(wire.where(F.col("reject").isNull()), {"_sig": wire_signature()})
    keys = ["sensor_name", "tag", "mac", "_sig", "_routed"]
    rows = rows.withColumn("_routed", F.col("routed") & (F.col("tag") != "LLDP"))
    fixed = F.col("tag").isin(*REFRESH_FLOORS)
    out = dedup_sliding(rows.where(~fixed), keys, ttl)
    for tag in REFRESH_FLOORS:
        kept = dedup_refresh(rows.where(F.col("tag") == tag), keys, refresh_ttl(tag, ttl))
        out = out.unionByName(kept)
    return out.drop("_sig", "_routed")
