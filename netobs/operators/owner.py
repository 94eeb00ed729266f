"""Address ownership: who last claimed an address, and the routed marker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netobs.functions.addr import is_unicast_mac
from netobs.functions.bytes import blob
from netobs.plans.slices import asof_within, seconds

OWNER_TTL = 180
PACKET_SALTS = 4


def valid_claims(claims: DataFrame, ip: str = "ip", mac: str = "owner_mac") -> DataFrame:
    """Claims of a non-zero address by a unicast MAC."""
    zero = F.col(ip).isin(bytes(4), bytes(16))
    return claims.where(is_unicast_mac(F.col(mac)) & ~zero)


def thin_claims(claims: DataFrame, keys: list[str], mac: str) -> DataFrame:
    """Drop a claim that repeats the one before it within the same second.

    Such a claim changes neither the owner nor its age, so an address keeps one
    claim per second plus the changes.
    """
    w = Window.partitionBy(*keys, "_sec").orderBy("ts", "seq")
    df = claims.withColumn("_sec", seconds())
    prev = F.lag(mac).over(w)
    return df.withColumn("_same", prev.eqNullSafe(F.col(mac))).where(~F.col("_same")).drop("_same", "_sec")


def owner_asof(
    packets: DataFrame,
    claims: DataFrame,
    keys: tuple[str, ...] = ("ip",),
    mac: str = "mac",
    owner: str = "owner_mac",
    ttl: int = OWNER_TTL,
    salts: int = PACKET_SALTS,
    out: str = "mismatch",
) -> DataFrame:
    """Add ``out``: the last claim within ``ttl`` seconds names another MAC.

    A packet is judged before a claim it carries itself.  Rows of both sides
    need ``ts`` and ``seq``.  The packet side of a busy address is cut by time
    slice and salt; claims, which are few, are copied to the salts.
    """
    ks = list(keys)
    slim = thin_claims(claims.select(*ks, "ts", "seq", owner), ks, owner)
    hit = asof_within(packets, slim, ks, [owner], ttl, "_own", width=ttl, salts=salts)
    return hit.withColumn(
        out, F.coalesce(F.col(f"_own.{owner}") != F.col(mac), F.lit(False))
    ).drop("_own")


def arp_claims(arp: DataFrame) -> DataFrame:
    """``arp`` needs ``spa`` and ``sha`` bytes."""
    return valid_claims(arp.select(*_own_keys(arp), "ts", "seq", F.col("spa").alias("ip"), F.col("sha").alias("owner_mac")))


def ndp_claims(ndp: DataFrame) -> DataFrame:
    """Source address claims of NDP / RA rows and target claims of advertisements.

    ``ndp`` needs ``src_addr, target_addr, claim_mac`` and ``is_na``.
    """
    pair = F.array(
        F.struct(F.col("src_addr").alias("ip")),
        F.struct(F.when(F.col("is_na"), F.col("target_addr")).alias("ip")),
    )
    rows = ndp.withColumn("_c", F.explode(pair)).where(F.col("_c.ip").isNotNull())
    return valid_claims(
        rows.select(*_own_keys(ndp), "ts", "seq", F.col("_c.ip").alias("ip"), F.col("claim_mac").alias("owner_mac"))
    )


def _own_keys(df: DataFrame) -> list[str]:
    return ["sensor_name"] if "sensor_name" in df.columns else []


def judged(link_type: Column, is_outbound: Column, ip: Column, mac: Column) -> Column:
    """Packets whose sender is compared with the recorded owner."""
    zero = ip.isin(bytes(4), bytes(16))
    return (
        is_outbound
        & link_type.isin("ethernet", "cooked")
        & ~zero
        & (F.length(mac) == 6)
        & (mac != blob("000000000000"))
        & is_unicast_mac(mac)
    )


def routed_flag(packets: DataFrame, claims: DataFrame | None, ttl: int = OWNER_TTL) -> DataFrame:
    """Add ``routed``: off-link source, or a sender that is not the recorded owner.

    Packets that are not judged get a NULL key: they take no part in the match
    and are spread evenly, and the packets are decoded once.
    """
    off = F.col("offlink_routed")
    if claims is None:
        return packets.withColumn("routed", off)
    ask = ~off & F.coalesce(
        judged(F.col("link_type"), F.col("is_outbound"), F.col("src_ip"), F.col("src_mac")), F.lit(False)
    )
    own = _own_keys(packets)
    asked = owner_asof(
        packets.withColumn("ip", F.when(ask, F.col("src_ip"))),
        claims,
        keys=(*own, "ip"),
        mac="src_mac",
        ttl=ttl,
    )
    return asked.withColumn("routed", off | F.col("mismatch")).drop("ip", "mismatch")
