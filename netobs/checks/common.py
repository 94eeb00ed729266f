"""Frame tables the queries share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netobs.operators.vectors import vectors
from netobs.checks import derived as g
from netobs.plans.jobs import Options, telemetry


def hex_lower(col: str) -> Column:
    return F.lower(F.hex(F.col(col)))


def v4_frames(p: DataFrame, proto, body, src="src_ip", dst="dst_ip", **kw) -> DataFrame:
    """Device to gateway."""
    ip = g.ipv4(proto, g.ip_hex(F.col(src)), g.ip_hex(F.col(dst)), body, **kw)
    return g.as_frames(p, g.ether(g.GATEWAY, g.mac_hex(), "0800", ip))


def tcp_frames(p: DataFrame, flags, sport, dport, body="", options="", **kw) -> DataFrame:
    return v4_frames(g.spread(p), 6, g.tcp(sport, dport, flags, body, options), **kw)


def udp_frames(p: DataFrame, sport, dport, body, **kw) -> DataFrame:
    return v4_frames(g.spread(p), 17, g.udp(sport, dport, body), **kw)


def link_local(dev: Column) -> Column:
    return g.cat("fe80" + "00" * 12, g.hx(dev + 1, 2))


def v6_frames(p: DataFrame, next_hdr, body, dst="ff02" + "00" * 13 + "01", src=None, **kw) -> DataFrame:
    ip = g.ipv6(next_hdr, src if src is not None else link_local(F.col("dev")), dst, body, **kw)
    return g.as_frames(g.spread(p), g.ether("333300000001", g.mac_hex(), "86dd", ip))


def records(frames: DataFrame, tag: str, letters: str, **options) -> DataFrame:
    """One record table before deduplication, without clock and location columns."""
    selection = vectors(
        letters, "v",
        extended=options.pop("extended", False),
        quic_stateful=options.pop("quic_stateful", False),
    )
    opts = Options(selection=selection, **options)
    df = telemetry(frames, opts, raw=True)[tag]
    return df.drop("ts", "iface", "vlan").withColumn("routed", F.col("routed").cast("int"))
