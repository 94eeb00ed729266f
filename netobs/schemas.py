"""Schemas of frames, packets and the eighteen record tables."""

from __future__ import annotations

from pyspark.sql.types import (
    BinaryType,
    BooleanType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructType,
    TimestampType,
)

TYPES = {
    "binary": BinaryType(), "bigint": LongType(), "boolean": BooleanType(), "double": DoubleType(),
    "int": IntegerType(), "string": StringType(), "timestamp": TimestampType(),
}


def struct(ddl: str) -> StructType:
    """Schema of ``name type, ...`` made without a JVM, so that workers can import it too."""
    out = StructType()
    for field in ddl.split(","):
        name, kind = field.split()
        out = out.add(name, TYPES[kind])
    return out


FRAME_DDL = "ts timestamp, seq bigint, iface string, link_type string, aux_vlan int, data binary"
PREFIX_DDL = "kind string, family int, iface string, lo binary, hi binary, prefix_len int"
STATS_DDL = "ts timestamp, iface string, packets bigint, drops bigint"
WIRE_DDL = "ts timestamp, seq bigint, line string"

FRAME = struct(FRAME_DDL)
PREFIX = struct(PREFIX_DDL)
STATS = struct(STATS_DDL)
WIRE = struct(WIRE_DDL)

LINK_TYPES = ("ethernet", "raw_ip", "cooked")

# Wire columns after the tag and the device MAC, in order.
RECORDS: dict[str, list[tuple[str, str]]] = {
    "SYN": [("src_ip", "string"), ("ttl", "int"), ("window", "int"), ("wscale", "int"),
            ("mss", "int"), ("opts", "string"), ("dst_port", "int")],
    "SYNACK": [("src_ip", "string"), ("ttl", "int"), ("window", "int"), ("wscale", "int"),
               ("mss", "int"), ("opts", "string"), ("src_port", "int")],
    "TCPLVL": [("src_ip", "string"), ("dst_ip", "string"), ("dst_port", "int"),
               ("rtt_us", "bigint"), ("retrans_count", "int"), ("state_event", "string")],
    "TLS": [("src_ip", "string"), ("dst_ip", "string"), ("dst_port", "int"), ("sni", "string"),
            ("ja4", "string"), ("alpn", "string")],
    "QUIC": [("src_ip", "string"), ("dst_ip", "string"), ("dst_port", "int"), ("sni", "string"),
             ("version", "string")],
    "HTTP": [("src_ip", "string"), ("user_agent", "string")],
    "DNS": [("src_ip", "string"), ("query_domain", "string")],
    "DNSEXT": [("src_ip", "string"), ("dst_ip", "string"), ("query_domain", "string"),
               ("qtype", "int"), ("rcode", "int"), ("latency_ms", "double"), ("entropy", "double")],
    "ALERT": [("src_ip", "string"), ("kind", "string"), ("query_domain", "string"),
              ("entropy", "double")],
    "DHCP": [("src_ip", "string"), ("hostname", "string"), ("vendor_class", "string"),
             ("prl", "string")],
    "DHCP6": [("src_ip", "string"), ("msg_type", "string"), ("duid_type", "string"),
              ("vendor_class", "string"), ("oro", "string"), ("fqdn", "string")],
    "MDNS": [("src_ip", "string"), ("port", "int"), ("qname", "string")],
    "NBNS": [("src_ip", "string"), ("netbios_name", "string")],
    "LLDP": [("sysname", "string"), ("sysdesc", "string")],
    "ARP": [("sender_ip", "string"), ("target_ip", "string"), ("op", "string")],
    "NDP": [("src_ip", "string"), ("type", "string"), ("target_ip", "string"), ("flags", "string")],
    "RA": [("src_ip", "string"), ("hop_limit", "int"), ("flags", "string"),
           ("router_lifetime", "int"), ("prefix", "string"), ("prefix_len", "int"),
           ("mtu", "bigint")],
    "L7": [("src_ip", "string"), ("dst_port", "int"), ("payload", "string")],
}

# Text shown on the wire where a table holds NULL.
PLACEHOLDERS: dict[tuple[str, str], str] = {
    ("SYN", "wscale"): "-1", ("SYN", "mss"): "-1", ("SYN", "opts"): "none",
    ("SYNACK", "wscale"): "-1", ("SYNACK", "mss"): "-1", ("SYNACK", "opts"): "none",
    ("TLS", "sni"): "none", ("TLS", "alpn"): "none",
    ("DHCP6", "vendor_class"): "none", ("DHCP6", "oro"): "none", ("DHCP6", "fqdn"): "none",
    ("NDP", "target_ip"): "none", ("NDP", "flags"): "-",
    ("RA", "flags"): "-", ("RA", "prefix"): "none",
}

CONTEXT = ["ts", "seq", "sensor_name", "iface", "vlan", "mac"]


def record_columns(tag: str) -> list[str]:
    return [name for name, _ in RECORDS[tag]]


def record_schema(tag: str) -> StructType:
    fields = ", ".join(f"{n} {t}" for n, t in RECORDS[tag])
    return struct(
        "ts timestamp, seq bigint, sensor_name string, iface string, vlan string, mac string, "
        f"{fields}, routed boolean"
    )
