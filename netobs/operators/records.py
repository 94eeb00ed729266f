"""Record extractors: packets to one typed table per tag.

All extractors return ``ts, seq, [sensor_name], iface, vlan, mac``, the record
columns in wire order and ``routed``.  They filter before they parse, so the
array walks run on matching packets only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netobs.functions.addr import ip_text, ipv4_text, ipv6_text, is_unicast_mac, mac_text
from netobs.functions.bytes import bits, blob, drop, latin1, take, u8, u16, u32
from netobs.functions.dns import dhcp6_name, dns_name, dns_qtype, netbios_name
from netobs.functions.quic import (
    MIN_DATAGRAM,
    quic_initials,
    quic_open,
    quic_unprotect_at,
    stateless_hello,
)
from netobs.functions.text import UNSAFE, entropy, find_ci, sanitize, until_nul
from netobs.functions.tlv import first_of, last_of, ndp_opts, opt8, opt16, tcp_options, tlv16
from netobs.functions.tls import hello_complete, ja4_like, tls_client_hello
from netobs.operators import decode as d
from netobs.operators.dnslat import DNS_TIMEOUT, dns_latency
from netobs.operators.filters import parse_mac
from netobs.operators.flows import FLOW_IDLE, app_flow_budget
from netobs.operators.handshake import SYN_TTL, tcp_handshake
from netobs.operators.owner import routed_flag
from netobs.plans.slices import asof_within
from netobs.plans.stage import shared, stage
from netobs.schemas import record_columns

ENTROPY_ALERT = 4.2
QUIC_SUCCESS_TTL = 15


def _own(df: DataFrame) -> list[str]:
    return ["sensor_name"] if "sensor_name" in df.columns else []


SENDER = "_sender"


def with_sender(df: DataFrame) -> DataFrame:
    """Keep what ``routed_flag`` needs in one column, and ``routed`` open.

    Records are extracted first; the flag then shuffles slim records instead of
    packets (``flagged``).
    """
    fields = ("link_type", "is_outbound", "src_ip", "src_mac", "offlink_routed")
    return df.withColumns({SENDER: F.struct(*fields), "routed": F.lit(False)})


def flagged(df: DataFrame, claims: DataFrame | None) -> DataFrame:
    """Settle ``routed`` of rows that carry their sender."""
    hold = F.struct(*[c for c in df.columns if c not in ("ts", "seq", *_own(df), SENDER, "routed")])
    slim = df.select("ts", "seq", *_own(df), f"{SENDER}.*", hold.alias("_row"))
    done = routed_flag(slim, claims)
    return done.select("ts", "seq", *_own(df), "_row.*", "routed").select(*[c for c in df.columns if c != SENDER])


def _record(df: DataFrame, tag: str, mac: Column | str = "device_mac") -> DataFrame:
    m = F.col(mac) if isinstance(mac, str) else mac
    sender = [SENDER] if SENDER in df.columns else []
    return df.select(
        "ts", "seq", *_own(df), "iface", "vlan", m.alias("mac"), *record_columns(tag), "routed", *sender
    )


def _nul_text(raw: Column) -> Column:
    """Text up to a NUL, unprintable characters blanked."""
    return F.regexp_replace(until_nul(raw), UNSAFE, " ")


# -- TCP ------------------------------------------------------------------------


def _with_options(seg: DataFrame) -> DataFrame:
    return stage(seg, {"_o": tcp_options(F.col("tcp_options"))}).withColumns(
        {
            "src_ip": ip_text("src_ip"),
            "wscale": F.col("_o.wscale"),
            "mss": F.col("_o.mss"),
            "opts": F.col("_o.opts"),
        }
    )


def rec_syn(seg: DataFrame) -> DataFrame:
    """Connection requests, inbound ones included."""
    rows = _with_options(seg.where(d.has_flag(d.SYN) & ~d.has_flag(d.ACK)))
    return _record(rows.withColumn("dst_port", F.col("dport")), "SYN")


def rec_synack(seg: DataFrame, router_macs: tuple[str, ...] = ()) -> DataFrame:
    """Answers of inside servers; a router's forwarded answers are left out."""
    rows = seg.where(d.has_flag(d.SYN) & d.has_flag(d.ACK) & F.col("is_outbound"))
    if router_macs:
        rows = rows.where(~F.col("src_mac").isin(*[parse_mac(m) for m in router_macs]))
    return _record(_with_options(rows).withColumn("src_port", F.col("sport")), "SYNACK")


def tcp_kind() -> Column:
    """SYN, SYNACK, RST, FIN of a segment, NULL for others."""
    syn, ack = d.has_flag(d.SYN), d.has_flag(d.ACK)
    return (
        F.when(syn & ~ack, F.lit("SYN")).when(syn, F.lit("SYNACK"))
        .when(d.has_flag(d.RST), F.lit("RST")).when(d.has_flag(d.FIN), F.lit("FIN"))
    )


def tcp_events(seg: DataFrame) -> DataFrame:
    """SYN, SYNACK, FIN, RST events on the client's key, for ``tcp_handshake``."""
    kind = tcp_kind()
    fwd = F.struct(
        F.lit(True).alias("forward"), F.col("src_mac").alias("client_mac"), F.col("sport").alias("client_port"),
        F.col("dport").alias("server_port"), F.col("src_ip").alias("client_ip"), F.col("dst_ip").alias("server_ip"),
    )
    rev = F.struct(
        F.lit(False).alias("forward"), F.col("dst_mac").alias("client_mac"), F.col("dport").alias("client_port"),
        F.col("sport").alias("server_port"), F.col("dst_ip").alias("client_ip"), F.col("src_ip").alias("server_ip"),
    )
    rows = seg.withColumn("kind", kind).where(F.col("kind").isNotNull())
    views = F.when(F.col("kind") == "SYN", F.array(fwd)).when(F.col("kind") == "SYNACK", F.array(rev)).otherwise(
        F.array(fwd, rev)
    )
    return rows.withColumn("_v", F.explode(views)).select(
        "ts", "seq", *_own(seg), "iface", "vlan", "routed", "kind", "_v.*"
    )


def control_events(seg: DataFrame) -> DataFrame:
    """What ``tcp_events`` needs of a segment, without its bytes."""
    slim = ["ts", "seq", *_own(seg), "iface", "vlan", "routed", SENDER, "flags", "src_mac", "dst_mac", "sport", "dport", "src_ip", "dst_ip"]
    return seg.select(*slim)


HANDSHAKE_KEYS = ["client_mac", "client_port", "server_port", "client_ip", "server_ip"]


def rec_tcplvl(seg: DataFrame, ttl: int = SYN_TTL) -> DataFrame:
    """Handshake time and FIN / RST state; MAC and routed come from the SYN."""
    own = _own(seg)
    hit = tcp_handshake(
        tcp_events(seg), [*own, *HANDSHAKE_KEYS], ttl, carry=("routed", "iface", "vlan"),
        id_cols=(*own, "ts", "seq"),
    )
    rows = hit.withColumns(
        {
            "src_ip": ip_text("client_ip"),
            "dst_ip": ip_text("server_ip"),
            "dst_port": F.col("server_port"),
        }
    )
    return _record(rows, "TCPLVL", mac_text("client_mac"))


def flow_payloads(
    seg: DataFrame,
    groups: frozenset[str] = frozenset("ht"),
    budget: int | None = None,
    idle: int = FLOW_IDLE,
) -> DataFrame:
    """HTTP / TLS client payloads; with a ``budget``, those inside the parsing budget of their flow."""
    ports = ([80, 8080] if "h" in groups else []) + ([443] if "t" in groups else [])
    rows = seg.where(F.col("dport").isin(*ports) & (F.length("payload") > 0))
    if budget is None:
        return rows
    done = F.when(F.col("dport") == 443, hello_complete(F.col("payload"))).otherwise(
        F.instr(latin1(F.col("payload")), "\r\n\r\n") > 0
    )
    keys = [*_own(seg), "src_ip", "dst_ip", "sport", "dport"]
    return app_flow_budget(rows.withColumn("complete", done), keys, idle=idle, budget=budget)


def rec_http(payloads: DataFrame) -> DataFrame:
    text = latin1(F.col("payload"))
    rows = payloads.where(
        F.col("dport").isin(80, 8080)
        & (F.length("payload") > 16)
        & (take(F.col("payload"), 0, 4).isin(b"GET ") | take(F.col("payload"), 0, 5).isin(b"POST "))
    )
    rows = stage(rows, {"_t": text})
    at = find_ci(F.col("_t"), "\r\nUser-Agent: ")
    rest = F.substring(F.col("_t"), at + 14, F.length("_t"))
    rows = stage(rows, {"_r": rest}, where=at > 0).where(F.instr("_r", "\r\n") > 0)
    agent = F.regexp_replace(F.substring_index("_r", "\r\n", 1), UNSAFE, " ")
    rows = stage(rows, {"user_agent": agent}).withColumn("src_ip", ip_text("src_ip"))
    return _record(rows.where(F.col("user_agent") != ""), "HTTP")


def _tls_columns(rows: DataFrame, record: str) -> DataFrame:
    return _hello_columns(stage(rows, {"_h": tls_client_hello(F.col(record))}).where(F.col("_h").isNotNull()))


def _hello_columns(parsed: DataFrame) -> DataFrame:
    return parsed.withColumns(
        {
            "sni": F.col("_h.sni"),
            "alpn": F.col("_h.alpn"),
            "ja4": ja4_like(F.col("_h")),
            "src_ip": ip_text("src_ip"),
            "dst_ip": ip_text("dst_ip"),
            "dst_port": F.col("dport"),
        }
    )


def _hello_payload() -> Column:
    """A TCP payload that begins a ClientHello."""
    p = F.col("payload")
    return (F.col("dport") == 443) & (F.length(p) > 44) & (u8(p, 0) == 22) & (u8(p, 5) == 1)


def rec_tls(payloads: DataFrame) -> DataFrame:
    """Client fingerprints from TCP port 443 (QUIC adds its own)."""
    return _record(_tls_columns(payloads.where(_hello_payload()), "payload"), "TLS")


def hello_sources(packets: DataFrame, vector: Column) -> DataFrame:
    """TCP payloads that begin a ClientHello (``vector`` NULL) and long QUIC datagrams, decoded in one pass."""
    tcp = F.col("proto") == d.TCP
    rows = stage(d.tcp_and_udp(packets), {"vector": F.when(~tcp, vector)})
    gram = (F.col("vector") == "QUIC") & (F.length("payload") >= MIN_DATAGRAM)
    return with_sender(rows.where(F.when(tcp, _hello_payload()).otherwise(gram)))


def rec_all_tls(sources: DataFrame) -> DataFrame:
    """Client fingerprints of ``hello_sources``, of datagrams that carry a hello alone."""
    rows = with_initials(sources, also=F.col("vector").isNull())
    tls = F.when(F.col("vector").isNull(), F.col("payload")).otherwise(stateless_hello(F.col("initials")))
    return rec_quic_tls(stage(rows, {"tls": tls}))


# -- QUIC -----------------------------------------------------------------------


def with_initials(
    df: DataFrame, payload: str = "payload", out: str = "initials", decrypt: bool = True, also: Column | None = None
) -> DataFrame:
    """Add the Initial packets of each datagram that has some.

    ``out``: ``ARRAY<STRUCT<off, dcid, u, plain>>``; ``plain`` is NULL when the
    packet does not verify, and missing without ``decrypt``. Rows with ``also``
    are no datagrams and stay, without Initials.
    """
    b = F.col(payload)
    if also is None:
        found = stage(df, {"_init": quic_initials(b)}).where(F.size("_init") > 0)
    else:
        found = stage(df, {"_init": quic_initials(F.when(~also, b))}).where(also | (F.size("_init") > 0))
    opened = F.transform(
        "_init",
        lambda i: F.struct(
            i["off"].alias("off"),
            i["dcid"].alias("dcid"),
            quic_unprotect_at(b, i).alias("u"),
        ),
    )
    if not decrypt:
        return stage(found, {out: opened}, drop=("_init",))
    plain = F.transform(
        "_u",
        lambda i: F.struct(
            i["off"].alias("off"),
            i["dcid"].alias("dcid"),
            i["u"].alias("u"),
            F.when(i["u"].isNotNull(), quic_open(i["u"])).alias("plain"),
        ),
    )
    return stage(stage(found, {"_u": opened}, drop=("_init",)), {out: plain}, drop=("_u",))


def quic_datagrams(udp: DataFrame) -> DataFrame:
    """Datagrams long enough to start a connection, with decrypted Initials."""
    return with_initials(long_datagrams(udp))


def long_datagrams(udp: DataFrame) -> DataFrame:
    return udp.where((F.col("vector") == "QUIC") & (F.length("payload") >= MIN_DATAGRAM))


def quic_hello(datagrams: DataFrame) -> DataFrame:
    """Add ``tls``: the ClientHello a datagram carries alone, NULL on failure."""
    return stage(datagrams, {"tls": stateless_hello(F.col("initials"))})


def rec_quic_tls(hellos: DataFrame) -> DataFrame:
    rows = hellos.where(F.col("tls").isNotNull())
    return _record(_tls_columns(rows, "tls"), "TLS")


def rec_parsed_tls(parsed: DataFrame) -> DataFrame:
    """TLS records of parsed hellos (``_h``)."""
    return _record(_hello_columns(parsed), "TLS")


def quic_failure_gate(
    failures: DataFrame, successes: DataFrame, keys: list[str], ttl: int = QUIC_SUCCESS_TTL
) -> DataFrame:
    """Drop failures of a flow that succeeded ``ttl`` seconds ago or less."""
    ok = successes.select(*keys, "ts", "seq", F.lit(True).alias("ok"))
    hit = asof_within(failures, ok, keys, ["ok"], ttl, "_s")
    return hit.where(F.col("_s").isNull()).drop("_s")


def rec_quic(hellos: DataFrame) -> DataFrame:
    """``encrypted`` records of Initials that gave no hello, behind the failure gate."""
    keys = [*_own(hellos), "device_mac", "src_ip", "dst_ip", "dport"]
    slim = ["ts", "seq", "iface", "vlan", "routed", *([SENDER] if SENDER in hellos.columns else []), *keys]
    both = shared(hellos.select(*slim, F.col("tls").isNotNull().alias("_ok")), "ts", "seq")
    gated = quic_failure_gate(
        both.where(~F.col("_ok")).drop("_ok"), both.where("_ok").drop("_ok"), keys
    )
    rows = gated.withColumns(
        {
            "src_ip": ip_text("src_ip"),
            "dst_ip": ip_text("dst_ip"),
            "dst_port": F.col("dport"),
            "sni": F.lit("encrypted"),
            "version": F.lit("v1"),
        }
    )
    return _record(rows, "QUIC")


# -- UDP ------------------------------------------------------------------------


def _named(rows: DataFrame) -> DataFrame:
    return rows.withColumn("src_ip", ip_text("src_ip"))


def dns_messages(udp: DataFrame) -> DataFrame:
    """DNS queries to and responses from port 53 with decoded header fields.

    Queries without a readable name are dropped; ``client_ip`` is the end that
    asked.
    """
    p = F.col("payload")
    flags = u16(p, 2)
    resp = bits(flags, 32768) != 0
    rows = stage(
        udp.where(F.col("vector") == "DNS"),
        {"txid": u16(p, 0), "rcode": bits(flags, 15), "is_response": resp},
        where=F.length(p) > 12,
    )
    rows = rows.where(
        (~F.col("is_response") & (F.col("dport") == 53)) | (F.col("is_response") & (F.col("sport") == 53))
    )
    query = ~F.col("is_response")
    rows = stage(rows, {"qname": F.when(query, dns_name(p, 12))}).withColumns(
        {
            "qtype": F.when(query, dns_qtype(p, 12)),
            "client_ip": F.when(query, F.col("src_ip")).otherwise(F.col("dst_ip")),
            "server_ip": F.when(query, F.col("dst_ip")).otherwise(F.col("src_ip")),
        }
    )
    return rows.where(F.col("is_response") | (F.col("qname") != ""))


def slim_messages(messages: DataFrame) -> DataFrame:
    """DNS messages without their bytes."""
    slim = ["ts", "seq", *_own(messages), "iface", "vlan", "routed", SENDER, "device_mac", "src_mac", "src_ip", "is_response",
            "client_ip", "server_ip", "txid", "rcode", "qtype", "qname"]
    return messages.select(*slim)


def rec_dns(messages: DataFrame) -> DataFrame:
    rows = _named(messages.where(~F.col("is_response")))
    return _record(rows.withColumn("query_domain", F.col("qname")), "DNS")


def rec_dnsext(messages: DataFrame, timeout: float = DNS_TIMEOUT) -> DataFrame:
    """Answered queries; MAC, name, type and routed are the query's."""
    own = _own(messages)
    slim = messages.select(
        "ts", "seq", *own, "iface", "vlan", "is_response", "client_ip", "server_ip", "txid", "rcode",
        "qtype", "routed", F.col("qname").alias("query_domain"),
        F.col("src_mac").alias("client_mac"),
    )
    hit = dns_latency(
        slim, [*own, "client_ip", "txid"], timeout,
        carry=("query_domain", "qtype", "client_mac", "routed"),
    )
    rows = stage(hit, {"entropy": entropy(F.col("query_domain"))}).withColumns(
        {
            "src_ip": ip_text("client_ip"),
            "dst_ip": ip_text("server_ip"),
            "latency_ms": (F.col("latency_us") / F.lit(1000.0)).cast("float").cast("double"),
        }
    )
    return _record(rows, "DNSEXT", mac_text("client_mac"))


def rec_alert(dnsext: DataFrame, threshold: float = ENTROPY_ALERT) -> DataFrame:
    """High-entropy names, from answered queries before deduplication."""
    limit = F.lit(threshold).cast("float")
    rows = dnsext.where(F.col("entropy").cast("float") >= limit)
    return _record(rows.withColumn("kind", F.lit("HIGH_DNS_ENTROPY")), "ALERT", "mac")


def rec_dhcp(udp: DataFrame) -> DataFrame:
    p = F.col("payload")
    rows = stage(
        udp.where(F.col("vector") == "DHCP"),
        {"_o": opt8(drop(p, 240))},
        where=(F.length(p) >= 241) & (take(p, 236, 4) == blob("63825363")),
    )
    rows = rows.withColumns(
        {"_host": last_of(F.col("_o"), 12), "_vend": last_of(F.col("_o"), 60), "_prl": last_of(F.col("_o"), 55, 1)}
    ).where(F.exists("_o", lambda o: o["t"].isin(12, 55, 60)))
    codes = F.transform(
        F.sequence(F.lit(0), F.greatest(F.length("_prl") - 1, F.lit(0))),
        lambda i: u8(F.col("_prl"), i).cast("string"),
    )
    rows = rows.withColumns(
        {
            "hostname": F.coalesce(_nul_text(F.col("_host")), F.lit("")),
            "vendor_class": F.coalesce(_nul_text(F.col("_vend")), F.lit("")),
            "prl": F.when(F.col("_prl").isNotNull(), F.array_join(codes, ",")).otherwise(F.lit("")),
        }
    )
    return _record(_named(rows), "DHCP")


def dhcp6_msg_name(code: Column) -> Column:
    # Client message types.
    names = {1: "SOLICIT", 3: "REQUEST", 4: "CONFIRM", 5: "RENEW", 6: "REBIND", 8: "RELEASE",
             9: "DECLINE", 11: "INFORMATION"}
    return _lookup(code, names, "OTHER")


def dhcp6_duid_name(code: Column) -> Column:
    # Identifier types.
    return _lookup(code, {1: "LLT", 2: "EN", 3: "LL", 4: "UUID"}, "UNKNOWN")


def _lookup(code: Column, names: dict[int, str], default: str) -> Column:
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.try_element_at(table, code), F.lit(default))


def rec_dhcp6(udp: DataFrame) -> DataFrame:
    p = F.col("payload")
    rows = stage(
        udp.where(F.col("vector") == "DHCP6"),
        {"_o": opt16(drop(p, 4))},
        where=(F.length(p) >= 4) & ~u8(p, 0).isin(12, 13),
    )
    rows = stage(
        rows,
        {
            "_duid": last_of(F.col("_o"), 1, 2),
            "_oro": last_of(F.col("_o"), 6, 2),
            "_fqdn": last_of(F.col("_o"), 39, 2),
            # a vendor class counts only when its first entry fits the option
            "_vend": last_of(
                F.filter(
                    "_o",
                    lambda o: (o["t"] == 16) & (F.length(o["v"]) >= 6) & (u16(o["v"], 4) <= F.length(o["v"]) - 6),
                ),
                16,
            ),
        },
    )
    wanted = F.transform(
        F.sequence(F.lit(0), F.greatest(F.floor(F.length("_oro") / 2).cast("int") - 1, F.lit(0))),
        lambda i: u16(F.col("_oro"), i * 2).cast("string"),
    )
    vendor = sanitize(take(F.col("_vend"), 6, u16(F.col("_vend"), 4)))
    rows = rows.withColumns(
        {
            "msg_type": dhcp6_msg_name(u8(p, 0)),
            "duid_type": F.when(F.col("_duid").isNull(), F.lit("UNKNOWN")).otherwise(
                dhcp6_duid_name(u16(F.col("_duid"), 0))
            ),
            "vendor_class": F.when(vendor != "", vendor),
            "oro": F.when(F.col("_oro").isNotNull(), F.array_join(wanted, ",")),
            "fqdn": F.when(F.col("_fqdn").isNotNull(), dhcp6_name(drop(F.col("_fqdn"), 1))),
        }
    )
    return _record(_named(rows), "DHCP6")


def rec_mdns(udp: DataFrame) -> DataFrame:
    p = F.col("payload")
    rows = stage(
        udp.where(F.col("vector") == "MDNS"),
        {
            "qname": dns_name(p, 12),
            "port": F.when(F.col("dport") == 5353, F.col("dport")).otherwise(F.col("sport")),
        },
        where=(F.length(p) >= 12) & (u16(p, 4) != 0),
    )
    return _record(_named(rows.where(F.col("qname") != "")), "MDNS")


def rec_nbns(udp: DataFrame) -> DataFrame:
    p = F.col("payload")
    rows = stage(
        udp.where(F.col("vector") == "NBNS"),
        {"netbios_name": netbios_name(take(p, 13, 32))},
        where=(F.length(p) >= 50) & (u8(p, 12) == 32),
    )
    return _record(_named(rows.where(F.col("netbios_name") != "")), "NBNS")


def rec_l7(udp: DataFrame) -> DataFrame:
    """Discovery text, sanitised, lower case."""
    rows = udp.where(F.col("vector") == "L7").withColumns(
        {
            "dst_port": F.when(F.col("dport").isin(1900, 3702), F.col("dport")).otherwise(F.col("sport")),
            "payload": sanitize(F.col("payload"), lower=True),
        }
    )
    return _record(_named(rows.where(F.col("payload") != "")), "L7")


# -- link layer -----------------------------------------------------------------


def rec_lldp(packets: DataFrame) -> DataFrame:
    rows = stage(packets.where(F.col("l3_proto") == d.ETH_LLDP), {"_o": tlv16(F.col("l4"))})
    rows = rows.where(F.exists("_o", lambda o: o["t"].isin(5, 6))).withColumns(
        {
            "sysname": F.coalesce(_nul_text(last_of(F.col("_o"), 5)), F.lit("")),
            "sysdesc": F.coalesce(_nul_text(last_of(F.col("_o"), 6)), F.lit("")),
            "routed": F.col("offlink_routed"),
        }
    )
    return _record(rows, "LLDP")


def arp_messages(packets: DataFrame, prefixes) -> DataFrame:
    """Ethernet / IPv4 ARP with a unicast sender; ``routed`` is off-link only."""
    p = F.col("l4")
    rows = stage(
        packets.where(F.col("l3_proto") == d.ETH_ARP),
        {"sha": take(p, 8, 6), "spa": take(p, 14, 4), "tpa": take(p, 24, 4), "_op": u16(p, 6)},
        where=(F.length(p) >= 28) & (take(p, 0, 6) == blob("000108000604")),
    )
    return prefixes.classified(rows.where(is_unicast_mac(F.col("sha"))), {}, {"spa": "routed"})


def rec_arp(arp: DataFrame) -> DataFrame:
    """The MAC of the record is the sender hardware address."""
    rows = arp.withColumns(
        {
            "sender_ip": ipv4_text("spa"),
            "target_ip": ipv4_text("tpa"),
            "op": F.when(F.col("_op") == 1, F.lit("request")).when(F.col("_op") == 2, F.lit("reply")).otherwise(F.lit("other")),
        }
    )
    return _record(rows, "ARP", mac_text("sha"))


def flag_letters(byte: Column, letters: str) -> Column:
    """Letters of the top bits that are set; NULL when none is."""
    text = F.concat(
        *[F.when(bits(byte, 128 >> i) != 0, F.lit(x)).otherwise(F.lit("")) for i, x in enumerate(letters)]
    )
    return F.when(text != "", text)


def ndp_messages(packets: DataFrame) -> DataFrame:
    """Router and neighbour discovery with the MAC that identifies the sender.

    Adds ``kind`` (RS, RA, NS, NA), ``opts, claim_mac, src_addr, target_addr,
    is_na``.  ``routed`` must be set by the caller (``ndp_routed``).
    """
    p = F.col("l4")
    kind = (
        F.when(u8(p, 0) == 133, F.lit("RS")).when(u8(p, 0) == 134, F.lit("RA"))
        .when(u8(p, 0) == 135, F.lit("NS")).when(u8(p, 0) == 136, F.lit("NA"))
    )
    rows = stage(
        packets.where((F.col("ip_version") == 6) & (F.col("proto") == d.ICMPV6)),
        {"kind": kind},
        where=F.length(p) >= 8,
    )
    start = F.when(F.col("kind") == "RS", F.lit(8)).when(F.col("kind") == "RA", F.lit(16)).otherwise(F.lit(24))
    rows = stage(
        rows.where(F.col("kind").isNotNull()),
        {"opts": ndp_opts(drop(p, start))},
        where=F.length(p) >= start,
    )
    lla = F.when(F.col("kind") == "NA", first_of(F.col("opts"), 2, 8)).otherwise(first_of(F.col("opts"), 1, 8))
    rows = stage(rows, {"_lla": take(lla, 2, 6)})
    use_option = (F.col("kind") != "RA") & F.coalesce(is_unicast_mac(F.col("_lla")), F.lit(False))
    return rows.withColumns(
        {
            "claim_mac": F.when(use_option, F.col("_lla")).otherwise(F.col("src_mac")),
            "src_addr": F.col("src_ip"),
            "target_addr": F.when(F.col("kind").isin("NS", "NA"), take(p, 8, 16)),
            "is_na": F.col("kind") == "NA",
        }
    ).drop("_lla")


def rec_ndp(ndp: DataFrame) -> DataFrame:
    rows = ndp.where(F.col("kind") != "RA").withColumns(
        {
            "src_ip": ipv6_text("src_addr"),
            "type": F.col("kind"),
            "target_ip": F.when(F.col("target_addr").isNotNull(), ipv6_text("target_addr")),
            "flags": F.when(F.col("is_na"), flag_letters(u8(F.col("l4"), 4), "RSO")),
        }
    )
    return _record(rows, "NDP", mac_text("claim_mac"))


def rec_ra(ndp: DataFrame) -> DataFrame:
    """Router advertisements: first prefix option, last MTU option."""
    p = F.col("l4")
    rows = ndp.where(F.col("kind") == "RA").withColumns(
        {"_pfx": first_of(F.col("opts"), 3, 32), "_mtu": last_of(F.col("opts"), 5, 8)}
    )
    rows = rows.withColumns(
        {
            "src_ip": ipv6_text("src_addr"),
            "hop_limit": u8(p, 4),
            "flags": flag_letters(u8(p, 5), "MOH"),
            "router_lifetime": u16(p, 6),
            "prefix": F.when(F.col("_pfx").isNotNull(), ipv6_text("substring(_pfx, 17, 16)")),
            "prefix_len": F.coalesce(u8(F.col("_pfx"), 2), F.lit(0)),
            "mtu": F.coalesce(u32(F.col("_mtu"), 4), F.lit(0).cast("bigint")),
        }
    )
    return _record(rows, "RA", mac_text("src_mac"))
