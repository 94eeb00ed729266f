"""Rows between packets and wire lines, the same for batch jobs and streams.

Every record of every group becomes one row of a common shape: its line and the
fields by which repeats are known, who sent it, and under which rule and key it is
judged together with other rows. What is no record by itself (an end of a
connection, a DNS message, a payload that counts) carries what its record will
need in ``body``. So owners, rules and repeats are each decided once for all
tables.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from netobs.functions.addr import ip_text, mac_text
from netobs.functions.bytes import latin1
from netobs.functions.text import entropy
from netobs.functions.tls import hello_complete
from netobs.operators import records as r
from netobs.operators.decode import tcp_segments, udp_datagrams
from netobs.operators.dedup import KEYS
from netobs.operators.filters import tcp_relevant, udp_vector
from netobs.operators.owner import arp_claims, judged, ndp_claims
from netobs.operators.vectors import Selection
from netobs.plans.stage import stage
from netobs.sources.wire import wire_body

# Where the packets that a group of records reads are kept.
CONTROL, APP, ARP, LLDP, NDP = "control", "app", "arp", "lldp", "ndp"

TCP, DNS, QUIC, FLOW = "tcp", "dns", "quic", "flow"  # rules of a flow
EVENT, MESSAGE, PAYLOAD = "event", "message", "payload"  # rows that are no records yet

BODY = "mac string, src_ip string, dst_ip string, dst_port int, query_domain string, qtype int, rcode int"
OPENER = "iface string, vlan string, routed boolean, body string"

# What a row needs for the owner's test and a rule; NULL where it has none.
FIELDS = {
    "part": "int", "tag": "string", "mac": "string", "iface": "string", "vlan": "string", "line": "string", "sig": "string",
    "body": "string", "ip": "string", "smac": "string", "off": "boolean", "ask": "boolean", "rule": "string", "conn": "string",
    "kind": "string", "_fwd": "string", "_rev": "string", "is_response": "boolean", "ok": "boolean",
    "_complete": "boolean", "_record": "boolean",
}


def _rows(df: DataFrame, **made: Column | str) -> DataFrame:
    """``df`` as rows of the chain; ``made`` replaces columns of the same names."""
    cols = []
    for name, kind in FIELDS.items():
        value = made.get(name, F.col(name) if name in ("mac", "iface", "vlan") and name in df.columns else F.lit(None))
        cols.append((F.lit(value) if isinstance(value, (str, int, bool)) else value).cast(kind).alias(name))
    return df.select("ts", "seq", *r._own(df), *cols)


def _sender(df: DataFrame) -> dict[str, Column]:
    """What the owner's test needs, from the packet's sender."""
    s = F.col(r.SENDER)
    off = F.coalesce(s["offlink_routed"], F.lit(False))
    ask = ~off & F.coalesce(judged(s["link_type"], s["is_outbound"], s["src_ip"], s["src_mac"]), F.lit(False))
    return {"ip": F.hex(s["src_ip"]), "smac": F.hex(s["src_mac"]), "off": off, "ask": ask, "part": 0}


def signature(tag: str, of: Callable[[str], Column] = F.col) -> Column:
    """The key fields by which repeats of a record are known."""
    return F.to_json(F.struct(*[of(n).alias(n) for n in KEYS[tag]]))


def _record(df: DataFrame, tag: str, **more) -> DataFrame:
    sender = _sender(df) if r.SENDER in df.columns else {"off": F.col("routed"), "ask": False, "part": 0}
    return _rows(df, **(sender | {"tag": tag, "line": wire_body(tag), "sig": signature(tag)} | more))


# -- rows of the record groups ---------------------------------------------------------


def _tcp_events(seg: DataFrame) -> DataFrame:
    """Every SYN, SYN+ACK, FIN and RST once, under its connection's key."""
    rows = r.control_events(seg).withColumn("kind", r.tcp_kind()).where(F.col("kind").isNotNull())
    a, b = (F.concat_ws(":", F.hex(f"{end}_ip"), F.col(port)) for end, port in (("src", "sport"), ("dst", "dport")))
    body = F.struct(
        mac_text("src_mac").alias("mac"), ip_text("src_ip").alias("src_ip"), ip_text("dst_ip").alias("dst_ip"), F.col("dport").alias("dst_port")
    )
    return _rows(
        rows, **_sender(rows), tag=EVENT, rule=TCP, conn=F.concat_ws("|", F.least(a, b), F.greatest(a, b)), kind=F.col("kind"),
        _fwd=F.concat_ws("/", a, F.hex("src_mac")), _rev=F.concat_ws("/", b, F.hex("dst_mac")), body=F.when(F.col("kind") == "SYN", F.to_json(body)),
    )


def _messages(messages: DataFrame) -> DataFrame:
    rows = r.slim_messages(messages)
    body = F.struct(
        mac_text("src_mac").alias("mac"), ip_text("client_ip").alias("src_ip"), ip_text("server_ip").alias("dst_ip"),
        F.col("qname").alias("query_domain"), "qtype", "rcode",
    )
    return _rows(
        rows, **_sender(rows), tag=MESSAGE, rule=DNS, conn=F.concat_ws("|", F.hex("client_ip"), F.col("txid")),
        is_response=F.col("is_response"), body=F.to_json(body),
    )


def _payloads(seg: DataFrame, sel: Selection, budget: int | None) -> list[DataFrame]:
    """HTTP and TLS records; with a budget also every payload they are counted by."""
    pay = r.flow_payloads(seg, sel.groups)
    # The extractors keep the columns of a record only, so the flow travels with the sender.
    pay = pay.withColumn(
        r.SENDER, F.col(r.SENDER).withField("flow", F.concat_ws("|", F.hex("src_ip"), F.hex("dst_ip"), F.col("sport"), F.col("dport")))
    )
    rule = {} if budget is None else {"rule": FLOW, "conn": F.col(f"{r.SENDER}.flow"), "_record": True, "part": 1}
    out = []
    if "h" in sel.groups:
        out.append(_record(r.rec_http(pay), "HTTP", **rule))
    if "t" in sel.groups:
        out.append(_record(r.rec_tls(pay), "TLS", **rule))
    if rule:
        whole = F.when(F.col("dport") == 443, hello_complete(F.col("payload"))).otherwise(F.instr(latin1(F.col("payload")), "\r\n\r\n") > 0)
        counted = _rows(pay, **_sender(pay), tag=PAYLOAD, rule=FLOW, conn=F.col(f"{r.SENDER}.flow"), _record=False, _complete=whole)
        out.append(counted)
    return out


def _quic(found: DataFrame) -> DataFrame:
    """TLS records of hellos, and a QUIC record or a success for every datagram with Initials.

    Both come from one row (``tls`` or NULL), so that what is before them runs once.
    """
    slim = ["ts", "seq", *r._own(found), "iface", "vlan", "routed", r.SENDER, "device_mac", "src_ip", "dst_ip", "dport", "tls"]
    both = found.select(*slim, F.explode(F.array(F.lit("TLS"), F.lit("QUIC"))).alias("as"))
    both = both.where((F.col("as") == "QUIC") | F.col("tls").isNotNull())
    parsed = stage(both, {"_h": F.when(F.col("as") == "TLS", r.tls_client_hello(F.col("tls")))}).where((F.col("as") == "QUIC") | F.col("_h").isNotNull())
    conn = F.concat_ws("|", "device_mac", F.hex("src_ip"), F.hex("dst_ip"), F.col("dport"))
    named = parsed.withColumns(
        {
            "mac": F.col("device_mac"), "conn": conn, "ok": F.col("tls").isNotNull(), "alpn": F.col("_h.alpn"),
            "ja4": F.when(F.col("_h").isNotNull(), r.ja4_like(F.col("_h"))), "src_ip": ip_text("src_ip"), "dst_ip": ip_text("dst_ip"),
            "dst_port": F.col("dport"), "sni": F.when(F.col("as") == "QUIC", F.lit("encrypted")).otherwise(F.col("_h.sni")), "version": F.lit("v1"),
        }
    )
    tls = F.col("as") == "TLS"
    return _rows(
        named, **_sender(named), tag=F.col("as"), line=F.when(tls, wire_body("TLS")).otherwise(wire_body("QUIC")),
        sig=F.when(tls, signature("TLS")).otherwise(signature("QUIC")), rule=F.when(~tls, F.lit(QUIC)), conn=F.when(~tls, F.col("conn")),
        ok=F.when(~tls, F.col("ok")),
    )


def extracted(
    pk: DataFrame, sel: Selection, prefixes, router_macs: tuple[str, ...], budget: int | None, hellos: Callable[[DataFrame, bool], DataFrame]
) -> tuple[DataFrame, DataFrame | None]:
    """All rows, and the claims of addresses; ``pk`` are routed packets.

    ``hellos`` finds the ClientHellos of QUIC datagrams, over several if the second argument says so.
    """

    def of(*routes: str) -> DataFrame:
        return pk.where(F.col("route").isin(*routes)).drop("route")

    def whole(rows: DataFrame) -> DataFrame:
        return rows.where(F.col("ip_version").isNotNull() & ~F.col("is_fragment"))

    def grams(*names: str) -> DataFrame:
        udp = udp_datagrams(whole(of(*names))).withColumn("vector", udp_vector(sel.groups))
        return r.with_sender(udp.where(F.col("vector").isin(*names)))

    out, claims = [], None
    if "l" in sel.groups:
        arp = r.arp_messages(of(ARP), prefixes)
        claims = arp_claims(arp)
        out += [_record(r.rec_lldp(of(LLDP)), "LLDP"), _record(r.rec_arp(arp), "ARP")]
        if sel.ipv6:
            ndp = r.ndp_messages(whole(of(NDP))).withColumn("routed", F.lit(False))
            claims = claims.unionByName(ndp_claims(ndp))
            kept = ndp.withColumn(r.SENDER, F.struct("src_addr", "claim_mac", "offlink_routed"))
            of_ndp = {k: F.hex(F.col(f"{r.SENDER}.{c}")) for k, c in (("ip", "src_addr"), ("smac", "claim_mac"))}
            sender = of_ndp | {"off": F.col(f"{r.SENDER}.offlink_routed"), "ask": True, "part": 0}
            for tag, table in (("NDP", r.rec_ndp(kept)), ("RA", r.rec_ra(kept))):
                out.append(_rows(table, tag=tag, line=wire_body(tag), sig=signature(tag), **sender))
    if "s" in sel.groups:
        seg = r.with_sender(tcp_segments(whole(of(CONTROL))).where(tcp_relevant(sel.groups)))
        out += [_record(r.rec_syn(seg), "SYN"), _record(r.rec_synack(seg, router_macs), "SYNACK")]
        if sel.extended:
            out.append(_tcp_events(seg))
    if sel.groups & set("ht"):
        out += _payloads(r.with_sender(tcp_segments(whole(of(CONTROL, APP))).where(tcp_relevant(sel.groups))), sel, budget)
    if "d" in sel.groups:
        out += [_record(r.rec_dhcp(grams("DHCP")), "DHCP"), _record(r.rec_dhcp6(grams("DHCP6")), "DHCP6")]
    if "n" in sel.groups:
        out.append(_record(r.rec_nbns(grams("NBNS")), "NBNS"))
    if "m" in sel.groups:
        out += [_record(r.rec_l7(grams("L7")), "L7"), _record(r.rec_mdns(grams("MDNS")), "MDNS")]
    if "q" in sel.groups:
        messages = r.dns_messages(grams("DNS"))
        out.append(_record(r.rec_dns(messages), "DNS"))
        if sel.extended:
            out.append(_messages(messages))
    if "t" in sel.groups:
        out.append(_quic(hellos(grams("QUIC"), sel.quic_stateful)))
    return reduce(DataFrame.unionByName, out), claims


def finished(rows: DataFrame) -> DataFrame:
    """Records of what the flow rules let go; records that were whole before pass.

    Needs ``opened`` (``iface, vlan, routed, body`` of the row that an event or a
    response belongs to), ``kind``, ``rtt_us`` and ``latency_us``.
    """
    rows = stage(rows, {"_q": F.from_json("opened.body", StructType.fromDDL(BODY)), "_b": F.from_json("body", StructType.fromDDL(BODY))}, drop=("body",))
    rows = stage(rows, {"_e": entropy(F.col("_q.query_domain"))})
    q, b = F.col("_q"), F.col("_b")

    def record(tag: str, fields: dict[str, Column], iface: Column, vlan: Column, routed: Column) -> Column:
        of = fields.__getitem__
        return F.struct(
            F.lit(tag).alias("tag"), fields["mac"].alias("mac"), iface.alias("iface"), vlan.alias("vlan"),
            wire_body(tag, of).alias("line"), signature(tag, of).alias("sig"), routed.alias("routed"),
        )

    opened = F.col("opened")
    level = {"mac": q["mac"], "src_ip": q["src_ip"], "dst_ip": q["dst_ip"], "dst_port": q["dst_port"], "rtt_us": F.col("rtt_us"),
             "retrans_count": F.lit(0), "state_event": F.col("kind")}
    answer = {"mac": q["mac"], "src_ip": b["src_ip"], "dst_ip": b["dst_ip"], "query_domain": q["query_domain"], "qtype": q["qtype"],
              "rcode": b["rcode"], "latency_ms": (F.col("latency_us") / F.lit(1000.0)).cast("float").cast("double"), "entropy": F.col("_e")}
    alert = {"mac": q["mac"], "src_ip": b["src_ip"], "kind": F.lit("HIGH_DNS_ENTROPY"), "query_domain": q["query_domain"], "entropy": F.col("_e")}
    here, there, routed = F.col("iface"), F.col("vlan"), opened["routed"]
    strange = F.col("_e").cast("float") >= F.lit(r.ENTROPY_ALERT).cast("float")
    same = F.struct(*[F.col(c).alias(c) for c in ("tag", "mac", "iface", "vlan", "line", "sig", "routed")])
    made = (
        F.when(F.col("tag") == EVENT, F.array(record("TCPLVL", level, opened["iface"], opened["vlan"], routed)))
        .when(F.col("tag") == MESSAGE, F.array(record("DNSEXT", answer, here, there, routed), F.when(strange, record("ALERT", alert, here, there, routed))))
        .when(F.col("tag") == PAYLOAD, F.slice(F.array(same), 1, 0))
        .otherwise(F.array(same))
    )
    return rows.select("ts", "seq", *r._own(rows), F.inline(F.filter(made, lambda x: x.isNotNull())))
