"""Whole jobs: frames to record tables, to wire lines, to inspector lines."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netobs.operators import records as r
from netobs.operators.classify import PrefixSet, PrefixTable, direction
from netobs.functions.bytes import bits, u8, u16
from netobs.operators import decode as d
from netobs.operators.decode import decode_frames, device_identity, tcp_segments, udp_datagrams
from netobs.operators.dedup import DEFAULT_TTL, REFRESH_FLOORS, dedup_records, dedup_refresh, dedup_sliding, refresh_ttl
from netobs.operators.dnslat import DNS_TIMEOUT, dns_latency
from netobs.operators.filters import (
    exclude_filter,
    hard_mac_exclusion,
    interest_prefilter,
    router_mac_exclusion,
    target_filter,
    tcp_relevant,
    udp_vector,
)
from netobs.operators.flows import app_flow_budget
from netobs.operators.handshake import tcp_handshake
from netobs.operators.inspect import inspect_packets
from netobs.operators.owner import arp_claims, ndp_claims, owner_asof
from netobs.operators.reassembly import AT, OPENED, hello_records, opened_initials, quic_reassemble, stateful_packets
from netobs.operators.vectors import Selection, vectors
from netobs.plans.rows import APP, ARP, CONTROL, EVENT, FLOW, LLDP, MESSAGE, NDP, PAYLOAD, QUIC, extracted, finished
from netobs.plans.slices import first_rows
from netobs.plans.stage import discard, shared, stage, work_folder
from netobs.schemas import record_columns
from netobs.sources.frames import select_ifaces
from netobs.sources.sensor import check_sensor, sensor_context
from netobs.sources.sinks import Sink, write_telemetry
from netobs.sources.wire import format_wire, with_marker, wrap_observation


@dataclass(frozen=True)
class Options:
    """Settings of a telemetry job."""

    selection: Selection = field(default_factory=vectors)
    prefixes: PrefixSet | PrefixTable = field(default_factory=PrefixSet)
    iface: str = "any"
    exclude: str | None = None
    target: str | None = None
    router_macs: tuple[str, ...] = ()
    hard_macs: tuple[str, ...] = ()
    dedup_ttl: int = DEFAULT_TTL
    flow_budget: int | None = None  # payloads of a flow that HTTP and TLS parse; all by default
    sensor_name: str | None = None

    def __post_init__(self):
        check_sensor(
            self.sensor_name is not None,
            self.sensor_name,
            self.iface,
            () if self.sensor_name else self.prefixes.inside,
        )


def located_packets(frames: DataFrame, opts: Options, prefilter: bool = True) -> DataFrame:
    """Decoded packets with direction, before any user filter."""
    rows = select_ifaces(frames, opts.iface, opts.sensor_name is not None)
    if opts.sensor_name is not None:
        rows = sensor_context(rows, opts.sensor_name)
    if prefilter:
        rows = interest_prefilter(rows)
    return direction(decode_frames(rows, opts.selection.ipv6), opts.prefixes)


def packets(frames: DataFrame, opts: Options) -> DataFrame:
    """Filtered packets with device identity, in the order the rules apply."""
    rows = exclude_filter(located_packets(frames, opts), opts.exclude)
    rows = router_mac_exclusion(hard_mac_exclusion(rows, opts.hard_macs), opts.router_macs)
    return device_identity(target_filter(rows, opts.target))


def _ndp_routed(ndp: DataFrame, claims: DataFrame) -> DataFrame:
    """Off-link source or another owner, without a direction test."""
    own = ["sensor_name"] if "sensor_name" in ndp.columns else []
    rows = owner_asof(
        ndp.withColumn("ip", F.col("src_addr")), claims, keys=(*own, "ip"), mac="claim_mac"
    ).drop("ip")
    return rows.withColumn("routed", F.col("offlink_routed") | F.col("mismatch")).drop("mismatch")


def with_route(pk: DataFrame, opts: Options) -> DataFrame:
    """Add ``route``: the part of the stored packets a packet belongs to; others are dropped.

    TCP packets that open or close are apart from those with data only, datagrams
    go by their vector.
    """
    groups, b, l3 = opts.selection.groups, F.col("l4"), F.col("l3_proto")
    ip = F.col("ip_version").isNotNull() & ~F.col("is_fragment")
    proto = F.col("proto")
    rows = pk.withColumns({"sport": u16(b, 0), "dport": u16(b, 2)})
    control = bits(u8(b, 13), d.SYN | d.FIN | d.RST) != 0
    route = F.lit(None).cast("string")
    if groups & set("dnmqt"):
        route = F.when(ip & (proto == d.UDP), udp_vector(groups)).otherwise(route)
    if groups & set("sht"):
        app = F.lit(APP) if groups & set("ht") else F.lit(None).cast("string")
        route = F.when(ip & (proto == d.TCP), F.when(control, F.lit(CONTROL)).otherwise(app)).otherwise(route)
    if "l" in groups:
        route = (
            F.when(l3 == d.ETH_ARP, F.lit(ARP)).when(l3 == d.ETH_LLDP, F.lit(LLDP))
            .when(ip & (proto == d.ICMPV6), F.lit(NDP)).otherwise(route)
        )
    # ``l4`` is cut out by now; the frame around it would be stored a second time.
    return rows.withColumn("route", route).drop("sport", "dport", "data").where(F.col("route").isNotNull())


def telemetry(
    frames: DataFrame, opts: Options, raw: bool = False, store: str | None = None
) -> dict[str, DataFrame]:
    """Record tables by tag; a table that is not used is never computed.

    ``raw`` leaves all tables as extracted, before deduplication.  ``store`` names
    a folder all executors share: the frames are decoded once, written there by
    route, and every table reads only its own routes; the caller removes the
    folder when the tables are no longer read (``write_job`` does).
    """
    sel = opts.selection
    pk = packets(frames, opts)
    if store is not None:
        routed = with_route(pk, opts)
        routed.write.partitionBy("route").parquet(store)
        pk = frames.sparkSession.read.schema(routed.schema).parquet(store)

    def of(*routes: str) -> DataFrame:
        return pk if store is None else pk.where(F.col("route").isin(*routes)).drop("route")

    def whole(rows: DataFrame) -> DataFrame:
        return rows.where(F.col("ip_version").isNotNull() & ~F.col("is_fragment"))

    out: dict[str, DataFrame] = {}
    claims = None

    if "l" in sel.groups:
        arp = r.arp_messages(of(ARP), opts.prefixes)
        claims = arp_claims(arp)
        if sel.ipv6:
            ndp = r.ndp_messages(whole(of(NDP)))
            claims = claims.unionByName(ndp_claims(ndp))
            ndp = _ndp_routed(ndp, claims)
            out["NDP"], out["RA"] = r.rec_ndp(ndp), r.rec_ra(ndp)
        out["LLDP"], out["ARP"] = r.rec_lldp(of(LLDP)), r.rec_arp(arp)

    # Records are extracted before the routed flag, which shuffles: no packet bytes travel.
    if sel.groups & set("sht"):
        if "s" in sel.groups:
            seg = r.with_sender(tcp_segments(whole(of(CONTROL))).where(tcp_relevant(sel.groups)))
            out["SYN"] = r.flagged(r.rec_syn(seg), claims)
            out["SYNACK"] = r.flagged(r.rec_synack(seg, opts.router_macs), claims)
            if sel.extended:
                out["TCPLVL"] = r.rec_tcplvl(r.flagged(r.control_events(seg), claims))
        if sel.groups & set("ht"):
            seg = r.with_sender(tcp_segments(whole(of(CONTROL, APP))).where(tcp_relevant(sel.groups)))
            pay = r.flow_payloads(seg, sel.groups, opts.flow_budget)
            if "h" in sel.groups:
                out["HTTP"] = r.flagged(r.rec_http(pay), claims)
            if "t" in sel.groups and opts.flow_budget is not None:
                out["TLS"] = r.flagged(r.rec_tls(pay), claims)

    if sel.groups & set("dnmqt"):

        def grams(*names: str) -> DataFrame:
            udp = udp_datagrams(whole(of(*names))).withColumn("vector", udp_vector(sel.groups))
            return r.with_sender(udp.where(F.col("vector").isin(*names)))

        if "d" in sel.groups:
            out["DHCP"] = r.flagged(r.rec_dhcp(grams("DHCP")), claims)
            out["DHCP6"] = r.flagged(r.rec_dhcp6(grams("DHCP6")), claims)
        if "n" in sel.groups:
            out["NBNS"] = r.flagged(r.rec_nbns(grams("NBNS")), claims)
        if "m" in sel.groups:
            out["L7"] = r.flagged(r.rec_l7(grams("L7")), claims)
            out["MDNS"] = r.flagged(r.rec_mdns(grams("MDNS")), claims)
        if "q" in sel.groups:
            msgs = r.flagged(r.slim_messages(r.dns_messages(grams("DNS"))), claims)
            out["DNS"] = r.rec_dns(msgs)
            if sel.extended:
                out["DNSEXT"] = r.rec_dnsext(msgs)
                out["ALERT"] = r.rec_alert(out["DNSEXT"])
        if "t" in sel.groups:
            quic_tls, quic = quic_tables(grams("QUIC"), sel.quic_stateful)
            out["QUIC"] = r.flagged(quic, claims)
            if "TLS" in out:
                out["TLS"] = out["TLS"].unionByName(r.flagged(quic_tls, claims))
            else:  # without a budget nothing but the packets decides, so TCP and QUIC are read together
                sources = r.hello_sources(whole(of(CONTROL, APP, "QUIC")), udp_vector(sel.groups))
                out["TLS"] = r.flagged(all_tls(sources, sel.quic_stateful), claims)

    if raw:
        return out
    return {
        tag: dedup_records(df, tag, opts.dedup_ttl, sel.deduplicated(tag)) for tag, df in out.items()
    }


def _kept(df: DataFrame, path: str, *by: str) -> DataFrame:
    """A table written to the shared folder and read again."""
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def job_lines(frames: DataFrame, opts: Options, store: str) -> DataFrame:
    """``ts, seq, [sensor_name], iface, vlan, tag, line`` of a whole batch job.

    Packets are decoded once and stored by route in the folder ``store``, which
    all executors share; the rows of all tables are extracted from there and meet
    the owners of addresses together, once, and are stored in turn. Rules and
    repeats are then decided over slim rows. The caller removes the folder when
    the lines are no longer read (``write_job`` does).
    """
    sel = opts.selection
    pk = _kept(with_route(packets(frames, opts), opts), f"{store}/packets", "route")
    rows, claims = extracted(pk, sel, opts.prefixes, opts.router_macs, opts.flow_budget, found_hellos)
    own, off = r._own(rows), F.coalesce(F.col("off"), F.lit(False))
    if claims is None:
        rows = rows.withColumn("routed", off)
    else:
        known = claims.select("ts", "seq", *own, F.hex("ip").alias("ip"), F.hex("owner_mac").alias("owner_mac"))
        asked = rows.withColumn("ip", F.when(F.col("ask"), F.col("ip")))  # others match nothing and are spread
        rows = owner_asof(asked, known, keys=(*own, "ip"), mac="smac").withColumn("routed", off | F.col("mismatch")).drop("mismatch")
    rows = _kept(rows.drop("ip", "smac", "off", "ask"), f"{store}/rows", "tag")
    lines = _suppressed(_records(rows, opts), opts).withColumn("line", with_marker(F.col("line"), F.col("routed")))
    if opts.sensor_name is not None:
        lines = wrap_observation(lines)
    return lines.select("ts", "seq", *own, "iface", "vlan", "tag", "line")


def _records(rows: DataFrame, opts: Options) -> DataFrame:
    """Records of stored rows: whole ones, and those that the rules of a flow make."""
    own, sel = r._own(rows), opts.selection
    none = F.lit(None).cast("struct<iface: string, vlan: string, routed: boolean, body: string>").alias("opened")
    shape = ["ts", "seq", *own, "tag", "mac", "iface", "vlan", "line", "sig", "body", "routed", "kind"]

    def whole(part: DataFrame) -> DataFrame:
        return part.select(*shape, none, *[F.lit(None).cast("bigint").alias(c) for c in ("rtt_us", "latency_us")])

    opener = F.struct("iface", "vlan", "routed", "body")
    parts = [whole(rows.where(~F.col("tag").isin(EVENT, MESSAGE, PAYLOAD) & F.col("rule").isNull()))]
    if "s" in sel.groups and sel.extended:
        sides = F.when(F.col("kind") == "SYN", F.array("_fwd")).when(F.col("kind") == "SYNACK", F.array("_rev")).otherwise(F.array("_fwd", "_rev"))
        seen = rows.where(F.col("tag") == EVENT).withColumn("first", opener).withColumn("client", F.explode(sides))
        seen = seen.withColumn("forward", F.col("client") == F.col("_fwd"))
        hit = tcp_handshake(seen, [*own, "conn", "client"], carry=("first",), id_cols=(*own, "ts", "seq"))
        parts.append(_made(hit, EVENT, kind=F.col("state_event"), opened=F.col("first"), rtt_us=F.col("rtt_us")))
    if "q" in sel.groups and sel.extended:
        asked = rows.where(F.col("tag") == MESSAGE).withColumn("first", opener)
        hit = dns_latency(asked, [*own, "conn"], DNS_TIMEOUT, carry=("first",))
        parts.append(_made(hit, MESSAGE, iface=F.col("iface"), vlan=F.col("vlan"), body=F.col("body"), opened=F.col("first"), latency_us=F.col("latency_us")))
    if "t" in sel.groups:
        tried = rows.where((F.col("tag") == "QUIC") & (F.col("rule") == QUIC))
        parts.append(whole(r.quic_failure_gate(tried.where(~F.col("ok")), tried.where("ok"), [*own, "conn"])))
    if opts.flow_budget is not None:
        counted = app_flow_budget(rows.where(F.col("tag") == PAYLOAD), [*own, "conn"], complete="_complete", budget=opts.flow_budget)
        fits = counted.select(*own, "conn", "ts", "seq").distinct()
        records = rows.where((F.col("rule") == FLOW) & (F.col("tag") != PAYLOAD))
        parts.append(whole(records.join(fits, [*own, "conn", "ts", "seq"], "left_semi")))
    return finished(reduce(DataFrame.unionByName, parts))


def _made(hit: DataFrame, tag: str, **columns) -> DataFrame:
    """What a rule let go, in the shape of the other rows."""
    kinds = {"mac": "string", "iface": "string", "vlan": "string", "line": "string", "sig": "string", "body": "string", "routed": "boolean",
             "kind": "string", "opened": None, "rtt_us": "bigint", "latency_us": "bigint"}
    values = [(columns[n] if k is None else columns.get(n, F.lit(None)).cast(k)).alias(n) for n, k in kinds.items()]
    return hit.select("ts", "seq", *r._own(hit), F.lit(tag).alias("tag"), *values)


def _suppressed(rows: DataFrame, opts: Options) -> DataFrame:
    """Records of all tags without repeats: one pass over those with sliding windows, one for each fixed window."""
    held = [t for t in opts.selection.tags if opts.selection.deduplicated(t)]
    if opts.dedup_ttl <= 0 or not held:
        return rows
    keys = [*r._own(rows), "tag", "mac", "sig", "_r"]
    rows = rows.withColumn("_r", F.when(F.col("tag") != "LLDP", F.col("routed")))
    parts = [rows.where(~F.col("tag").isin(*held))]
    if sliding := [t for t in held if t not in REFRESH_FLOORS]:
        parts.append(dedup_sliding(rows.where(F.col("tag").isin(*sliding)), keys, opts.dedup_ttl))
    windows: dict[int, list[str]] = {}
    for t in held:
        if t in REFRESH_FLOORS:
            windows.setdefault(refresh_ttl(t, opts.dedup_ttl), []).append(t)
    parts += [dedup_refresh(rows.where(F.col("tag").isin(*tags)), keys, ttl) for ttl, tags in windows.items()]
    return reduce(DataFrame.unionByName, [p.select(*rows.columns) for p in parts]).drop("_r")


def write_job(frames: DataFrame, opts: Options, sinks: list[Sink] | None = None) -> None:
    """A whole batch job: frames to wire lines in every sink.

    What it stores in the shared folder is cleared at the end.
    """
    spark, store = frames.sparkSession, work_folder(frames.sparkSession)
    try:
        write_telemetry(job_lines(frames, opts, store), sinks)
    finally:
        discard(spark, store)


def quic_tables(udp: DataFrame, stateful: bool) -> tuple[DataFrame, DataFrame]:
    """``(TLS, QUIC)`` records of QUIC datagrams.

    Stateless: a datagram without a complete hello is a failure.  Stateful: a
    hello may span packets; only a packet that does not verify is a failure.
    """
    if not stateful:
        hellos = r.quic_hello(r.quic_datagrams(udp))
        return r.rec_quic_tls(hellos), r.rec_quic(hellos)
    done, bad = spanning_hellos(udp)
    return r.rec_quic_tls(done), r.rec_quic(done.unionByName(bad))


def found_hellos(udp: DataFrame, stateful: bool) -> DataFrame:
    """Datagrams with Initials and ``tls``, the hello they complete or NULL."""
    if not stateful:
        return r.quic_hello(r.quic_datagrams(udp))
    done, bad = spanning_hellos(udp)
    return done.unionByName(bad)


def all_tls(sources: DataFrame, stateful: bool) -> DataFrame:
    """TLS records of ``hello_sources``."""
    if not stateful:
        return r.rec_all_tls(sources)
    opened = opened_initials(r.with_initials(sources, decrypt=False, also=F.col("vector").isNull()), outer=True)
    # A hello of TCP is read before the shuffle, so that no payload travels.
    tcp = F.col("part").isNull()
    opened = stage(opened, {"_h": F.when(tcp, r.tls_client_hello(F.col("payload")))}).where(~tcp | F.col("_h").isNotNull())
    slim = _slim(sources)
    moved = shared(opened.select(*slim, *OPENED, "_h"), AT, plain=(AT,))
    tcp_rows = moved.where(tcp).select(*slim, "_h")
    done = _spanning(moved.where(~tcp).drop("_h"), slim)
    quic_rows = stage(done, {"_h": r.tls_client_hello(F.col("tls"))}).where(F.col("_h").isNotNull()).select(*slim, "_h")
    return r.rec_parsed_tls(tcp_rows.unionByName(quic_rows))


def _slim(rows: DataFrame) -> list[str]:
    return ["ts", "seq", *r._own(rows), "iface", "vlan", "routed", r.SENDER, "device_mac", "src_ip", "dst_ip", "dport"]


def _spanning(opened: DataFrame, slim: list[str]) -> DataFrame:
    """Datagrams that complete a hello, with ``tls``; ``opened`` are spread by ``AT``."""
    own = r._own(opened)
    parts = stateful_packets(opened).where(F.col("frags").isNotNull()).select(*slim, AT, "dcid", "part", "frags")
    done = hello_records(quic_reassemble(parts, [AT, *own, "dcid"]))
    return first_rows(done, [*own, "ts", "seq"], ["part"]).select(*slim, "tls")


def spanning_hellos(udp: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Datagrams that complete a hello, and those with a packet that does not verify."""
    own, slim = r._own(udp), _slim(udp)
    opened = opened_initials(r.with_initials(r.long_datagrams(udp), decrypt=False))
    moved = shared(opened.select(*slim, *OPENED), AT, plain=(AT,))
    done = _spanning(moved, slim)
    # one failure per datagram, and none when the datagram completed a hello
    failed = stateful_packets(moved).where(F.col("frags").isNull()).select(*slim).dropDuplicates([*own, "ts", "seq"])
    bad = failed.join(done.select(*own, "ts", "seq"), [*own, "ts", "seq"], "left_anti")
    return done, bad.withColumn("tls", F.lit(None).cast("binary"))


def wire_lines(tables: dict[str, DataFrame], sensor: bool = False) -> DataFrame:
    """All records as ``ts, seq, tag, line`` text."""
    parts = []
    for tag, df in tables.items():
        line = format_wire(df, tag)
        if sensor:
            line = wrap_observation(line)
        parts.append(line.select("ts", "seq", F.lit(tag).alias("tag"), "line"))
    return reduce(DataFrame.unionByName, parts)


def register_views(tables: dict[str, DataFrame]) -> None:
    """Record tables as temporary views named after their tag, for SQL users."""
    for tag, df in tables.items():
        df.createOrReplaceTempView(tag)


def inspect(frames: DataFrame, opts: Options, show: str, count: int = 0) -> DataFrame:
    """Inspector lines; wins over the target filter and skips the prefilter."""
    return inspect_packets(located_packets(frames, opts, prefilter=False), show, opts.exclude, count)


def column_order(tag: str, df: DataFrame) -> DataFrame:
    """Record columns only, in wire order."""
    return df.select("mac", *record_columns(tag), "routed")
