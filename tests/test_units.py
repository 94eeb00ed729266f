"""Functions, argument rules, sources and sinks, and inputs beyond former limits."""

from __future__ import annotations

import re
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from netobs.functions.quic import quic_client_keys
from netobs.functions.tls import tls_client_hello
from netobs.operators import prefixes
from netobs.operators.classify import PrefixSet, PrefixTable, direction
from netobs.operators.decode import decode_frames
from netobs.operators.filters import endpoint_filter
from netobs.operators.vectors import vectors
from netobs.checks import derived as g
from netobs.plans.jobs import Options, located_packets, telemetry, wire_lines, write_job
from netobs.schemas import FRAME, STATS
from netobs.sources.frames import parse_ifaces, read_capture_stats, read_frames, select_ifaces
from netobs.sources.sensor import check_sensor
from netobs.sources.sinks import Sink, effective_sinks, stream_telemetry, write_telemetry
from netobs.sources.wire import format_wire, parse_wire, read_wire, to_typed
from netobs.streaming.hello import HelloParts

MAC, GATE = "020000000005", "02000000ff01"
NOW = datetime(2024, 5, 1, tzinfo=UTC)


def ether(ethertype, body, src=MAC, dst=GATE):
    return bytes.fromhex(dst + src + ethertype) + body


def ipv4(proto, body, src="192.168.0.5", dst="198.51.100.7"):
    size = (len(body) + 20).to_bytes(2, "big")
    ends = bytes(map(int, src.split("."))) + bytes(map(int, dst.split(".")))
    return bytes.fromhex("4500") + size + bytes(4) + bytes([64, proto]) + bytes(2) + ends + body


def tcp(sport, dport, flags, body=b""):
    return sport.to_bytes(2, "big") + dport.to_bytes(2, "big") + bytes(8) + bytes([0x50, flags, 4, 0, 0, 0, 0, 0]) + body


def frames(spark, datas, ifaces=None):
    rows = [(NOW, i, (ifaces or ["lan0"] * len(datas))[i], "ethernet", None, bytearray(x)) for i, x in enumerate(datas)]
    return spark.createDataFrame(rows, FRAME)


def test_rfc9001_client_keys(spark):
    """Appendix A.1 of RFC 9001."""
    row = spark.range(1).select(quic_client_keys(F.unhex(F.lit("8394c8f03e515708"))).alias("k")).select("k.*").first()
    assert bytes(row.key).hex() == "1f369613dd76d5467730efcbe3b1a22d"
    assert bytes(row.iv).hex() == "fa044b2f42a3fd3b46fb255c"
    assert bytes(row.hp).hex() == "9f50449e04a0e810283a1e9933adedd2"


PACKETS = [("10.0.0.1", "20.0.0.1", MAC, GATE), ("10.0.0.2", "10.9.9.9", GATE, MAC), ("30.0.0.1", "30.0.0.2", MAC, MAC)]


@pytest.mark.parametrize(
    ("text", "hits"),
    [
        ("10.0.0.0/8", [0, 1]), ("not 10.0.0.0/8", [2]), ("!10.0.0.0/8", [2]), ("10.0.0.1 or 30.0.0.1 and 10.0.0.2", [0]),
        ("(10.0.0.1 or 10.0.0.2) and 10.9.9.9", [1]), ("10.0.0.1 || 30.0.0.2", [0, 2]), ("02:00:00:00:ff:01 && !20.0.0.1", [1]),
        ("2001:db8::/32", []), (" or ".join(f"10.0.{i}.1" for i in range(200)), [0]),
    ],
)
def test_filters(spark, text, hits):
    rows = spark.createDataFrame(
        [(i, *(bytearray(map(int, x.split("."))) for x in r[:2]), *(bytearray.fromhex(x) for x in r[2:])) for i, r in enumerate(PACKETS)],
        "n int, src_ip binary, dst_ip binary, src_mac binary, dst_mac binary",
    )
    assert sorted(r.n for r in rows.where(endpoint_filter(text)).collect()) == hits


@pytest.mark.parametrize("text", ["", "()", "10.0.0.1 or", "nonsense", "10.0.0.0/33", "10.0.0.1 10.0.0.2", "(10.0.0.1"])
def test_bad_filters(spark, text):
    with pytest.raises(ValueError):
        endpoint_filter(text)


def test_sensor_rules():
    check_sensor(False)
    check_sensor(True, "north-1", "lan0")
    for bad in ((False, "x"), (False, None, "any", ("10.0.0.0/8",)), (True,), (True, "a b", "lan0"), (True, "x" * 64, "lan0"), (True, "x", "any")):
        with pytest.raises(ValueError):
            check_sensor(*bad)


def test_effective_sinks():
    kinds = lambda *s: [x.kind for x in effective_sinks(list(s))]
    assert kinds() == ["console"]
    assert kinds(Sink("text", "x")) == ["text"]
    assert kinds(Sink("kafka", "t")) == ["kafka", "console"]
    assert kinds(Sink("kafka", "t", exclusive=True)) == ["kafka"]
    with pytest.raises(ValueError):
        Sink("carrier pigeon")


def test_vector_letters():
    for letter, tags in (("s", "SYN SYNACK"), ("m", "L7 MDNS"), ("d", "DHCP DHCP6"), ("n", "NBNS"), ("q", "DNS"), ("h", "HTTP"), ("t", "TLS QUIC"), ("l", "LLDP ARP NDP RA")):
        assert vectors(letter).tags == tags.split() and vectors(letter).deduplicated(tags.split()[0])
        assert not vectors(letter.upper()).deduplicated(tags.split()[0])
    assert vectors().groups == frozenset("smdn") and vectors("a").groups == frozenset("smdnqhtl")
    with pytest.raises(ValueError):
        vectors("z")


def test_frames_and_counters_from_files(spark, tmp_path):
    data = frames(spark, [b"x" * 70000, b"y"])
    data.union(data.withColumn("link_type", F.lit("token ring"))).write.parquet(str(tmp_path / "f"))
    got = read_frames(spark, str(tmp_path / "f")).collect()
    assert sorted(len(r.data) for r in got) == [1, 70000]
    spark.createDataFrame([(NOW, "lan0", 5, 1)], STATS).write.parquet(str(tmp_path / "s"))
    assert read_capture_stats(spark, str(tmp_path / "s")).first().packets == 5


def test_write_and_read_back(spark, tmp_path):
    line = "DNS|02:00:00:00:00:05|192.168.0.5|" + "a" * 2000 + ".example"
    rows = spark.createDataFrame([(NOW, 1, line), (NOW, 2, "OBS|north|lan0|7|" + line + "|routed")], "ts timestamp, seq long, line string")
    write_telemetry(rows, [Sink("text", str(tmp_path / "t")), Sink("parquet", str(tmp_path / "p"))])
    wire = read_wire(spark, str(tmp_path / "t"))
    assert wire.where("reject IS NULL").count() == 2
    back = format_wire(to_typed(wire, "DNS"), "DNS").select("line", "routed", "sensor_name").collect()
    assert sorted((r.line, r.routed, r.sensor_name) for r in back) == [(line, False, None), (line + "|routed", True, "north")]
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2


def test_stream_to_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"line {i}") for i in range(5)], "seq long, line string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    sinks = [Sink("text", str(tmp_path / "t")), Sink("parquet", str(tmp_path / "p"))]
    stream_telemetry(stream, sinks, str(tmp_path / "state")).awaitTermination()
    assert spark.read.text(str(tmp_path / "t")).count() == 5 and spark.read.parquet(str(tmp_path / "p")).count() == 5


# -- beyond former limits ---------------------------------------------------------------


def test_nine_interfaces(spark):
    names = [f"e{i}" for i in range(9)]
    assert parse_ifaces(",".join(names)) == names
    assert select_ifaces(frames(spark, [b"x"] * 9, names), ",".join(names)).count() == 9


def test_two_hundred_extensions_and_a_thousand_ciphers(spark):
    exts = "".join(f"{0x1000 + i:04x}0000" for i in range(200))
    ciphers = F.transform(F.sequence(F.lit(1), F.lit(1000)), lambda i: i + 0x2000)
    row = spark.range(1).select(F.unhex(g.record_hex(g.hello_hex(ciphers, exts))).alias("b"))
    hello = row.select(tls_client_hello(F.col("b")).alias("h")).select("h.*").first()
    assert len(hello.ext_ids) == 200 and len(hello.ciphers) == 1000


def test_twelve_extension_headers(spark):
    chain = b"".join(bytes([60 if i < 11 else 17, 0]) + bytes(6) for i in range(12))
    body = chain + bytes.fromhex("11d7003500100000") + b"01234567"
    head = bytes.fromhex("60000000") + len(body).to_bytes(2, "big") + bytes([60, 64])
    packet = head + bytes.fromhex("fe80" + "00" * 13 + "05" + "ff02" + "00" * 13 + "01") + body
    got = decode_frames(frames(spark, [ether("86dd", packet)])).first()
    assert got.proto == 17 and bytes(got.l4).endswith(b"01234567")


def test_hello_of_twenty_kilobytes_in_pieces():
    hello = b"\x01" + (20000).to_bytes(3, "big") + bytes(i % 251 for i in range(20000))
    parts = [{"off": i, "bytes": hello[i : i + 900]} for i in range(0, len(hello), 900)]
    machine = HelloParts(5)
    for part in parts[:0:-1]:
        assert machine.add(0, [part]) is None
        fresh = HelloParts(5)
        fresh.load(*machine.dump())  # as between micro-batches
        machine = fresh
    assert machine.add(1, parts[:1]) == hello
    assert machine.add(1, [{"off": 1 << 60, "bytes": b"x"}]) is None


def web(n):
    return b"GET / HTTP/1.1\r\nUser-Agent: agent-" + str(n).encode() + b"x" * 300 + b"\r\n\r\n"


def test_all_payloads_of_a_flow_and_long_agents(spark):
    data = frames(spark, [ether("0800", ipv4(6, tcp(40000, 80, 24, web(i)))) for i in range(20)])
    full = telemetry(data, Options(selection=vectors("H")))["HTTP"].collect()
    assert len(full) == 20 and all(len(r.user_agent) > 300 for r in full)
    assert telemetry(data, Options(selection=vectors("H"), flow_budget=8))["HTTP"].count() == 1


def test_job_with_many_prefixes(spark):
    learned = tuple(("lan0", f"10.{i}.0.0/16") for i in range(70))
    data = frames(spark, [ether("0800", ipv4(6, tcp(40000, 443, 2), src=f"10.{i}.0.9")) for i in (3, 69, 200)])
    got = telemetry(data, Options(selection=vectors("S"), prefixes=PrefixSet(learned=learned)))["SYN"].collect()
    assert sorted((r.src_ip, r.routed) for r in got) == [("10.200.0.9", True), ("10.3.0.9", False), ("10.69.0.9", False)]


@pytest.mark.parametrize("most", [prefixes.MOST, 2])
def test_prefix_table_and_set_agree(spark, monkeypatch, most):
    """Every flag of the direction step, for prefixes written out and in a table, flattened or too large for that."""
    monkeypatch.setattr(prefixes, "MOST", most)
    learned = (("lan0", "10.1.0.0/16"), ("lan1", "10.1.2.0/24"), ("lan0", "2001:db8:1:2::/64"), ("lan1", "fd00:1::/48"))
    both = PrefixSet(inside=("203.0.113.0/24", "2001:db8:ffff::/48"), learned=learned)
    ips = ["10.1.2.3", "10.9.0.1", "203.0.113.9", "198.51.100.1", "172.16.5.5", "2001:db8:1:9::1", "2001:db8:1:2::5",
           "2001:db8:7::1", "fd00:1::9", "fd00:2::9", "2001:db8:ffff::1", "fe80::1"]
    import ipaddress

    rows = [
        (i, f"lan{i % 3}", 4 if "." in a else 6, bytearray(ipaddress.ip_address(a).packed), bytearray(ipaddress.ip_address(b).packed))
        for i, (a, b) in enumerate((a, b) for a in ips for b in ips for _ in range(3))
    ] + [(9999, "lan0", None, None, None)]
    packets = spark.createDataFrame(rows, "n int, iface string, ip_version int, src_ip binary, dst_ip binary")
    found = [sorted(direction(packets, p).select("n", "is_outbound", "offlink_routed").collect()) for p in (both, PrefixTable(both.table(spark)))]
    assert found[0] == found[1] and len(found[0]) > 100 and any(r.offlink_routed for r in found[0])


@pytest.mark.parametrize("most", [prefixes.MOST, 5])
def test_many_random_prefixes(spark, monkeypatch, most):
    """Nested, equal, touching and whole-space prefixes of both families against plain containment tests."""
    import ipaddress
    import random

    monkeypatch.setattr(prefixes, "MOST", most)
    monkeypatch.setattr(prefixes, "RANGES", 7)
    rng = random.Random(11)
    nets, learned = [], []
    for i in range(120):
        six = rng.random() < 0.5
        if six:
            base = rng.choice([0x2001 << 112, 0xFD00 << 112, 0]) + (rng.getrandbits(20) << 60)
            net = ipaddress.ip_network((base, rng.choice([0, 3, 16, 48, 52, 64, 128])), strict=False)
        else:
            net = ipaddress.ip_network((rng.choice([10, 192, 203]) << 24 | rng.getrandbits(12) << 8 | rng.getrandbits(8), rng.choice([8, 16, 20, 24, 31, 32])), strict=False)
        if rng.random() < 0.5:
            nets.append(str(net))
        else:
            learned.append((f"lan{rng.randrange(3)}", str(net)))
    table = PrefixSet(inside=tuple(nets), learned=tuple(learned))
    ends = [ipaddress.ip_network(n) for n in nets + [n for _, n in learned]]
    addresses = {a for n in ends for a in (n.network_address, n.broadcast_address)} | {ipaddress.ip_address("198.51.100.1"), ipaddress.ip_address("::1")}
    addresses |= {a + 1 for a in addresses if int(a) + 1 < 1 << (8 * len(a.packed))}
    packed = sorted(a.packed for a in addresses) + [None, b"abc"]
    df = spark.createDataFrame([(i, None if a is None else bytearray(a)) for i, a in enumerate(packed)], "n int, ip binary")
    for r in prefixes.Lookup(table.table(spark)).add(df, {"ip": "f"}).collect():
        a = ipaddress.ip_address(bytes(r.ip)) if r.ip is not None and len(r.ip) in (4, 16) else None
        within = lambda n: a is not None and a.version == ipaddress.ip_network(n).version and a in ipaddress.ip_network(n)
        direct = {i for i, n in learned if within(n)}
        near = {
            i for i, n in learned
            if a is not None and a.version == 6 and ":" in n and int(ipaddress.ip_network(n)[0]) >> 125 == 1
            and int(a) >> 80 == int(ipaddress.ip_network(n)[0]) >> 80
        }
        assert (r.f.any, set(r.f.direct), set(r.f.near)) == (bool(direct) or any(within(n) for n in nets), direct, near), r.ip


def test_prefix_table_needs_one_scan_and_moves_no_packets(spark, tmp_path):
    frames(spark, [ether("0800", ipv4(6, tcp(40000, 443, 2)))]).write.parquet(str(tmp_path / "frames"))
    table = PrefixSet(inside=("203.0.113.0/24",), learned=(("lan0", "10.1.0.0/16"), ("lan0", "2001:db8::/64")))
    opts = Options(selection=vectors("S"), prefixes=PrefixTable(table.table(spark)))
    data = read_frames(spark, str(tmp_path / "frames"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = formatted(located_packets(data, opts))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    steps = re.findall(r"^\((\d+)\) (.*)$", plan, re.M)
    assert len([x for x in steps if x[1].startswith("Scan parquet")]) == 1
    assert not [x for x in steps if x[1].startswith(("Exchange", "SortMergeJoin"))]
    assert len([x for x in steps if x[1].startswith("BroadcastHashJoin")]) == 2


def test_job_to_files(spark, tmp_path):
    data = frames(spark, [ether("0800", ipv4(6, tcp(40000 + i, 443, 2))) for i in range(3)])
    write_job(data, Options(selection=vectors("aS")), [Sink("text", str(tmp_path / "o"))])
    assert parse_wire(spark.read.text(str(tmp_path / "o")).withColumnRenamed("value", "line")).where("tag = 'SYN'").count() == 3


# -- plans ------------------------------------------------------------------------------


def formatted(df):
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


def test_whole_job_decodes_the_frames_once(spark, tmp_path):
    frames(spark, [ether("0800", ipv4(6, tcp(40000, 443, 2)))]).write.parquet(str(tmp_path / "frames"))
    data = read_frames(spark, str(tmp_path / "frames"))
    lines = wire_lines(telemetry(data, Options(selection=vectors("a", extended=True)), store=str(tmp_path / "store")))
    plan = formatted(lines)
    assert str(tmp_path / "store") in plan and str(tmp_path / "frames") not in plan
    assert lines.count() == 1


@pytest.mark.parametrize("tag", ["HTTP", "TLS", "DNSEXT", "SYN", "MDNS", "DHCP"])
def test_no_packet_bytes_below_an_exchange(spark, tag):
    data = frames(spark, [ether("0800", ipv4(6, tcp(40000, 443, 2)))])
    plan = formatted(telemetry(data, Options(selection=vectors("a", extended=True)))[tag])
    inputs = re.findall(r"\) (?:Exchange|Sort|Window)\s*\nInput \[\d+\]: \[([^\]]*)\]", plan)
    assert inputs
    for columns in inputs:
        names = {c.split("#")[0].strip() for c in columns.split(",")}
        assert not names & {"data", "l4", "initials"} and "payload" not in names - ({"payload"} if tag == "L7" else set())


def test_lines_of_all_tags_are_typed_in_one_pass(spark, sf_dir):
    """The same rows as a table for each tag, and the events are read once."""
    from netobs.checks import wirechecks
    from netobs.plans.stage import stage
    from netobs.schemas import RECORDS
    from netobs.sources.wire import by_tag, with_marker, wire_body

    texts = [
        "SYN|m|1.1.1.1|64|1024|-1|-1|none|443", "SYN|m|1.1.1.1|64|x|-1|-1|none|443", "DNS|m|1.1.1.1|a|routed", "DNS|m|1.1.1.1|a|b", "OBS|s|e|0|DNS|m|1|b",
        "ALERT|m|1|k|q|3.5", "ALERT|m|1|k|q|", "NDP|m|1|t|none|-", "WHAT|m|1", "", "RA|m|1|64|-|1800|none|64|1500|routed",
    ]
    wire = parse_wire(spark.createDataFrame(list(enumerate(texts)), "seq long, line string"))
    line = by_tag(lambda tag, of: with_marker(wire_body(tag, of), F.col("routed")))
    once = stage(wire.drop("line"), {"line": line}).where("line IS NOT NULL").select("seq", "line").collect()
    each = [r for tag in RECORDS for r in format_wire(to_typed(wire, tag), tag).select("seq", "line").collect()]
    assert sorted(map(tuple, once)) == sorted(map(tuple, each)) and len(once) == 6
    plan = wirechecks._typed_round_trip(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_frames_are_built_by_all_cores(spark, sf_dir):
    """A small table is one task; its rows are dealt out before a frame is built of them."""
    from netobs.checks import recordchecks

    for query in (recordchecks._rec_tls, recordchecks._rec_ndp, recordchecks._rec_dns):
        plan = query(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert "RepartitionByExpression [seq" in plan, query


def test_default_job_builds_the_frames_once(spark, sf_dir):
    from netobs.checks import recordchecks

    plan = recordchecks._job_default(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "events.parquet" not in plan and "route" in plan
