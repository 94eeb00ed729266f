"""Streaming rules against the batch ones on random input, cut and shuffled; whole jobs, sinks and limits on streams."""

from __future__ import annotations

import random
from datetime import UTC, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from netobs.checks import derived as g
from netobs.checks.recordchecks import dns_traffic, far_frames, mixed_frames
from netobs.checks.state import handshake_frames
from netobs.checks import streams
from netobs.checks.streams import through_stream
from netobs.functions.quic import nearest_number
from netobs.operators.classify import PrefixSet, PrefixTable
from netobs.operators.dedup import dedup_refresh
from netobs.operators.vectors import vectors
from netobs.plans.jobs import Options, inspect, job_lines
from netobs.sources.sinks import Ledger, Sink, stream_telemetry
from netobs.streaming import keyed
from netobs.streaming.inorder import InOrder, names_of
from netobs.streaming.job import packet_lines


def in_parts(rule, us, columns, rng):
    """Positions let go and new columns when the rows come in pieces."""
    state, out, made, at = {}, [], [], 0
    while at < len(us):
        n = rng.randrange(1, 9)
        piece = {k: v[at : at + n] for k, v in columns.items()}
        kept, more, state = rule(us[at : at + n], piece, state)
        out += [at + int(i) for i in kept]
        made += list(zip(*more.values(), strict=True)) if more else [()] * len(kept)
        at += n
    return out, made


def times(rng, n, most):
    return np.cumsum([rng.randrange(most) for _ in range(n)]).astype(np.int64) * 1_000_000


def whole(rule, us, columns):
    kept, more, _ = rule(us, columns, {})
    return [int(i) for i in kept], list(zip(*more.values(), strict=True)) if more else [()] * len(kept)


@pytest.mark.parametrize("seed", range(5))
@pytest.mark.parametrize("refresh", [False, True])
def test_cuts_do_not_matter_to_suppression(seed, refresh):
    rng = random.Random(seed)
    rule, us = keyed.suppression(20, refresh), times(rng, 80, 25)
    assert in_parts(rule, us, {}, rng) == whole(rule, us, {})
    want, last = [], None
    for i, s in enumerate((us // 1_000_000).tolist()):
        if last is None or s - last >= 20:
            want.append(i)
            last = s
        elif not refresh:
            last = s
    assert whole(rule, us, {})[0] == want


@pytest.mark.parametrize("seed", range(5))
def test_cuts_do_not_matter_to_other_rules(seed):
    rng = random.Random(seed)
    n = 90
    us = times(rng, n, 20)
    columns = {
        "_row": [f"r{i}" for i in range(n)], "is_response": [rng.random() < 0.5 for _ in range(n)], "_complete": [rng.random() < 0.2 for _ in range(n)],
        "_record": [rng.random() < 0.3 for _ in range(n)], "_right": [rng.random() < 0.3 for _ in range(n)], "_value": [f"v{rng.randrange(3)}" for _ in range(n)],
        "kind": [rng.choice(["SYN", "SYNACK", "FIN", "RST"]) for _ in range(n)], "_fwd": [rng.choice("ab") for _ in range(n)],
    }
    columns["_rev"] = ["b" if f == "a" else "a" for f in columns["_fwd"]]
    for rule in (keyed.latencies(10), keyed.budgets(15, 3), keyed.last_value(30, "x"), keyed.handshakes(40)):
        full = whole(rule, us, columns)
        assert full[0] and in_parts(rule, us, columns, rng) == full


def test_a_reset_between_two_open_entries_gives_one_row():
    """Both ends have an entry; the row is that of the end which sends."""
    rule = keyed.handshakes(120)
    us = np.array([0, 1, 2], np.int64) * 1_000_000
    columns = {"kind": ["SYN", "SYN", "RST"], "_fwd": ["a", "b", "a"], "_rev": ["b", "a", "b"], "_row": ["first", "second", "third"]}
    at, more, state = rule(us, columns, {})
    assert list(at) == [2] and more["_from"] == ["first"] and len(state["entries"]) == 2


def test_numbers_nearest_to_the_expected():
    assert [nearest_number(e, t, 1) for e, t in ((0, 7), (256, 0), (201, 44), (301, 200), (130, 250), (600, 20))] == [7, 256, 300, 200, 250, 532]
    assert nearest_number(0xA82F30EA + 1, 0x9B32, 2) == 0xA82F9B32  # the example of RFC 9000, A.3


def test_names_in_a_shape():
    assert names_of("a long, f array<struct<off: int, bytes: binary>>, d decimal(3,2)") == ["a", "f", "d"] and names_of("") == []


def test_late_but_within_the_delay_gives_the_batch_rows(spark, sf_dir):
    """Rows up to half the delay late, in other micro-batches than their neighbours."""
    rows = g.pulse(spark, sf_dir).select("ts", "seq", "dev", "event_type")
    got = through_stream(spark, lambda r: keyed.dedup_refresh(r, ["dev"], 40), rows)
    want = dedup_refresh(rows, ["dev"], 40)
    assert sorted(r.seq for r in got.collect()) == sorted(r.seq for r in want.collect())


def some_traffic(spark, sf):
    """Frames of all kinds on one clock: two machines claim an address, hellos over two datagrams, answers, ends of connections."""
    few = F.col("seq") % 4 == 0
    parts = [mixed_frames(spark, sf), dns_traffic(spark, sf), handshake_frames(spark, sf), far_frames(spark, sf).where(F.col("seq") % 20 < 2)]
    named = [p.withColumn("seq", F.col("seq") * 4 + i) for i, p in enumerate(parts)]
    out = named[0]
    for p in named[1:]:
        out = out.unionByName(p)
    other = mixed_frames(spark, sf).where(few & (F.length("data") == 42))
    moved = F.concat(F.expr("substring(data, 1, 11)"), F.unhex(F.lit("77")), F.expr("substring(data, 13, 15)"), F.unhex(F.lit("77")), F.expr("substring(data, 29)"))
    return out.unionByName(other.withColumns({"data": moved, "seq": F.col("seq") * 4 + 20_000_000}))


def test_a_whole_stream_gives_the_lines_of_the_batch_job(spark, sf_dir, monkeypatch):
    """Suppression, owners, handshakes, latency, budgets and hellos over two datagrams, with a restart."""
    monkeypatch.setattr(streams, "PARTS", 1)  # planning takes most of the time; stream_job_all has more parts
    prefixes = PrefixTable(PrefixSet(inside=("198.51.100.0/28",), learned=(("lan0", "192.168.0.0/16"),)).table(spark))
    opts = Options(selection=vectors("a", extended=True, quic_stateful=True), prefixes=prefixes, flow_budget=2)
    folder = str(spark.conf.get("spark.checkpoint.dir")) + "/traffic"
    some_traffic(spark, sf_dir).write.mode("overwrite").parquet(folder)
    frames = spark.read.parquet(folder)
    want = sorted((r.seq, r.tag, r.line) for r in job_lines(frames, opts, folder + "-store").select("seq", "tag", "line").collect())
    got = sorted((r.seq, r.tag, r.line) for r in through_stream(spark, lambda p: packet_lines(p, opts), frames, store=opts).select("seq", "tag", "line").collect())
    assert got == want
    assert {t for _, t, _ in want} >= {"SYN", "SYNACK", "TCPLVL", "TLS", "DNS", "DNSEXT", "ALERT", "HTTP", "DHCP", "ARP"}
    assert any(line.endswith("|routed") for _, _, line in want)


# -- sinks and limits -------------------------------------------------------------------------


def lines_stream(spark, folder, n):
    spark.range(n).select(F.concat(F.lit("line "), F.col("id")).alias("line")).repartition(2).write.mode("append").parquet(folder)
    return spark.readStream.schema("line string").parquet(folder)


def test_a_batch_that_fails_between_two_sinks_is_written_once(spark, tmp_path):
    """The second sink cannot be written at first; the first has the batch already and keeps one copy."""
    from netobs.sources import sinks as module

    written = []
    real = module._write_one

    def counted(df, sink):
        written.append(sink.target)
        if sink.target == "two" and written.count("two") == 1:
            raise RuntimeError("lost")

    module._write_one = counted
    try:
        stream = lines_stream(spark, str(tmp_path / "in"), 10)
        targets = [Sink("kafka", "one"), Sink("kafka", "two"), Sink("text", str(tmp_path / "out"))]
        run = stream_telemetry(stream, [*targets, Sink("console")], str(tmp_path / "state"))
        with pytest.raises(Exception, match="lost"):
            run.awaitTermination()
        stream_telemetry(stream, [*targets, Sink("console")], str(tmp_path / "state")).awaitTermination()
    finally:
        module._write_one = real
    assert written == ["one", "two", "two", ""]
    assert spark.read.text(str(tmp_path / "out")).count() == 10
    assert Ledger(spark, str(tmp_path / "state")).has(0, "0-kafka")


def test_a_stream_of_inspector_lines_ends_after_n(spark, sf_dir, tmp_path):
    frames = mixed_frames(spark, sf_dir)
    frames.repartition(6).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    lines = inspect(stream, Options(), "192.168.0.0/16", 250)
    run = stream_telemetry(lines, [Sink("text", str(tmp_path / "out"))], str(tmp_path / "state"), stop_at=250, processingTime="0 seconds")
    assert run.awaitTermination(120)
    assert spark.read.text(str(tmp_path / "out")).count() == 250


class Held:
    """A list state in memory that counts its calls."""

    def __init__(self):
        self.rows, self.calls = [], 0

    def exists(self):
        return bool(self.rows)

    def get(self):
        self.calls += 1
        return iter(self.rows)

    def put(self, rows):
        self.calls, self.rows = self.calls + 1, list(rows)

    def appendList(self, rows):  # noqa: N802
        self.calls, self.rows = self.calls + 1, self.rows + list(rows)

    def clear(self):
        self.put([])


class Handle:
    def __init__(self):
        self.states, self.timers = {}, []

    def getListState(self, name, _):  # noqa: N802
        return self.states.setdefault(name, Held())

    def registerTimer(self, ms):  # noqa: N802
        self.timers.append(ms)


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.ms


def test_many_keys_share_states_and_timers():
    rng = random.Random(5)
    rows = [(rng.randrange(200) * 1_000_000, n, f"k{rng.randrange(300)}") for n in range(4000)]
    handle, got, seen = Handle(), [], -1
    for ms in (50_000, 50_000, 120_000, 300_000):
        op = InOrder(keyed.suppression(20, True), ["seq"], "", "last long", "", 20)
        op.init(handle)
        part = [r for r in rows if seen < r[0] // 1000 <= min(ms + 30_000, 200_000)]
        seen = max(seen, min(ms + 30_000, 200_000))
        part = pd.DataFrame(part, columns=["us", "o0", "key"]).sample(frac=1, random_state=1)
        list(op.handleInputRows(("7",), iter([part.assign(row="r")[["us", "o0", "row", "key"]]]), Clock(ms)))
        for _ in range(2):  # two timers of one micro-batch
            got += [n for frame in op.handleExpiredTimer(("7",), Clock(ms), None) for n in frame["seq"].tolist()]
    want, last = [], {}
    for us, n, key in sorted(rows):
        if key not in last or us - last[key] >= 20_000_000:
            want.append(n)
            last[key] = us
    assert sorted(got) == sorted(want)
    assert not handle.states["held"].rows and not handle.states["pending"].rows  # idle keys are forgotten
    assert len(handle.timers) + sum(s.calls for s in handle.states.values()) < 40
