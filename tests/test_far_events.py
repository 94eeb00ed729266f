"""Queries over events far behind those of the small tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from netobs.checks import load
from netobs.checks import derived as g
from tests.check_oracles import compare, connect

REGISTRY = load()


def shifted(spark, sf_dir, tmp_path, by):
    events = g.table(spark, sf_dir, "events").withColumn("event_id", F.col("event_id") + by)
    events.coalesce(1).write.parquet(str(tmp_path / "made"))
    next((tmp_path / "made").glob("*.parquet")).rename(tmp_path / "events.parquet")
    return str(tmp_path)


def test_varints_beyond_thirty_bits(spark, sf_dir, tmp_path):
    """1000 * seq needs eight bytes from seq 1,073,742 on."""
    far = shifted(spark, sf_dir, tmp_path, 5_990_000)
    good, note = compare(spark, connect(far), far, "quic_varint", REGISTRY.QUERIES["quic_varint"], REGISTRY.ORACLES["quic_varint"])
    assert good, note


def test_target_of_the_last_number_of_a_round(spark, sf_dir, tmp_path):
    """65535 + 1 does not fit the address's last group; its text must not be that of 0x1000."""
    far = shifted(spark, sf_dir, tmp_path, 65_000)
    rows = REGISTRY.QUERIES["rec_ndp"](spark, far).where("type <> 'RS' AND seq BETWEEN 65533 AND 65537").collect()
    for r in rows:
        n = r.seq % 65536 + 1
        assert r.target_ip == ("2001:db8::1:0" if n == 65536 else f"2001:db8::{n:x}")
    assert 65535 in {r.seq for r in rows}


def test_counters_are_summed_before_the_state(spark, tmp_path):
    """The state of an interface has a row per interval, not one per row of the stream."""
    from netobs.streaming import keyed

    stats = spark.readStream.schema("ts timestamp, iface string, packets long, drops long").parquet(str(tmp_path))
    plan = keyed.drop_report(stats)._jdf.queryExecution().logical().toString()
    assert 0 < plan.index("TransformWithState") < plan.index("Aggregate")


def test_datagrams_of_a_small_file_are_made_by_all_cores(spark, sf_dir):
    from netobs.checks.recordchecks import split_frames

    frames = split_frames(spark, sf_dir, lambda half: half)
    assert frames.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism > 1


def test_padding_behind_a_frame(spark):
    """Only zeros, other frames or a lone byte behind a CRYPTO frame, and an empty packet."""
    from netobs.functions.quic import crypto_fragments

    frame = bytes.fromhex("060002aabb")
    plains = [frame, frame + bytes(1000), bytes(3) + frame + bytes(5), frame + bytes(7) + bytes.fromhex("060201cc") + bytes(2), frame + b"\x01" + bytes(3), frame + bytes(2) + b"\x1c", b"", bytes(9)]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(plains)], "i int, p binary")
    got = {r.i: [(f["off"], bytes(f["bytes"])) for f in r.f] for r in df.select("i", crypto_fragments(F.col("p")).alias("f")).collect()}
    one = [(0, b"\xaa\xbb")]
    assert got == {0: one, 1: one, 2: one, 3: [*one, (2, b"\xcc")], 4: one, 5: one, 6: [], 7: []}
