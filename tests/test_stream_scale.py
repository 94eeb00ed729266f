"""What streams keep on disk."""

from __future__ import annotations

import os

from netobs.checks import derived as g
from netobs.checks.recordchecks import mixed_frames
from netobs.checks.streams import through_stream
from netobs.operators.vectors import vectors
from netobs.plans.jobs import Options
from netobs.streaming import keyed
from netobs.streaming.job import routed_packets


def test_stored_packets_hold_their_bytes_once(spark, sf_dir):
    """``l4`` is cut out of the frame, which is not stored beside it."""
    rows = routed_packets(mixed_frames(spark, sf_dir), Options(selection=vectors("A")))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    assert "l4" in kinds and "data" not in kinds


def test_parts_go_when_the_stream_has_read_them(spark, sf_dir):
    shared = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(shared)) if os.path.isdir(shared) else set()
    rows = g.pulse(spark, sf_dir).select("ts", "seq", "dev", "event_type")
    assert 0 < through_stream(spark, lambda r: keyed.dedup_sliding(r, ["dev"], 3), rows).count() < 1000
    (made,) = set(os.listdir(shared)) - before
    kept = {os.path.relpath(at, f"{shared}/{made}").split(os.sep)[0] for at, _, files in os.walk(f"{shared}/{made}") if any(f.endswith(".parquet") for f in files)}
    assert kept == {"out"}
