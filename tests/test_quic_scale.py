"""QUIC jobs: frames are made and decoded once, and packets are opened before anything is shuffled."""

from __future__ import annotations

from pyspark.sql import functions as F

from netobs.checks import derived as g
from netobs.checks import load
from netobs.checks.common import records, tcp_frames
from netobs.checks.recordchecks import split_frames

REGISTRY = load()


def shuffled(node) -> int:
    """Bytes that the exchanges of an executed plan wrote; an exchange used twice counts once."""
    name = node.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return shuffled(node.executedPlan())
    if name.endswith("QueryStageExec"):
        return shuffled(node.plan())
    if name == "ReusedExchangeExec":
        return 0
    own = node.metrics().get("shuffleBytesWritten").get().value() if name == "ShuffleExchangeExec" else 0
    return own + sum(shuffled(node.children().apply(i)) for i in range(node.children().size()))


def tls(frames, seq="seq"):
    rows = records(frames, "TLS", "T", quic_stateful=True)
    return sorted(r[0] for r in rows.select(seq).collect())


def test_tcp_and_quic_are_read_together(spark, sf_dir):
    """One pass over the frames for the TLS records of both."""
    plan = REGISTRY.QUERIES["rec_tls_quic"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1


def test_no_datagram_is_shuffled(spark, sf_dir):
    """2,000 datagrams of 1,200 bytes; their hellos are a tenth of that."""
    df = REGISTRY.QUERIES["rec_tls_quic_far"](spark, sf_dir)
    df = df.select(F.sum("seq"))
    assert df.collect()[0][0] == 999 * 1000 // 2
    assert 0 < shuffled(df._jdf.queryExecution().executedPlan()) < 1_000_000


def test_number_many_windows_from_its_own(spark, sf_dir):
    """100,000 in four bytes, then 100,010 in one: the second opens only as the nearest to the first."""
    few = F.col("seq") < 80
    long, short = (split_frames(spark, sf_dir, lambda half: half * 10 + 100_000, size=n).where(few) for n in (4, 1))
    frames = long.where(F.col("seq") % 2 == 0).unionByName(short.where(F.col("seq") % 2 == 1))
    assert tls(frames, F.floor(F.col("seq") / 2)) == list(range(40))
    assert tls(short) == []


def test_hellos_of_tcp_beside_stateful_quic(spark, sf_dir):
    few = F.col("seq") < 40
    quic = split_frames(spark, sf_dir, lambda half: half).where(few)
    p = g.pk(spark, sf_dir).withColumn("seq", F.col("seq") + 1000).where(F.col("seq") < 1010)
    tcp = tcp_frames(p, 24, F.col("sport"), 443, g.record_hex(g.event_hello(F.col("k"), F.col("seq"))))
    assert tls(quic.unionByName(tcp)) == [2 * i + 1 for i in range(20)] + list(range(1000, 1010))
