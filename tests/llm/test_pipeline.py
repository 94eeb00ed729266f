"""The pipeline's stages on a real table, on odd rows and on nothing."""

from __future__ import annotations

import shutil

import corpus_pipeline
import pytest

from netobs.llm.common import table
from tests.llm.common import empty, messy

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
            sizes.append(out.count())
            before = {r.doc_id for r in docs.select("doc_id").collect()}
            assert {r.doc_id for r in out.select("doc_id").collect()} <= before
            docs = out
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
    texts = [r.text for r in docs.collect()]
    assert len({"".join(t.split()) for t in texts}) == len(texts)
    packed = {r.doc_id for r in out.collect()}
    assert packed == {r.doc_id for r in docs.collect()}


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and {"doc_id", "piece", "sequence_id", "offset"} <= set(rows[0].asDict())


@pytest.mark.parametrize("make", [messy, empty])
def test_odd_documents(spark, tmp_path, make):
    rows = make(spark)
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    shutil.copy(f"{SF}/labels.parquet", tmp_path / "labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert (len(out) > 0) == (make is messy) or make is empty


def test_unlearned_languages_and_junk_go(spark):
    """Texts in no learned language, without a label; all documents with letters stay."""
    given = table(spark, SF, "documents")
    strange = [
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw",
        "Alla människor är födda fria och lika i värde och rättigheter", "Все люди рождаются свободными и равными в своем достоинстве",
        "xqzt kjwv bnmp qwrtz asdfg hjklp zzxq wvbn", "aGVsbG8gd29ybGQ dGhpcyBpcyBiYXNl NjQgdGV4dA",
    ]
    more = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(strange)], "doc_id long, text string")
    left = corpus_pipeline.language_id(spark, given.unionByName(more, allowMissingColumns=True), SF)
    want = {r.doc_id for r in given.where("text rlike '[a-zA-Z]'").collect()}
    assert {r.doc_id for r in left.collect()} == want
