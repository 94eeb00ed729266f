"""The corpus pipeline: language, quality, exact and near duplicates, packing.

Each stage takes what the stage before kept, written as Parquet and read again.
All but the last return the columns of ``documents``. A stage learns only from
rows it is given, outside the fold that the single queries hold out.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netobs.llm import chosen_path, langid, naming, packing, quality
from netobs.llm.common import Scratch, fold, table

SURE = 0.5  # posterior under which no language is accepted
STRANGE = 2.0  # times the surprise of labelled texts from which a text is in no learned language
SHINGLE = 5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a learned language; null texts, texts without letters, in other languages and junk go."""
    labelled = docs.where(fold("doc_id", 4) != 2)
    model = langid.learn(labelled, str(public_tokenizers.path("piece_bpe_32k.model")), levels=True)
    marked = docs.select(F.struct("*").alias("row"), langid.language(model, F.col("text")).alias("l"))
    sure = (F.col("l.lang_pred") != "und") & (F.col("l.score") >= SURE) & (F.col("l.surprise") < STRANGE)
    return marked.where(sure).select("row.*")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble accepts."""
    labels = quality.labels_of(table(spark, sf_dir, "labels")).where(fold("k", 4) != 2)
    labelled = Scratch(spark, "quality-stage").save(quality.with_statistics(docs, "doc_id", "text"), "statistics").join(labels, "k")
    scored = quality.with_score(docs, quality.learn(labelled))
    return scored.where(F.col("score") >= quality.ACCEPT).select("row.*")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, white space aside."""
    return naming.keep_first(docs, naming.exact_dedup(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates on five-word shingles."""
    return chosen_path.keep_one(docs, chosen_path.near_components(docs, SHINGLE))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents that are left, with their places in sequences of 2048 tokens."""
    return packing.pack(docs, str(public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("language_id", language_id),
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("best_fit_packing", best_fit_packing),
]

ORACLE_SQL = None  # learned models have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; the rows of the last."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
