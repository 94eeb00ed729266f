"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics.

1. Statistics of the whole text, as column expressions.
2. A small random forest on labelled rows; every path from a root to a node is a
   rule, a conjunction of thresholds on statistics.
3. Logistic regression with a lasso penalty over the rules' truth values; most
   weights become 0.
4. The rules left over are compiled into one column expression, so scoring is a
   projection in the JVM.
"""

from __future__ import annotations

import math
import re

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netobs.llm.common import Scratch
from netobs.plans.stage import stage

TRAINING_ROWS = 20_000  # bound of the labelled sample that trees and weights are fitted on
TREES, DEPTH = 16, 3
PENALTY = 5e-4
ACCEPT = 0.7

Rule = tuple[tuple[str, str, float], ...]  # (statistic, "<=" or ">", threshold), all of which hold


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text; a null text counts as empty. Ratios over nothing are 0."""
    text = F.coalesce(text, F.lit(""))
    size = F.length(text)

    def share(pattern: str) -> Column:
        return (size - F.length(F.regexp_replace(text, pattern, ""))) / F.greatest(size, F.lit(1))

    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.split(text, "\n")
    n = F.size(words)
    again = F.zip_with(words, F.slice(words, 2, F.greatest(n, F.lit(1))), lambda a, b: a == b)
    return {
        "log_words": F.log1p(n),
        "word_length": size / F.greatest(n, F.lit(1)),
        "upper": share(r"\p{Lu}+"),
        "symbols": share(r"[^\p{L}\p{N}\s.,]+"),
        "digits": share(r"\p{Nd}+"),
        "distinct": F.size(F.array_distinct(words)) / F.greatest(n, F.lit(1)),
        "again": F.size(F.filter(again, lambda x: x)) / F.greatest(n, F.lit(1)),
        "words_a_line": n / F.size(lines),
        "lines_again": 1 - F.size(F.array_distinct(lines)) / F.size(lines),
    }


NAMES = tuple(f"stat_{k}" for k in ("log_words", "word_length", "upper", "symbols", "digits", "distinct", "again", "words_a_line", "lines_again"))


def with_statistics(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(k, stat_...) per row."""
    return docs.select(F.col(key).alias("k"), *[c.alias(f"stat_{name}") for name, c in statistics(F.col(text)).items()])


def with_score(docs: DataFrame, model: "RuleModel", text: str = "text") -> DataFrame:
    """(row, score): every row of ``docs`` as a struct with its score.

    The statistics are computed once per row; column names of ``docs`` cannot
    clash with theirs.
    """
    made = {f"stat_{name}": c for name, c in statistics(F.col("t")).items()}
    rows = docs.select(F.struct("*").alias("row"), F.col(text).alias("t"))
    return stage(stage(rows, made, drop=["t"]), {"score": model.score()}, drop=list(made))


def paths(debug: str, names: tuple[str, ...] = NAMES) -> list[Rule]:
    """Every root-to-node path of the trees in a model's text form, without repeats."""
    rules: dict[Rule, None] = {}
    above: list[tuple[int, tuple[str, str, float]]] = []
    for line in debug.splitlines():
        m = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) ([-+0-9.eE]+)\)", line)
        if not m:
            continue
        deep = len(m[1])
        above = [(d, c) for d, c in above if d < deep] + [(deep, (names[int(m[2])], m[3], float(m[4])))]
        rules.setdefault(tuple(sorted({c for _, c in above})))
    return list(rules)


def holds(rule: Rule) -> Column:
    test = F.lit(True)
    for name, sign, at in rule:
        test &= (F.col(name) <= at) if sign == "<=" else (F.col(name) > at)
    return test


class RuleModel:
    """Intercept and weighted rules; ``score`` is the compiled column."""

    def __init__(self, intercept: float, rules: dict[Rule, float]):
        self.intercept, self.rules = intercept, rules

    def score(self) -> Column:
        total = F.lit(float(self.intercept))
        for rule, weight in self.rules.items():
            total += F.when(holds(rule), float(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def learn(labelled: DataFrame, most_rows: int = TRAINING_ROWS, key: str = "k") -> RuleModel:
    """Fit on rows of statistics with a 0/1 ``label``.

    Beyond ``most_rows``, a sample by the key's hash of about that size. With no
    row or one class only, the score is the smoothed share of label 1.
    """
    tally = {r.label: r["count"] for r in labelled.where(F.col("label").isin(0, 1)).groupBy("label").count().collect()}
    n, ones = sum(tally.values()), tally.get(1, 0)
    if not 0 < ones < n:
        return RuleModel(math.log((ones + 1) / (n - ones + 1)), {})
    labelled = labelled.where(F.col("label").isin(0, 1))
    if n > most_rows:
        share = F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(1)), F.lit(1 << 20))
        labelled = labelled.where(share < int((1 << 20) * most_rows / n))
    scratch = Scratch(labelled.sparkSession, "quality")
    sample = scratch.save(labelled.repartition(8, key).sortWithinPartitions(key), "sample")
    inputs = VectorAssembler(inputCols=list(NAMES), outputCol="features")
    forest = RandomForestClassifier(
        numTrees=TREES, maxDepth=DEPTH, seed=1, featureSubsetStrategy="onethird", subsamplingRate=0.7, maxBins=64,
    ).fit(inputs.transform(sample))
    rules = paths(forest.toDebugString)
    truth = sample.select("label", F.array(*[holds(r).cast("double") for r in rules]).alias("truth"))
    truth = scratch.save(truth, "truth").select("label", array_to_vector("truth").alias("features"))
    fit = LogisticRegression(regParam=PENALTY, elasticNetParam=1.0, maxIter=60, standardization=False).fit(truth)
    weights = {r: float(w) for r, w in zip(rules, fit.coefficients.toArray(), strict=True) if w}
    scratch.drop("sample", "truth")
    return RuleModel(float(fit.intercept), weights)


def labels_of(labels: DataFrame, key: str = "doc_id", label: str = "quality") -> DataFrame:
    """One label per key, the smallest where rows disagree; null keys and labels are left out."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull())
    return known.groupBy(F.col(key).alias("k")).agg(F.min(label).cast("int").alias("label"))
