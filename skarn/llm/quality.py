"""Quality classifier: a sparse ensemble of rules over document statistics.

Boosted trees are fitted on a bounded sample of labelled rows; the path to each of their nodes is a
conjunctive rule. Lasso logistic regression on the rules' truth values keeps few of them, and these are
compiled into one Spark column expression: the score of all documents is computed by the JVM.

Only rows whose crc32(doc_id as text) mod 5 is not 0 teach, SAMPLE_ROWS at most, chosen by a hash of the
doc_id; labels, lang, source and doc_id are no inputs.

Defined results: a null or empty text has zero statistics and a score like any other; a null doc_id is
not held out (its remainder is null) and never teaches; with no usable labels every score is 0.5; a label
that is null or not 0 or 1 is not used; several labels of one doc_id count once, the lowest; repeated rows
are scored alike; an empty table gives no rows; other columns are not read.
"""
from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stats import FEATURES, with_statistics
from .trees import boost, lasso_logistic

#: Labelled rows that a model learns from, at most.
SAMPLE_ROWS = 20_000
FOLDS = 5
THRESHOLD = 0.3
PENALTY = 5e-4


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % FOLDS


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, label: str = "quality") -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the sample, in a fixed order."""
    usable = labels.where(F.col(label).isin(0, 1) & (fold(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.min(label).alias("label_"))
    by_hash = F.xxhash64(F.lit(5), F.col("doc_id"))
    taught = usable.orderBy(by_hash, "doc_id").limit(rows).select(F.col("doc_id").alias("id_"), "label_")
    # at most ``rows`` rows of 12 bytes
    some = docs.select("doc_id", "text").join(F.broadcast(taught), F.col("doc_id") == F.col("id_")).select("doc_id", "label_", "text")
    found = with_statistics(some, ["doc_id", "label_"], names=FEATURES)
    got = found.orderBy(F.xxhash64(F.lit(5), F.col("doc_id")), *[F.col(c) for c in found.columns]).limit(rows).toPandas()
    return got[list(FEATURES)].to_numpy(float), got["label_"].to_numpy(float)


class RuleEnsemble:
    """Weighted conjunctive rules; ``column`` is their Spark expression."""

    def __init__(self, intercept: float, rules: list[tuple[float, tuple[tuple[int, bool, float], ...]]]):
        self.intercept, self.rules = intercept, rules

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, penalty: float = PENALTY) -> RuleEnsemble:
        paths = boost(x, y, trees=12, depth=3, rate=0.4).paths()
        if not paths:
            return cls(0.0, [])
        intercept, weight = lasso_logistic(np.stack([holds(p, x) for p in paths], 1).astype(float), y, penalty)
        return cls(intercept, [(float(w), p) for w, p in zip(weight, paths, strict=True) if abs(w) > 1e-4])

    def column(self, prefix: str = "") -> Column:
        """The score, 0 to 1."""
        def test(f: int, low: bool, t: float) -> Column:
            c = F.col(prefix + FEATURES[f])
            return c <= t if low else c > t

        terms = [F.when(reduce(lambda a, b: a & b, [test(*c) for c in p]), F.lit(w)).otherwise(F.lit(0.0)) for w, p in self.rules]
        return 1 / (1 + F.exp(-reduce(lambda a, b: a + b, terms, F.lit(self.intercept))))

    def score(self, x: np.ndarray) -> np.ndarray:
        """The same in numpy, for tests."""
        z = np.full(len(x), self.intercept)
        for w, p in self.rules:
            z = z + w * holds(p, x)
        return 1 / (1 + np.exp(-z))


def holds(path: tuple, x: np.ndarray) -> np.ndarray:
    return reduce(np.logical_and, [x[:, f] <= t if low else x[:, f] > t for f, low, t in path])


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> RuleEnsemble:
    return RuleEnsemble.fit(*training_rows(docs, labels, rows))


def classify(docs: DataFrame, model: RuleEnsemble) -> DataFrame:
    """Returns (doc_id, held_out, score, predicted)."""
    stats = with_statistics(docs, ["doc_id"], names=FEATURES)
    scored = stats.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), model.column().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def accepted(docs: DataFrame, model: RuleEnsemble) -> DataFrame:
    """The documents predicted good, with their own columns."""
    prefix = "stat_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = f"_{prefix}"
    stats = with_statistics(docs, docs.columns, names=FEATURES, prefix=prefix)
    return stats.where(model.column(prefix) >= THRESHOLD).select(*docs.columns)


def op3_rule_ensemble(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return classify(docs, train(docs, labels))
