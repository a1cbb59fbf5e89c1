"""Quality rules: base limits on statistics, and boosted trees with monotonic constraints for the rest.

The trees learn ``labels.quality`` from a bounded sample (see quality.training_rows), may only fall with
the features in FALLING, and are flattened into numpy node arrays that score a batch of documents at once.

Defined results: a null text has no words and fails the base rules, as does every text of under 50 words;
with no usable labels every document that passes the base rules is kept; repeated rows are judged alike;
an empty table gives no rows; other columns are not read.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import fresh
from .quality import SAMPLE_ROWS, training_rows
from .stats import COUNTS, FEATURES, with_statistics
from .trees import Forest, boost, sigmoid

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
THRESHOLD = 0.3
#: More of these never makes a document better.
FALLING = ("symbol_share", "dup_line_share", "repeat_share", "same_as_last_share", "bang_share", "top_word_share")


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Forest:
    x, y = training_rows(docs, labels, rows)
    return boost(x, y, trees=60, depth=3, rate=0.2, monotone={FEATURES.index(f): -1 for f in FALLING})


def verdicts(found: dict[str, np.ndarray], model: Forest) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base_failed, kept, score) of a batch's statistics."""
    n = found["n_words"]
    failed = (n < MIN_WORDS) | (100 * found["n_repeat_words"] > MAX_REPEAT_PERCENT * n)
    score = sigmoid(model.margin(np.stack([found[f] for f in FEATURES], 1))) if len(model.roots) else np.ones(len(n))
    return failed, ~failed & (score >= THRESHOLD), score


def judge(docs: DataFrame, model: Forest) -> DataFrame:
    """Returns doc_id, the counts, base_failed, kept and score."""
    return with_statistics(docs, ["doc_id"], names=COUNTS, after=lambda found: [pa.array(a) for a in verdicts(found, model)], more="base_failed boolean, kept boolean, score double")


def kept(docs: DataFrame, model: Forest) -> DataFrame:
    """The documents kept, with their own columns."""
    (name,) = fresh(docs, "kept")
    judged = with_statistics(docs, docs.columns, names=(), after=lambda found: [pa.array(verdicts(found, model)[1])], more=f"{name} boolean")
    return judged.where(name).select(*docs.columns)


def op7_boosted_rules(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return judge(docs, train(docs, labels))
