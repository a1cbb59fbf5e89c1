"""Health scores as column expressions. A missing signal is unknown, not zero."""
from __future__ import annotations

from functools import reduce

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights of the total, of activity and of the quality signals.
TOTAL_WEIGHTS = {"popularity": 0.35, "activity": 0.30, "adoption": 0.20, "quality": 0.15}
QUALITY_WEIGHTS = {
    "license": 0.15, "releases": 0.1, "docs": 0.1, "not_archived": 0.1,
    "code_review": 0.15, "ci_tests": 0.15, "signed_releases": 0.1, "branch_protection": 0.1,
}
PUSH_DAYS, RELEASE_DAYS, ARCHIVED_CAP = 540, 365, 0.4


def clamp01(x: Column) -> Column:
    """Null stays null: least and greatest would skip it."""
    return F.when(x.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)))


def days_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 8.64e10


def popularity(stars: Column) -> Column:
    return clamp01(F.log10(F.greatest(F.lit(0), stars) + F.lit(1.0)) / 5)


def activity(pushed: Column, released: Column, releases_12m: Column, maintained: Column, now: Column) -> Column:
    push = clamp01(1 - days_between(now, pushed) / PUSH_DAYS)
    release = F.coalesce(clamp01(1 - days_between(now, released) / RELEASE_DAYS), F.lit(0.0))
    known = push * 0.5 + release * 0.2 + clamp01(releases_12m / 6) * 0.15
    return F.when(maintained.isNull(), clamp01(known / 0.85)).otherwise(clamp01(known + clamp01(maintained / 10) * 0.15))


def adoption(registries: Column, dependents: Column) -> Column:
    known = F.coalesce(clamp01(F.log10(dependents + F.lit(1.0)) / 3), F.lit(0.0))
    return clamp01(clamp01(registries / 3) * 0.7 + known * 0.3)


def quality(signals: dict[str, Column], vulnerabilities: Column) -> tuple[Column, Column]:
    """(quality, coverage) over the signals that are present; (0, 0) if none is."""
    pairs = F.filter(F.array(*[F.struct(signals[k].cast("double").alias("v"), F.lit(w).alias("w")) for k, w in QUALITY_WEIGHTS.items()]), lambda x: x["v"].isNotNull())
    total = lambda f: F.aggregate(pairs, F.lit(0.0), lambda a, x: a + f(x))
    weight = total(lambda x: x["w"])
    penalty = F.coalesce(clamp01(vulnerabilities / 10) * 0.3, F.lit(0.0))
    value = F.coalesce(clamp01(F.try_divide(total(lambda x: x["v"] * x["w"]), weight) - penalty), F.lit(0.0))
    return value, clamp01(weight / sum(QUALITY_WEIGHTS.values()))


def total(parts: dict[str, Column], archived: Column) -> Column:
    raw = reduce(lambda a, b: a + b, [parts[k] * w for k, w in TOTAL_WEIGHTS.items()])
    return F.when(archived, F.least(raw, F.lit(ARCHIVED_CAP))).otherwise(clamp01(raw))


def raw_momentum(stars: Column, created: Column, activity_: Column, now: Column) -> Column:
    return stars / F.greatest(F.lit(1.0), days_between(now, created)) * activity_


def z_score(df: DataFrame, value: str, into: str) -> DataFrame:
    """Adds the value's distance from the corpus mean in standard deviations, 0 where they are 0.

    Mean and deviation come from one aggregated row that joins every row; no window over the corpus.
    """
    corpus = df.agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_sd"))
    z = F.when(F.col("_sd") == 0, F.lit(0.0)).otherwise((F.col(value) - F.col("_mean")) / F.col("_sd"))
    return df.join(F.broadcast(corpus)).withColumn(into, z).drop("_mean", "_sd")  # one row


def moments(df: DataFrame, value: str, *by: str) -> DataFrame:
    """(by, n, mean, m2): what mean and deviation of parts are merged from; nulls don't count."""
    n = F.count(value)
    return df.groupBy(*by).agg(n.alias("n"), F.avg(F.col(value).cast("double")).alias("mean"), (F.var_pop(F.col(value).cast("double")) * n).alias("m2"))


def merged_moments(parts: Sequence[tuple[int, float | None, float | None]]) -> tuple[int, float | None, float | None]:
    """(n, mean, standard deviation) of all parts together, from (n, mean, m2) of each."""
    n, mean, m2 = 0, 0.0, 0.0
    for k, own, spread in parts:
        if k:
            off = own - mean
            m2 += spread + off * off * n * k / (n + k)
            mean += off * k / (n + k)
            n += k
    return (n, mean, math.sqrt(max(m2, 0.0) / n)) if n else (0, None, None)


def z_score_of(value: Column, mean: float | None, deviation: float | None) -> Column:
    """z_score with the corpus's mean and deviation as they are kept, without a pass over it."""
    if mean is None:
        return F.lit(None).cast("double")
    return F.when(value.isNotNull(), F.lit(0.0) if deviation == 0 else (value - F.lit(mean)) / F.lit(deviation))
