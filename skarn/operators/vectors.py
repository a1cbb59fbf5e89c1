"""Approximate nearest vectors: an inverted-file index of trained centroids, probed lists, exact ranking of what they hold.

Centroids are trained on a bounded sample (SAMPLE_ROWS, by a hash of the id); every vector is indexed, in the list of its nearest centroid. A
query looks into the lists of its ``probes`` nearest centroids, and ranks the vectors there by their exact cosine. How many of the true nearest are
found is measured against ``search.nearest`` (``recall``).
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors that centroids are trained on, at most, and rounds of training.
SAMPLE_ROWS, ROUNDS = 20_000, 12
#: Vectors and queries that meet at once, and pairs that are computed at once.
BLOCK, PAIRS = 8_192, 4_000_000
#: Cosines of a matrix product are off by less than this, so pairs closer to the last place than this are computed in order.
MARGIN = 1e-9
#: Lists that a query looks into.
PROBES = 8


def units(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(size > 0, size, 1)


def train(vectors: DataFrame, lists: int, rows: int = SAMPLE_ROWS, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids, ``lists`` at most, by spherical k-means on a sample; as large as the sample if that is smaller."""
    some = vectors.where("embedding IS NOT NULL").orderBy(F.xxhash64(F.lit(3), "vec_id"), "vec_id").limit(rows).select("embedding").toPandas()
    x = units(np.array(some["embedding"].tolist(), float)) if len(some) else np.zeros((0, 1))
    centre = x[np.linspace(0, len(x) - 1, min(lists, len(x))).astype(int)] if len(x) else x
    for _ in range(rounds if len(x) else 0):
        near = (x @ centre.T).argmax(1)
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        centre = np.where((np.bincount(near, minlength=len(centre)) > 0)[:, None], units(total), centre)
    return centre


def _near(centre: np.ndarray, n: int):
    """The n nearest centroids of each vector, best first."""
    @F.pandas_udf("array<int>")
    def near(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for v in batches:
            if not len(v) or not len(centre):
                yield pd.Series([[]] * len(v))
                continue
            sim = units(np.array(v.tolist(), float)) @ centre.T
            best = np.argpartition(-sim, min(n, len(centre)) - 1, axis=1)[:, :n]
            order = np.take_along_axis(sim, best, 1).argsort(1)[:, ::-1]
            yield pd.Series(list(np.take_along_axis(best, order, 1).astype(np.int32)))

    return near


def best(queries: DataFrame, vectors: DataFrame, by: list[str], n: int) -> DataFrame:
    """(query_id, vec_id, cosine, place): the n nearest of (by, vec_id, v) for each of (by, query_id, q), among those that meet in a group.

    The groups are blocks of a bounded size, each of which keeps its own n best before they are merged.
    """
    kinds = ", ".join(f"{k} {d.schema[c].dataType.simpleString()}" for k, d, c in (("query_id", queries, "query_id"), ("vec_id", vectors, "vec_id")))
    def meet(q: pa.Table, v: pa.Table) -> pa.Table:
        q, v = q.combine_chunks(), v.combine_chunks()
        found = _best(q.column("query_id"), q.column("q"), v.column("vec_id"), v.column("v"), n) if len(q) and len(v) else []
        names = ["query_id", "vec_id", "cosine"]
        if not found:
            return pa.table([q.column("query_id").slice(0, 0), v.column("vec_id").slice(0, 0), pa.array([], pa.float64())], names)
        return pa.concat_tables(pa.table(list(f), names) for f in found)

    q, v = queries.where("query_id IS NOT NULL").select(*by, "query_id", "q"), vectors.where("vec_id IS NOT NULL").select(*by, "vec_id", "v")
    local = q.groupBy(*by).cogroup(v.groupBy(*by)).applyInArrow(meet, f"{kinds}, cosine double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id"))
    return local.withColumn("place", place).where(F.col("place") <= n)


def _matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of doubles and their sizes; a null, or an array with a null, has size -1. Rows are filled up with zeros."""
    rows = column.combine_chunks()
    size = np.array(rows.value_lengths().fill_null(-1))
    flat = rows.flatten()
    x = np.zeros((len(rows), max(int(size.max(initial=0)), 1)))
    x[np.arange(x.shape[1])[None, :] < size[:, None]] = flat.to_numpy(zero_copy_only=False)
    if flat.null_count:
        at = np.repeat(np.arange(len(rows)), np.maximum(size, 0))
        size[at[np.array(flat.is_null())]] = -1
    return np.where(size[:, None] < 0, 0, x), size


def _in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of products of rows, added from the first to the last as SQL does."""
    total = np.zeros(len(a))
    for i in range(a.shape[1]):
        total += a[:, i] * b[:, i]
    return total


def _best(query_ids: pa.ChunkedArray, queries: pa.ChunkedArray, ids: pa.ChunkedArray, vectors: pa.ChunkedArray, n: int) -> list[tuple]:
    """(query ids, vector ids, cosines): the n best of a block for each query. A matrix product finds who may be among them, and only these cosines are computed in order.

    Of equal vectors the n + 1 first by id are enough. A cosine is null where a norm is 0 or the sizes differ; nulls come last, what is no number first.
    """
    by_id = np.argsort(ids.to_numpy(), kind="stable")
    x, size = _matrix(vectors.take(by_id))
    _, same = np.unique(np.column_stack([size.astype(float), x]).view(np.int64), axis=0, return_inverse=True)
    same = same.reshape(-1)
    order = np.argsort(same, kind="stable")
    starts = np.flatnonzero(np.r_[True, same[order][1:] != same[order][:-1]])
    nth = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    some = np.sort(order[nth <= n])
    x, size, v_ids = x[some], size[some], ids.take(by_id[some])
    keys = v_ids.to_numpy()
    q, q_size = _matrix(queries)
    width = max(x.shape[1], q.shape[1])
    x, q = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (x, q))
    with np.errstate(all="ignore"):
        norm, q_norm = np.sqrt(_in_order(x, x)), np.sqrt(_in_order(q, q))
        own = query_ids.to_numpy()
        left, right = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
        step = max(1, PAIRS // len(x))
        found = []
        for start in range(0, len(q), step):
            part = slice(start, min(start + step, len(q)))
            both = q_norm[part, None] * norm[None, :]
            cosine = (q[part] @ x.T) / both
            none = (both == 0) | (q_size[part, None] != size[None, :]) | (size[None, :] < 0)
            key = np.where(none, -np.inf, np.where(np.isnan(cosine), np.inf, cosine))
            there = np.ones(key.shape, bool)
            for i in np.flatnonzero(right[part] > left[part]):
                there[i, left[start + i] : right[start + i]] = False
            key[~there] = -np.inf
            none &= there
            last = np.partition(key, -n, axis=1)[:, -n] if key.shape[1] > n else np.full(len(key), -np.inf)
            few = np.isneginf(last)
            may = there & ~none & (key >= (last - MARGIN)[:, None])
            may[few] |= none[few] & (np.cumsum(none[few], axis=1) <= n)
            a, b = np.nonzero(may)
            exact = np.concatenate([_in_order(q[part][a[i : i + PAIRS // 16]], x[b[i : i + PAIRS // 16]]) for i in range(0, len(a), PAIRS // 16)]) if len(a) else np.zeros(0)
            exact = exact / both[a, b]
            null = none[a, b]
            rank = np.where(null, -np.inf, np.where(np.isnan(exact), np.inf, exact))
            sort = np.lexsort((b, null, -rank, a))
            a, b, exact, null = a[sort], b[sort], exact[sort], null[sort]
            first = np.flatnonzero(np.r_[np.ones(min(1, len(a)), bool), a[1:] != a[:-1]])
            kept = np.arange(len(a)) - np.repeat(first, np.diff(np.r_[first, len(a)])) < n
            found.append((query_ids.take(start + a[kept]), v_ids.take(b[kept]), pa.array(exact[kept], mask=null[kept])))
    return found


def build(vectors: DataFrame, path: str, lists: int = 0) -> Lists:
    """Writes (vec_id, embedding) by list to a new folder; lists: the square root of the number of vectors, unless given. Null vectors are left out."""
    lists = lists or max(1, int(vectors.count() ** 0.5))
    centre = train(vectors, lists)
    some = vectors.where("embedding IS NOT NULL").select("vec_id", "embedding").withColumn("list", F.get(_near(centre, 1)("embedding"), F.lit(0)))
    # a long list isn't the work of one task
    some.repartition("list", F.pmod(F.xxhash64("vec_id"), F.lit(4))).write.partitionBy("list").parquet(path)
    kinds = ", ".join(f"{c} {vectors.schema[c].dataType.simpleString()}" for c in ("vec_id", "embedding"))
    return Lists(vectors.sparkSession.read.schema(f"{kinds}, list int").parquet(path), centre)


class Lists:
    """An index that ``build`` has written, with its centroids."""

    def __init__(self, rows: DataFrame, centre: np.ndarray):
        self.rows, self.centre = rows, centre

    def nearest(self, queries: DataFrame, n: int = 10, probes: int = PROBES) -> DataFrame:
        """(query_id, vec_id, cosine, place) as search.nearest gives it, from the probed lists. Only their folders are read."""
        q = queries.where("embedding IS NOT NULL").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), F.explode(_near(self.centre, probes)("embedding")).alias("list"))
        sizes = self.rows.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
        small = F.broadcast(sizes)  # as many rows as lists
        v = self.rows.join(small, "list").select("list", F.pmod(F.xxhash64("vec_id"), "blocks").alias("block"), "vec_id", F.col("embedding").alias("v"))
        q = q.join(small, "list").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - F.lit(1).cast("long"))))
        return best(q, v, ["list", "block"], n)


def recall(found: DataFrame, true: DataFrame) -> DataFrame:
    """One row (recall): the share of the true (query_id, vec_id) that were found."""
    both = true.select("query_id", "vec_id").join(found.select("query_id", "vec_id").withColumn("hit", F.lit(1)), ["query_id", "vec_id"], "left")
    return both.agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
