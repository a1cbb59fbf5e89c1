"""Connected components of an undirected graph by alternating star contractions, as joins and groupings."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, shared_path

#: Edges of a task, about.
EDGES = 200_000


def _low(edges: DataFrame, by: str) -> DataFrame:
    """Minimum of each node's neighbours and itself: partial aggregates, so that a hub's edges are reduced before the shuffle."""
    other = "v" if by == "u" else "u"
    return edges.groupBy(by).agg(F.min(other).alias("m")).select(by, F.least(by, "m").alias("m"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of (u, v), the component being its smallest node.

    Each round links a node's larger neighbours to the smallest one (large star), then the node itself
    and its smaller ones (small star), until the edges form stars and stay as they are. Rounds grow
    with the logarithm of the longest path. A round's edges are a table in the shared folder, in turn one of
    two, so a lost executor costs one round at most, and plans start from the size of a table. Both sides of a
    join are plain shuffles, so that a hub's edges can be split over tasks. Tables take as many tasks as their
    rows need. Null ends and loops are dropped; no edges give no rows.
    """
    spark, path = edges.sparkSession, shared_path(edges.sparkSession, "edges")

    def kept(df: DataFrame, turn: int) -> DataFrame:
        df.where("u <> v").distinct().coalesce(tasks).write.mode("overwrite").parquet(f"{path}/{turn % 2}")
        return spark.read.parquet(f"{path}/{turn % 2}")

    e = edges.where(F.col("u").isNotNull() & F.col("v").isNotNull())
    tasks = _tasks(e.count())
    e = kept(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), 0)
    count, total = _state(e)
    for turn in range(1, max_rounds + 1):
        tasks = _tasks(2 * count)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(2 * tasks)
        low = checkpointed(_low(both, "u").coalesce(tasks))
        star = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        star = checkpointed(star.where("u <> v").distinct().coalesce(tasks))
        low = checkpointed(_low(star, "u").coalesce(tasks))
        near = star.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = kept(near.unionByName(low.select("u", F.col("m").alias("v"))), turn)
        # unchanged edges have the same count and sum of hashes
        now = _state(e)
        if now == (count, total):
            break
        count, total = now
    else:
        raise RuntimeError(f"the components did not settle in {max_rounds} rounds")
    found = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return checkpointed(found.unionByName(found.select(F.col("component").alias("node"), "component").distinct()))


def _tasks(rows: int) -> int:
    return max(1, -(-rows // EDGES))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
