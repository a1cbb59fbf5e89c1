"""Helpers shared by the operators of this package."""
from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What separates words: space and the control characters from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a table that is broadcast, at most; each of these tables has rows of under 200 bytes.
BROADCAST_ROWS = 50_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it.

    ``spark.checkpoint.dir`` is read from the session. Only where it is unset on a single machine, as in
    tests, is a temporary folder made; a cluster without a shared folder is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that the driver and the executors of {master} share")
        named = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.sparkContext.setCheckpointDir(named)
    return named


def checkpointed(df: DataFrame) -> DataFrame:
    """Runs the plan once, keeps its rows in the shared folder and cuts the lineage."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a checkpointed table for broadcast if a count shows that it is small; otherwise the join shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def prefix_sums(df: DataFrame, order: list[Column], **sums: Column) -> DataFrame:
    """Adds the sums over all rows before each row in the order (a total one), by name.

    Up to BROADCAST_ROWS rows (counted) are summed in one task. More are dealt by ranges, each range is summed in itself, and
    only the ranges' totals, one row for each partition, meet in one task.
    """
    df = checkpointed(df)
    if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        upto = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumns({k: F.coalesce(F.sum(c).over(upto), F.lit(0).cast("long")) for k, c in sums.items()})
    (part,) = fresh(df, "part")
    rows = df.withColumns({f"_{k}": c for k, c in sums.items()}).repartitionByRange(*order)
    rows = checkpointed(rows.withColumn(part, F.spark_partition_id()))
    zero = F.lit(0).cast("long")
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy(part).agg(*[F.sum(f"_{k}").alias(k) for k in sums])
    base = base.select(F.col(part).alias(f"_{part}"), *[F.coalesce(F.sum(k).over(before), zero).alias(f"__{k}") for k in sums])
    inside = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumns({k: F.coalesce(F.sum(f"_{k}").over(inside), zero) for k in sums})
    out = out.join(F.broadcast(base), F.col(part) == F.col(f"_{part}"))  # as many rows as partitions
    return out.select(*df.columns, *[(F.col(k) + F.col(f"__{k}")).alias(k) for k in sums])


def hash60(*cols) -> F.Column:
    """60 bits of MD5 over the columns as text, nulls as empty strings."""
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that the table doesn't have yet: the given ones, with underscores before them where needed."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
