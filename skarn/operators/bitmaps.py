"""Facet counts from bitmaps: documents have numbers, and each value of a facet a bitmap of its documents for every 32,768 numbers. A task numbers its
rows from a start of its own, so the last block of each task is a part of one.

A request makes one bitmap of its own: values of one attribute are united, attributes intersected, any other filter turned
into bits by the documents' ids. Counts are bits of the intersections, so no document's attributes are read. Meant for attributes with few
values (facets); a value's bitmap takes 4 KB for each block that holds it.
"""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .filters import values_of
from .search import MAX_FACET_VALUES


def build(df: DataFrame, path: str, attributes: Sequence[str], key: str = "id") -> FacetIndex:
    """Writes the numbers of the documents with their values, and the bitmaps by attribute, to a new folder."""
    values = [F.transform(F.array_distinct(values_of(df, a)), lambda x: x.cast("string")).alias(f"a{i}") for i, a in enumerate(attributes)]
    # numbers by task and row need no order; they are written with the values once, so both are read from there
    df.select(F.col(key).alias("id"), F.monotonically_increasing_id().alias("number"), *values).write.option("compression", "zstd").parquet(f"{path}/numbers")
    rows = df.sparkSession.read.parquet(f"{path}/numbers")
    pairs = [F.transform(f"a{i}", _named(a)) for i, a in enumerate(attributes)]
    flat = rows.select("number", F.explode(F.array_distinct(F.concat(*pairs))).alias("p")).select("number", "p.attribute", "p.value")
    _bits(flat, "attribute", "value").repartition("attribute", "value").sortWithinPartitions("value", "block").write.partitionBy("attribute").parquet(f"{path}/bitmaps")
    return FacetIndex(df.sparkSession, path)


def _named(attribute: str):
    return lambda v: F.struct(F.lit(attribute).alias("attribute"), v.alias("value"))


def _bits(rows: DataFrame, *by: str) -> DataFrame:
    """(by, block, bits) of (by, number)."""
    return rows.groupBy(*by, F.bitmap_bucket_number("number").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits"))


class FacetIndex:
    """Reads what ``build`` has written."""

    def __init__(self, spark: SparkSession, path: str):
        self.numbers = spark.read.parquet(f"{path}/numbers").select("id", "number")
        self.bitmaps = spark.read.schema("value string, block long, bits binary, attribute string").parquet(f"{path}/bitmaps")

    def of_values(self, attribute: str, values: Sequence[str]) -> DataFrame:
        """(block, bits) of the documents with any of the values."""
        some = self.bitmaps.where((F.col("attribute") == attribute) & F.col("value").isin(list(values)))
        return some.groupBy("block").agg(F.bitmap_or_agg("bits").alias("bits"))

    def of_ids(self, ids: DataFrame) -> DataFrame:
        """(block, bits) of some documents (id), as any filter or search finds them."""
        return _bits(self.numbers.join(ids.select("id").distinct(), "id").select("number"))

    def both(self, *filters: DataFrame) -> DataFrame:
        """The intersection of filters: blocks that one of them doesn't have are empty."""
        every = reduce(DataFrame.unionByName, filters)
        return every.groupBy("block").agg(F.bitmap_and_agg("bits").alias("bits"), F.count(F.lit(1)).alias("n")).where(F.col("n") == len(filters)).select("block", "bits")

    def count(self, where: DataFrame) -> DataFrame:
        """One row (docs) of a filter."""
        return where.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("docs"))

    def facets(self, attributes: Sequence[str], where: DataFrame | None = None, most: int = MAX_FACET_VALUES) -> DataFrame:
        """(attribute, value, docs) under a filter (None: all documents), as search.facets gives them."""
        some = self.bitmaps.where(F.col("attribute").isin(list(attributes)))
        if where is not None:
            met = some.join(where.select("block", F.col("bits").alias("own")), "block")
            both = met.select("attribute", "value", "block", F.explode(F.array("bits", "own")).alias("bits"))
            some = both.groupBy("attribute", "value", "block").agg(F.bitmap_and_agg("bits").alias("bits"))
        counts = some.groupBy("attribute", "value").agg(F.sum(F.bitmap_count("bits")).alias("docs")).where("docs > 0")
        place = F.row_number().over(Window.partitionBy("attribute").orderBy("value"))
        return counts.withColumn("n", place).where(F.col("n") <= most).drop("n")
