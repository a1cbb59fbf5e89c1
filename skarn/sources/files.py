"""Scans of raw JSON and cached responses, with bad rows counted instead of fatal."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Providers with their time to live in seconds.
PROVIDERS = {"scorecard": 7 * 86400, "depsdev": 7 * 86400, "osv": 3 * 86400, "brew": 86400, "artifacthub": 86400, "cncf-landscape": 7 * 86400}


def read_json(spark: SparkSession, path: str, schema: str, lines: bool = True) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejects as text) of a folder of JSON: objects by line, or (not lines) a file's array of objects, or one object.

    A file of the second kind that can't be read is one reject.
    """
    raw = spark.read.text(path, wholetext=not lines).where(F.trim("value") != "")
    own = f"{schema}, _corrupt_record string"
    if not lines:
        whole = raw.withColumn("many", F.from_json("value", f"array<struct<{_fields(spark, schema)}>>", {"mode": "PERMISSIVE"}))
        return whole.where("many IS NOT NULL").select(F.inline("many")), whole.where("many IS NULL").select(F.col("value").alias("_corrupt_record"))
    parsed = raw.select("value", F.from_json("value", own, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("j"))
    bad = F.col("j").isNull() | F.col("j._corrupt_record").isNotNull()
    return parsed.where(~bad).select("j.*").drop("_corrupt_record"), parsed.where(bad).select(F.col("value").alias("_corrupt_record"))


def _fields(spark: SparkSession, schema: str) -> str:
    return ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in spark.createDataFrame([], schema).schema.fields)


def split_valid(df: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejects with their ``violations``); a check that is null fails."""
    found = F.array_compact(F.array(*[F.when(~F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in checks.items()]))
    marked = df.withColumn("violations", found)
    return marked.where(F.size("violations") == 0).drop("violations"), marked.where(F.size("violations") > 0)


def flatten_landscape(df: DataFrame) -> DataFrame:
    """(position, name, repo_url, project) of nested categories, subcategories and items, in listing order."""
    c = df.select(F.posexplode("landscape").alias("c", "category"))
    s = c.select("c", F.posexplode("category.category.subcategories").alias("s", "sub"))
    i = s.select("c", "s", F.posexplode("sub.subcategory.items").alias("i", "item"))
    return i.select(F.struct("c", "s", "i").alias("position"), "item.item.name", "item.item.repo_url", "item.item.project")


def repo_key(owner: Column, name: Column, artifact: str) -> Column:
    """The storage key of an artifact."""
    from skarn.functions.text import encode_component

    return F.concat_ws("/", F.lit("repos"), encode_component(owner), encode_component(name), F.lit(artifact))
