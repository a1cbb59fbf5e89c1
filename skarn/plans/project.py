"""The projection job: repositories and their analysis become validated read-model documents."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn import vocabulary
from skarn.functions import text
from skarn.sources.files import read_json, split_valid

V = vocabulary.standard()


def documents(repos: DataFrame, analysis: DataFrame, icons: DataFrame | None = None) -> DataFrame:
    """Inner join with the analysis, left join with icons, whole structs written; joined on the repository's id."""
    out = repos.drop("kind", "domains", "summary", "k8s_relevance").join(analysis, "id")
    if icons is not None:
        out = out.join(icons.select("id", "icon"), "id", "left")
    return out.withColumn("document_id", text.document_id(F.col("full_name")))


def checked(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid documents, rejects with their violations)."""
    unit = lambda c: F.col(c).between(0, 1)
    checks = {
        "kind": vocabulary.is_valid(V["kind"], F.array("kind")), "domains": vocabulary.is_valid(V["domains"], F.col("domains")), "runtime": vocabulary.is_valid(V["runtime"], F.array("runtime")),
        "license_class": vocabulary.is_valid(V["license_class"], F.array("license_class")), "maturity": vocabulary.is_valid(V["maturity"], F.array("maturity")),
        "k8s_relevance": unit("k8s_relevance"), "confidence": unit("confidence"), "stars": F.col("stars") >= 0, "pushed_at": F.col("pushed_at").isNotNull(),
    }
    return split_valid(docs, checks)


def emit_corpus(docs: DataFrame, path: str, source: str) -> None:
    """Writes generated documents as JSON lines, marked with their source so that they can't pass for real ones."""
    docs.withColumn("discovery_source", F.lit(source)).write.json(path)


def load_corpus(spark, path: str, schema: str, source: str, lines: bool = True) -> DataFrame:
    """Documents of a generated corpus; one that is invalid, unreadable or not marked refuses all."""
    good, broken = read_json(spark, path, f"{schema}, discovery_source string", lines)
    valid, rejects = checked(good)
    unmarked = ~F.col("discovery_source").eqNullSafe(F.lit(source))
    for what, bad in (("unreadable", broken), ("invalid", rejects), ("not marked as generated", valid.where(unmarked))):
        if not bad.isEmpty():
            raise ValueError(f"a document is {what}: {bad.first().asDict()}")
    return valid
