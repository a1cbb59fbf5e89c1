"""Enrichment: registries, listings and scorecards joined to repositories, with bookkeeping of what was used."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.functions.text import is_https, normal_url, shell_quote
from skarn.operators.ingest import first_by


def formulas(repos: DataFrame, listing: DataFrame) -> DataFrame:
    """repos with the first formula (name, ordinal, homepage) of the same name, whatever its case."""
    first = first_by(listing.select(F.lower("name").alias("_key"), "ordinal", F.struct("name", "homepage").alias("formula")), ["_key"], ["ordinal"]).drop("ordinal")
    return repos.join(first, F.lower(F.col("name")) == F.col("_key"), "left").drop("_key")


def listings(repos: DataFrame, landscape: DataFrame) -> DataFrame:
    """repos with the first listing (position, repo_url, project) of the same normalised url."""
    first = first_by(landscape.select(normal_url(F.col("repo_url")).alias("_url"), "position", "project"), ["_url"], ["position"]).drop("position")
    return repos.join(first, normal_url(F.col("repo_url")) == F.col("_url"), "left").drop("_url")


def is_slug(name: Column) -> Column:
    return F.coalesce(F.regexp_like(F.lower(name), F.lit(r"^[a-z0-9]([a-z0-9._-]*[a-z0-9])?$")), F.lit(False))


def charts(repos: DataFrame, packages: DataFrame) -> DataFrame:
    """repos with their best package (repo, name, official, stars, repository, ordinal): official, then stars, then order.

    Packages without a safe name or an https repository are not eligible. The package brings its install command.
    """
    usable = packages.where(is_slug(F.col("name")) & is_slug(F.col("repository.name")) & is_https(F.col("repository.url")))
    ranked = usable.select("repo", (~F.coalesce("official", F.lit(False))).alias("_o"), (-F.coalesce("stars", F.lit(0))).alias("_s"), "ordinal", F.struct("name", "repository", "stars").alias("chart"))
    best = first_by(ranked, ["repo"], ["_o", "_s", "ordinal"]).select("repo", "chart")
    c = F.col("chart")
    command = F.concat(F.lit("helm repo add "), c["repository"]["name"], F.lit(" "), shell_quote(c["repository"]["url"]), F.lit(" && helm install "), c["name"], F.lit(" "), c["repository"]["name"], F.lit("/"), c["name"])
    return repos.join(best, "repo", "left").withColumn("chart_command", F.when(c.isNotNull(), command))


def scorecards(repos: DataFrame, cards: DataFrame) -> DataFrame:
    """repos with score and a map of checks (the last of a name counts; negative scores are unknown)."""
    known = F.filter("checks", lambda c: c["score"] >= 0)
    last = F.map_from_arrays(F.array_distinct(F.transform(known, lambda c: c["name"])), F.transform(F.array_distinct(F.transform(known, lambda c: c["name"])), lambda n: F.element_at(F.filter(known, lambda c: c["name"] == n), -1)["score"]))
    return repos.join(cards.select("repo", F.struct("score", last.alias("checks")).alias("scorecard")), "repo", "left")


def dependencies(repos: DataFrame, depsdev: DataFrame) -> DataFrame:
    """repos with their deps.dev answer, by repo."""
    return repos.join(depsdev.select("repo", F.struct(*[c for c in depsdev.columns if c != "repo"]).alias("depsdev")), "repo", "left")


def open_vulnerabilities(repos: DataFrame, osv: DataFrame) -> DataFrame:
    """repos (ecosystem, package) with the number of open vulnerabilities, by ``ecosystem::name``; null without an answer or an identity."""
    answers = osv.select("key", F.size("vulns").alias("osv_open_vulns"), F.col("fetched_at").alias("osv_fetched_at"))
    key = F.when(F.col("ecosystem").isNotNull() & F.col("package").isNotNull(), F.concat("ecosystem", F.lit("::"), "package"))
    return repos.withColumn("_key", key).join(answers, F.col("_key") == F.col("key"), "left").drop("_key", "key")


def bookkeeping(df: DataFrame, used: dict[str, Column], partial: dict[str, Column]) -> DataFrame:
    """Adds signals_used and partial_signals: the names whose test holds, in order."""
    names = lambda tests: F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(n)) for n, t in tests.items()]))
    return df.withColumns({"signals_used": names(used), "partial_signals": names(partial)})
