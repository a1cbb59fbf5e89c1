"""State of sweeps and runs: what was found, what is pending, and how runs begin, end and are reset."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.functions.text import content_hash
from skarn.sources.shared import written

#: Windows and seconds after which a sweep writes what it has, and what a run may end as.
FLUSH_WINDOWS, FLUSH_SECONDS = 25, 30
OUTCOMES = ("running", "complete", "failed", "interrupted")
#: Fields that a payload's hash covers; where and when a repository was found is left out.
PAYLOAD = ("repo_id", "full_name", "name", "owner", "description", "homepage", "stars", "forks", "open_issues", "language", "license", "topics", "archived", "fork", "default_branch", "created_at", "updated_at", "pushed_at")
COUNTERS = ("repos_seen", "repos_fetched", "repos_unchanged", "repos_skipped", "repos_failed", "icons_updated", "requests", "points_spent", "rate_limited")


def payload_hash(df: DataFrame) -> Column:
    """Changes with all that is stored of a repository, its stars included, and not with the query that found it."""
    fields = [c for c in PAYLOAD if c in df.columns]
    return content_hash(*[F.array_sort(c).alias(c) if c == "topics" else F.col(c) for c in fields])


def count_discovery(states: DataFrame, repos: DataFrame, runs: DataFrame, query_slug: str | None = None) -> DataFrame:
    """For each swept query: repositories, runs, pending windows and the last run (by start, then id).

    Counts are aggregates by query, joined to the states: a query counts from its first state on.
    """
    if query_slug is not None:
        states, repos, runs = (d.where(F.col("query_slug") == query_slug) for d in (states, repos, runs))
    n_repos = repos.groupBy("query_slug").agg(F.count(F.lit(1)).alias("repos"))
    last = F.max(F.struct("started_at", "run_id", F.coalesce("outcome", F.lit("unknown")).alias("outcome"))).alias("last_run")
    n_runs = runs.groupBy("query_slug").agg(F.count(F.lit(1)).alias("runs"), last)
    zero = F.lit(0).cast("long")
    out = states.join(n_repos, "query_slug", "left").join(n_runs, "query_slug", "left")
    pending = F.coalesce(F.cardinality("pending_windows"), F.lit(0))
    return out.select("query_slug", F.coalesce("query", "query_slug").alias("query"), F.coalesce("repos", zero).alias("repos"), F.coalesce("runs", zero).alias("runs"), pending.alias("pending_windows"), "last_run")


def totals(counts: DataFrame) -> DataFrame:
    return counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("repos", "runs", "pending_windows")])


def begin_sweep(states: DataFrame, initial: Column, now: Column) -> DataFrame:
    """States as a sweep opens them, with ``resumed``: what has pending windows goes on, the others start over with the initial ones."""
    resumed = F.coalesce(F.cardinality("pending_windows") > 0, F.lit(False))
    fresh = lambda c, value: F.when(resumed, F.col(c)).otherwise(value).alias(c)
    none = F.array().cast("array<string>")
    return states.select(
        "query_slug", "query", fresh("pending_windows", initial), fresh("completed_windows", none), fresh("failed_windows", none),
        fresh("started_at", now), fresh("pages_fetched", F.lit(0).cast("long")), fresh("dropped", F.lit(0).cast("long")), resumed.alias("resumed"),
    )


def window_done(states: DataFrame, done: DataFrame) -> DataFrame:
    """States after windows (query_slug, window, ok, children): off the pending ones, on to completed or failed; children of a
    window that was too large become pending."""
    by = done.groupBy("query_slug").agg(
        F.array_sort(F.collect_set("window")).alias("_gone"), F.array_sort(F.collect_set(F.when(F.col("ok"), F.col("window")))).alias("_ok"),
        F.array_sort(F.collect_set(F.when(~F.col("ok"), F.col("window")))).alias("_bad"), F.flatten(F.collect_list(F.coalesce("children", F.array().cast("array<string>")))).alias("_more"),
    )
    s = states.join(by, "query_slug", "left")
    none = F.array().cast("array<string>")
    or_none = lambda c: F.coalesce(F.col(c), none)
    finished = F.array_union(or_none("completed_windows"), or_none("_ok"))
    pending = F.array_except(F.array_union(or_none("pending_windows"), F.array_sort(or_none("_more"))), or_none("_gone"))
    return s.withColumns({"pending_windows": pending, "completed_windows": finished, "failed_windows": F.array_except(F.array_union(or_none("failed_windows"), or_none("_bad")), finished)}).drop("_gone", "_ok", "_bad", "_more")


def flush_due(windows_since: int, seconds_since: float) -> bool:
    """Whether a sweep writes now; at its end and on an error it always does. Repositories are written before the state."""
    return windows_since >= FLUSH_WINDOWS or seconds_since >= FLUSH_SECONDS


def run_row(run_id: str, query_slug: str, started_at, outcome: str = "running", ended_at=None, counts: dict | None = None) -> dict:
    """A run's row: written as ``running`` when it starts, so that one that died can be told, and again when it ends."""
    if outcome not in OUTCOMES or (outcome == "running") != (ended_at is None):
        raise ValueError(f"a run that is {outcome} with end {ended_at}")
    return {"run_id": run_id, "query_slug": query_slug, "started_at": started_at, "ended_at": ended_at, "outcome": outcome, **(counts or {})}


def reset_plan(counts: DataFrame, query_slug: str | None = None, everything: bool = False, include_runs: bool = False) -> DataFrame:
    """What a reset would remove, by query; a reset without a target is refused."""
    if query_slug is None and not everything:
        raise ValueError("a reset needs a query, or all of them by name")
    some = counts if query_slug is None else counts.where(F.col("query_slug") == query_slug)
    return some.select("query_slug", "repos", F.lit(1).cast("long").alias("state"), "runs", F.lit(include_runs).alias("delete_runs"))


def apply_reset(store, plan: DataFrame, names: Sequence[str] = ("repos", "state", "runs")) -> None:
    """Removes a plan's repositories, then its state, then (if planned) its runs, of all queries in one write each: a half-done reset can be done again."""
    for i, name in enumerate(names):
        some = plan.where("delete_runs") if i == 2 else plan
        key = store._spec(name).key
        gone = written(store.read(name).join(some.select("query_slug"), "query_slug", "left_semi").select(key), "gone")
        if not gone.isEmpty():
            store.put(name, store.read(name).limit(0), gone)


def crawl_counters(results: DataFrame) -> DataFrame:
    """One row of counters from results (type, changed, icon_updated, requests, points): fetched, skipped, failed or limited."""
    kind, changed = F.col("type"), F.coalesce("changed", F.lit(False))
    seen = kind.isin("fetched", "skipped", "failed")
    tests = {
        "repos_seen": seen, "repos_fetched": (kind == "fetched") & changed, "repos_unchanged": (kind == "fetched") & ~changed, "repos_skipped": kind == "skipped", "repos_failed": kind == "failed",
        "icons_updated": (kind == "fetched") & changed & F.coalesce("icon_updated", F.lit(False)), "rate_limited": kind == "limited",
    }
    sums = {"requests": "requests", "points_spent": "points"}
    answered = kind.isin("fetched", "skipped")
    found = {n: F.count_if(t) for n, t in tests.items()} | {n: F.coalesce(F.sum(F.when(answered, F.col(c))), F.lit(0)).cast("long") for n, c in sums.items()}
    return results.agg(*[found[n].alias(n) for n in COUNTERS])
