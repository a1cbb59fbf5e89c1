"""One sweep, end to end: windows are asked for in rounds, what is found is kept, and a sweep that dies goes on where it was.

The state is a collection with a row for each query: pending, completed and failed windows (the latter with their errors) and counters. A
round takes the next windows of every query, FLUSH_WINDOWS at most each, asks for all of them in one job, keeps the repositories, and then writes the
state and the run's row. So whatever dies in between, the windows of that round are still pending and are asked for once more; repositories are upserted, so this changes
nothing.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skarn.sources.shared import written
from skarn.sources.store import Collection, Store

from .discovery import FLUSH_WINDOWS, run_row
from .ingest import split_windows

#: Fixed value: hits of a window that a source hands out at most.
MOST_HITS = 1000
STATE = Collection("state", "query_slug string, pending_windows array<string>, completed_windows array<string>, failed_windows array<struct<window: string, error: string>>, pages_fetched long, dropped long, truncated long", "query_slug")
RUNS = Collection("runs", "run_id string, query_slug string, started_at string, ended_at string, outcome string, windows long, repos long", "run_id", ("query_slug",))


class Sweep:
    """repos: the collection of what is found (its key names a repository; with query_slug).

    source: from (query_slug, window) to (answers, items). Answers: one row for each window with hits, pages, dropped and error (null if all went
    well); items: rows of the repos collection, with the window, those of windows above MOST_HITS among them.
    """

    def __init__(self, store: Store, repos: str, source: Callable[[DataFrame], tuple[DataFrame, DataFrame]], most_hits: int = MOST_HITS):
        self.store, self.repos, self.source, self.most_hits = store, repos, source, most_hits

    def begin(self, queries: DataFrame) -> None:
        """Opens (query_slug, windows): queries with pending windows go on, others start over."""
        old = self.store.read("state").where(F.size("pending_windows") > 0).select("query_slug")
        fresh = queries.join(old, "query_slug", "left_anti")
        none = lambda c: F.expr(f"cast(array() as array<{c}>)")
        zero = F.lit(0).cast("long")
        self.store.put("state", fresh.select("query_slug", F.col("windows").alias("pending_windows"), none("string").alias("completed_windows"), none("struct<window: string, error: string>").alias("failed_windows"), zero.alias("pages_fetched"), zero.alias("dropped"), zero.alias("truncated")))

    def round(self) -> int:
        """Asks for the next windows of every query; returns how many there were. Repositories first, then the state."""
        state = self.store.read("state")
        flat = state.select("query_slug", F.posexplode("pending_windows").alias("place", "window"))
        first = F.row_number().over(Window.partitionBy("query_slug").orderBy("place"))
        asked = written(flat.withColumn("n", first).where(F.col("n") <= FLUSH_WINDOWS).select("query_slug", "window"), "asked")
        count = asked.count()
        if not count:
            return 0
        answers, items = self.source(asked)
        answers = written(answers.select("query_slug", "window", "hits", "pages", "dropped", "error"), "answers")
        self.store.put(self.repos, items.drop("window"))
        full = (F.col("hits") > self.most_hits) & F.col("error").isNull()
        parts = split_windows(answers.where(full).select("query_slug", "window")).groupBy("query_slug", "window").agg(F.sort_array(F.collect_list("child")).alias("children"))
        done = answers.join(parts, ["query_slug", "window"], "left")
        none = F.array().cast("array<string>")
        by = done.groupBy("query_slug").agg(
            F.collect_list("window").alias("gone"), F.sort_array(F.collect_list(F.when(F.col("error").isNull(), F.col("window")))).alias("ok"),
            F.sort_array(F.collect_list(F.when(F.col("error").isNotNull(), F.struct("window", "error")))).alias("bad"), F.flatten(F.collect_list(F.coalesce("children", none))).alias("more"),
            F.sum("pages").alias("pages"), F.sum("dropped").alias("lost"), F.count_if(full & F.col("children").isNull()).alias("cut"),
        )
        new = state.join(by, "query_slug").select(
            "query_slug", F.array_except(F.array_union("pending_windows", F.sort_array("more")), "gone").alias("pending_windows"), F.array_union("completed_windows", "ok").alias("completed_windows"),
            F.array_union("failed_windows", "bad").alias("failed_windows"), (F.col("pages_fetched") + F.col("pages")).alias("pages_fetched"), (F.col("dropped") + F.col("lost")).alias("dropped"), (F.col("truncated") + F.col("cut")).alias("truncated"),
        )
        self.store.put("state", new)
        return count

    def _run(self, run_id: str, started: str, slugs: list[str], outcome: str, ended: str | None, windows: int) -> None:
        rows = [run_row(f"{run_id}-{s}", s, started, outcome, ended, {"windows": windows}) for s in slugs]
        found = self.store.read(self.repos).groupBy("query_slug").agg(F.count(F.lit(1)).alias("repos"))
        made = self.store.spark.createDataFrame([tuple(r.values()) for r in rows], "run_id string, query_slug string, started_at string, ended_at string, outcome string, windows long")
        self.store.put("runs", made.join(F.broadcast(found), "query_slug", "left").fillna(0, ["repos"]))

    def run(self, run_id: str, clock: Callable[[], str], stop: Callable[[], bool] = lambda: False) -> str:
        """Rounds until no window is pending, or ``stop`` says so; returns the outcome. The run's row says ``running`` until then."""
        started, windows, outcome = clock(), 0, "failed"
        slugs = [r[0] for r in self.store.read("state").select("query_slug").collect()]  # one row for each query
        self._run(run_id, started, slugs, "running", None, 0)
        try:
            while not stop():
                asked = self.round()
                windows += asked
                if not asked:
                    outcome = "complete"
                    break
            else:
                outcome = "interrupted"
        finally:
            self._run(run_id, started, slugs, outcome, clock(), windows)
        return outcome
