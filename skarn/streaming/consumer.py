"""Structured Streaming consumers of the journal and event-time aggregates."""
from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from skarn.operators.journal import EVENTS
from skarn.streaming.journal_source import JournalSource

#: Types of events whose latest times a repository's state has.
PHASE_EVENTS = tuple(EVENTS)


def consume(spark: SparkSession, path: str, schema: str, checkpoint: str, handle: Callable[[DataFrame, int], None], files: int = 100) -> None:
    """Hands what is new in a journal folder to ``handle`` in batches and stops when all is read.

    A batch is handled at least once; the checkpoint moves on after it. Rows with an id met twice in a
    batch come once, so handlers that overwrite by id or by (repo, content hash) are idempotent.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    run = stream.writeStream.foreachBatch(lambda batch, n: handle(batch.dropDuplicates(["id"]), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()


def follow(spark: SparkSession, path: str, schema: str, checkpoint: str, handle: Callable[[DataFrame, int], None], after: str | None = None) -> None:
    """Hands the journal's events after an id (null: all) to ``handle`` and stops when all is read; the checkpoint keeps the last id.

    A new checkpoint replays from ``after``. Offsets are ids, so a file that comes late with earlier ids is not met again.
    """
    spark.dataSource.register(JournalSource)
    stream = spark.readStream.format("journal").schema(schema).option("path", path)
    stream = (stream if after is None else stream.option("after", after)).load()
    run = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()


class RepoState(StatefulProcessor):
    """The latest event of a repository and the latest time (microseconds) of each type, kept by key; events may come in any order and more than once."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "type string, id string, " + ", ".join(f"{k}_at long" for k in PHASE_EVENTS))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        """The events of a batch are folded first, so a key's state is read once and written once, however many they are."""
        kept = self.state.get() if self.state.exists() else ("", "", *[None] * len(PHASE_EVENTS))
        last, times = tuple(kept[:2]), dict(zip(PHASE_EVENTS, kept[2:], strict=True))
        for r in rows:
            if r.id > last[1]:
                last = (r.type, r.id)
            if r.type in times and r.ts is not None and (times[r.type] is None or times[r.type] < r.ts):
                times[r.type] = r.ts
        self.state.update((*last, *times.values()))
        yield Row(repo=key[0], phase=last[0], last_id=last[1], **{f"{k}_at": t for k, t in times.items()})

    def close(self) -> None:
        pass


def repo_states(events: DataFrame) -> DataFrame:
    """The state of each repository after each batch in which it has events, from a stream of (id, ts, type, repo).

    A repository's state is one small row under its key, and a batch reads and writes the states of its own repositories only.
    """
    times = ", ".join(f"{k}_at long" for k in PHASE_EVENTS)
    some = events.select("id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), "type", "repo")
    states = some.groupBy("repo").transformWithState(RepoState(), f"repo string, phase string, last_id string, {times}", "Update", "none")
    return states.withColumns({f"{k}_at": F.timestamp_micros(f"{k}_at") for k in PHASE_EVENTS})


def windowed_counts(events: DataFrame, length: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Events and their value by time window and type; in a stream, events later than ``late`` are left out."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.window("ts", length, slide), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """A user's sessions: events not further apart than the gap."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
