"""The append-only journal: day-partitioned events, range reads, checkpoints and folds."""
from __future__ import annotations

import secrets
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.functions.text import BASE32_DIGITS, ULID_DIGITS, day_bucket, is_repo_name, ulid_millis

#: Kinds of events, with the fields that each must have.
EVENTS = {"RepoDiscovered": ("source",), "RepoFetched": ("content_hash", "changed"), "RepoAnalyzed": ("content_hash", "confidence"), "RepoSkipped": ("reason",), "RepoFailed": ("phase", "error")}
PHASES = ("crawl", "analyze", "project")


def append(events: DataFrame, path: str) -> None:
    """Appends events (id, ts, type, repo, ...) in one folder for each day."""
    events.withColumn("day", day_bucket(F.col("ts"))).write.mode("append").partitionBy("day").parquet(path)


def violations(events: DataFrame) -> Column:
    """What is wrong with an event (type, repo, and the fields of its kind), as an array of field names."""
    there = lambda c: F.col(c).isNotNull() if c in events.columns else F.lit(False)
    bad = [F.when(~F.coalesce(F.col("type").isin(*EVENTS), F.lit(False)), "type"), F.when(~F.coalesce(is_repo_name(F.col("repo")), F.lit(False)), "repo")]
    bad += [F.when((F.col("type") == kind) & ~there(c), c) for kind, fields in EVENTS.items() for c in fields]
    if "confidence" in events.columns:
        bad.append(F.when((F.col("type") == "RepoAnalyzed") & ~F.col("confidence").between(0, 1), "confidence"))
    if "phase" in events.columns:
        bad.append(F.when((F.col("type") == "RepoFailed") & ~F.col("phase").isin(*PHASES), "phase"))
    return F.array_compact(F.array(*bad))


def stamped(events: DataFrame, millis: int, after: str | None = None, writer: int | None = None) -> DataFrame:
    """Adds id and ts: ids that sort by time and then as the rows come, all greater than ``after``.

    Ten digits of time, eleven of partition and row, and five of the writer (at random, unless given), so that two writers of one
    millisecond make no equal ids. If the clock is not past the time of ``after``, the
    next millisecond is taken, so events of one instant never sort before earlier ones.
    """
    if after is not None:
        millis = max(millis, millis_of(after) + 1)
    writer = secrets.randbits(25) if writer is None else writer
    digits = lambda c, n: F.lpad(F.translate(F.conv(c, 10, 32), BASE32_DIGITS, ULID_DIGITS), n, "0")
    place = F.monotonically_increasing_id()  # the partition above 33 bits of row
    ident = F.concat(digits(F.lit(millis), 10), digits(F.shiftright(place, 33), 4), digits(place.bitwiseAND((1 << 33) - 1), 7), digits(F.lit(writer), 5))
    return events.withColumns({"id": ident, "ts": F.timestamp_millis(F.lit(millis))})


def millis_of(event_id: str) -> int:
    """The time in an event's id."""
    out = 0
    for c in event_id[:10].upper():
        out = out * 32 + ULID_DIGITS.index(c)
    return out


def _newest(spark: SparkSession, path: str) -> str | None:
    """The greatest id of a journal, from the folder of its newest day only."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    days_ = sorted(n for n in names if n.startswith("day="))
    return spark.read.parquet(f"{path}/{days_[-1]}").agg(F.max("id")).first()[0] if days_ else None


def append_stamped(events: DataFrame, path: str, millis: int | None = None, writer: int | None = None) -> str | None:
    """Validates events, stamps them and appends them; one bad event refuses all. Returns the greatest id."""
    if not events.where(F.size(violations(events)) > 0).isEmpty():
        raise ValueError("an event is not valid")
    spark = events.sparkSession
    append(stamped(events, int(time.time() * 1000) if millis is None else millis, _newest(spark, path), writer), path)
    return _newest(spark, path)


def read_after(events: DataFrame, after: str | None = None, limit: int | None = None, until: str | None = None, timed_ids: bool = False) -> DataFrame:
    """Events with a greater id, in order.

    timed_ids: ids carry their time, so days before that of ``after`` are pruned as partitions.
    """
    if limit is not None and limit <= 0:
        raise ValueError("the limit must be positive")
    out = events
    if after is not None:
        out = out.where(F.col("id") > after)
        if timed_ids and "day" in events.columns:
            first = F.date_format(F.timestamp_millis(ulid_millis(F.lit(after))), "yyyy-MM-dd")
            out = out.where(F.col("day") >= first)
    if until is not None:
        out = out.where(F.col("ts") <= F.lit(until).cast("timestamp"))
    out = out.orderBy("id")
    return out.limit(limit) if limit else out


def days(events: DataFrame) -> DataFrame:
    return events.select(day_bucket(F.col("ts")).alias("day")).distinct()


def changed_only(events: DataFrame, kind: str) -> DataFrame:
    return events.where((F.col("type") == kind) & F.col("changed"))


def repo_state(events: DataFrame, phases: dict[str, Column]) -> DataFrame:
    """The latest event of each repository, and the latest time of each phase, in one aggregate."""
    last = F.max_by("type", "id").alias("phase")
    return events.groupBy("repo").agg(last, F.max("id").alias("last_id"), *[F.max(F.when(test, F.col("ts"))).alias(name) for name, test in phases.items()])


class Checkpoints:
    """Positions of consumers: a small table, one row for each consumer, replaced as a whole."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.schema = spark, path, "consumer string, last_event_id string, version long"

    def _rows(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.schema).parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], self.schema)
            raise

    def position(self, consumer: str) -> str | None:
        row = self._rows().where(F.col("consumer") == consumer).agg(F.max_by("last_event_id", "version").alias("at")).first()
        return row["at"]

    def advance(self, consumer: str, event_id: str | None) -> None:
        version = (self._rows().where(F.col("consumer") == consumer).agg(F.max("version")).first()[0] or 0) + 1
        self.spark.createDataFrame([(consumer, event_id, version)], self.schema).coalesce(1).write.mode("append").parquet(self.path)

    def reset(self, consumer: str) -> None:
        self.advance(consumer, None)
