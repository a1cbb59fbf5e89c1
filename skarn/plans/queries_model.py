"""Queries of the read model and of repository states as the journal keeps them up."""
from __future__ import annotations

from pyspark.sql import functions as F

from skarn.functions.text import content_hash
from skarn.operators import journal
from skarn.plans.queries_ingest import DERIVED_SQL, VOCABULARY, artifacts
from skarn.plans.tools import now, partitions_of, table
from skarn.queries import query
from skarn.sources.shared import shared_path
from skarn.sources.store import Collection, Store
from skarn.streaming import consumer
from skarn.streaming.read_model import ReadModel

DOCUMENTS = Collection("tools", "document_id string, id long, full_name string, content_hash string, kind string, license_class string, stars long, pushed_at timestamp_ntz, confidence double", "document_id")
#: Edits of the third and the second batch; the last state of a row: stars, and whether it has a push time.
LAST_STARS = "stars + CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN id % 5 = 0 THEN 10 ELSE 0 END"
LAST_UNPUSHED = "id % 30 <> 0 AND (id % 15 = 0 OR id % 6 = 0)"


def states_of(first):
    """Three states of the repositories: some starred and some spoilt, then some starred, spoilt and mended."""
    gone = F.lit(None).cast(first.schema["pushed_at"].dataType)
    key = F.col("id")
    second = first.withColumns({"stars": F.when(key % 3 == 0, F.col("stars") + 1).otherwise(F.col("stars")), "pushed_at": F.when(key % 6 == 0, gone).otherwise(F.col("pushed_at"))})
    # of the first state: a spoilt row's push time comes back without a join
    pushed = F.when(key % 30 == 0, F.col("pushed_at")).when((key % 15 == 0) | (key % 6 == 0), gone).otherwise(F.col("pushed_at"))
    third = first.withColumns({"stars": F.col("stars") + F.when(key % 3 == 0, 1).otherwise(0) + F.when(key % 5 == 0, 10).otherwise(0), "pushed_at": pushed})
    return [s.withColumn("content_hash", content_hash(F.col("full_name"), F.col("stars"), F.col("pushed_at").cast("string").alias("pushed_at"))) for s in (first, second, third)]


def kept_up(spark, d):
    """(model, journal's path, checkpoint) after three batches of edits."""
    store = Store(spark, shared_path(spark, "model"))
    store.ensure([DOCUMENTS])
    at: dict = {}
    model = ReadModel(store, "tools", lambda: at["rows"], VOCABULARY, now())
    path, checkpoint = shared_path(spark, "journal"), shared_path(spark, "position")
    positions = journal.Checkpoints(spark, shared_path(spark, "positions"))
    for state, edited in zip(states_of(artifacts(spark, d).withColumn("full_name", F.replace("full_name", F.lit("#"), F.lit("-")))), ("true", "id % 3 = 0", "id % 5 = 0"), strict=True):
        at["rows"] = state  # columns of the kept table, which needn't be written again
        fetched = at["rows"].where(edited).select(F.lit("RepoFetched").alias("type"), F.col("full_name").alias("repo"), "content_hash", F.lit(True).alias("changed"))
        journal.append_stamped(fetched.withColumns({"confidence": F.lit(None).cast("double"), "phase": F.lit(None).cast("string"), "error": F.lit(None).cast("string")}), path)
        model.follow(spark, path, checkpoint, positions)
    return model, path, checkpoint, positions


@query(DERIVED_SQL + f"SELECT id, coalesce(found, 'service') AS kind, license_class, ({LAST_STARS})::BIGINT AS stars FROM der WHERE pushed_at IS NOT NULL AND NOT ({LAST_UNPUSHED})")
def t4_incremental_read_model(spark, d):
    """Three batches of edits, each projecting its own repositories: the table is that of a full rebuild."""
    model, *_ = kept_up(spark, d)
    return model.store.read("tools").select("id", "kind", "license_class", "stars")


@query("""WITH e AS (SELECT lpad(event_id::VARCHAR, 12, '0') AS id, ts, CASE event_type WHEN 'view' THEN 'RepoFetched' WHEN 'purchase' THEN 'RepoAnalyzed' ELSE 'RepoSkipped' END AS type, 'u/' || user_id AS repo FROM events)
SELECT repo, arg_max(type, id) AS phase, max(id) AS last_id, epoch_us(max(ts) FILTER (type = 'RepoFetched')) AS fetched_at, epoch_us(max(ts) FILTER (type = 'RepoSkipped')) AS skipped_at FROM e GROUP BY repo""")
def t17_streamed_repo_state(spark, d):
    """The events as files in an order of their own, through the stateful stream: the last row of each repository is the batch fold."""
    kind = F.when(F.col("event_type") == "view", "RepoFetched").when(F.col("event_type") == "purchase", "RepoAnalyzed").otherwise("RepoSkipped")
    e = table(spark, d, "events").select(F.lpad(F.col("event_id").cast("string"), 12, "0").alias("id"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("type"), F.concat(F.lit("u/"), F.col("user_id").cast("string")).alias("repo"))
    inbox, out = shared_path(spark, "inbox"), shared_path(spark, "states")
    half = -(-partitions_of(spark, d, "events") // 2)  # two batches of files, which grow in number with the events
    e.repartition(2 * half, F.xxhash64("id")).write.parquet(inbox)
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema("id string, ts timestamp, type string, repo string").option("maxFilesPerTrigger", half).parquet(inbox)
        write = lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/batch={n}")
        consumer.repo_states(stream).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", shared_path(spark, "position")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(provider, before)
    last = spark.read.parquet(out).groupBy("repo").agg(F.max_by(F.struct("phase", "last_id", "RepoFetched_at", "RepoSkipped_at"), "batch").alias("s"))
    return last.select("repo", "s.phase", "s.last_id", F.unix_micros("s.RepoFetched_at").alias("fetched_at"), F.unix_micros("s.RepoSkipped_at").alias("skipped_at"))
