"""The read model kept up from the journal: each batch of events projects its own repositories and nothing else."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.operators import classify, journal
from skarn.operators.ingest import last_by
from skarn.plans import project
from skarn.sources.shared import written
from skarn.sources.store import Store
from skarn.streaming import consumer
from skarn.vocabulary import Vocabulary

#: What analysis adds to a repository.
ANALYSIS = ("id", "kind", "domains", "summary", "k8s_relevance", "confidence", "runtime", "license_class", "openness", "maturity", "governance", "needs_review")
EVENTS = "id string, ts timestamp, type string, repo string, content_hash string, changed boolean"


class ReadModel:
    """Documents of a store's collection (key document_id, with full_name and content_hash), made from artifacts and icons.

    artifacts: gives the repositories with their files and content_hash as they are now; icons: (id, icon), or None.
    """

    def __init__(self, store: Store, name: str, artifacts: Callable[[], DataFrame], vocabulary: Vocabulary, now: Column, icons: Callable[[], DataFrame] | None = None):
        self.store, self.name, self.artifacts, self.vocabulary, self.now, self.icons = store, name, artifacts, vocabulary, now, icons

    def projected(self, repos: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(documents, rejects) of repositories: analysis, join with the icons, validation."""
        analysis = classify.analyze(repos, self.vocabulary, self.now).select(*ANALYSIS)
        return project.checked(project.documents(repos, analysis, self.icons() if self.icons else None))

    def rebuild(self) -> int:
        """Projects all repositories; what is no longer there, or no longer valid, goes."""
        good, _ = self.projected(self.artifacts())
        good = written(good, "documents")
        return self.store.put(self.name, good, self.store.read(self.name).select("document_id").join(good.select("document_id"), "document_id", "left_anti"))

    def refresh(self, events: DataFrame) -> DataFrame:
        """Projects the repositories that a batch of events has fetched and changed; returns (repo, type, content_hash, confidence, phase, error) of each.

        A repository whose document has its content hash already is left alone, so a batch that comes again changes
        nothing. One without artifacts, or with a document that isn't valid, loses its document. The write is one version of the store.
        """
        changed = journal.changed_only(events, "RepoFetched").select(F.col("repo").alias("full_name")).distinct()
        stored = self.store.read(self.name).select("full_name", "document_id", F.col("content_hash").alias("stored_hash"))
        known = written(stored.join(changed, "full_name", "left_semi"), "known")
        artifacts = self.artifacts()
        todo = artifacts.join(changed, "full_name", "left_semi").join(known.select("full_name", "stored_hash"), "full_name", "left").where(~F.col("content_hash").eqNullSafe(F.col("stored_hash"))).drop("stored_hash")
        good, bad = self.projected(todo)
        # only what the store and the outcome need is written, so the texts meet the joins before the analysis at most
        good = written(good.select(*dict.fromkeys(c for c in (*self.store.read(self.name).columns, "full_name", "content_hash", "confidence") if c in good.columns)), "good")
        bad = written(bad.select("full_name", "content_hash", F.array_join("violations", ",").alias("error")), "bad")
        gone = known.join(artifacts.select("full_name"), "full_name", "left_anti").select("full_name", "document_id")
        gone = gone.unionByName(known.join(bad.select("full_name"), "full_name", "left_semi").select("full_name", "document_id"))
        if not (good.isEmpty() and gone.isEmpty()):
            self.store.put(self.name, good, gone.select("document_id"))
        none = lambda kind: F.lit(None).cast(kind)
        done = good.select(F.col("full_name").alias("repo"), F.lit("RepoAnalyzed").alias("type"), "content_hash", F.col("confidence").cast("double").alias("confidence"), none("string").alias("phase"), none("string").alias("error"))
        failed = bad.select(F.col("full_name").alias("repo"), F.lit("RepoFailed").alias("type"), "content_hash", none("double").alias("confidence"), F.lit("project").alias("phase"), "error")
        return done.unionByName(failed)

    def follow(self, spark: SparkSession, path: str, checkpoint: str, positions: journal.Checkpoints | None = None, consumer_name: str = "read-model") -> None:
        """Consumes what is new in a journal: documents first, then the outcome as events, then the position. A batch that dies in between is done again."""
        def handle(batch: DataFrame, n: int) -> None:
            events = last_by(batch.where("type = 'RepoFetched' AND changed"), ["repo"], ["id"])
            outcome = written(self.refresh(events), "outcome")
            if not outcome.isEmpty():
                journal.append_stamped(outcome, path)
            last = batch.agg(F.max("id")).first()[0]
            if positions is not None and last is not None:
                positions.advance(consumer_name, last)

        consumer.follow(spark, path, EVENTS, checkpoint, handle)
