from pyspark.sql import functions as F

from skarn.plans import queries_model


def table(store):
    return sorted(map(tuple, store.read("tools").collect()), key=repr)


def test_batches_end_at_a_full_rebuild_and_a_replay_changes_nothing(spark, sf, tmp_path):
    model, path, checkpoint, positions = queries_model.kept_up(spark, sf)
    kept, version = table(model.store), model.store._records("tools").last()[0]
    assert len(kept) > 50
    model.follow(spark, path, checkpoint)
    model.follow(spark, path, f"file://{tmp_path}/replay")  # all events once more
    assert table(model.store) == kept and model.store._records("tools").last()[0] == version
    model.rebuild()
    assert table(model.store) == kept
    outcomes = {(r.type, r.phase): r.n for r in spark.read.parquet(path).groupBy("type", "phase").agg(F.count("*").alias("n")).collect()}
    assert outcomes["RepoFailed", "project"] > 0 and outcomes["RepoAnalyzed", None] > len(kept)
    assert positions.position("read-model") <= spark.read.parquet(path).agg(F.max("id")).first()[0]
    # a repository that is gone loses its document with its next event
    first = kept[0]
    rows = model.artifacts().where(F.col("full_name") != first[2])
    model.artifacts = lambda: rows
    event = spark.createDataFrame([("z", "RepoFetched", first[2], True)], "id string, type string, repo string, changed boolean")
    assert model.refresh(event).count() == 0
    assert table(model.store) == kept[1:]


def test_the_third_state_needs_no_join(spark, sf):
    from skarn.plans.queries_ingest import artifacts

    third = queries_model.states_of(artifacts(spark, sf))[2]
    assert "Join" not in third._jdf.queryExecution().optimizedPlan().toString()
