import datetime as dt

import pytest
from pyspark.sql import functions as F

from skarn.operators import journal
from skarn.streaming import consumer
from skarn.streaming.journal_source import JournalReader

SCHEMA = "id string, ts timestamp, type string, repo string"


def events(spark, *repos, kind="RepoSkipped"):
    return spark.createDataFrame([(kind, r, "fork") for r in repos], "type string, repo string, reason string")


def test_two_writers_of_one_instant_make_no_equal_ids(spark):
    e = events(spark, *[f"a/r{i}" for i in range(50)])
    ids = [r.id for _ in range(2) for r in journal.stamped(e, 1_700_000_000_000).select("id").collect()]
    assert len(set(ids)) == 100 and {len(i) for i in ids} == {26}
    rows = journal.stamped(e, 5, writer=3).orderBy("id").select("repo").collect()
    assert [r.repo for r in rows] == [f"a/r{i}" for i in range(50)], "in the order of the rows"


def test_the_newest_day_alone_is_read_for_an_append(spark, tmp_path):
    path, day = f"file://{tmp_path}/j", 86_400_000
    first = journal.append_stamped(events(spark, "a/b"), path, 10 * day)
    second = journal.append_stamped(events(spark, "a/b"), path, 12 * day)
    (next((tmp_path / "j" / "day=1970-01-11").glob("*.parquet"))).write_bytes(b"unreadable")
    third = journal.append_stamped(events(spark, "a/b"), path, 11 * day)
    assert first < second < third and journal.millis_of(third) == 12 * day + 1


def test_a_stream_resumes_after_any_id_and_replays(spark, tmp_path):
    path, day, got = f"file://{tmp_path}/j", 86_400_000, []
    def run(name, after=None):
        got.clear()
        consumer.follow(spark, path, SCHEMA, f"file://{tmp_path}/{name}", lambda b, n: got.extend(r.repo for r in b.select("repo").collect()), after)
        return sorted(got)

    assert run("none") == []
    last = [journal.append_stamped(events(spark, f"a/r{k}", f"b/r{k}"), path, (10 + k) * day) for k in range(3)]
    everything = sorted(f"{o}/r{k}" for k in range(3) for o in "ab")
    assert run("one") == everything and run("one") == []
    journal.append_stamped(events(spark, "c/late"), path, 5 * day)
    assert run("one") == ["c/late"]
    assert run("two", last[1]) == ["a/r2", "b/r2", "c/late"] and run("three", last[0]) == ["a/r1", "a/r2", "b/r1", "b/r2", "c/late"]
    assert run("four") == sorted([*everything, "c/late"])


def test_days_before_an_offset_are_not_listed(spark, tmp_path):
    path, day = f"file://{tmp_path}/j", 86_400_000
    last = [journal.append_stamped(events(spark, f"a/r{k}"), path, (10 + k) * day) for k in range(4)]
    r = JournalReader({"path": path}, spark.createDataFrame([], SCHEMA).schema)
    assert r.latestOffset() == {"id": last[3]}
    parts = r.partitions({"id": last[1]}, {"id": last[2]})
    assert {p.path.split("day=")[1].split("/")[0] for p in parts} == {"1970-01-12", "1970-01-13"}
    assert sum(b.num_rows for p in parts for b in r.read(p)) == 1


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 0, 1)])
def test_the_stateful_fold_ends_at_the_batch_fold(spark, tmp_path, order):
    """Files in any order, one of them twice."""
    kinds = list(journal.EVENTS)
    rows = [(f"{i:04d}", dt.datetime(2024, 1, 1) + dt.timedelta(hours=(i * 37) % 400), kinds[i * i % 5], f"a/r{i % 7}") for i in range(90)]
    df = spark.createDataFrame(rows, SCHEMA)
    for place, k in enumerate([*order, order[0]]):
        part = spark.createDataFrame(rows[k * 30 : k * 30 + 30], SCHEMA)
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{place}")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        last: dict = {}
        run = consumer.repo_states(stream).writeStream.outputMode("update").foreachBatch(lambda b, n: last.update({r.repo: r for r in b.collect()})).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    want = journal.repo_state(df, {f"{k}_at": F.col("type") == k for k in kinds}).collect()
    assert {k: tuple(v) for k, v in last.items()} == {r.repo: tuple(r) for r in want}


def test_a_state_is_read_and_written_once_for_a_batch():
    from types import SimpleNamespace

    from skarn.streaming.consumer import PHASE_EVENTS, RepoState

    calls, held = [], []
    value = SimpleNamespace(exists=lambda: bool(held), get=lambda: calls.append("get") or held[-1], update=lambda v: calls.append("update") or held.append(v))
    state = RepoState()
    state.init(SimpleNamespace(getValueState=lambda *a: value))
    event = lambda i, kind, ts: SimpleNamespace(id=f"{i:03}", type=kind, ts=ts)
    batches = [[event(i, PHASE_EVENTS[i % 2], i * 10) for i in range(500)], [event(7, PHASE_EVENTS[2], 5), event(3, PHASE_EVENTS[0], None), event(4, "other", 9_999)]]
    for batch in batches:
        (row,) = state.handleInputRows(("a/b",), iter(batch), None)
    assert calls == ["update", "get", "update"]
    assert (row.repo, row.phase, row.last_id) == ("a/b", PHASE_EVENTS[1], "499")
    assert [row[f"{k}_at"] for k in PHASE_EVENTS] == [4980, 4990, 5, None, None]
