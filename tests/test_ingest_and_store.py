import datetime as dt

import pytest
from pyspark.sql import functions as F

from skarn.operators import discovery, ingest, journal
from skarn.sources import files
from skarn.sources.blobs import Blobs
from skarn.sources.store import Alias, Collection, Store, guard_seed, open_store, plan_create
from skarn.sources.versions import Taken, Versions
from skarn.streaming import consumer


def days(window):
    first, _, last = window.partition("..")
    a, b = dt.date.fromisoformat(first), dt.date.fromisoformat(last or first)
    return {a + dt.timedelta(n) for n in range((b - a).days + 1)}


@pytest.mark.parametrize("window", ["2008-01-01..2013-12-31", "2024-01-01..2024-12-31", "2023-04-01..2023-06-30", "2024-02-01..2024-02-29", "2023-02-01..2023-02-28"])
def test_children_tile_their_window(window):
    parts = [days(c) for c in ingest.children(window)]
    assert set().union(*parts) == days(window) and sum(map(len, parts)) == len(days(window))
    assert ingest.children("2024-02-29") == []


def test_bands_cover_all_stars(spark):
    df = spark.range(0, 6000).select(F.col("id"), ingest.star_band(F.col("id")).alias("band"))
    assert df.where("band IS NULL").count() == 0 and df.select("band").distinct().count() == 13


def test_window_plan_counts_each_row_once(spark):
    start = dt.date(2008, 1, 1)
    rows = [("b", start + dt.timedelta(days=n % 3000)) for n in range(9000)] + [("b", dt.date(2015, 5, 5))] * 70 + [("c", start)] * 3
    df = spark.createDataFrame(rows, "band string, d date")
    plan = ingest.window_plan(df, F.col("band"), F.col("d"), 2013, limit=50).collect()
    assert sum(r.hits for r in plan) == len(rows) and all(r.fits or r.created == "2015-05-05" for r in plan)
    assert [(r.created, r.hits) for r in plan if r.band == "c"] == [("", 3)]


def test_skip_fresh_and_expired(spark):
    now = F.to_timestamp(F.lit("2026-03-01"))
    reason = lambda *a: spark.range(1).select(ingest.skip_reason(*[F.lit(x) for x in a[:3]], F.lit(a[3]).cast("timestamp"), F.to_date(F.lit("2026-03-01"))).alias("x")).first().x
    assert reason(True, False, 200, "2026-01-01") == "fork" and reason(True, False, 201, "2026-01-01") is None
    assert reason(False, True, 1000, "2024-02-28") == "archived-stale" and reason(False, True, 1000, None) == "archived-stale" and reason(False, True, 1001, None) is None
    test = lambda f, *a: spark.range(1).select(f(*a).alias("x")).first().x
    assert test(ingest.is_fresh, F.lit("2026-02-28 23:59:00"), F.lit(60), now) is False and test(ingest.is_fresh, F.lit("2026-02-28 23:59:01"), F.lit(60), now) is True
    assert test(ingest.is_expired, F.lit("2026-04-01"), now) and test(ingest.is_expired, F.lit(None), now) and not test(ingest.is_expired, F.lit("2026-02-20"), now)


def test_outcomes_and_first_sightings(spark):
    inc = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, h string")
    old = spark.createDataFrame([(2, "x"), (3, None)], "id long, h string")
    assert {r.id: r.outcome for r in ingest.outcomes(inc, old, "id", "h").collect()} == {1: "new", 2: "changed", 3: "unchanged"}
    assert tuple(ingest.counters(ingest.outcomes(inc, old, "id", "h")).first()) == (1, 1, 1)
    seen = spark.createDataFrame([(1, 5, "late"), (1, 2, "early"), (2, 1, None)], "k long, seq long, v string")
    assert {(r.k, r.v) for r in ingest.first_by(seen, ["k"], ["seq"]).collect()} == {(1, "early"), (2, None)}
    assert {(r.k, r.v) for r in ingest.last_by(seen, ["k"], ["seq"]).collect()} == {(1, "late"), (2, None)}


def test_worklist_dedupes_and_shards(spark):
    repos = spark.createDataFrame([("a/b", 9), ("A/B", 8), ("bad name", 7), ("c/d", 6), ("e/f", 5)], "full_name string, stars long")
    assert [r.full_name for r in ingest.worklist(repos, 10).collect()] == ["a/b", "c/d", "e/f"]
    parts = [r.full_name for i in range(3) for r in ingest.worklist(repos, 10, 3, i).collect()]
    assert {p.lower() for p in parts} == {"a/b", "c/d", "e/f"}


EVENTS = [(f"{i:026d}", dt.datetime(2024, 1, 1 + i // 4, i % 4), "RepoFetched" if i % 2 else "RepoFailed", f"r{i % 3}", i % 4 == 1) for i in range(12)]
EVENT_SCHEMA = "id string, ts timestamp, type string, repo string, changed boolean"


def test_journal_reads_after_a_checkpoint(spark, tmp_path):
    path = f"{tmp_path}/journal"
    journal.append(spark.createDataFrame(EVENTS, EVENT_SCHEMA), path)
    e = spark.read.parquet(path)
    assert [r.id for r in journal.read_after(e).collect()] == [x[0] for x in EVENTS]
    assert [r.id for r in journal.read_after(e, EVENTS[4][0], 3).collect()] == [x[0] for x in EVENTS[5:8]]
    with pytest.raises(ValueError):
        journal.read_after(e, limit=0)
    assert journal.days(e).count() == 3 and journal.changed_only(e, "RepoFetched").count() == 3
    c = journal.Checkpoints(spark, f"{tmp_path}/checkpoints")
    assert c.position("analyzer") is None
    c.advance("analyzer", "05")
    c.advance("analyzer", "09")
    c.advance("projector", "01")
    assert (c.position("analyzer"), c.position("projector")) == ("09", "01")
    c.reset("analyzer")
    assert c.position("analyzer") is None
    state = {r.repo: r for r in journal.repo_state(e, {"failed_at": F.col("type") == "RepoFailed"}).collect()}
    assert state["r2"].last_id == EVENTS[11][0] and state["r2"].phase == "RepoFetched" and state["r2"].failed_at == EVENTS[8][1]


def test_stream_sees_what_the_batch_sees(spark, tmp_path):
    path, seen = f"{tmp_path}/journal", []
    journal.append(spark.createDataFrame(EVENTS[:7], EVENT_SCHEMA), path)
    take = lambda: consumer.consume(spark, path, EVENT_SCHEMA + ", day string", f"{tmp_path}/at", lambda batch, n: seen.extend(r.id for r in batch.collect()))
    take()
    assert sorted(seen) == [x[0] for x in EVENTS[:7]]
    journal.append(spark.createDataFrame(EVENTS[7:], EVENT_SCHEMA), path)
    take()
    take()
    assert sorted(seen) == [x[0] for x in EVENTS]


WIDGETS = Collection("widgets", "id string, `group` string, rank int, name string", "id", ("group",), ("rank", "name"))
NOTES = Collection("notes", "note_id string, `group` string", "note_id", ("group",))


def test_store_contract(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    s.ensure([WIDGETS, NOTES])
    s.ensure([WIDGETS])
    rows = lambda *r: spark.createDataFrame(list(r), WIDGETS.schema)
    assert s.get("widgets", "w1") is None and s.count("widgets") == 0
    s.put("widgets", rows(("w1", "a", 2, "x"), ("w2", "b", None, "y"), ("w3", "a", 1, "z")))
    s.put("widgets", rows(("w1", "a", 5, "x2")))
    assert s.get("widgets", "w1")["rank"] == 5 and s.count("widgets") == 3 and s.count("widgets", {"group": "a"}) == 2 and s.count("notes") == 0
    assert [r.id for r in s.list("widgets", sort=["rank:asc"]).collect()] == ["w3", "w1", "w2"] and [r.id for r in s.list("widgets", sort=["rank:desc"], limit=2).collect()] == ["w1", "w3"]
    assert s.list("widgets", fields=["name", "nope"]).columns == ["name"]
    with pytest.raises(ValueError):
        s.put("widgets", rows(("ok", "a", 1, "n"), ("not ok", "a", 1, "n")))
    s.put("widgets", rows())
    assert s.count("widgets") == 3
    for bad in (lambda: s.remove("widgets", {}), lambda: s.count("widgets", {"rank": 1}), lambda: s.list("widgets", sort=["group"])):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(KeyError):
        s.count("nothing")
    assert s.remove("widgets", {"group": "zzz"}) == 0 and s.remove("widgets", {"group": "a"}) == 2 and s.count("widgets") == 1
    many = spark.range(2500).select(F.concat(F.lit("m"), "id").alias("id"), F.lit("g").alias("group"), F.col("id").cast("int").alias("rank"), F.lit("n").alias("name"))
    s.put("widgets", many)
    assert s.count("widgets", {"group": "g"}) == 2500 and s.list("widgets").select("id").distinct().count() == 2501


def test_store_rewrites_touched_parts_only_and_refuses_a_lost_race(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    s.ensure([WIDGETS])
    rows = spark.range(300).select(F.concat(F.lit("m"), "id").alias("id"), F.lit("g").alias("group"), F.col("id").cast("int").alias("rank"), F.lit("n").alias("name"))
    s.put("widgets", rows)
    s.put("widgets", rows.where("rank = 7").withColumn("rank", F.lit(70)))
    parts, records = s._parts("widgets"), Versions(spark, f"file://{tmp_path}/store/widgets/versions")
    assert sorted(list(parts.values()).count(v) for v in set(parts.values())) == [1, len(parts) - 1] and s.get("widgets", "m7")["rank"] == 70 and s.count("widgets") == 300
    with pytest.raises(Taken):
        records.commit(2, {})
    (tmp_path / "store" / "widgets" / "versions" / "n0000000004.json").write_text('{"parts": {')  # a writer of another system died
    assert s._parts("widgets") == parts and s.count("widgets") == 300
    for rank in (71, 72):  # and the collection can still be written
        assert s.put("widgets", rows.where("rank = 8").withColumn("rank", F.lit(rank))) == rank - 66
        assert s.get("widgets", "m8")["rank"] == rank and s.count("widgets") == 300


def widget_rows(spark, *r):
    return spark.createDataFrame(list(r), WIDGETS.schema)


@pytest.mark.parametrize("other", ["w1", "w2"])
def test_two_writers_that_meet_keep_both_writes(spark, tmp_path, monkeypatch, other):
    """B commits between A's reading and A's commit, in the same part or in another."""
    a, b = (Store(spark, f"file://{tmp_path}/store") for _ in range(2))
    for s in (a, b):
        s.ensure([WIDGETS])
    a.put("widgets", widget_rows(spark, ("w1", "g", 1, "old"), ("w2", "g", 1, "old")))
    plain, late, made = Versions.commit, [], []

    def commit(self, number, record):
        if not late:
            late.append(number)
            b.put("widgets", widget_rows(spark, (other, "g", 222, "b"), ("w9", "g", 9, "b")))
        return plain(self, number, record)

    monkeypatch.setattr(Versions, "commit", commit)
    load = Store._load
    monkeypatch.setattr(Store, "_load", lambda self, *x: made.append(self) or load(self, *x))
    version = a.put("widgets", widget_rows(spark, ("w1", "g", 111, "a")))
    assert made.count(a) == (2 if other == "w1" else 1), "merged again only if the other writer touched the same part"
    monkeypatch.undo()
    assert {r.id: r["rank"] for r in b.read("widgets").collect()} == {"w1": 111, "w2": 222 if other == "w2" else 1, "w9": 9}
    a.barrier("widgets", version)
    with pytest.raises(TimeoutError):
        a.barrier("widgets", version + 1, 0.1)


def test_vacuum_removes_what_no_record_names(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    s.ensure([WIDGETS])
    for k in range(3):
        s.put("widgets", widget_rows(spark, ("w1", "g", k, "x")))
    (tmp_path / "store" / "widgets" / "v-dead").mkdir()
    (tmp_path / "store" / "widgets" / "staged-dead").mkdir()
    assert s.vacuum("widgets") == [], "what is young may be in use"
    assert len(s.vacuum("widgets", older_than=0)) == 4 and s.get("widgets", "w1")["rank"] == 2
    there = sorted(p.name for p in (tmp_path / "store" / "widgets").iterdir())
    assert len(there) == 2 and there[1] == "versions"
    assert s.put("widgets", widget_rows(spark, ("w1", "g", 7, "x"))) == 5 and s.get("widgets", "w1")["rank"] == 7


def test_declarations_may_grow_and_settings_change(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    assert [p["create"] for p in s.ensure([WIDGETS])] == [True]
    s.put("widgets", widget_rows(spark, ("w1", "a", 1, "x")))
    assert s.plan([WIDGETS]) == [{"name": "widgets", "create": False, "add_columns": [], "settings": {}}]
    wider = Collection("widgets", f"{WIDGETS.schema}, stars long", "id", ("group", "stars"), ("rank", "name"))
    again = Store(spark, f"file://{tmp_path}/store")
    assert again.ensure([wider]) == [{"name": "widgets", "create": False, "add_columns": ["stars"], "settings": {"filterable": {"from": ["group"], "to": ["group", "stars"]}}}]
    again.put("widgets", spark.createDataFrame([("w2", "a", 1, "y", 5)], wider.schema))
    assert {(r.id, r.stars) for r in again.read("widgets").collect()} == {("w1", None), ("w2", 5)} and again.count("widgets", {"stars": 5}) == 1
    for bad in (Collection("widgets", WIDGETS.schema.replace("rank int", "rank string"), "id"), Collection("widgets", WIDGETS.schema, "name"), Collection("widgets", "id string", "id")):
        with pytest.raises(ValueError):
            again.ensure([bad])


def test_a_batch_is_evaluated_once(spark, tmp_path):
    """Rows that come out otherwise each time (rand) are written as they came out the one time."""
    s = Store(spark, f"file://{tmp_path}/store")
    s.ensure([WIDGETS])
    s.put("widgets", spark.range(200).select(F.concat(F.lit("m"), "id").alias("id"), F.lit("g").alias("group"), F.lit(1).alias("rank"), F.lit("n").alias("name")))
    s.put("widgets", spark.range(5).select(F.concat(F.lit("m"), (F.rand() * 200).cast("int").cast("string")).alias("id"), F.lit("g").alias("group"), F.lit(2).alias("rank"), F.lit("n").alias("name")))
    assert s.count("widgets") == 200 and 1 <= s.read("widgets").where("rank = 2").count() <= 5
    for target in ("/data/x", "file:///data/x", "http://localhost:7700", "http://[::1]:7700/"):
        guard_seed(target)
    guard_seed("https://search.example.com", force=True)
    for target in ("https://search.example.com", "hdfs://cluster/x"):
        with pytest.raises(ValueError):
            guard_seed(target)


def test_alias_outlives_the_session_and_rolls_back(spark, tmp_path):
    for name, n in (("a", 5), ("b", 7)):
        spark.range(n).write.parquet(f"{tmp_path}/{name}")
    with pytest.raises(KeyError):
        Alias(spark, f"file://{tmp_path}/alias").read()
    Alias(spark, f"file://{tmp_path}/alias").promote(f"{tmp_path}/a", 5)
    with pytest.raises(ValueError):
        Alias(spark, f"file://{tmp_path}/alias").promote(f"{tmp_path}/b", 8)
    with pytest.raises(ValueError):
        Alias(spark, f"file://{tmp_path}/alias").roll_back()
    Alias(spark, f"file://{tmp_path}/alias").promote(f"{tmp_path}/b", 7)
    again = Alias(spark, f"file://{tmp_path}/alias")
    assert again.read().count() == 7 and again.previous() == f"{tmp_path}/a"
    again.roll_back()
    assert again.read().count() == 5 and again.previous() == f"{tmp_path}/b"
    assert [plan_create(*x)["apply_settings"] for x in ((False, 0), (True, 0), (True, 3), (True, 3, True))] == [True, True, False, True]


def test_blobs(spark, tmp_path):
    b = Blobs(spark, f"file://{tmp_path}/blobs")
    assert b.get("a/x.json") is None and b.list() == [] and not b.has("a/x.json")
    b.put_json("repos/a/x.json", {"k": [1, None]})
    b.put("repos/b/y.bin", b"\x00\xff")
    b.put("repos/b/y.bin", b"new")
    (tmp_path / "blobs" / "repos" / "b" / ".tmp-1").write_text("half")
    assert b.get_json("repos/a/x.json") == {"k": [1, None]} and b.get("repos/b/y.bin") == b"new"
    assert b.list() == ["repos/a/x.json", "repos/b/y.bin"] and b.list("repos/b/") == ["repos/b/y.bin"]
    assert {r.key: bytes(r.content) for r in b.scan("*.bin").collect()} == {"repos/b/y.bin": b"new"}
    assert b.delete("repos/b/y.bin") and not b.delete("repos/b/y.bin") and b.list("repos/b") == []
    for bad in ("", "/a", "a//b", "../a", "a/./b"):
        with pytest.raises(ValueError):
            b.put(bad, b"")


def test_stamped_events(spark, tmp_path):
    path = f"{tmp_path}/j"
    good = spark.createDataFrame([("RepoFetched", "a/b", "h", True, None, None), ("RepoFailed", "c/d", None, None, "crawl", "e")], "type string, repo string, content_hash string, changed boolean, phase string, error string")
    first = journal.append_stamped(good, path, 1000)
    second = journal.append_stamped(good, path, 900)  # a clock that went back
    assert second > first and spark.read.parquet(path).select("id").distinct().count() == 4
    e = spark.read.parquet(path)
    assert {r.id for r in journal.read_after(e, first).collect()} == {r.id for r in e.collect() if r.id > first} and e.where(F.col("id") > first).count() == 2
    for bad in (("Nope", "a/b", "h", True, None, None), ("RepoFetched", "ab", "h", True, None, None), ("RepoFetched", "a/b", None, True, None, None), ("RepoFailed", "a/b", None, None, "sleep", "e"), (None, None, None, None, None, None)):
        with pytest.raises(ValueError):
            journal.append_stamped(good.unionByName(spark.createDataFrame([bad], good.schema)), path, 2000)
    assert spark.read.parquet(path).count() == 4


def test_runs_and_resets(spark, tmp_path):
    with pytest.raises(ValueError):
        discovery.run_row("r", "q", 1, "complete")
    with pytest.raises(ValueError):
        discovery.run_row("r", "q", 1, "running", 2)
    assert discovery.run_row("r", "q", 1, "failed", 2, {"pages": 3}) == {"run_id": "r", "query_slug": "q", "started_at": 1, "ended_at": 2, "outcome": "failed", "pages": 3}
    assert discovery.flush_due(25, 0) and discovery.flush_due(0, 30) and not discovery.flush_due(24, 29.9)
    s = Store(spark, f"file://{tmp_path}/store")
    own = lambda name: Collection(name, "id string, query_slug string", "id", ("query_slug",))
    s.ensure([own("repos"), own("state"), own("runs")])
    for name in ("repos", "state", "runs"):
        s.put(name, spark.createDataFrame([(f"{q}{i}", q) for q in "pq" for i in range(3)], "id string, query_slug string"))
    counts = spark.createDataFrame([("p", 3, 3), ("q", 3, 3)], "query_slug string, repos long, runs long")
    with pytest.raises(ValueError):
        discovery.reset_plan(counts)
    discovery.apply_reset(s, discovery.reset_plan(counts, "p"))
    assert [s.count(n, {"query_slug": "p"}) for n in ("repos", "state", "runs")] == [0, 0, 3] and s.count("repos") == 3
    discovery.apply_reset(s, discovery.reset_plan(counts, everything=True, include_runs=True))
    assert [s.count(n) for n in ("repos", "state", "runs")] == [0, 0, 0]


def test_batches_hold_no_more_than_asked(spark):
    got = ingest.batches(spark.range(1000, numPartitions=3), 70).groupBy("batch").count().collect()
    assert sum(r["count"] for r in got) == 1000 and max(r["count"] for r in got) == 70 and len(got) == 15


def test_bad_json_is_counted_not_fatal(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"repo": "a/b", "stars": 3}\nnot json\n{"repo": "c/d", "stars": 4}\n')
    good, bad = files.read_json(spark, str(tmp_path), "repo string, stars long")
    assert good.count() == 2 and [r[0] for r in bad.collect()] == ["not json"] and bad.count() == 1
    valid, rejects = files.split_valid(good, {"stars": F.col("stars") > 3, "repo": F.col("repo").isNotNull()})
    assert valid.count() == 1 and rejects.first().violations == ["stars"]


def test_json_arrays_and_broken_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"repo": "a/b", "stars": 3},\n {"repo": "c/d"}]')
    (tmp_path / "b.json").write_text('{"repo": "e/f", "stars": 5}')
    (tmp_path / "c.json").write_text('[{"repo": ')
    (tmp_path / "d.json").write_text(" ")
    good, bad = files.read_json(spark, str(tmp_path), "repo string, stars long", lines=False)
    assert sorted((r.repo, r.stars) for r in good.collect()) == [("a/b", 3), ("c/d", None), ("e/f", 5)] and bad.count() == 1


def test_a_corpus_is_loaded_whole_or_not(spark, tmp_path):
    from skarn.plans import project

    schema = "id long, stars long, pushed_at string, kind string, domains array<string>, runtime string, license_class string, maturity string, k8s_relevance double, confidence double"
    good = [(i, 3, "2024-01-01", "cli", ["security"], "unknown", "permissive", "young", 0.5, 0.5) for i in range(4)]
    project.emit_corpus(spark.createDataFrame(good, schema), f"{tmp_path}/a", "made")
    assert project.load_corpus(spark, f"{tmp_path}/a", schema, "made").count() == 4
    with pytest.raises(ValueError, match="not marked"):
        project.load_corpus(spark, f"{tmp_path}/a", schema, "other")
    project.emit_corpus(spark.createDataFrame([*good, (9, 3, "2024-01-01", "widget", ["security"], "unknown", "permissive", "young", 0.5, 0.5)], schema), f"{tmp_path}/b", "made")
    with pytest.raises(ValueError, match="invalid"):
        project.load_corpus(spark, f"{tmp_path}/b", schema, "made")
    (tmp_path / "c.json").write_text('{"id": 1}\nbroken')
    with pytest.raises(ValueError, match="unreadable"):
        project.load_corpus(spark, f"{tmp_path}/c.json", schema, "made")
    for bad in (("files", None), ("other", "x")):
        with pytest.raises(ValueError):
            open_store(spark, *bad)
