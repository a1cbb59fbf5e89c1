import json
import math
import random

import pytest
from pyspark.sql import functions as F

from skarn.functions import scoring
from skarn.operators import bitmaps, search
from skarn.sources.pages import SearchPages
from skarn.sources.store import Collection, Store

GOOD = {"full_name": "a/b", "stargazers_count": 3, "topics": ["k8s"]}


def test_pages_are_read_item_by_item(spark, tmp_path):
    def write(name, raw):
        (tmp_path / f"{name}.json").write_text(raw if isinstance(raw, str) else json.dumps(raw))

    write("mixed", {"total_count": 9, "items": [GOOD, {"full_name": "nobody", "stargazers_count": -1}, GOOD | {"topics": [1]}, None]})
    write("none", {"total_count": 0, "items": []})
    spark.dataSource.register(SearchPages)
    read = lambda **o: {(r.page, r.place): r for r in spark.read.format("search_pages").option("path", str(tmp_path)).options(**o).load().collect()}
    got = read()
    assert {k: r.error for k, r in got.items()} == {("mixed", 0): None, ("mixed", 1): "full_name,stargazers_count", ("mixed", 2): "topics", ("mixed", 3): "item"}
    assert got["mixed", 0].stars == 3 and got["mixed", 0].topics == ["k8s"] and got["mixed", 1].total == 9
    for name, raw in (("bad", {"items": [{}, {}]}), ("broken", '{"items": [')):
        write(name, raw)
        with pytest.raises(Exception, match=f"page {name}"):
            read()
        rows = read(abort="false")
        assert rows[name, None].error.startswith("all 2" if name == "bad" else "unreadable") and len(rows) == 5
        (tmp_path / f"{name}.json").unlink()


def test_bitmap_facets_equal_the_scan(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i * 3, rng.choice("xyz"), rng.sample("abcde", rng.randint(0, 4)) + ["a"], rng.choice([None, True, False])) for i in range(500)] + [(9_000_000, None, None, None)]
    df = spark.createDataFrame(rows, "id long, kind string, domains array<string>, archived boolean")
    names = ["kind", "domains", "archived"]
    index = bitmaps.build(df, f"file://{tmp_path}/b", names)
    rows_of = lambda d: sorted(map(tuple, d.select("attribute", "value", "docs").collect()))
    assert rows_of(index.facets(names)) == rows_of(search.facets(df, names))
    where = F.col("kind").isin("x", "y") & F.exists("domains", lambda v: v.isin("b", "c"))
    own = index.both(index.of_values("kind", ["x", "y"]), index.of_values("domains", ["b", "c"]), index.of_ids(df.where("id % 2 = 0").select("id")))
    want = df.where(where & (F.col("id") % 2 == 0))
    assert rows_of(index.facets(names, own)) == rows_of(search.facets(want, names)) and index.count(own).first()[0] == want.count()
    ids = index.of_ids(index.numbers.where("id % 2 = 0"))
    plan = index.facets(names, index.both(index.of_values("kind", ["x", "y"]), ids))._jdf.queryExecution().optimizedPlan().toString()
    assert "kind#" not in plan and "domains#" not in plan, "no column of the documents is read"
    assert rows_of(index.facets(names, index.of_values("kind", ["none"]))) == []
    assert rows_of(index.facets(["domains"], None, 2)) == rows_of(search.facets(df, ["domains"], 2))


def test_numbers_need_no_order_of_the_documents(spark, tmp_path):
    df = spark.createDataFrame([(f"k{i}", "xy"[i % 2]) for i in range(100)], "id string, kind string").repartition(3)
    index = bitmaps.build(df, f"file://{tmp_path}/b", ["kind"])
    kept = spark.read.parquet(f"file://{tmp_path}/b/numbers")
    assert "a0" in kept.columns, "values are kept with the numbers, so the documents are read once"
    assert kept.select("number").distinct().count() == 100 and len({r.number >> 33 for r in kept.collect()}) == 3, "each task has numbers of its own"
    rows = {(r.value, r.docs) for r in index.facets(["kind"], index.of_ids(df.where("id < 'k5'").select("id"))).collect()}
    assert rows == {(r.kind, r["count"]) for r in df.where("id < 'k5'").groupBy("kind").count().collect()}


def test_kept_moments_equal_a_full_pass_after_random_writes(spark, tmp_path):
    rng = random.Random(2)
    s = Store(spark, f"file://{tmp_path}/s")
    s.ensure([Collection("c", "id string, v double, g string", "id", ("g",), (), ("v",))])
    assert s.statistics("c", "v") == (0, None, None)
    for _ in range(4):
        s.put("c", spark.createDataFrame([(f"k{rng.randrange(80)}", rng.choice([None, 1e9 + rng.random()]), rng.choice("ab")) for _ in range(60)], "id string, v double, g string"))
    s.remove("c", {"g": "b"})
    n, mean, deviation = s.statistics("c", "v")
    want = s.read("c").agg(F.count("v"), F.avg("v"), F.stddev_pop("v")).first()
    assert n == want[0] and math.isclose(mean, want[1], rel_tol=1e-12) and math.isclose(deviation, want[2], rel_tol=1e-4)
    assert scoring.merged_moments([(0, None, None)]) == (0, None, None)
    with pytest.raises(ValueError):
        s.statistics("c", "g")


def test_many_pages_in_few_files_and_partitions(spark, tmp_path):
    lines = [json.dumps({"page": i, "total_count": 1, "items": [GOOD] if i % 7 else [{}]}) for i in range(3000)] + ["", "{", json.dumps({"items": []})]
    (tmp_path / "p.txt").write_text("\n".join(lines))
    spark.dataSource.register(SearchPages)
    read = spark.read.format("search_pages").option("path", str(tmp_path)).option("lines", "true")
    got = read.option("abort", "false").load()
    assert got.rdd.getNumPartitions() == 1
    rows = {(r.page, r.place): r for r in got.collect()}
    assert len(rows) == 3002 and rows["8", 0].full_name == "a/b" and rows["7", None].error.startswith("all 1")
    assert {k: r.error for k, r in rows.items() if ":" in k[0]} == {("p.txt:3002", None): "unreadable: JSONDecodeError", ("p.txt:3003", None): "unreadable: KeyError"}
    with pytest.raises(Exception, match="page 0"):
        read.option("abort", "true").load().collect()


def test_small_pages_share_a_partition(spark, tmp_path):
    for i in range(40):
        (tmp_path / f"{i}.json").write_text(json.dumps({"items": [GOOD]}))
    spark.dataSource.register(SearchPages)
    got = spark.read.format("search_pages").option("path", str(tmp_path)).load()
    assert got.rdd.getNumPartitions() == 1 and got.count() == 40
