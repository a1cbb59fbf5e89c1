import random
import re

import pytest
from pyspark.sql import functions as F

from skarn.operators import postings, search

SCHEMA = "id long, name string, full_name string, summary string, github_topics array<string>, readme_excerpt string"


def corpus(seed=1, n=120):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abé1", k=rng.randint(1, 9)))
    text = lambda k: rng.choice([" ", "  ", "-", "\n", "/", ", "]).join(rng.choice([word(), word().upper()]) for _ in range(k))
    rows = [(i, text(2), f"{word()}/{word()}", rng.choice([None, text(6)]), rng.choice([None, [], [word(), word()]]), text(rng.choice([0, 30]))) for i in range(n)]
    return rows + [(n, None, None, None, None, None), (n + 1, "", "", "", [], " \n ")]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    df = spark.createDataFrame(corpus(), SCHEMA)
    return df, postings.build(df, f"file://{tmp_path_factory.mktemp('index')}/i", buckets=16)


QUERIES = ["a", "ab", "AB é", "aba", "b1 /", "abab", "1é1 a", "zzz", "a zzz", "", None, "é-", "aa bb"]


@pytest.mark.parametrize("q", QUERIES)
def test_matches_and_ranks_equal_the_scan(made, q):
    df, index = made
    want = df.where(search.matches(df, q)).select("id", search.field_rank(df, q).alias("rank"))
    assert sorted(map(tuple, index.matches(q).collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("q", ["a", "ab", "abab", "1ééb", "abababab", "1a1a1a1aa", "zzzz"])
def test_typos_equal_the_scan(made, q):
    df, index = made
    want = df.where(search.typo_match(df, F.col("readme_excerpt"), q)).select("id")
    assert sorted(map(tuple, index.typos(q, search.SEARCHABLE.index("readme_excerpt")).collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("q", ["a", "a b", "ab é a", "1 1", "zzz a"])
def test_closeness_equals_the_scan(made, q):
    df, index = made
    want = df.select("id", search.closeness(df, "summary", q).alias("c")).select("id", "c.*").where("prefix")
    assert sorted(map(tuple, index.closeness(q, search.SEARCHABLE.index("summary")).collect())) == sorted(map(tuple, want.collect()))


def test_only_the_terms_folders_are_read(spark, made):
    _, index = made
    terms = spark.createDataFrame([("abab",)], "term string")
    found = index.of(terms, postings.WORD)
    plan = found._jdf.queryExecution().toString()
    bucket = postings.bucket_of("abab", 16)
    assert re.search(rf"PartitionFilters: \[[^\]]*\(bucket#\d+ = {bucket}\)", plan)
    read = index.postings.where(F.col("bucket").isin([bucket])).select(F.input_file_name().alias("f")).distinct().count()
    every = index.postings.select(F.input_file_name().alias("f")).distinct().count()
    assert 0 < read <= postings.SPREAD and 8 * read <= every


def test_an_index_of_nothing(spark, tmp_path):
    index = postings.build(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/i")
    assert index.matches("a").count() == 0 and index.matches("").count() == 0 and index.typos("abcd", 0).count() == 0


def test_postings_are_packed_by_the_task(spark, tmp_path):
    df = spark.createDataFrame([(i, f"the the-x {i}") for i in range(600)], "id long, name string").repartition(3)
    index = postings.build(df, f"file://{tmp_path}/p", buckets=4)
    rows = index.postings.where("term IN ('the', 'the-x')").collect()
    assert {r.term for r in rows} == {"the", "the-x"} and len(rows) <= 6, "a row for a term and task, not for each document"
    assert sorted(i for r in rows if r.term == "the" for i in r.ids) == list(range(600))
    places = index.of(spark.createDataFrame([("the",), ("5",)], "term string"), postings.WORD).collect()
    assert {(r.term, tuple(r.places)) for r in places} == {("the", (1, 2)), ("5", (4,))} and len(places) == 601
    assert sorted(r.id for r in index.matches("e-x 59").collect()) == [i for i in range(600) if "59" in str(i)]


def test_matches_and_typos_read_no_places(made):
    _, index = made
    for found in (index.matches("ab b1"), index.typos("abab", 0)):
        plan = found._jdf.queryExecution().toString()
        assert "ids" in plan and "places" not in plan.split("Physical Plan")[1] and "ends" not in plan.split("Physical Plan")[1]


def test_terms_are_not_compared_to_write_the_postings(spark, tmp_path, monkeypatch):
    sorts = []
    df = spark.createDataFrame([(1, "b a a"), (2, "a-c b")], "id long, name string")
    monkeypatch.setattr(type(df), "sortWithinPartitions", lambda self, *c: sorts.append(c) or self)
    index = postings.build(df, f"file://{tmp_path}/i", buckets=4)
    assert not sorts and sorted(r.id for r in index.matches("a").collect()) == [1, 2] and [r.id for r in index.matches("a-c").collect()] == [2]
