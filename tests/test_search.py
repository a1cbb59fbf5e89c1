import random

import pytest
from pyspark.sql import functions as F

from skarn import vocabulary
from skarn.operators import filters, search

SCHEMA = """id long, owner string, name string, full_name string, summary string, readme_excerpt string, kind string, domains array<string>, archived boolean,
k8s_relevance double, stars long, language string, score_total double, momentum double, install_methods array<struct<method string, command string>>"""
ROWS = [
    (1, "a", "Helm Kit", "a/helm-kit", "packs charts", "see docs", "cli", ["packaging", "ci-cd"], False, 0.9, 50, "Go", 0.5, 1.0, [("brew", "x"), ("helm", "y")]),
    (2, "b", "Chart Lint", "b/chart-lint", "lints helm charts", None, "cli", ["packaging"], False, 0.5, 90, None, 0.9, None, [("brew", "z"), ("brew", "w")]),
    (3, "b", "Old", "b/old", "helm before", None, "cli", ["packaging", "packaging"], True, 0.9, 500, "Go", 0.4, 9.0, None),
    (4, "c", "Mesh", "c/mesh", "traffic", "helm inside", "operator", ["service-mesh", None], False, 0.4, 70, "Rust", 0.7, 3.0, []),
    (5, "c", "Far", "c/far", "other", None, "operator", None, False, 0.1, 10, "Go", 0.1, 2.0, [("krew", "k")]),
    (6, "a", "Twin", "a/twin", "packs too", None, "cli", ["ci-cd"], False, 0.8, 5, "C", 0.95, 0.5, None),
]


@pytest.fixture(scope="module")
def t(spark):
    return spark.createDataFrame(ROWS, SCHEMA).cache()


def ids(df):
    return sorted(r.id for r in df.collect())


@pytest.mark.parametrize(
    ("how", "want"),
    [
        ({}, [1, 2, 4, 6]), ({"include_archived": True}, [1, 2, 3, 4, 6]), ({"min_relevance": 0.0}, [1, 2, 4, 5, 6]), ({"selection": {"kind": ["cli"]}}, [1, 2, 6]),
        ({"selection": {"domains": ["ci-cd", "service-mesh"]}}, [1, 4, 6]), ({"selection": {"install_methods.method": ["helm"]}}, [1]),
        ({"selection": {"kind": ["operator"], "domains": ["ci-cd"]}}, []), ({"clauses": ["stars >= 70"]}, [2, 4]), ({"clauses": ['language = "Go"']}, [1]),
        ({"clauses": ["stars IN [50, 5]"]}, [1, 6]), ({"clauses": ['name = "50"']}, []), ({"selection": {"kind": []}}, [1, 2, 4, 6]),
    ],
)
def test_filters(t, how, want):
    assert ids(t.where(filters.build_filters(t, **how))) == want


def test_bad_requests_are_refused(t):
    for bad in ("stars ~ 3", "stars > x y", "nowhere = 1"):
        with pytest.raises(ValueError):
            filters.clause(t, bad)
    with pytest.raises(ValueError):
        filters.clause(t, "stars > 3", filterable=["kind"])
    with pytest.raises(ValueError):
        filters.order(["stars"], ["name"])
    with pytest.raises(ValueError):
        filters.page(t, [F.col("id")], 0)


def test_tokens_match_in_any_order_and_field(t):
    assert ids(t.where(search.matches(t, "HELM charts"))) == [1, 2]
    assert ids(t.where(search.matches(t, "kit docs packs"))) == [1]
    assert ids(t.where(search.matches(t, "  "))) == [1, 2, 3, 4, 5, 6] and ids(t.where(search.matches(t, "helm nothing"))) == []


def test_name_outranks_summary_and_rank_precedes_sort(t):
    rows = search.search(t, "helm", sort=["stars:desc"]).collect()
    assert [(r.id, r["rank"]) for r in rows] == [(1, 0), (3, 2), (2, 2), (4, 5)]
    assert [r.id for r in search.search(t).collect()] == [6, 2, 4, 1, 3, 5]


def test_missing_values_last_both_ways(t):
    assert [r.id for r in t.orderBy(*filters.order(["momentum:asc"])).collect()][-1] == 2
    assert [r.id for r in t.orderBy(*filters.order(["momentum:desc"])).collect()][-1] == 2


def test_paging_and_totals(t):
    by = filters.order(["stars"])
    assert [r.id for r in filters.page(t, by, 2, 2).collect()] == [4, 1]
    assert filters.page(t, by, 1, 0).count() == 0 and filters.page(t, by, 600, 20).count() == 0
    assert tuple(filters.totals(t, 4).first()) == (6, 2) and filters.rest_paging(500, 999) == (50, 200) and filters.rest_paging(None, None) == (20, 1)


def test_facets_count_a_document_once_and_drop_nulls(t):
    got = {(r.attribute, r.value): r.docs for r in search.facets(t, ["domains", "install_methods.method", "language", "archived"]).collect()}
    assert got["domains", "packaging"] == 3 and got["install_methods.method", "brew"] == 2 and got["language", "Go"] == 3 and got["archived", "true"] == 1
    assert all(v is not None for _, v in got) and search.facets(t, []).count() == 0
    with pytest.raises(ValueError):
        search.facets(t, ["nowhere"])


def test_alternatives_compare_hot_and_totals(t):
    got = search.alternatives(t, 2, 10, ["a/helm-kit"]).orderBy("place").collect()
    assert [(r.id, r.place, r.score_total) for r in got] == [(2, 1, 0.9)]  # same owner and archived left out, sharing a domain and the kind
    everything = F.lit(True)
    assert [r.id for r in search.alternatives(t, 2, 10, ["a/helm-kit"], everything).orderBy("place").collect()] == [2, 3]
    assert [r.id for r in search.alternatives(t, 9, 9, ["c/far"], everything).collect()] == []  # of the same owner only
    assert [r.id for r in search.alternatives(t, 1, 0, ["b/chart-lint"]).collect()] == []  # its best neighbour is cut before owners are looked at
    # every document is asked for, archived ones too; one without domains is met by its kind alone
    assert {(r.for_id, r.id) for r in search.alternatives(t).collect()} == {(1, 2), (2, 1), (3, 1)}
    bare = t.where("id <> 4").unionByName(t.where("id = 4").withColumn("owner", F.lit("d")))
    assert {(r.for_id, r.id) for r in search.alternatives(bare).collect()} == {(1, 2), (2, 1), (3, 1), (5, 4)}
    assert [r.full_name for r in search.compare(t, ["c/far", "no/no", "a/twin"]).orderBy("place").collect()] == ["c/far", "a/twin"]
    assert [r.id for r in search.whats_hot(t, "packaging", 2).collect()] == [1, 2] and [r.id for r in search.whats_hot(t, "packaging", 1, everything).collect()] == [3]
    assert {r.query: r.docs for r in search.query_totals(t, ["helm", "zzz", "packs"]).collect()} == {"helm": 4, "packs": 2}


def test_typos_and_corrections(spark, t):
    assert ids(t.where(search.typo_match(t, F.col("summary"), "chart"))) == [1, 2]
    assert ids(t.where(search.typo_match(t, F.col("summary"), "helmm"))) == [2, 3]
    assert ids(t.where(search.typo_match(t, F.col("summary"), "hem"))) == []
    words = spark.createDataFrame([("secrty",), ("networkking",), ("storage",), ("edg",), ("observabelitee",)], "word string")
    v = spark.createDataFrame([("security",), ("networking",), ("storage",), ("edge",), ("observability",)], "word string")
    assert {(r.word, r.suggestion, r.distance) for r in search.corrections(words, v).collect()} == {("networkking", "networking", 1)}
    words = spark.createDataFrame([("securty",), ("securitee",)], "word string")
    assert {(r.word, r.suggestion, r.distance) for r in search.corrections(words, v).collect()} == {("securty", "security", 1), ("securitee", "security", 2)}


def test_one_call_answers_with_hits_total_and_facets(t):
    a = search.search_tools(t, "helm", sort="stars", size=1, attributes=["kind", "install_methods.method"]).first()
    assert (a.total, a.page, a.hits_per_page, [h.full_name for h in a.hits]) == (3, 1, 1, ["a/helm-kit"])
    assert [(f.attribute, f.value, f.docs) for f in a.facets] == [("install_methods.method", "brew", 2), ("install_methods.method", "helm", 1), ("kind", "cli", 2), ("kind", "operator", 1)]
    none = search.search_tools(t, "nothing here", attributes=["kind"]).first()
    assert (none.total, none.hits, none.facets) == (0, [], [])
    with pytest.raises(ValueError):
        search.search_tools(t, sort="id")
    v = vocabulary.standard()
    a = search.rest_search(t, {"q": "", "limit": "0", "page": "-3", "sort": "stars", "kind": "cli,nope", "domain": "packaging"}, v).first()
    assert (a.total, a.page, [(r.repo, r.url) for r in a.results]) == (2, 1, [("b/chart-lint", "/tools/b/chart-lint"), ("a/helm-kit", "/tools/a/helm-kit")])
    assert [r.repo for r in search.rest_search(t, {"limit": "1", "page": "2"}, v).first().results] == ["b/chart-lint"]
    assert filters.is_sort_key("recent") and not filters.is_sort_key("__proto__") and filters.sort_spec() == [] and filters.sort_spec("score") == ["score_total:desc"]
    assert "install_methods.method" in filters.default_facets(v) and filters.family_attribute("kind") == "kind"


def test_suggested_queries(spark):
    words = search.vocabulary_list(vocabulary.standard())
    v = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, position int")
    asked = ["netwroking helm", "polcy", "policy", "zzzzzz", "  ", "Securty  Storag edge", "a a", "edg"]
    got = {}
    for r in search.suggest_queries(spark.createDataFrame([(q,) for q in asked], "query string"), v).orderBy("query", "place").collect():
        got.setdefault(r["query"], []).append(r.suggestion)
    assert got == {
        "netwroking helm": ["networking helm", "netwroking", "helm"], "polcy": ["policy"], "a a": ["a"],
        "Securty  Storag edge": ["security storag edge", "securty storage edge", "securty", "storag"],
    }


def test_places_over_many_partitions(spark):
    df = spark.range(1000, numPartitions=7).select("id", (F.col("id") * 37 % 101).alias("k"))
    got = filters.numbered(df, [F.desc("k"), F.col("id")]).collect()
    assert [r.id for r in sorted(got, key=lambda r: r.place)] == [r.id for r in sorted(got, key=lambda r: (-r.k, r.id))]
    assert sorted(r.place for r in got) == list(range(1, 1001)) and filters.numbered(df.limit(0), [F.col("id")]).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_corrections_match_brute_force(spark, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abc" if seed % 2 else "abcdefghé", k=rng.randint(1, 13)))
    vocabulary, asked = {word() for _ in range(60)}, {word() for _ in range(120)}
    for v in list(vocabulary):  # near ones
        w = list(v)
        for _ in range(rng.randint(1, 3)):
            at = rng.randrange(len(w) + 1)
            w[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "q"])
        asked.add("".join(w))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    want = set()
    for a in asked - vocabulary:
        k = 2 if len(a) >= 8 else 1 if len(a) >= 5 else 0
        near = sorted((distance(a, v), v) for v in vocabulary if distance(a, v) <= k) if k else []
        want |= {(a, v, d, i) for i, (d, v) in enumerate(near[:3], 1)}
    frame = lambda ws: spark.createDataFrame([(w,) for w in sorted(ws)], "word string")
    got = {(r.word, r.suggestion, r.distance, r.place) for r in search.corrections(frame(asked), frame(vocabulary), 3).collect()}
    assert got == want and want


def test_params_round_trip():
    known = {"kind": ["cli", "operator"], "domain": ["storage"]}
    s = filters.selection_from_params({"kind": "cli,nope,operator", "domain": ["storage", "storage"]}, known)
    assert s == {"kind": ["cli", "operator"], "domain": ["storage"]}
    assert filters.params_from_selection(s, {"q": "x", "page": "3", "kind": "old"}) == {"q": "x", "kind": "cli,operator", "domain": "storage"}
    assert filters.toggle(s, "domain", "storage") == {"kind": ["cli", "operator"]} and filters.toggle({}, "kind", "cli") == {"kind": ["cli"]}
