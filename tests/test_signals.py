from pyspark.sql import functions as F

from skarn.functions import render
from skarn.operators import artifacts, search, signals


def test_best_chart_and_command(spark):
    repos = spark.createDataFrame([("a",), ("b",)], "repo string")
    rows = [("a", "plain", None, 9, 1, ("r", "https://x.org/i")), ("a", "good", True, 1, 2, ("r", "https://x.org/it's")), ("a", "also", True, 1, 3, ("r", "https://x.org")), ("a", "bad;name", True, 99, 0, ("r", "https://x.org")), ("b", "http", True, 5, 0, ("r", "http://x.org"))]
    p = spark.createDataFrame(rows, "repo string, name string, official boolean, stars long, ordinal long, repository struct<name string, url string>")
    got = {r.repo: r for r in signals.charts(repos, p).collect()}
    assert got["a"].chart.name == "good" and got["a"].chart_command == "helm repo add r 'https://x.org/it'\\''s' && helm install good r/good" and got["b"].chart is None


def test_listings_and_formulas_take_the_first(spark):
    repos = spark.createDataFrame([("Kit", "https://H.org/Kit.git"), ("none", None)], "name string, repo_url string")
    land = spark.createDataFrame([("https://h.org/kit/", 2, "sandbox"), ("https://h.org/kit", 1, "graduated")], "repo_url string, position int, project string")
    assert {r.name: r.project for r in signals.listings(repos, land).collect()} == {"Kit": "graduated", "none": None}
    brew = spark.createDataFrame([("kit", 5, "late"), ("KIT", 3, "first")], "name string, ordinal int, homepage string")
    assert {r.name: r.formula and r.formula.homepage for r in signals.formulas(repos, brew).collect()} == {"Kit": "first", "none": None}


def test_scorecard_map_keeps_the_last_and_drops_unknown(spark):
    cards = spark.createDataFrame([("a", 5.0, [("x", 1.0), ("x", 4.0), ("y", -1.0)])], "repo string, score double, checks array<struct<name string, score double>>")
    assert signals.scorecards(spark.createDataFrame([("a",)], "repo string"), cards).first().scorecard.checks == {"x": 4.0}


def test_artifacts(spark):
    tree = [("blob", "a/logo.svg"), ("tree", "a"), ("blob", "b/c/icon.png"), ("blob", ""), ("blob", "go.mod"), ("blob", "charts/z/Chart.yaml"), ("blob", "charts/a/Chart.yaml")]
    row = [(tree, "![b](https://shields.io/x)\n\n<img src='i.png'> ![u](v.png)\n\n![1](1) ![2](2) ![3](3)", "own")]
    df = spark.createDataFrame(row, "tree array<struct<type string, path string>>, readme string, owner string").withColumn("paths", artifacts.blob_paths(F.col("tree")))
    r = df.select(artifacts.manifest_selection(F.col("paths")).alias("m"), artifacts.logo_candidate(F.col("paths"), F.col("readme"), F.col("owner")).alias("l"), artifacts.logo_candidate(F.array().cast("array<string>"), F.col("readme"), F.col("owner")).alias("i"), artifacts.logo_candidate(F.array().cast("array<string>"), F.lit("text"), F.col("owner")).alias("a")).first()
    assert r.m == ["go.mod", "charts/a/Chart.yaml"] and tuple(r.l) == ("tree", "a/logo.svg") and tuple(r.i) == ("readme", "i.png") and r.a.source == "avatar"
    icon = spark.range(1).select(artifacts.icon_descriptor(F.lit("tree"), F.lit("https://x/y"), F.array(F.lit(32)), F.lit("t")).alias("x"), artifacts.icon_descriptor(F.lit("tree"), F.lit("http://x/y"), F.array(F.lit(32)), F.lit("t")).alias("y")).first()
    assert icon.x is not None and icon.y is None


def test_sidebar_summaries_hybrid_and_badges(spark):
    labels = spark.createDataFrame([("kind", "a", 1), ("kind", "b", 9), ("kind", "c", 0), ("kind", "d", 0)], "family string, value string, docs long")
    assert [r.value for r in search.sidebar(labels, {"kind": ["c"]}).orderBy("place").collect()] == ["c", "b", "a"]
    assert spark.range(1).select(search.first_words(F.lit(" a  b\nc d"), 3).alias("x")).first().x == "a b c"
    hits = spark.createDataFrame([(1, 0), (2, 5)], "id long, rank int")
    near = spark.createDataFrame([(2, 0.9), (3, 0.8)], "id long, cosine double")
    assert [r.id for r in search.hybrid(hits, near).collect()] == [2, 1, 3]
    html = "<p><a href='x'><img src='1'></a> <img src='2'>\n<img src='3'></p><p><img src='4'> text</p>"
    assert spark.range(1).select(render.without_badges(F.lit(html)).alias("x")).first().x == "<p><img src='4'> text</p>"
