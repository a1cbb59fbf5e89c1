import random

import duckdb
import pytest

from skarn.llm import urlfilter
from skarn.llm.graph import components


def classes(edges):
    parent = {}
    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("seed", range(3))
def test_components_match_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, x) for x in range(5001, 5200)] + [(None, 3), (4, 4), (1000, 1001)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == classes(edges)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def page(link):
    return f"<html><head>{link}</head><body>text</body></html>"


ROWS = [
    (1, "http://x.com/en/a", page("")),  # block by rule
    (2, "https://good.info/1", page('<link rel="canonical" href="http://x.com/en/a">')),
    (3, "https://good.info/2?q=1#f", page("<LINK href='/1' REL='canonical foo'>")),
    (4, "https://good.info/3", page('<meta http-equiv="refresh" content="0; url=https://GOOD.info/2?q=1">')),
    (5, "https://free.info/", page("")),
    (6, "https://a.example.com/en/7x", page('<link rel=canonical href="http://x.com/en/b">')),  # explicit allow
    (7, "https://a.example.com/en/8", page("")),
    (8, "https://c.info/1", page('<link rel="canonical" href="https://a.example.com/en/71">')),
    (9, "https://c.info/1", page('<link rel="canonical" href="http://x.com/en/c">')),
    (10, None, page('<link rel="canonical" href="http://x.com/en/a">')),
    (11, "no-scheme.com/en/", None),
    (12, "https://d.info/", page('<!-- <link rel="canonical" href="http://x.com/en/a"> -->')),
    (12, "https://d.info/", page('<script>"<link rel=canonical href=http://x.com/en/a>"</script>')),
    (13, "ftp://EXAMPLE.net", page("")),
    (14, "http://sub.example.net/de/88?x", page("")),
    (15, "http://other.net/de/8", page("")),
]
WANT = {
    1: ("com/en/", "block"), 2: (None, "block"), 3: (None, "block"), 4: (None, "block"), 5: (None, "allow"), 6: ("example.com/en/7", "allow"), 7: ("com/en/", "block"),
    8: (None, "allow"), 9: (None, "allow"), 10: (None, "allow"), 11: (None, "allow"), 12: (None, "allow"), 13: (None, "allow"), 14: ("example.net/de/8", "block"), 15: ("net/de/", "allow"),
}


def test_aliases_take_the_block_and_explicit_allow_precedes(spark):
    pages = spark.createDataFrame([(*r, "clash") for r in ROWS], "page_id long, url string, html string, verdict string")
    rows = urlfilter.judge(pages).collect()
    assert len(rows) == len(ROWS) and {r.page_id: (r.rule, r.verdict) for r in rows} == WANT
    by = {r.page_id: (r.host, r.path) for r in rows}
    assert by[13] == ("example.net", "") and by[10] == by[11] == ("", "") and by[3] == ("good.info", "/2") and by[14] == ("sub.example.net", "/de/88")
    assert urlfilter.judge(pages.limit(0)).count() == 0


def test_known_edges_join_in(spark):
    pages = spark.createDataFrame([(1, "http://q.info/a", None)], "page_id long, url string, html string")
    edges = spark.createDataFrame([("q.info/a", "mid.info/"), ("mid.info/", "x.org/es/1")], "u string, v string")
    assert urlfilter.judge(pages).first().verdict == "allow" and urlfilter.judge(pages, edges=edges).first().verdict == "block"


def test_sql_twin_agrees(spark):
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", ROWS)
    got = urlfilter.judge(spark.createDataFrame(ROWS, "page_id long, url string, html string")).collect()
    want = con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({urlfilter.oracle()})").fetchall()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize(
    ("href", "target"),
    [
        ("../en/7", "h.example/a/en/7"), ("./x", "h.example/a/b/x"), ("../../../z/.", "h.example/z/"), ("/p/../q/..", "h.example/"), ("//O.example/a/./b", "o.example/a/b"), ("http://O.example/a/../b?x=../y", "o.example/b?x=../y"),
        ("..", "h.example/a/"), ("....", "h.example/a/b/...."), ("?q=1", "h.example/a/b/c?q=1"), ("http://o.example", "o.example"),
    ],
)
def test_dot_segments_of_targets_are_resolved(spark, href, target):
    pages = spark.createDataFrame([(1, "http://h.example/a/b/c", f'<link rel="canonical" href="{href}">')], "page_id long, url string, html string")
    assert [r.v for r in urlfilter.alias_edges(pages).collect()] == [target]


def test_planted_aliases_match_sql(spark, sf):
    got = sorted(map(tuple, urlfilter.planted_aliases(spark, sf).select("page_id", "host", "path", "rule", "verdict").collect()), key=str)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    want = con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({urlfilter.oracle(urlfilter.PLANTED)})").fetchall()
    assert got == sorted(want, key=str) and any(r[3] is None and r[4] == "block" for r in got)
