import math
import os
from urllib.parse import quote

import duckdb
import pytest

from skarn import queries as library

library.load()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(v)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(library.QUERIES))
def test_query_equals_its_sql_twin(spark, sf, duck, name):
    df = library.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in columns) for r in df.collect())
    if name not in library.ORACLES:
        assert got
        return
    found = duck.execute(library.ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    want = sorted(tuple(norm(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert got == want


def test_entry_imports_and_registers():
    import __spark_entry__ as e

    assert set(library.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    if os.path.isdir(os.path.join(os.path.dirname(e.__file__), "skarn", "llm")):
        assert {"pipeline", "op6_chosen_path"} <= set(e.queries())


def test_storage_keys_of_all_urls(spark, tmp_path):
    urls = {1: "https://a.org/x?q=1&r=a b#top", 2: None, 3: "http://a.org:80/%C3/é", 4: "no scheme", 5: "http://a/?to=http://b/~(it's)*!"}
    spark.createDataFrame(list(urls.items()), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.key_start for r in library.QUERIES["s5_all_storage_keys"](spark, str(tmp_path)).collect()}
    assert got == {i: u and "repos/" + quote(u.split("://", 1)[-1], safe="-_.!~*'()") for i, u in urls.items()}


def test_links_of_all_tools_without_hidden_values(spark, sf, duck):
    got = library.QUERIES["f29_all_visible_links"](spark, sf).collect()
    some = duck.execute("SELECT count(*) FROM part WHERE p_size & 7 > 0").fetchone()[0]
    assert len({r.id for r in got if r.family == "install_methods"}) == some
    assert {r.value for r in got if r.family == "license_class"} == {"permissive", "copyleft", "source-available"}


def test_suggestions_of_all_words(spark, tmp_path):
    often = "größenordnung straße internationalisierung слово cliché four"
    rare = ["größenordnumg strasse strase internationalisierungg слова clichés fours x" + "y" * 5000, "internationlisirung größenordnung", None, ""]
    texts = [often] * 4 + rare
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.word, r.suggestion, r.distance) for r in library.QUERIES["r14_all_suggestions"](spark, str(tmp_path)).collect()}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    asked = {w for t in rare for w in (t or "").split()} - set(often.split())
    want = {(w, v, distance(w, v)) for w in asked for v in often.split() if len(w) < 100}
    assert got == {(w, v, k) for w, v, k in want if k <= (2 if len(w) >= 8 else 1 if len(w) >= 5 else 0)}
    assert {"größenordnumg", "internationalisierungg", "слова", "clichés"} <= {w for w, _, _ in got}
