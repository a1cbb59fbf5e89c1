import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from skarn.functions import render, scoring, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def lit(x):
    return F.lit(x)


@pytest.mark.parametrize(
    ("column", "want"),
    [
        (lambda: text.slugify(lit("  Kube Operator!! ")), "kube-operator"), (lambda: text.slugify(lit("!!")), None), (lambda: text.slugify(lit("a" * 99 + " b")), "a" * 99),
        (lambda: text.document_id(lit("o/n/x")), "o__n/x"), (lambda: text.full_name(lit("o__n__x")), "o/n__x"), (lambda: text.is_repo_name(lit("a/b.c")), True),
        (lambda: text.is_safe_name(lit("a/..")), False), (lambda: text.is_store_id(lit("null")), False), (lambda: text.is_store_id(lit("a_b-1")), True), (lambda: text.is_store_id(lit(None).cast("string")), False),
        (lambda: text.is_https(lit("https://a.b/c")), True), (lambda: text.is_https(lit("javascript:x")), False), (lambda: text.normal_url(lit(" HTTPS://X.y/Z.git/ ")), "https://x.y/z"),
        (lambda: text.encode_component(lit("a b/c")), "a%20b%2Fc"), (lambda: text.ulid_millis(lit("01ARZ3NDEKTSV4RRFFQ69G5FAV")), 1469922850259),
        (lambda: text.fnv1a(lit("")), 2166136261), (lambda: text.fnv1a(lit("a")), 0xE40C292C), (lambda: text.fnv1a(lit("foobar")), 0xBF9CF968),
        (lambda: text.shell_quote(lit("it's")), "'it'\\''s'"), (lambda: text.decode_base64(lit("aGVs\nbG8=")), "hello"), (lambda: text.cut_bytes(lit("aé漢🙂"), 5), "aé"),
        (lambda: text.cut_bytes(lit("aé漢🙂"), 6), "aé漢"), (lambda: text.cut_bytes(lit("aé漢🙂"), 9), "aé漢"), (lambda: text.cut_bytes(lit("aé"), 9), "aé"), (lambda: text.escape_html(lit("<a b='c'>&")), "&lt;a b=&#39;c&#39;&gt;&amp;"),
        (lambda: text.content_hash(lit(1).alias("a"), lit(None).cast("string").alias("b")), hashlib.sha256(b'{"a":1,"b":null}').hexdigest()[:32]),
    ],
)
def test_scalars(spark, column, want):
    assert one(spark, column()) == want


def test_relative_time_and_shards(spark):
    now = F.lit(dt.datetime(2024, 1, 2))
    ago = lambda **k: one(spark, text.relative_time(F.lit(dt.datetime(2024, 1, 2) - dt.timedelta(**k)), now))
    assert (ago(minutes=59), ago(minutes=61), ago(days=3, hours=5)) == ("59m ago", "1h ago", "3d ago")
    shards = [r.s for r in spark.createDataFrame([(f"o/r{i}",) for i in range(200)], "n string").select(text.shard_of(F.col("n"), 4).alias("s")).collect()]
    assert set(shards) == {0, 1, 2, 3}


def now():
    return F.lit(dt.datetime(2026, 8, 1))


def days_ago(n):
    return F.lit(dt.datetime(2026, 8, 1) - dt.timedelta(days=n))


def test_scores_keep_their_laws(spark):
    null = F.lit(None)
    assert one(spark, scoring.popularity(F.lit(0))) == 0 and one(spark, scoring.popularity(F.lit(99999))) == pytest.approx(1) and one(spark, scoring.popularity(F.lit(10**9))) == 1
    assert one(spark, scoring.clamp01(null.cast("double"))) is None
    fresh = one(spark, scoring.activity(now(), now(), F.lit(6), null.cast("double"), now()))
    assert fresh == pytest.approx(1) and one(spark, scoring.activity(now(), now(), F.lit(6), F.lit(0.0), now())) == pytest.approx(0.85)
    assert one(spark, scoring.activity(days_ago(90), null.cast("timestamp"), F.lit(0), null.cast("double"), now())) == pytest.approx(0.5 * (1 - 90 / 540) / 0.85)
    assert one(spark, scoring.adoption(F.lit(3), null.cast("long"))) == pytest.approx(0.7) and one(spark, scoring.adoption(F.lit(9), F.lit(10**6))) == pytest.approx(1)


def test_quality_renormalises_over_what_is_present(spark):
    none = {k: F.lit(None).cast("double") for k in scoring.QUALITY_WEIGHTS}
    q, c = scoring.quality(none, F.lit(None).cast("long"))
    assert (one(spark, q), one(spark, c)) == (0, 0)
    some = none | {"license": F.lit(1.0), "docs": F.lit(0.0)}
    q, c = scoring.quality(some, F.lit(None).cast("long"))
    assert one(spark, q) == pytest.approx(0.6) and one(spark, c) == pytest.approx(0.25 / 0.95)
    q, _ = scoring.quality(some, F.lit(20))
    assert one(spark, q) == pytest.approx(0.3)


def test_total_caps_archived_and_z_score(spark):
    parts = {k: F.lit(1.0) for k in scoring.TOTAL_WEIGHTS}
    assert one(spark, scoring.total(parts, F.lit(False))) == pytest.approx(1) and one(spark, scoring.total(parts, F.lit(True))) == 0.4
    same = scoring.z_score(spark.createDataFrame([(2.0,), (2.0,)], "v double"), "v", "z")
    assert [r.z for r in same.collect()] == [0, 0]
    two = scoring.z_score(spark.createDataFrame([(1.0,), (3.0,)], "v double"), "v", "z")
    assert sorted(r.z for r in two.collect()) == [-1, 1]


def test_render_is_safe_and_absolute(spark):
    html = '<h1 onclick="x">T</h1><script>bad()</script><a href="../b c" title="q&quot;">l</a><a href="javascript:x">j</a><img src="/i.png" srcset="a.png 1x, data:x 2x"><p>open <b>two'
    got = render.clean(html, "https://h.org/d/e/f")
    assert got == '<h1>T</h1><a href="https://h.org/d/b c" title="q&quot;">l</a><a>j</a><img src="https://h.org/i.png" srcset="https://h.org/d/e/a.png 1x"><p>open <b>two</b></p>'
    pages = spark.createDataFrame([(1, html, "https://h.org/"), (2, None, None)], "page_id long, html string, url string")
    assert {r.page_id: r.html for r in render.rendered(pages).collect()}[2] == ""
