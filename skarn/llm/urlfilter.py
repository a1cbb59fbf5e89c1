"""URL filters: path rules on hosts, and redirect equivalence for the urls that no rule fits.

A page's url is an alias of the canonical url and of the redirect target that its html names
(``<link rel=canonical>``, ``<meta http-equiv=refresh>``; outside comments and scripts), and urls that
differ in scheme, fragment or case of host only are one node. Connected components over these edges
are the classes. The verdict is the fitting rule's, the longest winning; a url without a rule takes its
class's: allow if a url of the class is allowed by a rule (explicit allow has precedence), else block
if one is blocked, else allow.

Defined results: a null url or one without ``://`` has an empty host and path, no rule, no aliases and
the verdict allow; null html names no aliases; repeated rows are judged alike; an empty table gives no
rows; other columns are not read. A target url that is no page itself still has its rule and counts. Relative targets
resolve against the page's own url: a ``<base>`` element changes nothing.
Everything is DataFrame functions: no Python runs on the executors.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed
from .graph import components

#: (verdict, host and path prefix)
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3))


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(_rest(url), r"(?s)^([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def node(url: Column) -> Column:
    """Host, path and query: the identity of a url; null without ``://``."""
    query = F.regexp_extract(_rest(url), r"(?s)^[^?#]*(\?[^#]*)?", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(host(url), path(url), query))


def rule(host_: Column, path_: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, null if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, text in sorted(rules, key=lambda r: len(r[1])):
        h, _, p = text.partition("/")
        fits = ((host_ == h) | host_.endswith("." + h)) & path_.startswith("/" + p)
        found = F.when(fits, F.struct(F.lit(text).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _attribute(tag: Column, name: str) -> Column:
    """An attribute's value, quoted or not; empty if missing."""
    hit = lambda g: F.regexp_extract(tag, rf"(?is)[\s\x22']{name}\s*=\s*(?:\x22([^\x22]*)\x22|'([^']*)'|([^\s\x22'>]+))", g)
    return F.concat(hit(1), hit(2), hit(3))


def _resolved(href: Column, url: Column) -> Column:
    """href against the page's url."""
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    origin = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*(?:[^?#]*/)?)", 1)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    return (
        F.when(F.trim(href) == "", F.lit(None).cast("string"))
        .when(F.regexp_like(href, F.lit(r"^[A-Za-z][A-Za-z0-9+.\-]*://")), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(F.regexp_like(href, F.lit(r"^[A-Za-z][A-Za-z0-9+.\-]*:")) | href.startswith("#"), F.lit(None).cast("string"))
        .when(href.startswith("?"), F.concat(origin, path(url), href))
        .otherwise(F.concat(folder, href))
    )


def _without_dots(url: Column) -> Column:
    """The url with the segments ``.`` and ``..`` of its path resolved."""
    rest = F.split(F.substr(path(url), F.lit(2)), "/")
    last = F.element_at(rest, -1)
    rest = F.concat(rest, F.when(last.isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>")))
    left = lambda done, s: F.when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(s == ".", done).otherwise(F.concat(done, F.array(s)))
    done = F.aggregate(rest, F.array().cast("array<string>"), left)
    parts = F.concat(F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1), F.lit("/"), F.array_join(done, "/"), F.regexp_extract(url, r"(?s)^.*?://[^?#]*(.*)$", 1))
    return F.when(F.regexp_like(path(url), F.lit(r"/\.\.?(/|$)")), parts).otherwise(url)


def alias_edges(pages: DataFrame) -> DataFrame:
    """(u, v): a page's node and the node of a redirect or canonical link in its html."""
    html = F.col("html")
    some = pages.where(F.regexp_like(html, F.lit(r"(?i)canonical|http-equiv")) & (F.instr("url", "://") > 0)).select("url", "html")
    # attribute values between quotes may hold '>'
    tags = F.regexp_extract_all(F.regexp_replace(html, r"(?is)<!--.*?-->|<script\b.*?</script\s*>", " "), F.lit(r"(?is)<(?:link|meta)\b(?:[^>\x22']|\x22[^\x22]*\x22|'[^']*')*>"), F.lit(0))
    t = some.select("url", F.explode(tags).alias("tag"))
    link = F.regexp_like("tag", F.lit(r"(?i)^<link")) & F.array_contains(F.split(F.lower(F.trim(_attribute(F.col("tag"), "rel"))), r"\s+"), "canonical")
    meta = F.regexp_like("tag", F.lit(r"(?i)^<meta")) & (F.lower(F.trim(_attribute(F.col("tag"), "http-equiv"))) == "refresh")
    moved = F.regexp_extract(_attribute(F.col("tag"), "content"), r"(?is)^\s*[\d.]*\s*[;,]\s*url\s*=\s*['\x22]?([^'\x22]*)", 1)
    href = F.trim(F.replace(F.when(link, _attribute(F.col("tag"), "href")).when(meta, moved), F.lit("&amp;"), F.lit("&")))
    # a generator between the steps keeps the optimizer from repeating the long expressions in every later use
    t = t.select("url", F.explode(F.array(href)).alias("href")).where("href <> ''")
    ends = F.struct(node(F.col("url")).alias("u"), _resolved(F.col("href"), F.col("url")).alias("to"))
    t = t.select(F.inline(F.array(ends))).where("to IS NOT NULL")
    t = t.select("u", F.explode(F.array(_without_dots(F.col("to")))).alias("to"))
    return t.select("u", F.explode(F.array(node(F.col("to")))).alias("v")).where("v IS NOT NULL AND u <> v")


def judge(pages: DataFrame, rules=RULES, edges: DataFrame | None = None) -> DataFrame:
    """Returns (page_id, host, path, rule, verdict). edges: further aliases (u, v) by node, if known."""
    found = alias_edges(pages)
    if edges is not None:
        found = found.unionByName(edges.select("u", "v"))
    found = checkpointed(found.distinct())
    own = pages.select("page_id", "url").withColumns({"host": host(F.col("url")), "path": path(F.col("url")), "node": node(F.col("url"))})
    own = own.withColumn("hit", rule(F.col("host"), F.col("path"), rules))
    plain = [F.col("page_id"), F.col("host"), F.col("path"), F.col("hit.rule").alias("rule")]
    if found.isEmpty():
        return own.select(*plain, F.coalesce("hit.verdict", F.lit("allow")).alias("verdict"))
    # a node is host, path and query, so its rule follows from its text, page or not
    members = components(found)
    as_url = F.concat(F.lit("http://"), F.col("node"))
    decided = members.withColumn("said", rule(host(as_url), path(as_url), rules)["verdict"])
    # kept before the join, so that the members of a large class can be split over tasks; 'allow' < 'block'
    classes = checkpointed(decided.groupBy("component").agg(F.min("said").alias("class_verdict")).where("class_verdict IS NOT NULL"))
    verdicts = members.join(classes, "component").select("node", "class_verdict")
    out = own.join(verdicts, "node", "left")
    return out.select(*plain, F.coalesce("hit.verdict", "class_verdict", F.lit("allow")).alias("verdict"))


def op5_redirect_equivalence(spark, sf_dir):
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


#: html of a page with planted aliases, as SQL that Spark and DuckDB both read.
PLANTED = """CASE page_id % 6
 WHEN 0 THEN '<head><link rel="canonical" href="http://a.example.com/en/' || CAST(floor(page_id / 20) AS BIGINT) || '"></head>'
 WHEN 1 THEN '<meta http-equiv="refresh" content="0; url=https://A.example.com/x/../en/./' || CAST(floor(page_id / 20) AS BIGINT) || '#top">'
 WHEN 2 THEN '<!-- <link rel=canonical href=/no> --><link href="/up/../group/' || CAST(floor(page_id / 9) AS BIGINT) || '/." rel="Canonical">'
 WHEN 3 THEN '<link rel=canonical href="http://example.com/en/7' || CAST(floor(page_id / 50) AS BIGINT) || '">' END"""


def planted_aliases(spark, sf_dir):
    """The verdicts of all pages with planted redirects and canonical links, as their own html names none."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").withColumn("html", F.expr(PLANTED)))


def _attribute_sql(name: str) -> str:
    pattern = f"""(?is)[\\s\\x22\'\']{name}\\s*=\\s*(?:\\x22([^\\x22]*)\\x22|\'\'([^\'\']*)\'\'|([^\\s\\x22\'\'>]+))"""
    return "(" + " || ".join(f"regexp_extract(tag, '{pattern}', {g})" for g in (1, 2, 3)) + ")"


def _parts_sql(url: str) -> tuple[str, str, str]:
    """SQL of a url's host, path and node."""
    rest = f"substr({url}, strpos({url}, '://') + 3)"
    host_ = f"translate(regexp_extract({rest}, '(?s)^([^/?#]*)', 1), '{UPPER}', '{LOWER}')"
    path_ = f"regexp_extract({rest}, '(?s)^[^/?#]*([^?#]*)', 1)"
    return host_, path_, f"{host_} || {path_} || regexp_extract({rest}, '(?s)^[^?#]*(\\?[^#]*)?', 1)"


def _rule_sql(what: int, rules=RULES) -> str:
    whens = []
    for rule_ in sorted(rules, key=lambda r: -len(r[1])):
        h, _, p = rule_[1].partition("/")
        whens.append(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}') THEN '{rule_[what]}'")
    return "CASE " + " ".join(whens) + " END"


def oracle(planted: str | None = None) -> str:
    """The same verdicts as DuckDB SQL; classes by a recursive closure, for graphs that fit one machine."""
    host_, path_, node_ = _parts_sql("url")
    moved = "regexp_extract(" + _attribute_sql("content") + ", '(?is)^\\s*[\\d.]*\\s*[;,]\\s*url\\s*=\\s*[\'\'\\x22]?([^\'\'\\x22]*)', 1)"
    pages = "pages" if planted is None else f"(SELECT page_id, url, {planted} AS html FROM pages)"
    return f"""
WITH RECURSIVE own AS (SELECT page_id, url, html, coalesce(contains(url, '://'), false) AS ok,
    CASE WHEN contains(url, '://') THEN {host_} ELSE '' END AS host, CASE WHEN contains(url, '://') THEN {path_} ELSE '' END AS path, CASE WHEN contains(url, '://') THEN {node_} END AS node FROM {pages}),
tags AS (SELECT url, node, unnest(regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<script\\b.*?</script\\s*>', ' ', 'g'), '(?is)<(?:link|meta)\\b(?:[^>\\x22'']|\\x22[^\\x22]*\\x22|''[^'']*'')*>')) AS tag FROM own WHERE ok),
refs AS (SELECT url, node, trim(replace(CASE
    WHEN regexp_matches(tag, '(?i)^<link') AND list_contains(regexp_split_to_array(lower(trim({_attribute_sql("rel")})), '\\s+'), 'canonical') THEN {_attribute_sql("href")}
    WHEN regexp_matches(tag, '(?i)^<meta') AND lower(trim({_attribute_sql("http-equiv")})) = 'refresh' THEN {moved} END, '&amp;', '&')) AS href FROM tags),
origins AS (SELECT *, regexp_extract(url, '(?s)^(.*?)://', 1) AS scheme, regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) AS origin, regexp_extract(url, '(?s)^(.*?://[^/?#]*(?:[^?#]*/)?)', 1) AS folder FROM refs WHERE href <> ''),
ends AS (SELECT node AS u, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.\\-]*://') THEN href WHEN starts_with(href, '//') THEN scheme || ':' || href WHEN starts_with(href, '/') THEN origin || href
    WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.\\-]*:') OR starts_with(href, '#') THEN NULL WHEN starts_with(href, '?') THEN origin || {path_} || href
    ELSE CASE WHEN ends_with(folder, '/') THEN folder ELSE folder || '/' END || href END AS url FROM origins),
split AS (SELECT u, url, {path_} AS path, string_split(substr({path_}, 2), '/') AS segments FROM ends WHERE contains(url, '://')),
plain AS (SELECT u, CASE WHEN regexp_matches(path, '/[.][.]?(/|$)') THEN regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || '/' || array_to_string(list_reduce(
    list_prepend([]::VARCHAR[], list_transform(list_concat(segments, CASE WHEN segments[-1] IN ('.', '..') THEN [''] ELSE [] END), lambda s: [s])),
    lambda a, s: CASE WHEN s[1] = '..' THEN a[1:greatest(len(a) - 1, 0)] WHEN s[1] = '.' THEN a ELSE list_concat(a, s) END), '/') || regexp_extract(url, '(?s)^.*?://[^?#]*(.*)$', 1) ELSE url END AS url FROM split),
e AS (SELECT u, {node_} AS v FROM plain),
pairs AS (SELECT u, v FROM e WHERE u <> v UNION SELECT v, u FROM e WHERE u <> v),
reach(a, b) AS (SELECT u, u FROM pairs UNION SELECT a, v FROM reach JOIN pairs ON b = u),
said AS (SELECT a, {_rule_sql(0)} AS said FROM (SELECT a, regexp_extract(b, '(?s)^([^/?#]*)', 1) AS host, regexp_extract(b, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM reach)),
class AS (SELECT a, min(said) AS verdict FROM said GROUP BY a)
SELECT page_id, host, path, {_rule_sql(1)} AS rule, coalesce({_rule_sql(0)}, class.verdict, 'allow') AS verdict FROM own LEFT JOIN class ON node = a
"""
