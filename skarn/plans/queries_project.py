"""Queries of the projection, of rendering and of scans."""
from __future__ import annotations

from pyspark.sql import functions as F

from skarn.functions import render, text
from skarn.operators import classify, filters, ingest
from skarn.plans import project
from skarn.plans.queries_ingest import ARTIFACTS_SQL, DERIVED_SQL, VOCABULARY, artifacts
from skarn.plans.tools import TOOLS_SQL, now, repos, table
from skarn.queries import query
from skarn.sources import files


def projected(spark, d):
    a = classify.analyze(artifacts(spark, d), VOCABULARY, now())
    analysis = a.select("id", "kind", "domains", "summary", "k8s_relevance", "confidence", "runtime", "license_class", "openness", "maturity", "governance", "needs_review")
    return project.documents(repos(spark, d), analysis)


@query(DERIVED_SQL + "SELECT coalesce(found, 'service') AS kind, license_class, count(*) AS docs, sum(stars)::BIGINT AS stars FROM der WHERE pushed_at IS NOT NULL GROUP BY 1, 2")
def f26_f28_project_documents(spark, d):
    good, _ = project.checked(projected(spark, d))
    return good.groupBy("kind", "license_class").agg(F.count(F.lit(1)).alias("docs"), F.sum("stars").alias("stars"))


@query(ARTIFACTS_SQL + "SELECT id, concat_ws(',', CASE WHEN size % 9 = 0 THEN 'kind' END, CASE WHEN size % 4 = 0 THEN 'domains' END, CASE WHEN pushed_at IS NULL THEN 'pushed_at' END) AS violations FROM art WHERE size % 9 = 0 OR size % 4 = 0 OR pushed_at IS NULL")
def f26_rejects(spark, d):
    """Spoils the kind of some documents and the domains of others, and collects what is refused."""
    docs = projected(spark, d).withColumn("kind", F.when(F.col("size") % 9 == 0, "widget").otherwise(F.col("kind")))
    docs = docs.withColumn("domains", F.when(F.col("size") % 4 == 0, F.array().cast("array<string>")).otherwise(F.col("domains")))
    _, bad = project.checked(docs)
    return bad.select("id", F.array_join("violations", ",").alias("violations"))


@query("WITH u AS (SELECT o_orderkey AS k, o_totalprice AS v, 0 AS seq FROM orders UNION ALL SELECT o_orderkey, o_totalprice + 1, 1 FROM orders WHERE o_orderstatus = 'F') SELECT k, arg_max(v, seq) AS v FROM u GROUP BY k")
def s19_upsert_latest(spark, d):
    o = table(spark, d, "orders")
    old = o.select(F.col("o_orderkey").alias("k"), F.lit(0).alias("seq"), F.col("o_totalprice").alias("v"))
    new = o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k"), F.lit(1).alias("seq"), (F.col("o_totalprice") + 1).alias("v"))
    return ingest.last_by(old.unionByName(new), ["k"], ["seq"]).select("k", "v")


@query("""SELECT page_id, 'repos/' || replace(replace(replace(replace(replace(url_encode(CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE url END), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')'), '%2A', '*') AS key_start,
  length(url) AS n FROM pages""")
def s5_all_storage_keys(spark, d):
    """Keys of every page: what follows the first '://', or the whole url without one; null for a null url."""
    at = F.instr("url", "://")
    name = F.when(at > 0, F.substr("url", at + 3)).otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", F.concat(F.lit("repos/"), text.encode_component(name)).alias("key_start"), F.length("url").cast("long").alias("n"))


@query("""SELECT count(*) FILTER (ok) AS good, count(*) FILTER (NOT ok) AS bad, sum((props::JSON->>'$.k')::BIGINT) FILTER (ok)::BIGINT AS total
FROM (SELECT *, event_id % 7 <> 0 AND event_id % 11 <> 0 AND event_id % 13 <> 0 AND props IS NOT NULL AS ok FROM events)""")
def s10_x15_json_payloads(spark, d):
    """Payloads, some of them cut off, without their field, or with a text in its place."""
    k = F.col("event_id")
    payload = F.when(k % 7 == 0, F.expr("left(props, 3)")).when(k % 11 == 0, '{"other": 1}').when(k % 13 == 0, '{"k": "many"}').otherwise(F.col("props"))
    e = table(spark, d, "events").withColumn("parsed", F.from_json(payload, "k long"))
    good, bad = files.split_valid(e, {"k": F.col("parsed.k").isNotNull()})
    both = good.select("parsed.k", F.lit(True).alias("ok")).unionByName(bad.select("parsed.k", F.lit(False).alias("ok")))
    return both.agg(F.count_if("ok").alias("good"), F.count_if(~F.col("ok")).alias("bad"), F.sum(F.when(F.col("ok"), F.col("k"))).alias("total"))


@query("SELECT r_name AS category, n_name AS name, row_number() OVER (ORDER BY r_regionkey, n_nationkey) AS place FROM nation JOIN region ON n_regionkey = r_regionkey")
def s17_nested_flatten(spark, d):
    """Nests nations below regions as a listing, and flattens the listing again."""
    n = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    item = F.struct(F.struct(F.col("n_name").alias("name"), F.col("n_nationkey").alias("repo_url"), F.col("r_name").alias("project")).alias("item"))
    sub = n.groupBy("r_regionkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", item.alias("i")))), lambda x: x["i"]).alias("items"))
    category = F.struct(F.struct(F.array(F.struct(F.struct("items").alias("subcategory"))).alias("subcategories")).alias("category"))
    nested = sub.agg(F.transform(F.array_sort(F.collect_list(F.struct("r_regionkey", category.alias("c")))), lambda x: x["c"]).alias("landscape"))
    flat = files.flatten_landscape(nested)
    return filters.numbered(flat, [F.col("position")]).select(F.col("project").alias("category"), "name", "place")


@query(TOOLS_SQL + "SELECT string_agg('<url><loc>https://example.org/tools/' || replace(full_name, '#', '%23') || '</loc></url>', '' ORDER BY stars DESC, id) AS sitemap FROM (SELECT * FROM repos ORDER BY stars DESC, id LIMIT 1000)")
def s32_sitemap_top_1000(spark, d):
    top = repos(spark, d).orderBy(F.desc("stars"), "id").limit(1000)
    loc = F.concat(F.lit("<url><loc>https://example.org/tools/"), F.replace("full_name", F.lit("#"), F.lit("%23")), F.lit("</loc></url>"))
    return top.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("stars")).alias("s"), "id", loc.alias("loc")))), lambda x: x["loc"]), "").alias("sitemap"))


@query("SELECT doc_id, n, strlen(t) <= 1000 AS short FROM (SELECT doc_id, length(text) AS n, text AS t FROM documents)")
def x16_byte_lengths(spark, d):
    return table(spark, d, "documents").select("doc_id", F.length("text").cast("long").alias("n"), (F.octet_length("text") <= 1000).alias("short"))


@query()
def c22_render_pages(spark, d):
    """Rows-only: the parser's output has no SQL twin; tests hold it against fixtures."""
    return render.rendered(table(spark, d, "pages"))


@query("SELECT part.p_partkey, methods.method, '''' || method || ' install ' || replace(p_name, ' ', '-') || '''' AS quoted FROM part, (SELECT unnest(['brew', 'helm', 'krew']) AS method, unnest([1, 2, 4]) AS bit) methods WHERE p_size & bit > 0")
def c14_install_commands(spark, d):
    m = repos(spark, d).select(F.col("id").alias("p_partkey"), F.explode("install_methods").alias("m"))
    return m.select("p_partkey", "m.method", text.shell_quote(F.col("m.command")).alias("quoted"))
