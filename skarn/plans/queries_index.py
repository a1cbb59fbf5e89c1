"""Queries answered from the inverted index; their twins are those of the whole scans."""
from __future__ import annotations

from pyspark.sql import functions as F

from skarn.functions import scoring
from skarn.operators import bitmaps, filters, postings, search, vectors
from skarn.operators.search import SEARCHABLE
from skarn.plans import queries_more, queries_search  # noqa: F401  their twins are used here
from skarn.plans.queries_search import FACETS, MOMENTUM_SQL, VISIBLE, facets_sql
from skarn.plans.tools import TOOLS_SQL, kept_path, table, tools
from skarn.queries import ORACLES, query
from skarn.sources.pages import SearchPages
from skarn.sources.shared import shared_path
from skarn.sources.store import Collection, Store


def tools_index(spark, d):
    return postings.Index(spark, kept_path(spark, d, "tools-index", lambda path: postings.build(tools(spark, d), path)))


def documents_index(spark, d):
    path = kept_path(spark, d, "documents-index", lambda path: postings.build(table(spark, d, "documents"), path, "doc_id", ("text",)), ("documents",))
    return postings.Index(spark, path, 1)


@query(ORACLES["r3_all_tokens"])
def r3_indexed(spark, d):
    return tools_index(spark, d).matches("The RED").select("id")


@query(ORACLES["r5_field_rank"])
def r5_indexed(spark, d):
    return tools_index(spark, d).matches("ring er").groupBy("rank").agg(F.count(F.lit(1)).alias("docs"))


@query(ORACLES["r7_typo_tolerance"])
def r7_indexed(spark, d):
    return documents_index(spark, d).typos("thing", 0).select(F.col("id").alias("doc_id"))


@query(ORACLES["r8_closeness"])
def r8_indexed(spark, d):
    index = tools_index(spark, d)
    near = index.closeness("r gear", SEARCHABLE.index("name"))
    return index.ids.join(near, "id", "left").select("id", F.coalesce("exact", F.lit(False)).alias("exact"), F.coalesce("prefix", F.lit(False)).alias("prefix"), "gap")


def facet_bitmaps(spark, d):
    return bitmaps.FacetIndex(spark, kept_path(spark, d, "bitmaps", lambda path: bitmaps.build(tools(spark, d), path, list(FACETS))))


@query(ORACLES["a1_facets_after_query"])
def a1_bitmaps_after_query(spark, d):
    """The filter's documents by scan and index; the facets' attributes aren't read."""
    t, index = tools(spark, d), facet_bitmaps(spark, d)
    shown = index.of_ids(t.where(filters.build_filters(t)).select("id"))
    return index.facets(list(FACETS), index.both(shown, index.of_ids(tools_index(spark, d).matches("the bolt"))))


@query(ORACLES["r13_browse_facets"])
def r13_bitmaps(spark, d):
    t, index = tools(spark, d), facet_bitmaps(spark, d)
    return index.facets(list(FACETS), index.of_ids(t.where(filters.build_filters(t)).select("id")))


@query(facets_sql("kind IN ('SMALL', 'PROMO') AND list_has_any(domains, ['red', 'bolt', 'gear'])"))
def a5_bitmaps_of_a_selection(spark, d):
    """A selection of facet values: bitmaps alone answer."""
    index = facet_bitmaps(spark, d)
    return index.facets(list(FACETS), index.both(index.of_values("kind", ["SMALL", "PROMO"]), index.of_values("domains", ["red", "bolt", "gear"])))


@query(f"{TOOLS_SQL}, {MOMENTUM_SQL.replace('FROM tools', 'FROM (SELECT * REPLACE (CASE WHEN id % 7 = 0 THEN raw_momentum * 3 ELSE raw_momentum END AS raw_momentum) FROM tools WHERE id % 11 <> 0)')} SELECT id, round(momentum, 5) AS momentum FROM m")
def a7_kept_statistics(spark, d):
    """z-scores from the moments that a store keeps by part, after an upsert and a removal."""
    store = Store(spark, shared_path(spark, "measured"))
    store.ensure([Collection("scores", "id string, `group` string, raw_momentum double", "id", ("group",), (), ("raw_momentum",))])
    t = tools(spark, d).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") % 11 == 0, "out").otherwise("in").alias("group"), "raw_momentum")
    store.put("scores", t)
    store.put("scores", t.where("CAST(id AS LONG) % 7 = 0").withColumn("raw_momentum", F.col("raw_momentum") * 3))
    store.remove("scores", {"group": "out"})
    _, mean, deviation = store.statistics("scores", "raw_momentum")
    return store.read("scores").select(F.col("id").cast("long").alias("id"), F.round(scoring.z_score_of(F.col("raw_momentum"), mean, deviation), 5).alias("momentum"))


@query("""WITH i AS (SELECT o_orderkey // 100 AS page, o_orderkey AS k, CASE WHEN o_orderkey // 100 % 13 = 0 OR o_orderkey % 7 = 0 THEN 'full_name' END AS bad FROM orders),
p AS (SELECT page, count(*) AS n, count(bad) AS b, sum(k) FILTER (bad IS NULL) AS s FROM i GROUP BY page)
SELECT page, CASE WHEN b = n THEN 0 ELSE n - b END AS good, CASE WHEN b = n THEN 0 ELSE b END AS bad, b = n AS aborted, CASE WHEN b < n THEN s END::BIGINT AS stars FROM p""")
def s9_s10_search_pages(spark, d):
    """Orders as items of recorded pages of a hundred at most: good ones, mixed ones, and pages of which all items are bad."""
    path, k = shared_path(spark, "pages"), F.col("o_orderkey")
    page = F.expr("o_orderkey div 100")
    name = F.when((page % 13 == 0) | (k % 7 == 0), "nobody").otherwise(F.concat(F.lit("o/r"), k.cast("string")))
    items = table(spark, d, "orders").groupBy(page.alias("page")).agg(F.count(F.lit(1)).alias("total_count"), F.collect_list(F.struct(name.alias("full_name"), k.alias("stargazers_count"))).alias("items"))
    items.select(F.to_json(F.struct("page", "total_count", "items")).alias("value")).write.option("maxRecordsPerFile", 2_000).text(path)
    spark.dataSource.register(SearchPages)
    read = spark.read.format("search_pages").option("path", path).option("abort", "false").option("lines", "true").load()
    whole, bad = F.col("place").isNull(), F.col("error").isNotNull()
    return read.groupBy(F.col("page").cast("long").alias("page")).agg(F.count_if(~whole & ~bad).alias("good"), F.count_if(~whole & bad).alias("bad"), F.bool_or(whole).alias("aborted"), F.sum("stars").alias("stars"))


def vector_lists(spark, d):
    v = table(spark, d, "embeddings")
    return vectors.build(v, shared_path(spark, "lists"))


@query("SELECT count(*) FILTER (vec_id % 50 = 0) * least(10, count(*) - 1) AS asked, true AS enough FROM embeddings")
def r25_vector_lists(spark, d):
    """The index's answers to the stated queries held against the exact ones: recall at 10 of 0.95 or more.

    These vectors are random and form no clusters, so four fifths of the lists are probed; real ones need a few.
    """
    v = table(spark, d, "embeddings")
    asked = v.where("vec_id % 50 = 0")
    true = search.nearest(asked, v)
    lists = vector_lists(spark, d)
    found = lists.nearest(asked, probes=-(-4 * len(lists.centre) // 5))
    return vectors.recall(found, true).join(true.agg(F.count(F.lit(1)).alias("asked"))).select("asked", (F.col("recall") >= 0.95).alias("enough"))


HYBRID_SQL = """SELECT id, round(coalesce(1.0 / (1 + rank), 0) * 0.5 + coalesce(cosine, 0) * 0.5, 6) AS score FROM hits FULL JOIN near USING (id) ORDER BY score DESC, id LIMIT 10"""


@query(TOOLS_SQL + f""", hits AS (SELECT id, {queries_search.rank_sql('ring')} AS rank FROM tools WHERE {queries_search.match_sql('ring')}), q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0),
near AS (SELECT vec_id AS id, list_sum(list_transform(range(1, len(q) + 1), lambda i: q[i]::DOUBLE * embedding[i]::DOUBLE)) /
  (sqrt(list_sum(list_transform(q, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))) AS cosine FROM q, embeddings WHERE vec_id <> 0 ORDER BY cosine DESC, vec_id LIMIT 50)
""" + HYBRID_SQL)
def r25_hybrid(spark, d):
    """Keyword hits from the inverted index and the vectors nearest to one, in one list."""
    v = table(spark, d, "embeddings")
    near = search.nearest(v.where("vec_id = 0"), v, 50).select(F.col("vec_id").alias("id"), "cosine")
    return search.hybrid(tools_index(spark, d).matches("ring"), near).select("id", F.round("score", 6).alias("score"))
