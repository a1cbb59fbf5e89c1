"""Queries of the search surface: filters, matching, rank, facets, paging, scores."""
from __future__ import annotations

from pyspark.sql import functions as F

from skarn import vocabulary
from skarn.functions import scoring
from skarn.operators import filters, search
from skarn.plans.tools import TOOLS_SQL, table, tools
from skarn.queries import query
from skarn.sources.shared import written

TEXT = ("name", "full_name", "summary", "readme_excerpt")
#: SQL of the match on a token and of the index of the first field that holds it, as search.matches and field_rank make them.
HIT = "(contains(lower(name), '{0}') OR contains(lower(full_name), '{0}') OR contains(lower(coalesce(summary, '')), '{0}') OR contains(lower(coalesce(readme_excerpt, '')), '{0}'))"


def match_sql(q: str) -> str:
    return " AND ".join(HIT.format(t) for t in search.tokens(q)) or "true"


def rank_sql(q: str) -> str:
    any_token = lambda c: " OR ".join(f"contains(lower(coalesce({c}, '')), '{t}')" for t in search.tokens(q))
    return f"CASE WHEN {any_token('name')} THEN 0 WHEN {any_token('full_name')} THEN 1 WHEN {any_token('summary')} THEN 2 WHEN {any_token('readme_excerpt')} THEN 5 ELSE 6 END"


VISIBLE = "NOT archived AND k8s_relevance >= 0.4"
FACETS = {"kind": "[kind]", "domains": "domains", "language": "[language]", "license": "[license]", "archived": "[archived::VARCHAR]", "install_methods.method": "methods"}


def facets_sql(where: str = "true", most: int = 200) -> str:
    parts = " UNION ALL ".join(f"SELECT '{a}' AS attribute, unnest(list_distinct({c})) AS value FROM hits" for a, c in FACETS.items())
    return f"""{TOOLS_SQL}, hits AS (SELECT * FROM tools WHERE {where}), pairs AS ({parts})
SELECT * FROM (SELECT attribute, value, count(*) AS docs FROM pairs WHERE value IS NOT NULL GROUP BY attribute, value) QUALIFY row_number() OVER (PARTITION BY attribute ORDER BY value) <= {most}"""


@query(TOOLS_SQL + "SELECT id, full_name FROM tools WHERE kind = 'PROMO' AND NOT archived AND language IS NULL")
def f1_where_equality(spark, d):
    return tools(spark, d).where(filters.where_equal({"kind": "PROMO", "archived": False, "language": None})).select("id", "full_name")


@query(TOOLS_SQL + f"SELECT id, kind FROM tools WHERE list_has_any(domains, ['red', 'bolt']) AND kind IN ('PROMO', 'LARGE') AND {VISIBLE}")
def f5_filter_in_array(spark, d):
    t = tools(spark, d)
    return t.where(filters.build_filters(t, {"domains": ["red", "bolt"], "kind": ["PROMO", "LARGE"]})).select("id", "kind")


@query(TOOLS_SQL + f"SELECT id, len(methods)::INT AS n FROM tools WHERE list_has_any(methods, ['krew']) AND {VISIBLE}")
def f5_install_method_in_struct(spark, d):
    t = tools(spark, d)
    return t.where(filters.build_filters(t, {"install_methods.method": ["krew"]})).select("id", F.size("install_methods").alias("n"))


@query(TOOLS_SQL + f"SELECT archived, count(*) AS docs FROM tools WHERE {VISIBLE} GROUP BY archived")
def f6_f7_default_visibility(spark, d):
    t = tools(spark, d)
    return t.where(filters.build_filters(t)).groupBy("archived").agg(F.count(F.lit(1)).alias("docs"))


@query(TOOLS_SQL + "SELECT id, stars FROM tools WHERE stars >= 800 AND k8s_relevance > 0.2 AND kind = 'SMALL' AND forks < 40 AND list_has_any(methods, ['helm', 'brew']) AND k8s_relevance >= 0.4")
def f8_comparisons(spark, d):
    t = tools(spark, d)
    clauses = ["stars >= 800", "k8s_relevance > 0.2", 'kind = "SMALL"', "forks < 40", 'install_methods.method IN ["helm", "brew"]']
    return t.where(filters.build_filters(t, clauses=clauses, include_archived=True, filterable=["stars", "k8s_relevance", "kind", "forks", "install_methods.method"])).select("id", "stars")


@query(TOOLS_SQL + "SELECT id, array_to_string(methods, ',') AS methods, array_to_string(domains, ',') AS domains FROM tools")
def f10_dotted_paths(spark, d):
    t = tools(spark, d)
    return t.select("id", F.array_join(filters.values_of(t, "install_methods.method"), ",").alias("methods"), F.array_join(filters.values_of(t, "domains"), ",").alias("domains"))


@query(TOOLS_SQL + "SELECT id, full_name AS name, '/tools/' || full_name AS url, stars, score_total AS score FROM tools")
def f27_rest_projection(spark, d):
    return tools(spark, d).select("id", F.col("full_name").alias("name"), F.concat(F.lit("/tools/"), F.col("full_name")).alias("url"), "stars", F.col("score_total").alias("score"))


@query(facets_sql())
def a1_facets_all(spark, d):
    return search.facets(tools(spark, d), list(FACETS))


@query(facets_sql(f"{VISIBLE} AND {match_sql('the bolt')}"))
def a1_facets_after_query(spark, d):
    t = tools(spark, d)
    return search.facets(t.where(filters.build_filters(t)).where(search.matches(t, "the bolt", TEXT)), list(FACETS))


@query(facets_sql(VISIBLE))
def r13_browse_facets(spark, d):
    return search.browse_facets(tools(spark, d), list(FACETS))


@query(TOOLS_SQL + "SELECT 'full_name' AS attribute, full_name AS value, count(*) AS docs FROM tools GROUP BY 2 ORDER BY 2 LIMIT 200")
def a2_facet_cap(spark, d):
    return search.facets(tools(spark, d), ["full_name"])


@query(TOOLS_SQL + f"SELECT least(count(*), 10000) AS total_hits, ceil(least(count(*), 10000) / 20)::BIGINT AS total_pages FROM tools WHERE {VISIBLE}")
def a4_totals(spark, d):
    t = tools(spark, d)
    return filters.totals(t.where(filters.build_filters(t)))


SPELLINGS = ("red ring", "blue", "zzz", "bolt the", "widget", "green gear")


@query(TOOLS_SQL + "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{q}' AS query, count(*) AS docs FROM tools WHERE {VISIBLE} AND {match_sql(q)}" for q in SPELLINGS) + ") WHERE docs > 0")
def a6_multi_query_totals(spark, d):
    t = tools(spark, d)
    return search.query_totals(t, SPELLINGS, filters.build_filters(t))


MOMENTUM_SQL = "m AS (SELECT *, CASE WHEN stddev_pop(raw_momentum) OVER () = 0 THEN 0 ELSE (raw_momentum - avg(raw_momentum) OVER ()) / stddev_pop(raw_momentum) OVER () END AS momentum FROM tools)"


@query(f"{TOOLS_SQL}, {MOMENTUM_SQL} SELECT id, round(momentum, 6) AS momentum FROM m")
def a7_momentum_zscore(spark, d):
    return scoring.z_score(tools(spark, d), "raw_momentum", "momentum").select("id", F.round("momentum", 6).alias("momentum"))


@query(TOOLS_SQL + "SELECT kind, language, count(*) AS docs, sum(stars)::BIGINT AS stars FROM tools GROUP BY ROLLUP (kind, language)")
def a9_counts_per_group(spark, d):
    return tools(spark, d).rollup("kind", "language").agg(F.count(F.lit(1)).alias("docs"), F.sum("stars").alias("stars"))


@query(TOOLS_SQL + "SELECT id, round(popularity, 6) AS popularity FROM tools")
def k1_popularity(spark, d):
    return tools(spark, d).select("id", F.round("popularity", 6).alias("popularity"))


@query(TOOLS_SQL + "SELECT id, round(activity, 6) AS activity FROM tools")
def k2_activity(spark, d):
    return tools(spark, d).select("id", F.round("activity", 6).alias("activity"))


@query(TOOLS_SQL + "SELECT id, round(adoption, 6) AS adoption FROM tools")
def k3_adoption(spark, d):
    return tools(spark, d).select("id", F.round("adoption", 6).alias("adoption"))


@query(TOOLS_SQL + "SELECT id, round(quality, 6) AS quality, round(quality_coverage, 6) AS coverage FROM tools")
def k4_quality_coverage(spark, d):
    return tools(spark, d).select("id", F.round("quality", 6).alias("quality"), F.round("quality_coverage", 6).alias("coverage"))


@query(TOOLS_SQL + "SELECT id, round(raw_momentum, 6) AS raw FROM tools")
def k5_raw_momentum(spark, d):
    return tools(spark, d).select("id", F.round("raw_momentum", 6).alias("raw"))


@query(TOOLS_SQL + "SELECT id, archived, score_total FROM tools")
def k7_total_archived_cap(spark, d):
    return tools(spark, d).select("id", "archived", "score_total")


@query(TOOLS_SQL + f"SELECT id FROM tools WHERE {match_sql('The RED')}")
def r3_all_tokens(spark, d):
    t = tools(spark, d)
    return t.where(search.matches(t, "The RED", TEXT)).select("id")


@query(TOOLS_SQL + f"SELECT rank, count(*) AS docs FROM (SELECT {rank_sql('ring er')} AS rank FROM tools WHERE {match_sql('ring er')}) GROUP BY rank")
def r5_field_rank(spark, d):
    t = tools(spark, d)
    return t.where(search.matches(t, "ring er")).select(search.field_rank(t, "ring er").alias("rank")).groupBy("rank").agg(F.count(F.lit(1)).alias("docs"))


@query(TOOLS_SQL + f"SELECT id, score_total, stars FROM tools WHERE {VISIBLE} ORDER BY stars DESC NULLS LAST, id LIMIT 20 OFFSET 20")
def o5_page_2(spark, d):
    t = tools(spark, d)
    return filters.page(t.where(filters.build_filters(t)), filters.order(["stars:desc"]), 2, 20).select("id", "score_total", "stars")


@query(TOOLS_SQL + f"SELECT id, {rank_sql('bolt on')} AS rank, stars FROM tools WHERE {VISIBLE} AND {match_sql('bolt on')} ORDER BY rank, stars DESC NULLS LAST, id LIMIT 25")
def o7_sort_within_rank(spark, d):
    t = tools(spark, d)
    return search.search(t, "bolt on", filters.build_filters(t), ["stars:desc"], 1, 25).select("id", "rank", "stars")


@query(TOOLS_SQL + "SELECT id, row_number() OVER (ORDER BY language ASC NULLS LAST, pushed_at DESC NULLS LAST, id) AS place FROM tools")
def o2_missing_last(spark, d):
    """The place of every tool, those without a language last."""
    t = tools(spark, d).select("id", "language", "pushed_at")
    return filters.numbered(t, filters.order(["language:asc", "pushed_at:desc"])).select("id", "place")


@query(TOOLS_SQL + """SELECT full_name, place, stars, score_total FROM tools JOIN (SELECT unnest(['Brand#17/red-widget-1', 'nobody/none', 'Brand#2/small-ring-0', 'Brand#4/blue-bolt-2']) AS full_name, unnest([0, 1, 2, 3]) AS place) USING (full_name)""")
def r10_compare(spark, d):
    return search.compare(tools(spark, d), ["Brand#17/red-widget-1", "nobody/none", "Brand#2/small-ring-0", "Brand#4/blue-bolt-2"]).select("full_name", "place", "stars", "score_total")


@query(TOOLS_SQL + """, met AS (SELECT DISTINCT a.id AS for_id, a.owner AS for_owner, b.id, b.owner, b.full_name, b.score_total FROM tools a JOIN tools b
  ON a.kind = b.kind AND list_has_any(a.domains, b.domains) AND NOT b.archived AND b.k8s_relevance >= 0.4),
near AS (SELECT *, row_number() OVER (PARTITION BY for_id ORDER BY score_total DESC NULLS LAST, id) AS r FROM met),
kept AS (SELECT * FROM near WHERE r <= 20 AND owner <> for_owner)
SELECT for_id, row_number() OVER (PARTITION BY for_id ORDER BY score_total DESC NULLS LAST, id)::INT AS place, id, full_name, score_total FROM kept
QUALIFY row_number() OVER (PARTITION BY for_id ORDER BY score_total DESC NULLS LAST, id) <= 10""")
def r11_alternatives(spark, d):
    return search.alternatives(tools(spark, d))


@query(f"{TOOLS_SQL}, {MOMENTUM_SQL} SELECT id, round(momentum, 6) AS momentum FROM m WHERE list_contains(domains, 'red') AND {VISIBLE} ORDER BY m.momentum DESC NULLS LAST, id LIMIT 10")
def r12_whats_hot(spark, d):
    t = scoring.z_score(tools(spark, d), "raw_momentum", "momentum")
    return search.whats_hot(t, "red").select("id", F.round("momentum", 6).alias("momentum"))


@query(facets_sql().replace("SELECT * FROM (SELECT attribute", ", counts AS (SELECT * FROM (SELECT attribute") + """)
SELECT attribute, value, docs, row_number() OVER (PARTITION BY attribute ORDER BY docs DESC, value)::INT AS place FROM counts
QUALIFY row_number() OVER (PARTITION BY attribute ORDER BY docs DESC, value) <= 5""")
def w11_top_n_per_family(spark, d):
    return search.top_values(search.facets(tools(spark, d), list(FACETS)), 5)


@query("""SELECT doc_id FROM documents WHERE list_bool_or(list_transform(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda t: abs(length(t) - 5) <= 1 AND levenshtein(t, 'thing') <= 1))""")
def r7_typo_tolerance(spark, d):
    t = table(spark, d, "documents")
    return t.where(search.typo_match(t, F.col("text"), "thing")).select("doc_id")


@query()
def r14_all_suggestions(spark, d):
    """Corrects each rarer word of the corpus by its frequent ones: words of any letters and length. No twin: DuckDB counts edits in bytes."""
    docs = table(spark, d, "documents")
    n = docs.count()
    words = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))).alias("word"))
    counts = written(words.groupBy("word").agg(F.count(F.lit(1)).alias("docs")), "words")
    frequent = F.col("docs") >= max(3, n // 50)
    return search.corrections(counts.where(~frequent), counts.where(frequent).select("word"))


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0),
n AS (SELECT query_id, vec_id, list_sum(list_transform(range(1, len(q) + 1), lambda i: q[i]::DOUBLE * embedding[i]::DOUBLE)) /
  (sqrt(list_sum(list_transform(q, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))) AS cosine
  FROM q JOIN embeddings ON query_id <> vec_id)
SELECT query_id, vec_id, round(cosine, 6) AS cosine, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id)::INT AS place FROM n
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) <= 10""")
def r25_nearest_vectors(spark, d):
    v = table(spark, d, "embeddings")
    return search.nearest(v.where("vec_id % 50 = 0"), v).select("query_id", "vec_id", F.round("cosine", 6).alias("cosine"), "place")


@query(TOOLS_SQL + f", page AS (SELECT * FROM tools WHERE {VISIBLE} AND {match_sql('gear')}) SELECT kind, count(*) AS docs, max(score_total) AS best FROM page GROUP BY kind")
def r1_search_tools(spark, d):
    """The flagship: default filters and a query, hits by kind with their best score."""
    t = tools(spark, d)
    hits = t.where(filters.build_filters(t)).where(search.matches(t, "gear", TEXT))
    return hits.groupBy("kind").agg(F.count(F.lit(1)).alias("docs"), F.max("score_total").alias("best"))


SEARCH_FACETS = ("kind", "domains", "install_methods.method")


def page_sql(q: str, where: str, order: str, size: int, number: int) -> str:
    """SQL of search_tools' row: hits as texts in order, total, and facets as texts."""
    values = {"kind": "[kind]", "domains": "domains", "install_methods.method": "methods"}
    pairs = " UNION ALL ".join(f"SELECT '{a}' AS attribute, unnest(list_distinct({values[a]})) AS value FROM f" for a in SEARCH_FACETS)
    return f"""{TOOLS_SQL}, f AS (SELECT *, {rank_sql(q)} AS rank FROM tools WHERE {where} AND {match_sql(q)}),
h AS (SELECT full_name || ' ' || rank AS hit, row_number() OVER (ORDER BY rank, {order}, id) AS place FROM f ORDER BY place LIMIT {size} OFFSET {(number - 1) * size}),
c AS (SELECT attribute, value, count(*) AS docs FROM ({pairs}) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY attribute ORDER BY value) <= 200)
SELECT coalesce((SELECT string_agg(hit, '|' ORDER BY place) FROM h), '') AS hits, (SELECT least(count(*), 10000) FROM f) AS total, {number} AS page, {size} AS hits_per_page,
  coalesce((SELECT string_agg(attribute || '=' || value || ':' || docs, '|' ORDER BY attribute, value) FROM c), '') AS facets"""


@query(page_sql("gear", VISIBLE, "stars DESC NULLS LAST", 15, 2))
def r1_search_page(spark, d):
    """A whole answer as one row: the second page's hits in order, the total and the facets of all hits."""
    a = search.search_tools(tools(spark, d), "gear", sort="stars", number=2, size=15, attributes=SEARCH_FACETS)
    hits = F.array_join(F.transform("hits", lambda h: F.concat_ws(" ", h.full_name, h["rank"])), "|")
    facets = F.array_join(F.transform("facets", lambda f: F.concat(f.attribute, F.lit("="), f.value, F.lit(":"), f.docs.cast("string"))), "|")
    return a.select(hits.alias("hits"), "total", "page", "hits_per_page", facets.alias("facets"))


@query(page_sql("the", f"{VISIBLE} AND list_has_any(methods, ['helm', 'krew'])", "score_total DESC NULLS LAST", 50, 1).replace("full_name || ' ' || rank AS hit", "full_name || ' ' || stars || ' /tools/' || full_name AS hit"))
def r1_rest_search(spark, d):
    """The public answer to url parameters, odd ones among them: an unknown sort, a limit beyond the largest, values that no family has."""
    params = {"q": "the", "sort": "id; drop", "limit": "500", "page": "0", "install": "helm,krew,nonsense", "kind": "nowhere"}
    a = search.rest_search(tools(spark, d), params, vocabulary.standard())
    hits = F.array_join(F.transform("results", lambda h: F.concat_ws(" ", h.repo, h.stars, h.url)), "|")
    facets = F.array_join(F.transform("facets", lambda f: F.concat(f.attribute, F.lit("="), f.value, F.lit(":"), f.docs.cast("string"))), "|")
    return a.select(hits.alias("hits"), "total", "page", F.lit(50).alias("hits_per_page"), facets.alias("facets"))


VOCABULARY_WORDS = search.vocabulary_list(vocabulary.standard())
_W = "[" + ", ".join(f"'{w}'" for w in VOCABULARY_WORDS) + "]"


@query(f"""WITH v AS (SELECT unnest({_W}) AS word, unnest(range({len(VOCABULARY_WORDS)})) AS position),
a AS (SELECT DISTINCT ({_W})[p_partkey % {len(VOCABULARY_WORDS)} + 1] AS w, p_size AS size, p_name AS name FROM part),
b AS (SELECT DISTINCT CASE WHEN size % 7 = 0 THEN w ELSE substr(w, 1, size % length(w)) || CASE WHEN size % 5 = 0 THEN 'q' ELSE '' END || substr(w, size % length(w) + 2) END || CASE WHEN size % 3 = 0 THEN '' ELSE ' ' || upper(name) END AS query FROM a),
q AS (SELECT query, list_filter(regexp_split_to_array(lower(query), '[ ]+'), lambda x: x <> '') AS ws FROM b),
f AS (SELECT query, ws, unnest(ws) AS word, unnest(range(len(ws))) AS at_ FROM q),
u AS (SELECT DISTINCT word, CASE WHEN length(word) >= 8 THEN 2 WHEN length(word) >= 5 THEN 1 ELSE 0 END AS k FROM f WHERE word NOT IN (SELECT word FROM v)),
n AS (SELECT u.word, v.word AS suggestion, levenshtein(u.word, v.word) AS distance, position FROM u JOIN v ON abs(length(u.word) - length(v.word)) <= k AND levenshtein(u.word, v.word) <= k WHERE k > 0 QUALIFY row_number() OVER (PARTITION BY u.word ORDER BY distance, position) = 1),
c AS (SELECT query, array_to_string(ws, ' ') AS own, array_to_string(list_transform(ws, lambda x, i: CASE WHEN i = at_ + 1 THEN suggestion ELSE x END), ' ') AS s, at_ AS place FROM f JOIN n USING (word)
  UNION ALL SELECT query, array_to_string(ws, ' '), word, 1000 + at_ FROM f WHERE len(ws) > 1),
e AS (SELECT query, s, min(place) AS place FROM c WHERE s <> own GROUP BY query, s)
SELECT query, row_number() OVER (PARTITION BY query ORDER BY place)::INT AS place, s AS suggestion FROM e QUALIFY row_number() OVER (PARTITION BY query ORDER BY place) <= 4""")
def r14_suggest_queries(spark, d):
    """Queries with mangled and right words of the vocabulary, alone and beside others."""
    size, count = F.col("p_size"), len(VOCABULARY_WORDS)
    w = F.element_at(F.array(*[F.lit(x) for x in VOCABULARY_WORDS]), (F.col("p_partkey") % count + 1).cast("int"))
    part = table(spark, d, "part").select(w.alias("w"), "p_size", "p_name")
    at = size % F.length("w")
    spoilt = F.concat(F.substr("w", F.lit(1), at), F.when(size % 5 == 0, "q").otherwise(""), F.substr("w", at + 2))
    asked = part.select(F.concat(F.when(size % 7 == 0, F.col("w")).otherwise(spoilt), F.when(size % 3 == 0, "").otherwise(F.concat(F.lit(" "), F.upper("p_name")))).alias("query")).distinct()
    words = spark.createDataFrame(list(zip(VOCABULARY_WORDS, range(count), strict=True)), "word string, position int")
    return search.suggest_queries(asked, words)


@query(TOOLS_SQL + ", f AS (SELECT kind AS value, count(*) AS docs FROM tools GROUP BY 1) SELECT value, docs, value = 'SMALL' AS selected, row_number() OVER (ORDER BY value = 'SMALL' DESC, docs DESC, value)::INT AS place FROM f")
def r22_facet_sidebar(spark, d):
    counts = search.facets(tools(spark, d), ["kind"]).withColumnRenamed("attribute", "family")
    return search.sidebar(counts, {"kind": ["SMALL"]}).select("value", "docs", "selected", "place")


@query("SELECT doc_id, array_to_string(list_slice(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> ''), 1, 40), ' ') AS summary FROM documents")
def r24_short_summaries(spark, d):
    return table(spark, d, "documents").select("doc_id", search.first_words(F.col("text")).alias("summary"))
