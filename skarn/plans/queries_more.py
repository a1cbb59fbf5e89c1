"""Queries of paging variants, sets, dates, artifact joins, generated corpora and the streamed journal."""
from __future__ import annotations

from pyspark.sql import functions as F

from skarn import vocabulary
from skarn.operators import ingest, search
from skarn.plans.tools import TOOLS_SQL, repos, table, tools
from skarn.queries import query
from skarn.sources.shared import shared_path
from skarn.streaming import consumer


@query("SELECT p_partkey AS repo, p_brand AS readme, coalesce(tree, '') AS tree, coalesce(n, 0)::BIGINT AS manifests, latest FROM part LEFT JOIN (SELECT l_partkey, string_agg(DISTINCT l_returnflag || l_linestatus, ',' ORDER BY l_returnflag || l_linestatus) AS tree, count(DISTINCT l_suppkey) AS n, max(l_shipdate)::DATE AS latest FROM lineitem GROUP BY 1) ON p_partkey = l_partkey")
def j1_s7_artifact_join(spark, d):
    line, part = table(spark, d, "lineitem").withColumnRenamed("l_partkey", "repo"), table(spark, d, "part").withColumnRenamed("p_partkey", "repo")
    out = ingest.artifacts(
        part.select("repo"), part.select("repo", F.col("p_brand").alias("readme")), line.select("repo", F.concat("l_returnflag", "l_linestatus").alias("path")),
        line.select("repo", F.col("l_suppkey").cast("string").alias("name"), F.lit("x").alias("content")), line.select("repo", F.col("l_shipdate").alias("published_at")),
    )
    return out.select("repo", "readme", F.coalesce(F.array_join("tree", ","), F.lit("")).alias("tree"), F.coalesce(F.cardinality("manifests"), F.lit(0)).cast("long").alias("manifests"), F.to_date("latest_release_at").alias("latest"))


@query(TOOLS_SQL + "SELECT id, full_name, stars FROM repos WHERE owner = 'Brand#7'")
def o11_owner_worklist(spark, d):
    return ingest.owner_worklist(repos(spark, d), "Brand#7").select("id", "full_name", "stars")


@query(TOOLS_SQL + "SELECT id, stars, (SELECT count(*) FROM repos WHERE kind = 'LARGE') AS total FROM repos WHERE kind = 'LARGE' ORDER BY stars DESC, id LIMIT 15")
def o12_list_with_total(spark, d):
    return ingest.with_total(repos(spark, d).where("kind = 'LARGE'"), [F.desc("stars"), F.col("id")], 15).select("id", "stars", "total")


@query("SELECT count(*) AS n, sum(o_orderkey)::BIGINT AS keys, true AS fits, true AS enough FROM orders")
def o15_batches(spark, d):
    """Every row is in one batch; no batch has more than 1000, and all but the last of a partition have 1000."""
    b = ingest.batches(table(spark, d, "orders"), 1000).groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))
    full = F.count_if(F.col("n") == 1000) == F.sum(F.floor(F.col("n") / 1000))
    return b.agg(F.sum("n").alias("n"), F.sum("keys").alias("keys"), (F.max("n") <= 1000).alias("fits"), full.alias("enough"))


@query("""SELECT p_partkey, list_sort(list_distinct(string_split(p_name, ' '))) = list_sort(list_distinct(list_concat(list_reverse(string_split(p_name, ' ')),
  CASE p_size % 3 WHEN 0 THEN [p_brand] WHEN 1 THEN string_split(p_name, ' ') ELSE [] END))) AS same FROM part""")
def u4_same_set(spark, d):
    """A name's words against the same ones in another order, repeated, or with one more."""
    words = F.split("p_name", " ")
    more = F.when(F.col("p_size") % 3 == 0, F.array("p_brand")).when(F.col("p_size") % 3 == 1, words).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "part").select("p_partkey", ingest.same_set(words, F.concat(F.reverse(words), more)).alias("same"))


@query("SELECT DISTINCT m AS month FROM (SELECT strftime(o_orderdate, '%Y-%m') AS m FROM orders UNION ALL SELECT strftime(l_shipdate, '%Y-%m') FROM lineitem)")
def u1_u2_union_of_windows(spark, d):
    month = lambda c: F.date_format(c, "yyyy-MM").alias("month")
    return table(spark, d, "orders").select(month("o_orderdate")).unionByName(table(spark, d, "lineitem").select(month("l_shipdate"))).distinct()


@query(TOOLS_SQL + r""", w AS (SELECT id, regexp_split_to_array(lower(name), '[^\p{L}\p{N}]+') AS w FROM tools),
p AS (SELECT *, list_position(list_transform(w, lambda x: starts_with(x, 'r')), true) AS a, list_position(list_transform(w, lambda x: starts_with(x, 'gear')), true) AS b FROM w)
SELECT id, list_contains(w, 'r') AND list_contains(w, 'gear') AS exact, coalesce(a, 0) > 0 AND coalesce(b, 0) > 0 AS prefix, CASE WHEN coalesce(a, 0) > 0 AND coalesce(b, 0) > 0 THEN abs(b - a)::BIGINT END AS gap FROM p""")
def r8_closeness(spark, d):
    t = tools(spark, d)
    return t.select("id", search.closeness(t, "name", "r gear").alias("c")).select("id", "c.exact", "c.prefix", "c.gap")


@query("SELECT strftime(unnest(range(min(ts)::DATE, max(ts)::DATE + 1, INTERVAL 1 DAY)), '%Y-%m-%d') AS day FROM events")
def x8_day_list(spark, d):
    return table(spark, d, "events").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).select(F.explode(ingest.day_list(F.col("a"), F.col("b"))).alias("day"))


@query("SELECT o_orderkey, strftime(date_trunc('quarter', o_orderdate), '%Y-%m-%d') AS first, strftime(last_day(date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH), '%Y-%m-%d') AS last, day(last_day(o_orderdate))::INT AS days FROM orders")
def x9_quarter_bounds(spark, d):
    quarter = F.trunc("o_orderdate", "quarter")
    date = lambda c: F.date_format(c, "yyyy-MM-dd")
    return table(spark, d, "orders").select("o_orderkey", date(quarter).alias("first"), date(F.last_day(F.add_months(quarter, 2))).alias("last"), F.dayofmonth(F.last_day("o_orderdate")).alias("days"))


@query(TOOLS_SQL + """SELECT id, 'topic:kubernetes stars:' || CASE WHEN stars > 5000 THEN '>5000' WHEN stars >= 1000 THEN '1000..5000' WHEN stars >= 500 THEN '500..999' WHEN stars >= 200 THEN '200..499' WHEN stars >= 100 THEN '100..199'
  WHEN stars >= 50 THEN '50..99' WHEN stars >= 20 THEN '20..49' WHEN stars >= 10 THEN '10..19' WHEN stars >= 5 THEN '5..9' WHEN stars >= 3 THEN '3..4' ELSE stars::VARCHAR END
  || CASE WHEN created_at IS NULL THEN '' ELSE ' created:' || strftime(created_at, '%Y-%m-%d') END AS text FROM (SELECT * REPLACE (CASE WHEN id % 3 = 0 THEN id % 60 ELSE stars END AS stars) FROM repos)""")
def t11_query_text(spark, d):
    """The source query of every repository's own window, with stars of all bands."""
    created = F.coalesce(F.date_format("created_at", "yyyy-MM-dd"), F.lit(""))
    stars = F.when(F.col("id") % 3 == 0, F.col("id") % 60).otherwise(F.col("stars"))
    return repos(spark, d).select("id", ingest.query_text(F.lit("topic:kubernetes"), ingest.star_band(stars), created).alias("text"))


KINDS = vocabulary.standard()["kind"].ids()


def pick_sql(salt: str, k: int | str, seed: int = 1) -> str:
    return f"(('0x' || substr(md5('{seed}|{salt}|' || id), 1, 15))::BIGINT % {k})"


@query(f"""SELECT id, 'owner' || {pick_sql('owner', '(SELECT greatest(1, count(*) // 4) FROM part)')} AS owner, 'owner' || {pick_sql('owner', '(SELECT greatest(1, count(*) // 4) FROM part)')} || '/tool' || id AS full_name, floor(pow(10, {pick_sql('stars', 4500)} / 1000))::BIGINT AS stars,
  {pick_sql('archived', 100)} < 6 AS archived, {pick_sql('relevance', 101)} / 100 AS k8s_relevance, {KINDS}[((id + {pick_sql('kind', 3)} * {len(KINDS)}) % {len(KINDS)})::INT + 1] AS kind FROM (SELECT unnest(range(count(*))) AS id FROM part)""")
def s26_generated_corpus(spark, d):
    """As many made documents as there are parts: every kind occurs, stars are skewed, some are archived."""
    return ingest.generated(spark, table(spark, d, "part").count(), {"kind": KINDS})


@query("SELECT event_type AS type, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY 1")
def t4_t5_streamed_journal(spark, d):
    """Consumes the events as a stream, batch by batch, into a table, and folds the table."""
    events, out = table(spark, d, "events"), shared_path(spark, "journal")
    inbox = shared_path(spark, "inbox")
    events.select(F.col("event_id").alias("id"), F.col("event_type").alias("type"), "ts").write.parquet(inbox)
    consumer.consume(spark, inbox, "id long, type string, ts timestamp_ntz", shared_path(spark, "position"), lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}"), files=2)
    return spark.read.parquet(out).groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))
