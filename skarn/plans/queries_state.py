"""Queries of sweeps, runs, stores, the stamped journal and further enrichment."""
from __future__ import annotations

from pyspark.sql import functions as F

from skarn.functions import text
from skarn.operators import artifacts as files_of
from skarn.operators import classify, discovery, journal, signals
from skarn.plans import project
from skarn.plans.tools import TOOLS_SQL, repos, table
from skarn.queries import query
from skarn.sources.shared import shared_path, written
from skarn.sources.store import Collection, Store, open_store


@query(TOOLS_SQL + """SELECT id, substr(sha256('{"full_name":"' || full_name || '","name":"' || name || '","owner":"' || owner || '","stars":' || stars || ',"forks":' || forks || ',"open_issues":' || open_issues
  || ',"language":' || coalesce('"' || language || '"', 'null') || ',"license":' || coalesce('"' || license || '"', 'null') || ',"topics":["' || array_to_string(list_sort(domains), '","') || '"],"archived":' || archived || '}'), 1, 32) AS hash FROM repos""")
def t7_payload_hash(spark, d):
    r = repos(spark, d).withColumn("topics", F.reverse("domains")).drop("created_at", "pushed_at")
    return r.select("id", discovery.payload_hash(r).alias("hash"))


# --- sweeps: brands are queries, parts their repositories, orders of customers their runs ---
def states(spark, d):
    number = F.substring_index("p_brand", "#", -1).cast("int")
    s = table(spark, d, "part").select(F.col("p_brand").alias("query_slug"), number.alias("n")).distinct()
    windows = lambda n: F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("w"), i.cast("string")))
    none = F.array().cast("array<string>")
    return s.select(
        "query_slug", F.when(F.col("n") > 2, F.concat(F.lit("brand "), F.col("n").cast("string"))).alias("query"), F.when(F.col("n") == 4, None).when(F.col("n") % 2 == 0, none).otherwise(windows(F.col("n"))).alias("pending_windows"),
        F.array(F.lit("w0")).alias("completed_windows"), none.alias("failed_windows"), F.lit("2001-01-01").alias("started_at"), F.col("n").cast("long").alias("pages_fetched"), F.lit(0).cast("long").alias("dropped"),
    )


STATES_SQL = """states AS (SELECT query_slug, CASE WHEN n > 2 THEN 'brand ' || n END AS query, CASE WHEN n = 4 THEN NULL WHEN n % 2 = 0 THEN [] ELSE list_transform(range(1, n + 1), lambda i: 'w' || i) END AS pending, n
FROM (SELECT DISTINCT p_brand AS query_slug, split_part(p_brand, '#', 2)::INT AS n FROM part))"""


def runs(spark, d):
    return table(spark, d, "orders").select(F.concat(F.lit("Brand#"), (F.col("o_custkey") % 7).cast("string")).alias("query_slug"), F.col("o_orderdate").alias("started_at"), F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("outcome"))


COUNTS_SQL = f"""WITH {STATES_SQL}, runs AS (SELECT 'Brand#' || (o_custkey % 7) AS query_slug, o_orderdate, o_orderkey, nullif(o_orderstatus, 'P') AS outcome FROM orders),
r AS (SELECT query_slug, count(*) AS runs, max({{'d': o_orderdate, 'k': o_orderkey}}).k AS last_run FROM runs GROUP BY 1), p AS (SELECT p_brand AS query_slug, count(*) AS repos FROM part GROUP BY 1)"""


def counts(spark, d):
    return discovery.count_discovery(states(spark, d), table(spark, d, "part").select(F.col("p_brand").alias("query_slug")), runs(spark, d))


@query(COUNTS_SQL + """SELECT s.query_slug, coalesce(query, s.query_slug) AS query, coalesce(repos, 0) AS repos, coalesce(runs, 0) AS runs, coalesce(len(pending), 0)::INT AS pending_windows, last_run,
  (SELECT coalesce(outcome, 'unknown') FROM runs WHERE o_orderkey = last_run) AS outcome FROM states s LEFT JOIN r USING (query_slug) LEFT JOIN p USING (query_slug)""")
def j14_a9_count_discovery(spark, d):
    c = counts(spark, d)
    return c.select("query_slug", "query", "repos", "runs", "pending_windows", F.col("last_run.run_id").alias("last_run"), F.col("last_run.outcome").alias("outcome"))


@query(COUNTS_SQL + "SELECT sum(coalesce(repos, 0))::BIGINT AS repos, sum(coalesce(runs, 0))::BIGINT AS runs, sum(coalesce(len(pending), 0))::BIGINT AS pending_windows FROM states LEFT JOIN r USING (query_slug) LEFT JOIN p USING (query_slug)")
def a9_discovery_totals(spark, d):
    return discovery.totals(counts(spark, d))


@query(COUNTS_SQL + "SELECT query_slug, coalesce(repos, 0) AS repos, 1::BIGINT AS state, coalesce(runs, 0) AS runs, true AS delete_runs FROM states LEFT JOIN r USING (query_slug) LEFT JOIN p USING (query_slug)")
def t15_reset_plan(spark, d):
    return discovery.reset_plan(counts(spark, d), everything=True, include_runs=True)


@query(f"""WITH {STATES_SQL} SELECT query_slug, coalesce(len(pending), 0) > 0 AS resumed, CASE WHEN coalesce(len(pending), 0) > 0 THEN array_to_string(pending, ',') ELSE 'all' END AS pending,
  CASE WHEN coalesce(len(pending), 0) > 0 THEN 'w0' ELSE '' END AS completed, CASE WHEN coalesce(len(pending), 0) > 0 THEN n ELSE 0 END::BIGINT AS pages FROM states""")
def t8_begin_sweep(spark, d):
    s = discovery.begin_sweep(states(spark, d), F.array(F.lit("all")), F.lit("2001-12-31"))
    return s.select("query_slug", "resumed", F.array_join("pending_windows", ",").alias("pending"), F.array_join("completed_windows", ",").alias("completed"), F.col("pages_fetched").alias("pages"))


@query(f"""WITH {STATES_SQL} SELECT query_slug, CASE WHEN coalesce(len(pending), 0) = 0 THEN '' ELSE array_to_string(list_concat(list_filter(pending, lambda w: w NOT IN ('w1', 'w2', 'w3')), CASE WHEN n >= 2 THEN ['w2a', 'w2b'] ELSE [] END), ',') END AS pending,
  CASE WHEN coalesce(len(pending), 0) = 0 THEN 'w0' WHEN n >= 2 THEN 'w0,w1,w2' ELSE 'w0,w1' END AS completed, CASE WHEN coalesce(len(pending), 0) > 0 AND n >= 3 THEN 'w3' ELSE '' END AS failed FROM states""")
def t8_windows_done(spark, d):
    """The first window of each sweep is done, the second too large, the third fails."""
    s = written(states(spark, d), "states")
    w = s.select("query_slug", F.explode(F.filter("pending_windows", lambda x: x.isin("w1", "w2", "w3"))).alias("window"))
    done = w.withColumns({"ok": F.col("window") != "w3", "children": F.when(F.col("window") == "w2", F.array(F.lit("w2b"), F.lit("w2a")))})
    out = discovery.window_done(s, done)
    return out.select("query_slug", F.array_join("pending_windows", ",").alias("pending"), F.array_join("completed_windows", ",").alias("completed"), F.array_join("failed_windows", ",").alias("failed"))


KIND = "CASE event_id % 9 WHEN 0 THEN 'skipped' WHEN 1 THEN 'failed' WHEN 2 THEN 'limited' ELSE 'fetched' END"


@query(f"""SELECT count(*) FILTER (t <> 'limited') AS repos_seen, count(*) FILTER (t = 'fetched' AND c) AS repos_fetched, count(*) FILTER (t = 'fetched' AND NOT c) AS repos_unchanged, count(*) FILTER (t = 'skipped') AS repos_skipped,
  count(*) FILTER (t = 'failed') AS repos_failed, count(*) FILTER (t = 'fetched' AND c AND event_id % 5 = 0) AS icons_updated, sum(user_id % 4) FILTER (t IN ('fetched', 'skipped'))::BIGINT AS requests,
  sum(user_id % 3) FILTER (t IN ('fetched', 'skipped'))::BIGINT AS points_spent, count(*) FILTER (t = 'limited') AS rate_limited FROM (SELECT *, {KIND} AS t, coalesce(event_id % 2 = 0 AND event_id % 11 <> 0, false) AS c FROM events)""")
def a11_crawl_counters(spark, d):
    e = F.col("event_id")
    changed = F.when(e % 11 != 0, e % 2 == 0)
    return discovery.crawl_counters(table(spark, d, "events").select(F.expr(KIND).alias("type"), changed.alias("changed"), (e % 5 == 0).alias("icon_updated"), (F.col("user_id") % 4).alias("requests"), (F.col("user_id") % 3).alias("points")))


DECLARED = "['kubectl-plugin', 'operator', 'helm-chart', 'controller', 'admission-webhook', 'terraform-provider', 'library-sdk', 'cli', 'learning-resource']"


@query(f"SELECT kind, count(*) AS parts FROM (SELECT ({DECLARED} || ['service', 'widget'])[p_size % 11 + 1] AS kind FROM part) WHERE list_contains({DECLARED}, kind) GROUP BY kind")
def a14_declared_kinds(spark, d):
    """Parts by kind, of the kinds that rules can give; the others are left out."""
    kinds = classify.declared_kinds()
    own = F.array(*[F.lit(k) for k in (*kinds, "service", "widget")])
    given = table(spark, d, "part").select(F.element_at(own, (F.col("p_size") % 11 + 1).cast("int")).alias("kind"))
    return given.where(F.col("kind").isin(kinds)).groupBy("kind").agg(F.count(F.lit(1)).alias("parts"))


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'tree' END AS source, CASE WHEN page_id % 3 = 0 THEN url END AS source_url, CASE WHEN page_id % 3 = 0 THEN 2 ELSE 0 END::INT AS sizes, 'now' AS fetched_at, 'status 500' AS error FROM pages""")
def c24_kept_icon(spark, d):
    """A failed fetch of an icon: of pages with a good one before, with an empty one, and with none."""
    id_ = F.col("page_id")
    before = F.struct(F.when(id_ % 3 == 0, "tree").alias("source"), F.col("url").alias("source_url"), F.array(F.lit(32), F.lit(64)).alias("sizes"))
    icon = files_of.kept_icon(F.when(id_ % 3 != 2, before), F.lit("status 500"), F.lit("now"))
    return table(spark, d, "pages").select("page_id", icon.alias("i")).select("page_id", "i.source", "i.source_url", F.size("i.sizes").alias("sizes"), "i.fetched_at", "i.error")


@query("""WITH n AS (SELECT page_id, regexp_replace(regexp_replace(lower(trim(url)), '/+$', ''), '\\.git$', '') AS k FROM pages)
SELECT page_id, project FROM n LEFT JOIN (SELECT k, 'p' || min(page_id) AS project FROM n WHERE page_id % 4 = 1 GROUP BY k) USING (k)""")
def j4_landscape_listings(spark, d):
    """Pages against a listing that writes some of their urls in capitals and with slashes."""
    pages = table(spark, d, "pages")
    land = pages.where("page_id % 4 = 1").select(F.concat(F.lit(" "), F.upper("url"), F.lit("/")).alias("repo_url"), F.col("page_id").alias("position"), F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("project"))
    return signals.listings(pages.select("page_id", F.col("url").alias("repo_url")), land).select("page_id", "project")


@query("""SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN NULL ELSE n END AS vulns FROM part LEFT JOIN (SELECT l_partkey, count(DISTINCT l_suppkey)::INT AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON p_partkey = l_partkey""")
def j6_open_vulnerabilities(spark, d):
    """Packages by ecosystem and name; those without an identity stay unknown."""
    part = table(spark, d, "part")
    known = part.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 3 != 0, "Go").alias("ecosystem"), F.col("p_partkey").cast("string").alias("package"))
    line = table(spark, d, "lineitem").where("l_returnflag = 'R'")
    osv = line.groupBy(F.concat(F.lit("Go::"), F.col("l_partkey").cast("string")).alias("key")).agg(F.collect_set("l_suppkey").alias("vulns"), F.max("l_shipdate").alias("fetched_at"))
    return signals.open_vulnerabilities(known, osv).select("id", F.col("osv_open_vulns").alias("vulns"))


@query("""SELECT id, count(*) AS n, count(*) AS ids, 1700000000123 AS millis, true AS ordered FROM (SELECT CASE event_type WHEN 'view' THEN 'RepoFetched' WHEN 'purchase' THEN 'RepoAnalyzed' ELSE 'RepoSkipped' END AS id FROM events) GROUP BY 1""")
def t1_stamped_journal(spark, d):
    """Appends all events in two batches at one instant: ids are distinct, and the later batch sorts after the earlier."""
    kind = F.when(F.col("event_type") == "view", "RepoFetched").when(F.col("event_type") == "purchase", "RepoAnalyzed").otherwise("RepoSkipped")
    e = table(spark, d, "events").select(kind.alias("type"), F.concat(F.lit("a/b"), F.col("user_id").cast("string")).alias("repo"), F.lit("h").alias("content_hash"), F.lit(True).alias("changed"), F.lit(0.5).alias("confidence"), F.lit("fork").alias("reason"), (F.col("event_id") % 2).alias("turn"))
    path = shared_path(spark, "stamped")
    for turn in (0, 1):
        journal.append_stamped(e.where(F.col("turn") == turn), path, 1_700_000_000_123)
    j = spark.read.parquet(path)
    first_late = j.where("turn = 1").agg(F.min("id")).first()[0]
    by = j.groupBy(F.col("type").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"), F.min(text.ulid_millis(F.col("id"))).alias("millis"), F.max(F.when(F.col("turn") == 0, F.col("id"))).alias("last_early"))
    return by.select("id", "n", "ids", "millis", F.coalesce(F.col("last_early") < first_late, F.lit(True)).alias("ordered"))


ORDERS = Collection("orders", "id string, status string, price double", "id", ("status",), ("price",))


@query("SELECT o_orderkey::VARCHAR AS id, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE o_orderstatus END AS status, CASE WHEN o_orderstatus = 'F' THEN o_totalprice + 1 ELSE o_totalprice END AS price FROM orders WHERE o_orderstatus <> 'P'")
def s19_s22_store(spark, d):
    """Writes all orders to a store, some of them again, and removes others."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    store = Store(spark, shared_path(spark, "store"))
    store.ensure([ORDERS])
    store.put("orders", o)
    store.put("orders", o.where("status = 'F'").withColumns({"status": F.lit("done"), "price": F.col("price") + 1}))
    store.remove("orders", {"status": "P"})
    return store.read("orders")


@query("SELECT o_orderstatus AS status, count(*) AS n, (SELECT max(o_totalprice) FROM orders) AS best FROM orders GROUP BY 1")
def a3_f3_store_reads(spark, d):
    """Counts by filter, and a sorted, limited projection, of a store's collection."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    store = open_store(spark, "memory")
    store.ensure([ORDERS])
    store.put("orders", o)
    best = store.list("orders", fields=["price"], sort=["price:desc"], limit=1).first()["price"]
    counts = [(s, store.count("orders", {"status": s})) for s in ("F", "O", "P")]
    return spark.createDataFrame([c for c in counts if c[1]], "status string, n long").withColumn("best", F.lit(best))


@query("SELECT event_id, user_id FROM events WHERE event_type = 'view' AND event_id % 3 = 0")
def f22_changed_events(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", F.col("event_type").alias("type"), F.when(F.col("event_id") % 5 > 0, F.col("event_id") % 3 == 0).otherwise(F.col("event_id") % 3 == 0).alias("changed"))
    return journal.changed_only(e, "view").select("event_id", "user_id")


@query(TOOLS_SQL + "SELECT id, kind, stars FROM repos WHERE id % 5 <> 0 AND pushed_at IS NOT NULL AND kind IS NOT NULL")
def s25_emit_and_load(spark, d):
    """A corpus written as JSON lines and loaded again, every document checked."""
    none = F.lit("unknown")
    docs = repos(spark, d).where("id % 5 <> 0 AND pushed_at IS NOT NULL").select(
        "id", F.col("kind").alias("type"), "stars", F.col("pushed_at").cast("string").alias("pushed_at"), F.lit("cli").alias("kind"), F.array(F.lit("security")).alias("domains"), none.alias("runtime"), none.alias("license_class"), none.alias("maturity"), "k8s_relevance", F.lit(0.5).alias("confidence"),
    )
    path = shared_path(spark, "corpus")
    project.emit_corpus(docs, path, "generated")
    schema = "id long, type string, stars long, pushed_at string, kind string, domains array<string>, runtime string, license_class string, maturity string, k8s_relevance double, confidence double"
    return project.load_corpus(spark, path, schema, "generated").select("id", F.col("type").alias("kind"), "stars")
