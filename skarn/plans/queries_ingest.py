"""Queries of ingest, journal, classification, joins and scalar functions."""
from __future__ import annotations

from pyspark.sql import functions as F

from skarn import vocabulary
from skarn.functions import text
from skarn.operators import artifacts as files_of
from skarn.operators import classify, ingest, journal, search, signals
from skarn.plans.tools import TOOLS_SQL, now, repos, table, tools
from skarn.queries import query
from skarn.streaming import consumer

VOCABULARY = vocabulary.standard()


def vocabulary_sql() -> str:
    """The vocabulary as a DuckDB table ``vocab``."""
    rows = [(f.id, v.id, v.label, v.hidden, a) for f in VOCABULARY.families for v in f.values for a in (v.aliases or (None,))]
    text_ = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x).lower()
    return "vocab(family, value, label, hidden, alias) AS (VALUES " + ", ".join("(" + ", ".join(map(text_, r)) + ")" for r in rows) + ")"


# --- artifacts: what classification reads, derived from the corpus ---
def artifacts(spark, d):
    r = repos(spark, d)
    size, base = F.col("size"), F.replace("name", F.lit(" "), F.lit("-"))
    when = lambda k, *values: [F.when(size % k == 0, F.lit(v)) for v in values]
    name = F.when(size % 10 == 0, F.concat(F.lit("kubectl-"), base)).when(size % 10 == 1, F.concat(base, F.lit("-operator"))).when(size % 10 == 2, F.concat(base, F.lit("-controller"))).when(size % 10 == 3, F.concat(F.lit("terraform-provider-"), base)).when(size % 10 == 4, F.concat(F.lit("awesome-"), base)).otherwise(base)
    topics = F.array_compact(F.array(*when(7, "kubernetes"), *when(5, "prometheus"), *when(9, "helm"), *when(4, "Redis"), *when(11, "tutorial"), *when(8, "gitops"), *when(10, "Tracing")))
    tree = F.array_compact(F.array(F.lit("README.md"), *when(13, ".krew.yaml"), *when(6, "cmd/main.go"), *when(8, "config/crd/a.yaml"), *when(16, "PROJECT"), *when(12, "charts/x/Chart.yaml"), *when(23, "enterprise/x.go"), *when(19, "deploy/admission/webhook.yaml"), *when(29, "action.yml")))
    go = F.concat_ws("\n", F.concat(F.lit("module example.org/"), base), F.lit("require k8s.io/client-go"), *when(6, "require spf13/cobra"), *when(15, "require sigs.k8s.io/controller-runtime"))
    npm, cargo = F.lit('{"name": "kit", "uses": "@kubernetes/client-node"}'), F.lit('[package]\nname = "crate"\nkube = "1"')
    entry = lambda k, name, value: F.when(size % k == 0, F.struct(F.lit(name).alias("key"), value.alias("value")))
    manifests = F.map_from_entries(F.array_compact(F.array(entry(3, "go.mod", go), entry(14, "package.json", npm), entry(25, "Cargo.toml", cargo))))
    return r.withColumns(
        {
            "name": name, "topics": topics, "tree": tree, "manifests": manifests, "description": F.when(size % 21 == 0, F.lit("Tools for Kubernetes")).otherwise(F.col("summary")), "readme": F.col("readme_excerpt"),
            "cncf_level": F.when(size == 25, "graduated").when(size == 31, "sandbox"), "org_type": F.when(size % 20 == 0, "foundation").when(size % 20 == 1, "vendor-backed"), "owner_type": F.when(F.col("id") % 2 == 0, "User").otherwise("Organization"),
        }
    )


ARTIFACTS_SQL = TOOLS_SQL + r""", base AS (SELECT * EXCLUDE (name), replace(name, ' ', '-') AS base FROM repos),
art0 AS (SELECT *, CASE size % 10 WHEN 0 THEN 'kubectl-' || base WHEN 1 THEN base || '-operator' WHEN 2 THEN base || '-controller' WHEN 3 THEN 'terraform-provider-' || base WHEN 4 THEN 'awesome-' || base ELSE base END AS name,
  size % 7 = 0 AS t_kube, size % 11 = 0 AS t_learn, size % 9 = 0 AS t_helm, size % 13 = 0 AS krew, size % 8 = 0 AS crd, size % 12 = 0 AS chart, size % 6 = 0 AS cmd, size % 3 = 0 AS go, size % 14 = 0 AS npm, size % 25 = 0 AS cargo,
  CASE WHEN size % 21 = 0 THEN 'Tools for Kubernetes' ELSE summary END AS description,
  list_slice(list_filter([CASE WHEN size % 5 = 0 THEN 'observability' END, CASE WHEN size % 9 = 0 THEN 'packaging' END, CASE WHEN size % 4 = 0 THEN 'database' END, CASE WHEN size % 8 = 0 THEN 'gitops' END,
    CASE WHEN size % 10 = 0 AND size % 5 <> 0 THEN 'observability' END], lambda x: x IS NOT NULL), 1, 3) AS doms FROM base),
art AS (SELECT *, CASE WHEN krew OR size % 10 = 0 THEN 'kubectl-plugin' WHEN crd AND size % 16 = 0 THEN 'operator' WHEN chart THEN 'helm-chart' WHEN go AND size % 15 = 0 THEN 'controller'
   WHEN size % 10 = 2 THEN 'controller' WHEN size % 10 = 1 THEN 'operator' WHEN size % 19 = 0 THEN 'admission-webhook' WHEN size % 10 = 3 THEN 'terraform-provider' WHEN go AND NOT cmd THEN 'library-sdk' WHEN npm THEN 'library-sdk'
   WHEN cargo THEN 'library-sdk' WHEN cmd AND go AND size % 6 = 0 THEN 'cli' WHEN t_learn OR size % 10 = 4 THEN 'learning-resource' END AS found,
  CASE WHEN krew THEN 0.95 WHEN size % 10 = 0 THEN 0.8 WHEN crd AND size % 16 = 0 THEN 0.95 WHEN chart THEN 0.9 WHEN go AND size % 15 = 0 THEN 0.8 WHEN size % 10 = 2 THEN 0.7 WHEN size % 10 = 1 THEN 0.7 WHEN size % 19 = 0 THEN 0.75
   WHEN size % 10 = 3 THEN 0.9 WHEN go AND NOT cmd THEN 0.65 WHEN npm THEN 0.7 WHEN cargo THEN 0.65 WHEN cmd AND go AND size % 6 = 0 THEN 0.75 WHEN t_learn OR size % 10 = 4 THEN 0.8 ELSE 0 END AS confidence FROM art0)
"""


@query(ARTIFACTS_SQL + "SELECT id, coalesce(found, 'service') AS kind, confidence::DOUBLE AS confidence, array_to_string(CASE WHEN len(doms) = 0 THEN ['dev-experience'] ELSE doms END, ',') AS domains, confidence < 0.7 OR len(doms) = 0 AS needs_review FROM art")
def c1_c3_c16_kind_and_domains(spark, d):
    a = classify.analyze(artifacts(spark, d), VOCABULARY, now())
    return a.select("id", "kind", "confidence", F.array_join("domains", ",").alias("domains"), "needs_review")


@query(ARTIFACTS_SQL + "SELECT id, round(least(1, CASE WHEN t_kube OR t_helm THEN 0.4 ELSE 0 END + CASE WHEN name ILIKE '%kube%' OR name ILIKE '%k8s%' THEN 0.2 ELSE 0 END + CASE WHEN description ILIKE '%kubernetes%' OR description ILIKE '%k8s%' THEN 0.15 ELSE 0 END + CASE WHEN go OR chart OR crd THEN 0.35 ELSE 0 END), 6)::DOUBLE AS relevance FROM art")
def c4_relevance(spark, d):
    return artifacts(spark, d).select("id", F.round(classify.relevance(), 6).alias("relevance"))


@query(ARTIFACTS_SQL + """SELECT id, CASE WHEN krew THEN 'workstation' WHEN found IN ('cli', 'kubectl-plugin') THEN 'workstation' WHEN chart OR crd THEN 'in-cluster' WHEN size % 29 = 0 THEN 'ci-pipeline'
  WHEN (go OR npm OR cargo) AND NOT cmd THEN 'in-your-code' WHEN found IN ('operator', 'controller', 'admission-webhook', 'helm-chart') THEN 'in-cluster' ELSE 'unknown' END AS runtime FROM art""")
def c5_runtime(spark, d):
    return classify.analyze(artifacts(spark, d), VOCABULARY, now()).select("id", "runtime")


DERIVED_SQL = ARTIFACTS_SQL + """, der AS (SELECT *, CASE license WHEN 'mit' THEN 'permissive' WHEN 'apache-2.0' THEN 'permissive' WHEN 'gpl-3.0' THEN 'copyleft' WHEN 'busl-1.1' THEN 'source-available' ELSE 'unknown' END AS license_class,
  epoch_us(TIMESTAMP '2001-12-31' - pushed_at) / 8.64e10 AS push_age, epoch_us(TIMESTAMP '2001-12-31' - released_at) / 8.64e10 AS release_age, epoch_us(TIMESTAMP '2001-12-31' - created_at) / 8.64e10 AS age FROM art)
"""


@query(DERIVED_SQL + """SELECT id, license_class, CASE WHEN license_class IN ('source-available', 'unknown') THEN license_class WHEN size % 23 = 0 THEN 'open-core' ELSE 'fully-open' END AS openness,
  CASE WHEN archived THEN 'archived' WHEN size = 25 THEN 'cncf-graduated' WHEN size = 31 THEN 'cncf-sandbox' WHEN age IS NULL OR age < 0 THEN 'unknown' WHEN push_age > 365 THEN 'dormant' WHEN age < 365 THEN 'young'
    WHEN coalesce(release_age <= 365, false) OR push_age <= 183 THEN 'established' ELSE 'unknown' END AS maturity,
  CASE WHEN size % 20 = 0 THEN 'foundation' WHEN size % 20 = 1 THEN 'vendor-backed' WHEN id % 2 = 0 THEN 'individual' ELSE 'unknown' END AS governance FROM der""")
def c6_c10_derived_enums(spark, d):
    return classify.analyze(artifacts(spark, d), VOCABULARY, now()).select("id", "license_class", "openness", "maturity", "governance")


@query(ARTIFACTS_SQL + "SELECT id, CASE WHEN go THEN 'Go' WHEN npm THEN 'npm' WHEN cargo THEN 'crates.io' END AS ecosystem, CASE WHEN go THEN 'example.org/' || base WHEN npm THEN 'kit' WHEN cargo THEN 'crate' END AS package FROM art")
def c11_package_identity(spark, d):
    p = artifacts(spark, d).select("id", classify.package_identity().alias("p"))
    return p.select("id", F.col("p.ecosystem").alias("ecosystem"), F.col("p.name").alias("package"))


@query(ARTIFACTS_SQL + "SELECT coalesce(found, '') AS kind, count(*) AS repos FROM art GROUP BY 1")
def w5_first_verdict(spark, d):
    return classify.with_kind(artifacts(spark, d)).groupBy(F.coalesce("kind", F.lit("")).alias("kind")).agg(F.count(F.lit(1)).alias("repos"))


# --- vocabulary ---
def part_words(spark, d):
    """A vocabulary of the parts: brands are families, names values, types labels; some are hidden, some have their size as alias."""
    p = F.col("p_partkey")
    return table(spark, d, "part").select(F.col("p_brand").alias("family"), F.col("p_name").alias("value"), F.col("p_type").alias("label"), (p % 5 == 0).alias("hidden"), F.when(p % 3 == 0, F.col("p_size").cast("string")).alias("alias"))


PART_WORDS_SQL = "vocab AS (SELECT p_brand AS family, p_name AS value, p_type AS label, p_partkey % 5 = 0 AS hidden, CASE WHEN p_partkey % 3 = 0 THEN p_size::VARCHAR END AS alias FROM part)"


@query("WITH " + PART_WORDS_SQL + " SELECT family, count(DISTINCT value) AS n_values, count(DISTINCT value) FILTER (hidden) AS n_hidden, count(alias) AS n_aliases FROM vocab GROUP BY family")
def a12_vocabulary_summary(spark, d):
    v = part_words(spark, d)
    return v.groupBy("family").agg(F.countDistinct("value").alias("n_values"), F.countDistinct(F.when(F.col("hidden"), F.col("value"))).alias("n_hidden"), F.count("alias").alias("n_aliases"))


@query("WITH " + PART_WORDS_SQL + ", w AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(value || ' ' || label), '[\\s\\-_/]+')) AS word FROM vocab WHERE NOT hidden) SELECT word FROM w WHERE length(word) >= 4")
def r16_vocabulary_words(spark, d):
    return search.vocabulary_words(part_words(spark, d))


@query(ARTIFACTS_SQL + ", " + vocabulary_sql() + ", c AS (SELECT CASE license WHEN 'mit' THEN 'permissive' WHEN 'apache-2.0' THEN 'permissive' WHEN 'gpl-3.0' THEN 'copyleft' WHEN 'busl-1.1' THEN 'source-available' ELSE 'unknown' END AS value, count(*) AS docs FROM art GROUP BY 1) SELECT DISTINCT family, v.value, label, coalesce(docs, 0)::BIGINT AS docs FROM vocab v LEFT JOIN c ON v.value = c.value AND family = 'license_class' WHERE NOT hidden AND family = 'license_class'")
def j13_facet_labels(spark, d):
    counts = search.facets(artifacts(spark, d).withColumn("license_class", classify.license_class(VOCABULARY)), ["license_class"])
    return search.labelled(counts, VOCABULARY.frame(spark)).where("family = 'license_class'")


@query(TOOLS_SQL + ", " + vocabulary_sql() + """, own AS (SELECT id, 'kind' AS family, kind AS value FROM tools UNION SELECT id, 'domains', unnest(domains) FROM tools UNION SELECT id, 'install_methods', unnest(methods) FROM tools
  UNION SELECT id, 'license_class', CASE license WHEN 'mit' THEN 'permissive' WHEN 'apache-2.0' THEN 'permissive' WHEN 'gpl-3.0' THEN 'copyleft' WHEN 'busl-1.1' THEN 'source-available' ELSE 'unknown' END FROM tools)
SELECT DISTINCT id, family, value, label FROM own JOIN vocab USING (family, value) WHERE NOT hidden""")
def f29_all_visible_links(spark, d):
    """Links of every tool; unknown license classes are hidden, and the tools' kinds and domains aren't in the vocabulary."""
    t = tools(spark, d).withColumns({"install_methods": F.col("install_methods.method"), "license_class": classify.license_class(VOCABULARY)})
    return search.visible_links(t, VOCABULARY.frame(spark), ["kind", "domains", "install_methods", "license_class"])


@query(ARTIFACTS_SQL + "SELECT id, len(doms) BETWEEN 1 AND 3 AS ok FROM art")
def f25_vocabulary_membership(spark, d):
    a = artifacts(spark, d).withColumn("found", classify.domains(VOCABULARY))
    return a.select("id", vocabulary.is_valid(VOCABULARY["domains"], F.col("found")).alias("ok"))


# --- ingest ---
@query("SELECT l_partkey, min((l_shipdate, l_orderkey, l_linenumber, l_suppkey)).l_orderkey AS first_order, max((l_shipdate, l_orderkey, l_linenumber, l_suppkey)).l_orderkey AS last_order FROM (SELECT l_partkey, {'l_shipdate': l_shipdate, 'l_orderkey': l_orderkey, 'l_linenumber': l_linenumber, 'l_suppkey': l_suppkey} AS s FROM lineitem) GROUP BY 1".replace("min((l_shipdate, l_orderkey, l_linenumber, l_suppkey))", "min(s)").replace("max((l_shipdate, l_orderkey, l_linenumber, l_suppkey))", "max(s)"))
def w1_w2_first_and_last_sighting(spark, d):
    seen = table(spark, d, "lineitem").select("l_partkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey")
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey"]
    first = ingest.first_by(seen, ["l_partkey"], order).select("l_partkey", F.col("l_orderkey").alias("first_order"))
    return first.join(ingest.last_by(seen, ["l_partkey"], order).select("l_partkey", F.col("l_orderkey").alias("last_order")), "l_partkey")


@query("SELECT o_custkey, arg_max(o_orderkey, {'d': o_orderdate, 'k': o_orderkey}) AS last_order, max(o_orderdate)::DATE AS last_day FROM orders GROUP BY 1")
def w3_latest_per_group(spark, d):
    runs = table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    return ingest.last_by(runs, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", F.col("o_orderkey").alias("last_order"), F.to_date("o_orderdate").alias("last_day"))


@query("SELECT l_partkey, l_suppkey, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_returnflag = 'R' DESC, l_quantity DESC, l_orderkey, l_linenumber, l_suppkey) = 1")
def w4_j5_best_candidate(spark, d):
    c = table(spark, d, "lineitem").select("l_partkey", (F.col("l_returnflag") != "R").alias("rest"), (-F.col("l_quantity")).alias("less"), "l_orderkey", "l_linenumber", "l_suppkey")
    best = ingest.first_by(c, ["l_partkey"], ["rest", "less", "l_orderkey", "l_linenumber", "l_suppkey"])
    return best.select("l_partkey", "l_suppkey", (-F.col("less")).alias("l_quantity"))


@query(TOOLS_SQL + "SELECT CASE WHEN size % 3 = 0 THEN 'new' WHEN size % 2 = 0 THEN 'unchanged' ELSE 'changed' END AS outcome, count(*) AS repos FROM repos GROUP BY 1")
def j9_delta_outcome(spark, d):
    digest = lambda stars: text.content_hash(F.col("full_name"), F.col("license"), stars.alias("stars"))
    r = repos(spark, d)
    incoming = r.select("id", digest(F.col("stars")).alias("digest"))
    known = r.where("size % 3 <> 0").select("id", digest(F.when(F.col("size") % 2 == 0, F.col("stars")).otherwise(F.col("stars") + 1)).alias("digest"))
    return ingest.outcomes(incoming, known, "id", "digest").groupBy("outcome").agg(F.count(F.lit(1)).alias("repos"))


@query(TOOLS_SQL + "SELECT count(*) FILTER (size % 3 = 0) AS repos_new, count(*) FILTER (size % 3 <> 0 AND size % 2 = 1) AS repos_changed, count(*) FILTER (size % 3 <> 0 AND size % 2 = 0) AS repos_unchanged FROM repos")
def a10_run_counters(spark, d):
    r = repos(spark, d)
    known = r.where("size % 3 <> 0").select("id", (F.col("stars") + F.col("size") % 2).alias("digest"))
    return ingest.counters(ingest.outcomes(r.select("id", F.col("stars").alias("digest")), known, "id", "digest"))


@query("SELECT DISTINCT o_orderdate::DATE AS day FROM orders WHERE o_orderdate::DATE NOT IN (SELECT l_shipdate::DATE FROM lineitem WHERE l_returnflag = 'R')")
def j10_anti_completed(spark, d):
    windows = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    done = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.to_date("l_shipdate").alias("day")).distinct()
    return ingest.pending(windows, done, "day")


@query("SELECT c_mktsegment AS segment, count(DISTINCT c_custkey) AS customers, count(o_orderkey) AS orders, max(o_orderdate)::DATE AS last_day FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def j14_explore_counts(spark, d):
    runs = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"), F.max("o_orderdate").alias("last"))
    c = table(spark, d, "customer").join(runs, F.col("c_custkey") == F.col("o_custkey"), "left")
    return c.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.countDistinct("c_custkey").alias("customers"), F.coalesce(F.sum("orders"), F.lit(0)).alias("orders"), F.to_date(F.max("last")).alias("last_day"))


@query("SELECT p_partkey, min(p_partkey) OVER (PARTITION BY lower(p_name)) AS formula FROM part")
def j3_first_match(spark, d):
    part = table(spark, d, "part")
    formulas = part.select(F.upper("p_name").alias("formula_name"), "p_partkey").groupBy(F.lower("formula_name").alias("key")).agg(F.min("p_partkey").alias("formula"))
    return part.join(formulas, F.lower("p_name") == F.col("key"), "left").select("p_partkey", "formula")


@query("SELECT p.page_id, q.page_id AS twin FROM pages p JOIN (SELECT regexp_replace(regexp_replace(lower(trim(url)), '/+$', ''), '\\.git$', '') AS k, min(page_id) AS page_id FROM pages GROUP BY 1) q ON regexp_replace(regexp_replace(lower(trim(p.url)), '/+$', ''), '\\.git$', '') = q.k")
def j4_normalised_url(spark, d):
    pages = table(spark, d, "pages").select("page_id", text.normal_url(F.col("url")).alias("k"))
    first = pages.groupBy("k").agg(F.min("page_id").alias("twin"))
    return pages.join(first, "k").select("page_id", "twin")


@query(ARTIFACTS_SQL + ", t AS (SELECT unnest(list_filter([CASE WHEN size % 5 = 0 THEN 'prometheus' END, CASE WHEN size % 9 = 0 THEN 'helm' END, CASE WHEN size % 4 = 0 THEN 'redis' END, CASE WHEN size % 8 = 0 THEN 'gitops' END, CASE WHEN size % 10 = 0 THEN 'tracing' END], lambda x: x IS NOT NULL)) AS topic FROM art), " + vocabulary_sql() + " SELECT value AS domain, count(*) AS topics FROM t JOIN vocab ON topic = alias AND family = 'domains' GROUP BY value")
def j7_topic_aliases(spark, d):
    topics = artifacts(spark, d).select(F.explode("topics").alias("topic"))
    aliases = VOCABULARY.frame(spark).where("family = 'domains'")
    return topics.join(F.broadcast(aliases), F.lower("topic") == F.col("alias")).groupBy(F.col("value").alias("domain")).agg(F.count(F.lit(1)).alias("topics"))


@query("SELECT event_id, epoch_us(TIMESTAMP '2024-02-01' - ts) / 1e6 < floor(value) * 86400 AS fresh FROM events")
def f12_ttl_fresh(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", ingest.is_fresh(F.col("ts"), F.floor("value") * 86400, F.to_timestamp(F.lit("2024-02-01"))).alias("fresh"))


@query("SELECT event_id, NOT coalesce(ts <= TIMESTAMP '2024-01-30', false) OR epoch_us(TIMESTAMP '2024-01-30' - ts) / 8.64e10 > 15 AS expired FROM events")
def f13_refresh_expired(spark, d):
    return table(spark, d, "events").select("event_id", ingest.is_expired(F.col("ts"), F.to_timestamp(F.lit("2024-01-30")), 15).alias("expired"))


@query(TOOLS_SQL + "SELECT id, CASE WHEN size % 2 = 0 AND stars <= 200 THEN 'fork' WHEN archived AND stars <= 1000 AND (pushed_at IS NULL OR pushed_at < TIMESTAMP '2001-06-30' - INTERVAL 0 MONTH) THEN 'archived-stale' END AS reason FROM repos")
def f14_f15_skip_rules(spark, d):
    then = F.to_date(F.lit("2003-06-30"))
    return repos(spark, d).select("id", ingest.skip_reason(F.col("size") % 2 == 0, F.col("archived"), F.col("stars"), F.col("pushed_at"), then).alias("reason"))


FNV_SQL = "list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295)"


@query(TOOLS_SQL + f", h AS (SELECT id, {FNV_SQL.format('full_name')} AS h FROM repos) SELECT id, h AS hash, (abs(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) % 4)::BIGINT AS shard FROM h")
def f16_shards(spark, d):
    return repos(spark, d).select("id", text.fnv1a(F.col("full_name")).alias("hash"), text.shard_of(F.col("full_name"), 4).cast("long").alias("shard"))


@query(TOOLS_SQL + r", n AS (SELECT id, replace(replace(full_name, '#', CASE WHEN id % 2 = 0 THEN '-' ELSE '#' END), 'gear', '..') AS f FROM repos) SELECT id, regexp_matches(f, '^[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+$') AS is_repo, regexp_matches(f, '^[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+$') AND NOT list_contains(string_split(f, '/'), '..') AS is_safe FROM n")
def f17_f18_names(spark, d):
    f = F.replace(F.replace("full_name", F.lit("#"), F.when(F.col("id") % 2 == 0, "-").otherwise("#")), F.lit("gear"), F.lit(".."))
    return repos(spark, d).select("id", text.is_repo_name(f).alias("is_repo"), text.is_safe_name(f).alias("is_safe"))


@query("SELECT page_id, starts_with(url, 'https://') AS https FROM pages")
def f19_https_urls(spark, d):
    return table(spark, d, "pages").select("page_id", text.is_https(F.col("url")).alias("https"))


@query("SELECT doc_id, regexp_matches(source, '^[A-Za-z0-9_-]+$') AND length(source) <= 250 AND source NOT IN ('undefined', 'null') AS ok FROM documents")
def f20_store_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", text.is_store_id(F.col("source")).alias("ok"))


@query(ARTIFACTS_SQL + "SELECT id, confidence::DOUBLE AS confidence FROM art WHERE confidence < 0.7")
def f23_f24_low_confidence(spark, d):
    return classify.with_kind(artifacts(spark, d)).where(F.col("confidence") < classify.AMBIGUOUS).select("id", "confidence")


@query("SELECT band, created, hits, hits <= 1000 AS fits FROM (SELECT band, CASE WHEN nb <= 1000 THEN '' WHEN nk <= 1000 AND y <= 1996 THEN '..1996-12-31' WHEN ny <= 1000 THEN y || '-01-01..' || y || '-12-31' WHEN nq <= 1000 THEN strftime(q, '%Y-%m-%d') || '..' || strftime(last_day(q + INTERVAL 2 MONTH), '%Y-%m-%d') WHEN nm <= 1000 THEN strftime(m, '%Y-%m-%d') || '..' || strftime(last_day(m), '%Y-%m-%d') ELSE strftime(d, '%Y-%m-%d') END AS created, count(*)::BIGINT AS hits FROM (SELECT *, count(*) OVER (PARTITION BY band) AS nb, count(*) OVER (PARTITION BY band, y <= 1996) AS nk, count(*) OVER (PARTITION BY band, y) AS ny, count(*) OVER (PARTITION BY band, q) AS nq, count(*) OVER (PARTITION BY band, m) AS nm FROM (SELECT CASE WHEN o_totalprice < 100000 THEN 'low' WHEN o_totalprice < 300000 THEN 'mid' ELSE 'high' END AS band, o_orderdate::DATE AS d, year(o_orderdate) AS y, date_trunc('quarter', o_orderdate)::DATE AS q, date_trunc('month', o_orderdate)::DATE AS m FROM orders)) GROUP BY 1, 2)")
def t9_t10_window_plan(spark, d):
    price = F.col("o_totalprice")
    return ingest.window_plan(table(spark, d, "orders"), F.when(price < 100000, "low").when(price < 300000, "mid").otherwise("high"), F.col("o_orderdate"), 1996)


@query(TOOLS_SQL + "SELECT CASE WHEN stars > 5000 THEN '>5000' WHEN stars >= 1000 THEN '1000..5000' WHEN stars >= 500 THEN '500..999' WHEN stars >= 200 THEN '200..499' WHEN stars >= 100 THEN '100..199' WHEN stars >= 50 THEN '50..99' WHEN stars >= 20 THEN '20..49' WHEN stars >= 10 THEN '10..19' WHEN stars >= 5 THEN '5..9' WHEN stars >= 3 THEN '3..4' ELSE stars::VARCHAR END AS band, count(*) AS repos FROM repos GROUP BY 1")
def t12_star_bands(spark, d):
    return repos(spark, d).groupBy(ingest.star_band(F.col("stars")).alias("band")).agg(F.count(F.lit(1)).alias("repos"))


@query(TOOLS_SQL + f", top AS (SELECT * FROM repos ORDER BY stars DESC, full_name LIMIT 400), h AS (SELECT *, replace(full_name, '#', '-') AS f FROM top), k AS (SELECT *, {FNV_SQL.format('f')} AS h FROM h) SELECT f AS full_name, stars FROM k WHERE abs(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) % 4 = 1 ORDER BY stars DESC, full_name LIMIT 100")
def o10_worklist(spark, d):
    named = repos(spark, d).select(F.replace("full_name", F.lit("#"), F.lit("-")).alias("full_name"), "stars")
    return ingest.worklist(named, 100, 4, 1).select("full_name", "stars")


# --- journal ---
def events(spark, d):
    e = table(spark, d, "events")
    return e.select(F.lpad(F.col("event_id").cast("string"), 26, "0").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("type"), F.col("user_id").alias("repo"), "value", "props")


@query("SELECT lpad(event_id::VARCHAR, 26, '0') AS id, event_type AS type, user_id AS repo FROM events WHERE event_id > 7000 ORDER BY id LIMIT 1500")
def t2_journal_after(spark, d):
    return journal.read_after(events(spark, d), "7000".rjust(26, "0"), 1500).select("id", "type", "repo")


@query("SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS day FROM events")
def a13_day_buckets(spark, d):
    return journal.days(events(spark, d))


@query("SELECT user_id AS repo, arg_max(event_type, event_id) AS phase, lpad(max(event_id)::VARCHAR, 26, '0') AS last_id, max(ts) FILTER (event_type = 'view') AS viewed_at, max(ts) FILTER (event_type = 'purchase') AS bought_at FROM events GROUP BY 1".replace("max(ts) FILTER (event_type = 'view')", "epoch_us(max(ts) FILTER (event_type = 'view'))").replace("max(ts) FILTER (event_type = 'purchase')", "epoch_us(max(ts) FILTER (event_type = 'purchase'))"))
def t17_a16_repo_state(spark, d):
    s = journal.repo_state(events(spark, d), {"viewed_at": F.col("type") == "view", "bought_at": F.col("type") == "purchase"})
    return s.withColumns({c: F.unix_micros(c) for c in ("viewed_at", "bought_at")})


@query("SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def t19_tumbling_windows(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return consumer.windowed_counts(e, "1 hour").select(F.unix_micros("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n FROM s GROUP BY user_id, s")
def t19_sessions(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return consumer.sessions(e).select("user_id", F.unix_micros("start").alias("start"), "n")


# --- scalar functions ---
@query(r"SELECT c_custkey, regexp_replace(substr(regexp_replace(regexp_replace(lower(c_name || '  ' || c_mktsegment || '!'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 100), '-+$', '') AS slug FROM customer")
def x2_slugify(spark, d):
    return table(spark, d, "customer").select("c_custkey", text.slugify(F.concat("c_name", F.lit("  "), "c_mktsegment", F.lit("!"))).alias("slug"))


@query("SELECT c_custkey, substr(sha256('{\"c_name\":\"' || c_name || '\",\"c_nationkey\":' || c_nationkey || ',\"missing\":null}'), 1, 32) AS hash FROM customer")
def x5_content_hash(spark, d):
    return table(spark, d, "customer").select("c_custkey", text.content_hash(F.col("c_name"), F.col("c_nationkey"), F.lit(None).cast("string").alias("missing")).alias("hash"))


@query("SELECT event_id, epoch_us(ts) // 1000 AS millis FROM events")
def x17_ulid_time(spark, d):
    """Writes each event's time as an identifier and reads it back."""
    e = table(spark, d, "events")
    encoded = F.lpad(F.translate(F.conv(F.unix_millis(F.col("ts").cast("timestamp")), 10, 32), text.BASE32_DIGITS, text.ULID_DIGITS), 10, "0")
    return e.select("event_id", text.ulid_millis(F.concat(encoded, F.lit("0000000000000000"))).alias("millis"))


@query(TOOLS_SQL + "SELECT id, regexp_replace(full_name, '/', '__') AS doc, full_name AS back FROM repos")
def x18_document_id(spark, d):
    t = repos(spark, d).withColumn("doc", text.document_id(F.col("full_name")))
    return t.select("id", "doc", text.full_name(F.col("doc")).alias("back"))


@query("""SELECT event_id, CASE WHEN m IS NULL THEN '—' WHEN m < 60 THEN greatest(m, 0) || 'm ago' WHEN m < 2880 THEN (m // 60) || 'h ago' ELSE (m // 1440) || 'd ago' END AS ago,
  CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm' ELSE (s // 3600) || 'h' || right('0' || ((s // 60) % 60), 2) || 'm' END AS took, strftime(ts, '%b %-d, %Y') AS label
FROM (SELECT *, CASE WHEN event_id % 9 > 0 THEN floor(epoch_us(TIMESTAMP '2024-01-29' - ts) / 60e6)::BIGINT END AS m, floor(event_id * 777 / 1000 + 0.5)::BIGINT AS s FROM events)""")
def x11_relative_time(spark, d):
    """Ages (some to come, some unknown), durations and date labels."""
    e = table(spark, d, "events")
    ts = F.when(F.col("event_id") % 9 > 0, F.col("ts"))
    return e.select("event_id", text.relative_time(ts, F.to_timestamp(F.lit("2024-01-29"))).alias("ago"), text.duration(F.col("event_id") * 777).alias("took"), text.date_label(F.col("ts")).alias("label"))


@query("SELECT doc_id, text AS back, strlen(text) AS bytes FROM documents")
def x16_s13_base64(spark, d):
    t = table(spark, d, "documents")
    packed = F.regexp_replace(F.base64(F.encode("text", "UTF-8")), "(.{1,60})", "$1\n")
    return t.select("doc_id", text.decode_base64(packed).alias("back"), F.octet_length("text").cast("long").alias("bytes"))


@query("SELECT c_custkey, '''' || replace(c_name || '''s', '''', '''\\''''') || '''' AS quoted FROM customer")
def x19_shell_quote(spark, d):
    return table(spark, d, "customer").select("c_custkey", text.shell_quote(F.concat("c_name", F.lit("'s"))).alias("quoted"))


@query(TOOLS_SQL + f"SELECT id, upper(regexp_extract(name, '[A-Za-z0-9]')) AS letter, ({FNV_SQL.format('name')} % 360)::BIGINT AS hue FROM repos")
def c23_monogram(spark, d):
    m = repos(spark, d).select("id", text.monogram(F.col("name")).alias("m"))
    return m.select("id", "m.letter", "m.hue")


# --- enrichment ---
@query("WITH c AS (SELECT p_partkey, l_suppkey, l_quantity, l_returnflag = 'R' AS official, l_orderkey * 10 + l_linenumber AS ordinal FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_suppkey % 4 <> 0) SELECT p_partkey AS id, arg_min('chart-' || l_suppkey, {'o': NOT official, 's': -l_quantity, 'n': ordinal, 'k': l_suppkey}) AS chart FROM c GROUP BY 1")
def c13_w4_best_chart(spark, d):
    line = table(spark, d, "lineitem")
    url = F.when(F.col("l_suppkey") % 4 == 0, "http://plain.example.org").otherwise("https://charts.example.org")
    packages = line.select(
        F.col("l_partkey").alias("repo"), F.concat(F.lit("chart-"), "l_suppkey").alias("name"), (F.col("l_returnflag") == "R").alias("official"), F.col("l_quantity").alias("stars"),
        F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("n"), F.col("l_suppkey").alias("k")).alias("ordinal"), F.struct(F.lit("main").alias("name"), url.alias("url")).alias("repository"),
    )
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("repo"))
    return signals.charts(parts, packages).where("chart IS NOT NULL").select(F.col("repo").alias("id"), F.col("chart.name").alias("chart"))


@query("WITH s AS (SELECT l_partkey AS repo, avg(l_discount) AS score, list({'n': l_returnflag, 's': l_tax * 100 - 3, 'k': l_orderkey * 10 + l_linenumber, 'x': l_suppkey} ORDER BY l_orderkey * 10 + l_linenumber, l_suppkey) AS c FROM lineitem GROUP BY 1), k AS (SELECT repo, unnest(list_filter(c, lambda x: x.s >= 0)) AS c FROM s) SELECT repo AS id, c.n AS name, round(arg_max(c.s, {'k': c.k, 'x': c.x}), 4) AS score FROM k GROUP BY 1, 2")
def c15_j6_scorecard_checks(spark, d):
    line = table(spark, d, "lineitem")
    check = F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), F.col("l_suppkey").alias("x"), F.struct(F.col("l_returnflag").alias("name"), (F.col("l_tax") * 100 - 3).alias("score")).alias("c"))
    cards = line.groupBy(F.col("l_partkey").alias("repo")).agg(F.avg("l_discount").alias("score"), F.transform(F.array_sort(F.collect_list(check)), lambda x: x["c"]).alias("checks"))
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("repo"))
    out = signals.scorecards(parts, cards)
    return out.select(F.col("repo").alias("id"), F.explode("scorecard.checks").alias("name", "s")).select("id", "name", F.round("s", 4).alias("score"))


@query(ARTIFACTS_SQL + "SELECT id, concat_ws(',', CASE WHEN go THEN 'manifests' END, CASE WHEN readme_excerpt IS NOT NULL THEN 'readme' END, CASE WHEN released_at IS NOT NULL THEN 'releases' END) AS used, CASE WHEN readme_excerpt IS NULL THEN 'readme' ELSE '' END AS part FROM art")
def c12_signal_bookkeeping(spark, d):
    a = artifacts(spark, d)
    out = signals.bookkeeping(a, {"manifests": F.col("manifests")["go.mod"].isNotNull(), "readme": F.col("readme").isNotNull(), "releases": F.col("released_at").isNotNull()}, {"readme": F.col("readme").isNull()})
    return out.select("id", F.array_join("signals_used", ",").alias("used"), F.array_join("partial_signals", ",").alias("part"))


@query(ARTIFACTS_SQL + "SELECT id, CASE WHEN chart THEN 'charts/x/Chart.yaml' ELSE '' END AS manifests FROM art")
def c18_w6_manifest_selection(spark, d):
    return artifacts(spark, d).select("id", F.array_join(files_of.manifest_selection(F.col("tree")), ",").alias("manifests"))


@query(ARTIFACTS_SQL + """SELECT id, CASE WHEN size % 4 = 1 THEN 'tree' WHEN size % 4 = 2 AND readme_excerpt IS NOT NULL THEN 'readme' ELSE 'avatar' END AS source,
  CASE WHEN size % 4 = 1 THEN 'assets/logo.svg' WHEN size % 4 = 2 AND readme_excerpt IS NOT NULL THEN 'docs/picture.png' ELSE 'https://github.com/' || owner || '.png' END AS url FROM art""")
def c19_w9_logo_candidates(spark, d):
    """Logos of the tree, of the README (after badges), and avatars."""
    a, size = artifacts(spark, d), F.col("size") % 4
    tree = F.when(size == 1, F.concat("tree", F.array(F.lit("assets/deep/logo.svg"), F.lit("assets/logo.svg")))).otherwise(F.col("tree"))
    badges = "\n\n![a](https://x/badge.svg) ![b](u) ![c](v)\n\n![first](docs/picture.png)\n\n![second](other.png)"
    readme = F.when(size == 2, F.concat("readme", F.lit(badges))).otherwise(F.col("readme"))
    out = a.select("id", files_of.logo_candidate(tree, readme, F.col("owner")).alias("logo"))
    return out.select("id", "logo.source", "logo.url")


@query("WITH p AS (SELECT *, replace(p_name, ' ', '-') AS formula FROM part) SELECT p_partkey AS id, min(p_partkey) OVER (PARTITION BY lower(formula)) AS place FROM p")
def j3_formulas(spark, d):
    part = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.replace("p_name", F.lit(" "), F.lit("-")).alias("name"))
    listing = part.select(F.upper("name").alias("name"), F.col("id").alias("ordinal"), F.col("id").cast("string").alias("homepage"))
    return signals.formulas(part, listing).select("id", F.col("formula.homepage").cast("long").alias("place"))
