"""The corpus of tools, derived from the relational tables, as a plan and as its SQL twin."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.functions import scoring
from skarn.sources.shared import shared_path

NOW = "2001-12-31"


def now() -> Column:
    return F.to_timestamp(F.lit(NOW))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Where each session keeps what is made of a folder's tables.
_KEPT: dict[tuple, str] = {}


def source_state(spark: SparkSession, sf_dir: str, names: tuple[str, ...]) -> tuple:
    """Bytes, files and time of change of each table: another state means other data."""
    jvm = spark.sparkContext._jvm
    out = []
    for name in names:
        path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        size = fs.getContentSummary(path)
        out.append((size.getLength(), size.getFileCount(), fs.getFileStatus(path).getModificationTime()))
    return tuple(out)


def kept_path(spark: SparkSession, sf_dir: str, name: str, make, sources: tuple[str, ...] = ("part", "lineitem", "documents"), rebuild: bool = False) -> str:
    """The folder that make(path) has written for a session, a folder of tables and the state of these tables; written once."""
    key = (spark.sparkContext.applicationId, sf_dir, name, source_state(spark, sf_dir, sources))
    if rebuild or key not in _KEPT:
        path = shared_path(spark, name)
        make(path)
        _KEPT[key] = path
    return _KEPT[key]


#: Bytes of a table's files for each partition of its shuffle, about.
PARTITION_BYTES = 16 << 20


def partitions_of(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Partitions that grow with a table, so that a task's rows and what it keeps of them don't; not fewer than there are cores."""
    return max(spark.sparkContext.defaultParallelism, -(-source_state(spark, sf_dir, (name,))[0][0] // PARTITION_BYTES))


#: The columns that make_tools adds.
SCORES = ("popularity", "activity", "adoption", "quality", "quality_coverage", "raw_momentum", "score_total")


def repos(spark: SparkSession, sf_dir: str, rebuild: bool = False) -> DataFrame:
    """Write-model rows: the read model's table without its scores, so texts are stored once."""
    return tools(spark, sf_dir, rebuild).drop(*SCORES)


def tools(spark: SparkSession, sf_dir: str, rebuild: bool = False) -> DataFrame:
    """Read-model rows, made once for a state of their tables and kept as a table in the shared folder: filters and columns of a query reach its scan."""
    make = lambda path: make_tools(make_repos(spark, sf_dir)).write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(kept_path(spark, sf_dir, "tools", make, rebuild=rebuild))


def make_repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write-model rows: one for each part, with its line items folded and its document's text.

    Line items are aggregated before the join, so the join sees one row for each part. A part and a supplier seldom meet twice, so nothing
    is folded before the shuffle: rows of five narrow columns are shuffled once, and all aggregates and the joins keep their partitions.
    """
    row = ("l_partkey", "l_suppkey", "l_quantity", "l_shipdate", (F.col("l_returnflag") == "R").alias("returned"))
    line = table(spark, sf_dir, "lineitem").select(*row).repartition(partitions_of(spark, sf_dir, "lineitem"), "l_partkey").groupBy("l_partkey").agg(
        F.sum("l_quantity").cast("long").alias("stars"), F.count(F.lit(1)).alias("forks"), F.count_if("returned").alias("open_issues"),
        F.countDistinct("l_suppkey").alias("dependents"), F.max("l_shipdate").alias("pushed_at"), F.min("l_shipdate").alias("created_at"),
        F.count_if(F.col("l_shipdate") > F.lit("2000-12-31").cast("timestamp_ntz")).alias("releases_12m"),
    )
    part = table(spark, sf_dir, "part")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    size = F.col("p_size")
    bit = lambda k, name: F.when(size.bitwiseAND(k) > 0, F.struct(F.lit(name).alias("method"), F.concat(F.lit(f"{name} install "), F.replace("p_name", F.lit(" "), F.lit("-"))).alias("command")))
    joined = part.join(line, F.col("p_partkey") == F.col("l_partkey"), "left").join(docs, F.col("p_partkey") == F.col("doc_id"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return joined.select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("owner"), F.col("p_name").alias("name"),
        F.concat("p_brand", F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"), F.col("p_partkey").cast("string")).alias("full_name"),
        F.col("p_type").alias("kind"), F.array_distinct(F.split("p_name", " ")).alias("domains"),
        zero("stars"), zero("forks"), zero("open_issues"), zero("dependents"), zero("releases_12m"), "pushed_at", "created_at",
        F.when(F.col("p_partkey") % 3 != 0, F.col("pushed_at")).alias("released_at"), (size % 17 == 0).alias("archived"),
        ((F.col("p_partkey") % 11) / 10).alias("k8s_relevance"), F.col("lang").alias("language"),
        F.regexp_extract("text", r"^[^\n]*", 0).alias("summary"), F.col("text").alias("readme_excerpt"),
        F.element_at(F.array(*[F.lit(x) for x in ("mit", "gpl-3.0", "busl-1.1", None, "apache-2.0", "own-1.0")]), (size % 6 + 1).cast("int")).alias("license"),
        F.array_compact(F.array(bit(1, "brew"), bit(2, "helm"), bit(4, "krew"))).alias("install_methods"), size.alias("size"), F.col("p_retailprice").alias("price"),
    )


def make_tools(r: DataFrame) -> DataFrame:
    """Read-model rows: repositories with their scores."""
    unless = lambda k, c: F.when(F.col("id") % k != 0, c)
    signals = {
        "license": F.col("license").isNotNull().cast("double"), "releases": F.col("released_at").isNotNull().cast("double"), "docs": F.col("readme_excerpt").isNotNull().cast("double"),
        "not_archived": (~F.col("archived")).cast("double"), "code_review": unless(3, F.col("size") % 11 / 10), "ci_tests": unless(5, F.col("size") % 7 / 10),
        "signed_releases": unless(7, F.col("size") % 5 / 10), "branch_protection": unless(2, F.col("size") % 3 / 10),
    }
    value, coverage = scoring.quality(signals, unless(4, F.col("size") % 6))
    return (
        r.withColumn("popularity", scoring.popularity(F.col("stars")))
        .withColumn("activity", scoring.activity(F.col("pushed_at"), F.col("released_at"), F.col("releases_12m"), unless(3, F.col("size") % 11), now()))
        .withColumn("adoption", scoring.adoption(F.size("install_methods"), unless(6, F.col("dependents"))))
        .withColumn("quality", value)
        .withColumn("quality_coverage", coverage)
        .withColumn("raw_momentum", scoring.raw_momentum(F.col("stars"), F.col("created_at"), F.col("activity"), now()))
        .withColumn("score_total", F.round(scoring.total({k: F.col(k) for k in scoring.TOTAL_WEIGHTS}, F.col("archived")), 6))
    )


#: DuckDB twin of tools(): common table expressions to put before a query.
TOOLS_SQL = """
WITH line AS (SELECT l_partkey, sum(l_quantity)::BIGINT AS stars, count(*) AS forks, count(*) FILTER (l_returnflag = 'R') AS open_issues,
       count(DISTINCT l_suppkey) AS dependents, max(l_shipdate) AS pushed_at, min(l_shipdate) AS created_at,
       count(*) FILTER (l_shipdate > TIMESTAMP '2000-12-31') AS releases_12m FROM lineitem GROUP BY l_partkey),
repos AS (SELECT p_partkey AS id, p_brand AS owner, p_name AS name, p_brand || '/' || replace(p_name, ' ', '-') || '-' || p_partkey AS full_name,
       p_type AS kind, CASE WHEN split_part(p_name, ' ', 1) = split_part(p_name, ' ', 2) THEN [split_part(p_name, ' ', 1)] ELSE string_split(p_name, ' ') END AS domains,
       coalesce(stars, 0)::BIGINT AS stars, coalesce(forks, 0)::BIGINT AS forks, coalesce(open_issues, 0)::BIGINT AS open_issues,
       coalesce(dependents, 0)::BIGINT AS dependents, coalesce(releases_12m, 0)::BIGINT AS releases_12m, pushed_at, created_at,
       CASE WHEN p_partkey % 3 <> 0 THEN pushed_at END AS released_at, p_size % 17 = 0 AS archived, (p_partkey % 11) / 10 AS k8s_relevance,
       lang AS language, regexp_extract(text, '^[^\\n]*') AS summary, text AS readme_excerpt,
       ['mit', 'gpl-3.0', 'busl-1.1', NULL, 'apache-2.0', 'own-1.0'][p_size % 6 + 1] AS license,
       list_filter([CASE WHEN p_size & 1 > 0 THEN 'brew' END, CASE WHEN p_size & 2 > 0 THEN 'helm' END, CASE WHEN p_size & 4 > 0 THEN 'krew' END], lambda x: x IS NOT NULL) AS methods,
       p_size AS size, p_retailprice AS price
     FROM part LEFT JOIN line ON p_partkey = l_partkey LEFT JOIN documents ON p_partkey = doc_id),
aged AS (SELECT *, epoch_us(TIMESTAMP '2001-12-31' - pushed_at) / 8.64e10 AS push_age, epoch_us(TIMESTAMP '2001-12-31' - released_at) / 8.64e10 AS release_age,
       epoch_us(TIMESTAMP '2001-12-31' - created_at) / 8.64e10 AS age, CASE WHEN id % 3 <> 0 THEN size % 11 END AS maintained FROM repos),
parts AS (SELECT *, least(1, greatest(0, log10(stars + 1) / 5)) AS popularity,
       CASE WHEN push_age IS NOT NULL THEN least(1, greatest(0, 1 - push_age / 540)) * 0.5
         + coalesce(CASE WHEN release_age IS NOT NULL THEN least(1, greatest(0, 1 - release_age / 365)) END, 0) * 0.2 + least(1, releases_12m / 6) * 0.15 END AS known,
       least(1, greatest(0, least(1, len(methods) / 3) * 0.7 + coalesce(CASE WHEN id % 6 <> 0 THEN least(1, log10(dependents + 1) / 3) END, 0) * 0.3)) AS adoption,
       [(license IS NOT NULL)::INT, (released_at IS NOT NULL)::INT, (readme_excerpt IS NOT NULL)::INT, (NOT archived)::INT,
        CASE WHEN id % 3 <> 0 THEN size % 11 / 10 END, CASE WHEN id % 5 <> 0 THEN size % 7 / 10 END,
        CASE WHEN id % 7 <> 0 THEN size % 5 / 10 END, CASE WHEN id % 2 <> 0 THEN size % 3 / 10 END]::DOUBLE[] AS v,
       [0.15, 0.1, 0.1, 0.1, 0.15, 0.15, 0.1, 0.1]::DOUBLE[] AS w FROM aged),
scored AS (SELECT *, CASE WHEN maintained IS NULL THEN least(1, greatest(0, known / 0.85)) ELSE least(1, greatest(0, known + least(1, maintained / 10) * 0.15)) END AS activity,
       list_sum(list_transform(range(1, 9), lambda i: CASE WHEN v[i] IS NOT NULL THEN v[i] * w[i] ELSE 0 END)) AS vw,
       list_sum(list_transform(range(1, 9), lambda i: CASE WHEN v[i] IS NOT NULL THEN w[i] ELSE 0 END)) AS ww,
       coalesce(CASE WHEN id % 4 <> 0 THEN least(1, size % 6 / 10) END * 0.3, 0) AS penalty FROM parts),
valued AS (SELECT *, least(1, greatest(0, vw / ww - penalty)) AS quality, least(1, ww / 0.95) AS quality_coverage,
       CASE WHEN activity IS NOT NULL THEN stars / greatest(1, age) * activity END AS raw_momentum FROM scored),
tools AS (SELECT *, round(CASE WHEN archived THEN least(0.35 * popularity + 0.3 * activity + 0.2 * adoption + 0.15 * quality, 0.4)
       ELSE least(1, greatest(0, 0.35 * popularity + 0.3 * activity + 0.2 * adoption + 0.15 * quality)) END, 6) AS score_total FROM valued)
"""
