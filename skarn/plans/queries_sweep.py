"""A whole sweep over a table, and the tree of its windows."""
from __future__ import annotations

from pyspark.sql import functions as F

from skarn.operators import ingest, sweep
from skarn.plans.tools import table
from skarn.queries import query
from skarn.sources.shared import shared_path
from skarn.sources.store import Collection, Store

FOUND = Collection("found", "id string, query_slug string, created string", "id", ("query_slug",))


def order_source(orders, most_hits: int, broken: str = "false"):
    """Orders as a source: a window's hits are the orders of its days, of which the first most_hits are handed out; some windows are out of order."""
    o = orders.select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderstatus").alias("query_slug"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("created"))

    def source(windows):
        ends = F.split("window", r"\.\.")
        w = windows.select("query_slug", "window", ends[0].alias("low"), F.element_at(ends, -1).alias("high"))
        met = w.join(o, "query_slug").where(F.col("created").between(F.col("low"), F.col("high")) & ~F.expr(broken))
        answers = w.join(met.groupBy("query_slug", "window").agg(F.count(F.lit(1)).alias("hits")), ["query_slug", "window"], "left").fillna(0, ["hits"])
        pages = F.ceil(F.least(F.col("hits"), F.lit(most_hits)) / 100)
        error = F.when(F.expr(broken), F.lit("502"))
        answers = answers.select("query_slug", "window", "hits", F.greatest(pages, F.lit(1)).alias("pages"), F.lit(0).cast("long").alias("dropped"), error.alias("error"))
        full = answers.where(F.col("hits") > most_hits).select("query_slug", "window")
        return answers, met.join(full, ["query_slug", "window"], "left_anti").select("id", "query_slug", "created", "window")

    return source


def opened(spark, d, most_hits: int, broken: str = "false"):
    o = table(spark, d, "orders")
    store = Store(spark, shared_path(spark, "sweep"))
    store.ensure([sweep.STATE, sweep.RUNS, FOUND])
    s = sweep.Sweep(store, "found", order_source(o, most_hits, broken), most_hits)
    year = F.date_format(F.trunc("o_orderdate", "year"), "yyyy-MM-dd")
    last = F.concat(F.date_format("o_orderdate", "yyyy"), F.lit("-12-31"))
    s.begin(o.groupBy(F.col("o_orderstatus").alias("query_slug")).agg(F.array(F.concat(F.min(year), F.lit(".."), F.max(last))).alias("windows")))
    return s


@query("SELECT o_orderkey::VARCHAR AS id, o_orderstatus AS query_slug, strftime(o_orderdate, '%Y-%m-%d') AS created FROM orders")
def t8_sweep(spark, d):
    """Sweeps all orders by status: from one window of all years down to what holds 200 hits at most."""
    s = opened(spark, d, max(200, table(spark, d, "orders").count() // 200))
    s.run("r1", lambda: "2001-12-31")
    return s.store.read("found")


@query("""WITH RECURSIVE span AS (SELECT o_orderstatus AS band, min(o_orderdate)::DATE AS a, max(o_orderdate)::DATE AS b FROM orders GROUP BY 1),
t AS (SELECT band, date_trunc('year', a)::DATE AS a, (date_trunc('year', b) + INTERVAL 1 YEAR - INTERVAL 1 DAY)::DATE AS b, 0 AS level FROM span
  UNION ALL (SELECT band, s.x AS a, (s.x + CASE k WHEN 1 THEN INTERVAL 1 YEAR WHEN 2 THEN INTERVAL 3 MONTH WHEN 3 THEN INTERVAL 1 MONTH ELSE INTERVAL 1 DAY END - INTERVAL 1 DAY)::DATE AS b, level + 1 AS level
  FROM (SELECT *, CASE WHEN year(a) < year(b) THEN 1 WHEN b >= a + INTERVAL 300 DAY THEN 2 WHEN b >= a + INTERVAL 80 DAY THEN 3 ELSE 4 END AS k FROM t WHERE a < b) q,
    LATERAL (SELECT unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, CASE k WHEN 1 THEN INTERVAL 1 YEAR WHEN 2 THEN INTERVAL 3 MONTH WHEN 3 THEN INTERVAL 1 MONTH ELSE INTERVAL 1 DAY END))::DATE AS x) s))
SELECT band, CASE WHEN a = b THEN strftime(a, '%Y-%m-%d') ELSE strftime(a, '%Y-%m-%d') || '..' || strftime(b, '%Y-%m-%d') END AS window, level FROM t""")
def t9_window_tree(spark, d):
    """All windows that a sweep of each status could ask for, from all its years down to days."""
    o = table(spark, d, "orders")
    first, last = F.date_format(F.min(F.trunc("o_orderdate", "year")), "yyyy-MM-dd"), F.concat(F.date_format(F.max("o_orderdate"), "yyyy"), F.lit("-12-31"))
    return ingest.window_tree(o.groupBy(F.col("o_orderstatus").alias("band")).agg(F.concat(first, F.lit(".."), last).alias("window")))
