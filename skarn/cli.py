"""Command line over the library: ``python -m skarn.cli COMMAND --data FOLDER``."""
from __future__ import annotations

import argparse
from collections.abc import Sequence


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="skarn")
    p.add_argument("--data", default=".", help="folder of the parquet tables")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("search", help="one page of hits")
    s.add_argument("query", nargs="?", default="")
    s.add_argument("--where", action="append", default=[], help="a clause such as 'stars >= 100'")
    s.add_argument("--sort", action="append", default=[])
    s.add_argument("--page", type=int, default=1)
    s.add_argument("--limit", type=int, default=20)
    s.add_argument("--archived", action="store_true")
    f = sub.add_parser("facets", help="documents for each value")
    f.add_argument("attributes", nargs="+")
    t = sub.add_parser("tool", help="one document by its full name")
    t.add_argument("name")
    a = sub.add_parser("alternatives", help="other tools of the same kind and domain")
    a.add_argument("name")
    a.add_argument("--limit", type=int, default=10)
    h = sub.add_parser("hot", help="the most momentum")
    h.add_argument("--domain")
    h.add_argument("--limit", type=int, default=10)
    g = sub.add_parser("suggest", help="other queries for one that found nothing, of those that find something")
    g.add_argument("query")
    w = sub.add_parser("rest", help="the public answer to url parameters, as one row")
    w.add_argument("params", nargs="*", help="name=value, such as q=ring or kind=cli,operator")
    r = sub.add_parser("run", help="a registered query")
    r.add_argument("name")
    sub.add_parser("list", help="the registered queries")
    return p


def frame(spark, args: argparse.Namespace):
    """The DataFrame that a command stands for."""
    from pyspark.sql import functions as F

    from skarn import queries, vocabulary
    from skarn.functions import scoring
    from skarn.operators import filters, search
    from skarn.plans.tools import tools

    queries.load()
    if args.command == "run":
        return queries.QUERIES[args.name](spark, args.data)
    t = tools(spark, args.data)
    if args.command == "search":
        size, page = filters.rest_paging(args.limit, args.page)
        return search.search(t, args.query, filters.build_filters(t, clauses=args.where, include_archived=args.archived), args.sort, page, size)
    if args.command == "facets":
        return search.facets(t.where(filters.build_filters(t)), args.attributes)
    if args.command == "suggest":
        words = search.vocabulary_list(vocabulary.standard())
        v = spark.createDataFrame([(x, i) for i, x in enumerate(words)], "word string, position int")
        found = search.suggest_queries(spark.createDataFrame([(args.query,)], "query string"), v)
        asked = [r.suggestion for r in found.collect()]  # four at most
        proven = search.query_totals(t, asked, filters.build_filters(t)) if asked else found.select(F.col("suggestion").alias("query"), F.lit(0).alias("docs"))
        return found.join(proven.withColumnRenamed("query", "suggestion"), "suggestion").orderBy("place").select("suggestion", "docs")
    if args.command == "rest":
        scored = scoring.z_score(t, "raw_momentum", "momentum")
        return search.rest_search(scored, dict(p.split("=", 1) for p in args.params), vocabulary.standard())
    if args.command == "tool":
        return t.where(t.full_name == args.name).limit(1)
    if args.command == "alternatives":
        return search.alternatives(t, args.limit, only=[args.name])
    return search.whats_hot(scoring.z_score(t, "raw_momentum", "momentum"), args.domain, args.limit)


def main(argv: Sequence[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "list":
        from skarn import queries

        queries.load()
        print(*sorted(queries.QUERIES), sep="\n")
        return 0
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("skarn").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    for row in frame(spark, args).toJSON().toLocalIterator():
        print(row)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
