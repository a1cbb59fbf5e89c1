"""Search over a corpus of documents: matching, rank, facets, alternatives, comparison and suggestions."""
from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skarn.sources.shared import written

from . import filters
from .vectors import BLOCK, best

#: Searched attributes by weight, values of a facet at most, and word lengths from which typos are allowed.
SEARCHABLE = ("name", "full_name", "summary", "description", "github_topics", "readme_excerpt")
MAX_FACET_VALUES, ONE_TYPO, TWO_TYPOS = 200, 4, 8


def tokens(query: str | None) -> list[str]:
    return (query or "").lower().split()


def text_of(df: DataFrame, field: str) -> Column:
    """A field as lower-case text: arrays joined by spaces, missing ones empty."""
    many = isinstance(df.schema[field].dataType, T.ArrayType)
    return F.lower(F.coalesce(F.array_join(F.col(field), " ") if many else F.col(field).cast("string"), F.lit("")))


def searched(df: DataFrame, fields: Sequence[str] = SEARCHABLE) -> list[str]:
    return [f for f in fields if f in df.columns]


def matches(df: DataFrame, query: str | None, fields: Sequence[str] = SEARCHABLE) -> Column:
    """Every token occurs in some field; an empty query matches all."""
    texts = [text_of(df, f) for f in searched(df, fields)]
    return filters.everything([reduce(lambda a, b: a | b, [t.contains(w) for t in texts]) for w in tokens(query)])


def field_rank(df: DataFrame, query: str | None, fields: Sequence[str] = SEARCHABLE) -> Column:
    """Index of the first field in which any token occurs; the number of fields if none or without a query."""
    rank = F.lit(len(fields))
    for i, f in reversed(list(enumerate(fields))):
        if f in df.columns and tokens(query):
            hit = reduce(lambda a, b: a | b, [text_of(df, f).contains(w) for w in tokens(query)])
            rank = F.when(hit, F.lit(i)).otherwise(rank)
    return rank


def search(df: DataFrame, query: str | None = None, where: Column | None = None, sort: Sequence[str] = (), number: int = 1, size: int = 20) -> DataFrame:
    """One page of hits with their rank: by field rank, then the sort asked for, else by score."""
    found = df.where(F.lit(True) if where is None else where).where(matches(df, query)).withColumn("rank", field_rank(df, query))
    return filters.page(found, [F.col("rank").asc(), *filters.order(sort or ["score_total"])], number, size)


def facets(df: DataFrame, attributes: Sequence[str], most: int = MAX_FACET_VALUES) -> DataFrame:
    """(attribute, value, docs): documents for each value of each attribute, all attributes in one pass.

    A value counts once for a document, nulls make no value. Each attribute keeps its first ``most``
    values in code point order; the counts are small by then.
    """
    if not attributes:
        return df.select(F.lit("").alias("attribute"), F.lit("").alias("value"), F.lit(0).cast("long").alias("docs")).limit(0)
    def of(attribute: str) -> Column:
        values = F.array_distinct(F.transform(filters.values_of(df, attribute), lambda x: x.cast("string")))
        return F.transform(values, lambda v: F.struct(F.lit(attribute).alias("attribute"), v.alias("value")))

    pairs = [of(a) for a in attributes]
    counts = df.select(F.explode(F.concat(*pairs)).alias("p")).groupBy("p.attribute", "p.value").agg(F.count(F.lit(1)).alias("docs"))
    order = Window.partitionBy("attribute").orderBy("value")
    return counts.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).drop("n")


def top_values(counts: DataFrame, n: int) -> DataFrame:
    """The n most frequent values of each attribute, ties in code point order, with their place."""
    order = Window.partitionBy("attribute").orderBy(F.desc("docs"), "value")
    return counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def labelled(counts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The visible vocabulary (family, value, label, hidden) with counts, 0 where no document has the value."""
    shown = vocabulary.where(~F.col("hidden")).select("family", "value", "label").distinct()
    c = counts.select(F.col("attribute").alias("family"), "value", "docs")
    return shown.join(c, ["family", "value"], "left").withColumn("docs", F.coalesce("docs", F.lit(0)))


def compare(df: DataFrame, names: Sequence[str], key: str = "full_name") -> DataFrame:
    """The named documents in the order asked for, with their place; unknown names are left out."""
    asked = df.sparkSession.createDataFrame([(n, i) for i, n in enumerate(names)], f"`{key}` string, place int")
    return df.join(F.broadcast(asked), key)  # as many rows as the request names


def search_tools(df: DataFrame, query: str | None = None, where: Column | None = None, sort: str = "relevance", number: int = 1, size: int = 20, attributes: Sequence[str] = (), best: int = MAX_FACET_VALUES) -> DataFrame:
    """One row for a request: hits in order, total, page, hits_per_page and facets of all hits.

    ``where``: as filters.build_filters makes it (None: default visibility); sort: a key of filters.SORTS.
    The hits of a page and the values of the facets are bounded, so they fit into a row.
    """
    found = df.where(filters.build_filters(df) if where is None else where).where(matches(df, query)).withColumn("rank", field_rank(df, query))
    by = [F.col("rank").asc(), *filters.order(filters.sort_spec(sort) or ["score_total"])]
    hits = filters.page(found, by, number, size)
    hits = hits.select(F.struct(F.row_number().over(Window.orderBy(*by)).alias("place"), *hits.columns).alias("hit"))
    hits = hits.agg(F.array_sort(F.collect_list("hit")).alias("hits"))
    counts = facets(found, attributes, best).agg(F.array_sort(F.collect_list(F.struct("attribute", "value", "docs"))).alias("facets"))
    total = filters.totals(found, size)
    one = lambda d: d.withColumn("request", F.lit(1))  # noqa: E731  each has one row
    out = one(hits).join(one(total), "request").join(one(counts), "request")
    return out.select("hits", F.col("total_hits").alias("total"), F.lit(number).alias("page"), F.lit(size).alias("hits_per_page"), "facets")


def browse_facets(df: DataFrame, attributes: Sequence[str], where: Column | None = None, best: int = MAX_FACET_VALUES) -> DataFrame:
    """Facets without hits, of what ``where`` shows (None: default visibility)."""
    return facets(df.where(filters.build_filters(df) if where is None else where), attributes, best)


def rest_search(df: DataFrame, params: dict[str, str], vocabulary) -> DataFrame:
    """The public answer to url parameters q, sort, limit, page and facet families: one row with total, page, results and facets."""
    number = lambda name: int(float(params[name])) if re.fullmatch(r"-?\d+(\.\d+)?", params.get(name, "")) else None
    size, page = filters.rest_paging(number("limit") or None, number("page"))
    chosen = filters.selection_from_params(params, {f.param: f.ids(hidden=False) for f in vocabulary.families})
    names = {f.param: filters.family_attribute(f.id) for f in vocabulary.families}
    where = filters.build_filters(df, {names[k]: v for k, v in chosen.items()})
    sort = params.get("sort", "")
    there = [a for a in filters.default_facets(vocabulary) if a.split(".")[0] in df.columns]
    answer = search_tools(df, params.get("q"), where, sort if filters.is_sort_key(sort) else "relevance", page, size, there)
    public = [c for c in ("summary", "kind", "domains", "stars", "install_methods", "repo_url", "indexed_at") if c in df.columns]
    def shown(hit):
        return F.struct(hit.full_name.alias("repo"), *[hit[c].alias(c) for c in public], hit.score_total.alias("score"), F.concat(F.lit("/tools/"), hit.full_name).alias("url"))

    return answer.select("total", "page", F.transform("hits", shown).alias("results"), "facets")


def alternatives(df: DataFrame, n: int = 10, extra: int = 10, only: Sequence[str] | None = None, where: Column | None = None) -> DataFrame:
    """For each document (or those named): others of the same kind that share a domain and have another owner.

    Of what ``where`` shows (None: default visibility) the ``n + extra`` best by score are taken first and
    other owners' kept then, so fewer than n may be left. A document without domains is met by its kind
    alone. The lead of each kind and domain is a small table, which documents are joined with; the join
    adds no rows, and nothing is compared with all.
    """
    asked = df.where(F.col("full_name").isin(list(only))) if only is not None else df
    shown = df.where(filters.build_filters(df) if where is None else where)
    most = n + extra
    hit = F.struct(F.col("score_total").isNull().alias("unscored"), (-F.col("score_total")).alias("negative"), "id", "owner", "full_name")
    flat = shown.select("kind", hit.alias("hit"), F.explode(F.concat(F.array_distinct(F.coalesce("domains", F.array())), F.array(F.lit(None)))).alias("domain"))
    ranked = Window.partitionBy("kind", "domain").orderBy("hit")
    lead = flat.withColumn("r", F.row_number().over(ranked)).where(F.col("r") <= most)
    lead = lead.groupBy("kind", "domain").agg(F.array_sort(F.collect_list("hit")).alias("hits"))
    own = F.when(F.col("domain").isNotNull(), F.struct("domain", "hits"))
    lead = lead.groupBy("kind").agg(F.map_from_entries(F.collect_list(own)).alias("by_domain"), F.max(F.when(F.col("domain").isNull(), F.col("hits"))).alias("all_hits"))
    lead = written(lead, "leads")
    none = F.array().cast(lead.schema["all_hits"].dataType)
    domains = F.array_compact(F.array_distinct(F.coalesce("domains", F.array())))
    met = F.flatten(F.transform(domains, lambda d: F.coalesce(F.try_element_at("by_domain", d), none)))
    near = F.slice(F.when(F.size(domains) == 0, F.col("all_hits")).otherwise(F.array_sort(F.array_distinct(met))), 1, most)
    kept = F.filter(near, lambda h: (h.full_name != F.col("full_name")) & ~h.owner.eqNullSafe(F.col("owner")))
    out = asked.select("kind", F.col("id").alias("for_id"), "full_name", "owner", "domains").join(lead, "kind")
    out = out.select("for_id", F.posexplode(F.slice(kept, 1, n)).alias("p", "h"))
    return out.select("for_id", (F.col("p") + 1).alias("place"), "h.id", "h.full_name", (-F.col("h.negative")).alias("score_total"))


def whats_hot(df: DataFrame, domain: str | None = None, n: int = 10, where: Column | None = None) -> DataFrame:
    """The documents with most momentum, of those that ``where`` shows (None: default visibility)."""
    some = df.where(filters.build_filters(df, {"domains": [domain]} if domain else None) if where is None else where)
    return some.orderBy(F.col("momentum").desc_nulls_last(), "id").limit(n)


def query_totals(df: DataFrame, queries: Sequence[str], where: Column | None = None) -> DataFrame:
    """(query, docs) of the queries that match any document, in one pass over the corpus."""
    some = df.where(where) if where is not None else df
    hits = F.array_compact(F.array(*[F.when(matches(df, q), F.lit(q)) for q in queries]))
    return some.select(F.explode(hits).alias("query")).groupBy("query").agg(F.count(F.lit(1)).alias("docs"))


def typo_match(df: DataFrame, text: Column, word: str) -> Column:
    """Whether a token of the text is the word up to one typo (from 4 letters) or two (from 8)."""
    allowed = 2 if len(word) >= TWO_TYPOS else 1 if len(word) >= ONE_TYPO else 0
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    if not allowed:
        return F.array_contains(words, word)
    return F.exists(words, lambda t: F.levenshtein(t, F.lit(word), allowed) >= 0)


def vocabulary_list(vocabulary, least: int = 4) -> list[str]:
    """The distinct words of the visible values' ids and labels of all facets, in the vocabulary's order."""
    text = [f"{v.id} {v.label}".lower() for f in vocabulary.families if f.facet for v in f.values if not v.hidden]
    return list(dict.fromkeys(w for t in text for w in re.split(r"[\s\-_/]+", t) if len(w) >= least))


def vocabulary_words(vocabulary: DataFrame, least: int = 4) -> DataFrame:
    """Distinct words of the visible values' ids and labels."""
    text = F.lower(F.concat_ws(" ", "value", "label"))
    return vocabulary.where(~F.col("hidden")).select(F.explode(F.split(text, r"[\s\-_/]+")).alias("word")).where(F.length("word") >= least).distinct()


def tolerance(word: Column) -> Column:
    """Edits that a misspelt word may be away: 2 from 8 letters, 1 from 5, else none."""
    return F.when(F.length(word) >= 8, 2).when(F.length(word) >= 5, 1).otherwise(0)


def corrections(words: DataFrame, vocabulary: DataFrame, n: int = 4) -> DataFrame:
    """(word, suggestion, distance, place): vocabulary words within the tolerance of each misspelt word.

    Words of the vocabulary aren't corrected. Equal distances are in the order of the vocabulary's column
    ``position``, if it has one, else of the words. No word is compared with the whole vocabulary: one of k + 1
    parts of a vocabulary word is whole in a word that is k edits away, near its place, so words meet on parts.
    The parts are a small table beside the words', of as many rows as the vocabulary has, some times over.
    """
    place = ["position"] if "position" in vocabulary.columns else []
    vocabulary = vocabulary.select("word", *place)
    asked = words.select("word").distinct().join(vocabulary.select("word"), "word", "left_anti").withColumn("k", tolerance(F.col("word"))).where("k > 0")
    long = F.length("word")
    # words of 5 to 7 letters may be meant by one edit, longer ones by two
    known = vocabulary.withColumn("size", long).select("*", F.explode(F.array(*[F.when(t, F.lit(k)) for k, t in ((1, F.col("size").between(4, 8)), (2, F.col("size") >= 6))])).alias("k")).where("k IS NOT NULL")
    known = _part_places(known.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("k") + 1))))
    known = written(known.select(F.col("word").alias("suggestion"), *place, "k", "size", "i", F.substr("word", F.col("start"), F.col("part_size")).alias("part")), "parts")
    asked = asked.withColumn("own", long).withColumn("size", F.explode(F.sequence(F.col("own") - F.col("k"), F.col("own") + F.col("k"))))
    asked = _part_places(asked.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("k") + 1))))
    # with the first i - 1 parts damaged, a whole part is at most i - 1 places off, and so from the other end
    shift, before, after = F.col("own") - F.col("size"), F.col("i") - 1, F.col("k") + 1 - F.col("i")
    low = F.greatest(F.lit(1), F.col("start") - before, F.col("start") + shift - after)
    high = F.least(F.col("own") - F.col("part_size") + 1, F.col("start") + before, F.col("start") + shift + after)
    asked = asked.select("word", "k", "size", "i", "part_size", F.explode(F.when(low <= high, F.sequence(low, high))).alias("at"))
    asked = asked.select("word", "k", "size", "i", F.substr("word", F.col("at"), F.col("part_size")).alias("part"))
    met = asked.join(known, ["k", "size", "i", "part"]).withColumn("distance", F.levenshtein("word", "suggestion", 2))
    met = met.where((F.col("distance") >= 0) & (F.col("distance") <= F.col("k"))).select("word", "suggestion", "distance", *place).distinct()
    order = Window.partitionBy("word").orderBy("distance", *place, "suggestion")
    return met.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).drop(*place)


def _part_places(df: DataFrame) -> DataFrame:
    """Adds start and part_size: where part i of k + 1 of a word of ``size`` letters is; the later ones take the letters left over."""
    parts = F.col("k") + 1
    base, rest = F.expr("size div (k + 1)").cast("int"), F.col("size") % parts
    longer = F.greatest(F.lit(0), F.col("i") - 1 - (parts - rest))
    return df.withColumns({"start": ((F.col("i") - 1) * base + 1 + longer).cast("int"), "part_size": (base + (F.col("i") > parts - rest).cast("int")).cast("int")})


def suggest_queries(queries: DataFrame, vocabulary: DataFrame, n: int = 4) -> DataFrame:
    """(query, place, suggestion): other queries for each query that found nothing, best first, never the query itself.

    First, one misspelt word at a time is replaced by its nearest word of the vocabulary; then, for a query
    of several words, each word alone. None of them is known to find anything (see query_totals).
    """
    words = F.filter(F.split(F.lower(F.col("query")), r"\s+"), lambda w: w != "")
    asked = queries.select("query").distinct().withColumn("words", words)
    flat = asked.select("query", F.posexplode("words").alias("at", "word"))
    best = corrections(flat, vocabulary, 1).select("word", "suggestion")
    fixed = flat.join(best, "word").groupBy("query").agg(F.array_sort(F.collect_list(F.struct("at", "suggestion"))).alias("fixed"))
    all_ = asked.join(fixed, "query", "left")
    replaced = F.transform(F.coalesce("fixed", F.array()), lambda f: F.array_join(F.transform("words", lambda w, i: F.when(i == f["at"], f.suggestion).otherwise(w)), " "))
    single = F.when(F.size("words") > 1, F.col("words")).otherwise(F.array().cast("array<string>"))
    found = F.array_except(F.array_distinct(F.concat(replaced, single)), F.array(F.array_join("words", " ")))
    out = all_.select("query", F.posexplode(F.slice(found, 1, n)).alias("place", "suggestion"))
    return out.withColumn("place", F.col("place") + 1)


def nearest(queries: DataFrame, vectors: DataFrame, n: int = 10, blocks: int | None = None) -> DataFrame:
    """(query_id, vec_id, cosine, place): the n vectors nearest to each query, by exact comparison with all.

    The stated queries are compared with every vector in blocks (of vectors.BLOCK vectors and queries, unless
    there are given ``blocks``): each block of vectors meets all queries and keeps its own n best before the blocks are merged.
    """
    blocks = blocks or -(-vectors.count() // BLOCK) or 1
    groups = -(-queries.count() // BLOCK) or 1
    every = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")))
    q = queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), F.pmod(F.xxhash64("vec_id"), F.lit(groups)).alias("part")).withColumn("block", every(blocks))
    v = vectors.select("vec_id", F.col("embedding").alias("v"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block")).withColumn("part", every(groups))
    return best(q, v, ["block", "part"], n)


def sidebar(labels: DataFrame, selected: dict[str, Sequence[str]], n: int | None = None) -> DataFrame:
    """Facet groups in display order: selected values first, then by count; values without documents only if selected."""
    chosen = F.lit(False)
    for family, values in selected.items():
        chosen = chosen | ((F.col("family") == family) & F.col("value").isin(list(values)))
    shown = labels.withColumn("selected", chosen).where((F.col("docs") > 0) | F.col("selected"))
    place = F.row_number().over(Window.partitionBy("family").orderBy(F.desc("selected"), F.desc("docs"), "value"))
    shown = shown.withColumn("place", place)
    return shown.where(F.col("selected") | (F.col("place") <= n)) if n else shown


def visible_links(df: DataFrame, vocabulary: DataFrame, families: Sequence[str]) -> DataFrame:
    """(id, family, value, label) of a document's values that the vocabulary shows."""
    pairs = F.concat(*[_tagged(filters.values_of(df, f), f) for f in families])
    flat = df.select("id", F.explode(pairs).alias("p")).select("id", "p.family", "p.value").distinct()
    shown = vocabulary.where(~F.col("hidden")).select("family", "value", "label").distinct()
    return flat.join(F.broadcast(shown), ["family", "value"])  # the closed vocabulary


def _tagged(values: Column, family: str) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(family).alias("family"), v.alias("value")))


def first_words(text: Column, n: int = 40) -> Column:
    """The first n words of a text, as result lists show them."""
    return F.array_join(F.slice(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""), 1, n), " ")


def hybrid(hits: DataFrame, near: DataFrame, weight: float = 0.5, n: int = 10) -> DataFrame:
    """Joins keyword hits (id, rank) and vector hits (id, cosine): reciprocal rank and cosine, weighed, best n."""
    both = hits.select("id", (1 / (1 + F.col("rank"))).alias("k")).join(near.select("id", F.col("cosine").alias("c")), "id", "full")
    score = F.coalesce("k", F.lit(0.0)) * weight + F.coalesce("c", F.lit(0.0)) * (1 - weight)
    return both.select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(n)


def closeness(df: DataFrame, field: str, query: str) -> Column:
    """struct(exact, prefix, gap): whether each query token is a whole token of the field, whether each begins one,
    and the places between the first hits of neighbouring tokens. An approximation of a search server's rules."""
    words = F.split(text_of(df, field), r"[^\p{L}\p{N}]+")
    asked = tokens(query)
    exact = filters.everything([F.array_contains(words, t) for t in asked])
    prefix = filters.everything([_begins(words, t) for t in asked])
    place = [F.array_position(F.transform(words, _starts(t)), True) for t in asked]
    gap = F.lit(0).cast("long")
    for a, b in zip(place[:-1], place[1:], strict=True):
        gap = gap + F.abs(b - a)
    return F.struct(exact.alias("exact"), prefix.alias("prefix"), F.when(prefix, gap).alias("gap"))


def _starts(token: str):
    return lambda w: w.startswith(token)


def _begins(words: Column, token: str) -> Column:
    return F.exists(words, _starts(token))
