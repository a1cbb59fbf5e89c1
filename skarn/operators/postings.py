"""A positional inverted index for search: which documents hold a token, in which field and where.

Three tables in one folder: postings (a term's documents in a field, with their places), in folders by a checksum of the
term; the distinct terms; and the documents' ids. Terms are of two kinds: words of letters and digits (with their places, for typos,
prefixes and distances), and what stands between white space and isn't such a word (without places). A query's token is a part of a term of
either kind. A query finds its terms in the table of terms, which is much smaller than the texts, and then reads the postings of these terms only.

Postings are made without a shuffle: a task packs what it reads, so that one row has the documents of a term in a segment of about SEGMENT
tokens, and writes its segments' rows to the folders.

Answers equal those of the whole scans in ``search``: matches and field_rank, typo_match, closeness.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.sources.shared import written

from .search import ONE_TYPO, SEARCHABLE, TWO_TYPOS, searched, text_of, tokens

CHUNK, WORD = 0, 1
#: What no word has.
OTHER = r"[^\p{L}\p{N}]"
#: Tokens that are packed at once, about.
SEGMENT = 4_000_000
#: Folders of the postings, each with a file of every task, and the files of a folder that four tasks have written.
BUCKETS, SPREAD = 32, 4


def bucket_of(term: str, buckets: int = BUCKETS) -> int:
    return zlib.crc32(term.encode()) % buckets


def _bucket(term: str, buckets: int) -> Column:
    return (F.crc32(F.col(term).cast("binary")) % buckets).cast("int")


def build(df: DataFrame, path: str, key: str = "id", fields: Sequence[str] = SEARCHABLE, buckets: int = BUCKETS) -> Index:
    """Writes the index of a table's fields (missing ones are left out) to a new folder."""
    text = []
    for f in searched(df, fields):
        chunks, words = F.split(text_of(df, f), r"\s+"), F.split(text_of(df, f), rf"{OTHER}+")
        text += [F.struct(F.lit(fields.index(f)).alias("field"), F.lit(kind).alias("kind"), tokens.alias("tokens")) for kind, tokens in ((CHUNK, F.filter(chunks, lambda t: t.rlike(OTHER))), (WORD, words))]
    rows = _packed(df.select(F.col(key).alias("id"), F.inline(F.array(*text))), len(fields))
    # the write sorts by folder, one small number; an order of terms in a file would serve no reader
    rows.withColumn("bucket", _bucket("term", buckets)).write.partitionBy("bucket").option("compression", "zstd").parquet(f"{path}/postings")
    known = df.sparkSession.read.schema("kind int, term string, bucket int").parquet(f"{path}/postings")
    known.groupBy("kind", "term").agg(F.first("bucket").alias("bucket")).write.option("compression", "zstd").parquet(f"{path}/terms")
    df.select(F.col(key).alias("id")).write.parquet(f"{path}/ids")
    return Index(df.sparkSession, path, len(fields), buckets)


def _packed(rows: DataFrame, fields: int) -> DataFrame:
    """(kind, term, field, ids, ends, places) of (id, field, kind, tokens): one row for a term and field in each segment of a task. ends: where a document's places end."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tokens = [], 0
        for batch in batches:
            held.append(batch)
            tokens += len(batch.column("tokens").flatten())
            if tokens >= SEGMENT:
                yield _segment(held, fields)
                held, tokens = [], 0
        if tokens:
            yield _segment(held, fields)

    return rows.select("id", "field", "kind", "tokens").mapInArrow(pack, f"kind int, term string, field int, ids array<{rows.schema['id'].dataType.simpleString()}>, ends array<int>, places array<int>")


def _segment(batches: Sequence[pa.RecordBatch], fields: int) -> pa.RecordBatch:
    """Tokens are sorted by term, kind and field; what is equal and of one document is a posting, postings of one term, kind and field are a row."""
    table = pa.Table.from_batches(batches).combine_chunks()
    one = lambda name: table.column(name).combine_chunks()
    size = pc.list_value_length(one("tokens")).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(size)), size)
    at = (np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + 1).astype(np.int32)
    terms = one("tokens").flatten().dictionary_encode()
    group = (terms.indices.to_numpy().astype(np.int64) * 2 + one("kind").to_numpy()[row]) * fields + one("field").to_numpy()[row]
    some = np.flatnonzero(pc.not_equal(terms.dictionary, "").to_numpy(zero_copy_only=False)[terms.indices.to_numpy()])
    order = some[np.argsort(group[some], kind="stable")]
    group, row, at = group[order], row[order], at[order]
    first = np.flatnonzero(np.r_[np.ones(min(1, len(group)), bool), (group[1:] != group[:-1]) | (row[1:] != row[:-1])])  # of each posting
    start = np.flatnonzero(np.r_[np.ones(min(1, len(first)), bool), group[first][1:] != group[first][:-1]])  # of each row
    own = group[first][start]
    kind = own // fields % 2
    postings, repeats = np.diff(np.r_[start, len(first)]), np.diff(np.r_[first, len(group)])
    ends = lambda n: pa.array(np.r_[0, np.cumsum(n)].astype(np.int32))
    many = np.add.reduceat(repeats, start) if len(start) else repeats
    end = np.cumsum(repeats) - np.repeat(np.cumsum(many) - many, postings)
    placed = group // fields % 2 == WORD
    return pa.RecordBatch.from_arrays(
        [pa.array(kind.astype(np.int32)), terms.dictionary.take(pa.array(own // fields // 2)), pa.array((own % fields).astype(np.int32)),
         pa.ListArray.from_arrays(ends(postings), one("id").take(pa.array(row[first]))),
         pa.ListArray.from_arrays(ends(np.where(kind == WORD, postings, 0)), pa.array(end[placed[first]].astype(np.int32))), pa.ListArray.from_arrays(ends(np.where(kind == WORD, many, 0)), pa.array(at[placed]))],
        names=["kind", "term", "field", "ids", "ends", "places"],
    )


class Index:
    """Reads an index that ``build`` has written."""

    def __init__(self, spark: SparkSession, path: str, fields: int = len(SEARCHABLE), buckets: int = BUCKETS):
        self.fields, self.buckets = fields, buckets
        self.ids = spark.read.parquet(f"{path}/ids")
        kind = self.ids.schema["id"].dataType.simpleString()
        # an index of nothing has no files to tell the columns
        self.postings = spark.read.schema(f"kind int, term string, field int, ids array<{kind}>, ends array<int>, places array<int>, bucket int").parquet(f"{path}/postings")
        self.terms = spark.read.schema("kind int, term string, bucket int").parquet(f"{path}/terms")

    def containing(self, token: str, kind: int = CHUNK) -> DataFrame:
        """(term): terms of which the token is a part; with CHUNK words too."""
        return self.terms.where((F.col("kind") >= kind) & F.col("term").contains(token)).select("term")

    def near(self, token: str) -> DataFrame:
        """(term): words up to the typos that the token's length allows."""
        k = 2 if len(token) >= TWO_TYPOS else 1 if len(token) >= ONE_TYPO else 0
        words = self.terms.where(F.col("kind") == WORD)
        if not k:
            return words.where(F.col("term") == token).select("term")
        return words.where(F.length("term").between(len(token) - k, len(token) + k) & (F.levenshtein("term", F.lit(token), k) >= 0)).select("term")

    def of(self, terms: DataFrame, kind: int, places: bool = True) -> DataFrame:
        """The postings of (term, ...), one row for a document, from the folders of these terms only; without places, these aren't read."""
        terms = written(terms, "terms")
        folders = [r[0] for r in terms.select(_bucket("term", self.buckets)).distinct().collect()]  # BUCKETS at most
        some = self.postings.where(F.col("bucket").isin(folders) & (F.col("kind") >= kind)).join(terms, "term")
        if not places:
            return some.select(*terms.columns, "field", F.explode("ids").alias("id"))
        before = lambda i: F.coalesce(F.get("ends", i - 1), F.lit(0))
        posting = F.transform("ids", lambda id_, i: F.struct(id_.alias("id"), F.slice("places", before(i) + 1, F.get("ends", i) - before(i)).alias("places")))
        return some.select(*terms.columns, "field", F.inline(posting))

    def matches(self, query: str | None) -> DataFrame:
        """(id, rank): documents in which every token occurs in some field, and the first field that holds any of them."""
        asked = sorted(set(tokens(query)))
        if not asked:
            return self.ids.select("id", F.lit(self.fields).alias("rank"))
        terms = reduce(DataFrame.unionByName, [self.containing(t).withColumn("token", F.lit(i)) for i, t in enumerate(asked)])
        every = reduce(lambda a, b: a & b, [F.bool_or(F.col("token") == i) for i in range(len(asked))])
        return self.of(terms, CHUNK, False).groupBy("id").agg(every.alias("every"), F.min("field").alias("rank")).where("every").select("id", "rank")

    def typos(self, token: str, field: int) -> DataFrame:
        """(id): documents of which a word of the field is the token up to its typos."""
        return self.of(self.near(token), WORD, False).where(F.col("field") == field).select("id").distinct()

    def closeness(self, query: str, field: int) -> DataFrame:
        """(id, exact, prefix, gap) of the documents in which every token begins a word of the field.

        exact: each token is a whole word; gap: the places between the first hits of neighbouring tokens.
        """
        asked = tokens(query)
        terms = reduce(DataFrame.unionByName, [self.containing(t, WORD).where(F.col("term").startswith(t)).withColumn("token", F.lit(i)) for i, t in enumerate(asked)])
        hits = self.of(terms, WORD).where(F.col("field") == field)
        whole = reduce(lambda a, b: a | b, [(F.col("token") == i) & (F.col("term") == t) for i, t in enumerate(asked)])
        by = hits.groupBy("id", "token").agg(F.min(F.col("places")[0]).alias("first"), F.bool_or(whole).alias("exact"))
        by = by.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("token", "first"))).alias("firsts"), F.bool_and("exact").alias("exact"))
        by = by.where(F.size("firsts") == len(asked))
        gap = reduce(lambda a, b: a + b, [F.abs(F.col("firsts")[i + 1]["first"] - F.col("firsts")[i]["first"]) for i in range(len(asked) - 1)], F.lit(0).cast("long"))
        return by.select("id", "exact", F.lit(True).alias("prefix"), gap.cast("long").alias("gap"))
