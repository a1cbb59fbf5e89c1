"""Ranked lexical search: an index of segments with posting blocks, searched by Block-Max WAND.

The index is made in one pass without a shuffle: a task cuts its texts into segments of about SEGMENT_BYTES. In
a segment, each term's postings (document, occurrences) lie in blocks of BLOCK, packed in one, two or four bytes
each. A block keeps its first and last document and its peaks: the pairs of occurrences and document length
that no other posting of the block beats in both. A posting's impact grows with occurrences and falls with length, so the
largest impact over the peaks is the block's exact maximum, whatever the statistics of the whole corpus are.

A search brings together the posting rows of a block of queries and a segment. Pointers move over block ends
only (shallow moves): the pivot is the next document at which the lists that can have reached it hold block
maxima that together meet the threshold, and everything before it is skipped without being unpacked. From the pivot on,
blocks are unpacked and scored as long as their maxima meet the threshold. A query's threshold is the score of
its n-th best document so far; a task keeps it from segment to segment. Each task hands on n documents a query at most, and
a window ranks them.

Terms, weights and scores: see ``TERM``, ``weight`` and ``impact``. N, L and df are counted over all documents.

Defined results: a null or empty text has no terms, is in no result and doesn't count in N; a null query text
has no results; rows with one item_id are one query of all their terms; rows with a null item_id are left out; documents
that repeat a doc_id are ranked each; of equal scores the smaller doc_id comes first, a null doc_id last; texts of
any length are indexed whole; empty tables give no rows; other columns are not read.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .common import shared_path, small
from .textkernel import Words, by_group, chunks, texts

#: Postings of a block; text bytes of a segment, about; queries that meet a segment at once, about.
BLOCK = 128
SEGMENT_BYTES = 16 << 20
QUERIES_AT_ONCE = 1024
#: Pairs of query and term that are broadcast, at most; each is under 100 bytes but for its term.
BROADCAST_PAIRS = 100_000
#: Documents that are scored before the threshold is looked at again.
STRETCH = 1024
NO_DOC = np.iinfo(np.int64).max
#: Bytes of terms: letters and digits of ASCII, and all that isn't ASCII.
TERM = np.zeros(256, bool)
TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
INDEX = "segment long, term binary, docs long, terms long, first array<int>, last array<int>, width array<int>, peaks array<int>, peak_tf array<int>, peak_n array<int>, packed binary, ids array<long>"


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def postings(data: np.ndarray, offsets: np.ndarray):
    """Distinct terms; term number, document and occurrences of each posting, in order; terms of each document."""
    words = Words(data, offsets, TERM[data])
    terms, code = words.numbered(lower=True)
    docs = max(len(words.count), 1)
    key, tf = np.unique(code.astype(np.int64) * docs + words.doc, return_counts=True)
    return terms, key // docs, key % docs, tf, words.count


def _widths(largest: np.ndarray) -> np.ndarray:
    return np.where(largest < 1 << 8, 1, np.where(largest < 1 << 16, 2, 4))


def _packed(values: np.ndarray, width: np.ndarray, at: np.ndarray, out: np.ndarray) -> None:
    """Writes each value in its width, little end first, from its place on."""
    for k in range(4):
        some = width > k
        out[at[some] + k] = (values[some] >> (8 * k)) & 255


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values.astype(np.int32)))


def segment_rows(number: int, ids: pa.Array, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
    """The segment's row of documents (term null: ids, and lengths as packed) and a row for each of its terms."""
    terms, code, doc, tf, n = postings(data, offsets)
    starts_term = np.flatnonzero(np.diff(code, prepend=-1))
    inside = np.arange(len(code)) - np.repeat(starts_term, np.diff(np.append(starts_term, len(code))))
    starts = np.flatnonzero(inside % BLOCK == 0)  # of blocks
    block = np.cumsum(inside % BLOCK == 0) - 1
    size = np.diff(np.append(starts, len(code)))
    gap = np.diff(doc, prepend=0)
    gap[starts_term] = doc[starts_term]
    wide = np.maximum.reduceat(gap, starts) if len(starts) else np.zeros(0, np.int64)
    often = np.maximum.reduceat(tf, starts) if len(starts) else np.zeros(0, np.int64)
    wg, wt = _widths(wide), _widths(often)
    begin = np.concatenate(([0], np.cumsum(size * (wg + wt))))
    out = np.zeros(int(begin[-1]), np.uint8)
    place = np.arange(len(code)) - starts[block]
    _packed(gap, wg[block], begin[block] + place * wg[block], out)
    _packed(tf, wt[block], begin[block] + size[block] * wg[block] + place * wt[block], out)
    # peaks: by length upwards and occurrences downwards, those with more occurrences than all before
    order = np.lexsort((-tf, n[doc], block))
    most = np.maximum.accumulate(tf[order] + block[order] * (1 << 32))
    peak = np.ones(len(order), bool)
    peak[1:] = most[1:] > most[:-1]
    peak = order[peak]
    at_term = np.append(np.searchsorted(starts, starts_term), len(starts))  # blocks of each term
    of_block = np.searchsorted(block[peak], np.arange(len(starts) + 1))
    docs = np.diff(np.append(starts_term, len(code)))
    rows = len(starts_term)
    none = pa.nulls(1)

    def column(first: pa.Array, rest: pa.Array, kind: pa.DataType) -> pa.Array:
        return pa.chunked_array([first.cast(kind), rest.cast(kind)]).combine_chunks()

    ints, doc_of = pa.list_(pa.int32()), code[starts_term]
    packed = pa.BinaryArray.from_buffers(pa.binary(), rows, [None, pa.py_buffer(begin[at_term].astype(np.int32)), pa.py_buffer(out)])
    last = doc[np.append(starts[1:], len(code)) - 1] if len(starts) else starts
    columns = [
        pa.array(np.full(rows + 1, number)), column(none, terms.take(pa.array(doc_of)), pa.binary()), pa.array(np.append(int((n > 0).sum()), docs)), column(pa.array([int(n.sum())]), pa.nulls(rows), pa.int64()),
        column(none, _lists(doc[starts], at_term), ints), column(none, _lists(last, at_term), ints), column(none, _lists(wg * 8 + wt, at_term), ints), column(none, _lists(np.diff(of_block), at_term), ints),
        column(none, _lists(tf[peak], of_block[at_term]), ints), column(none, _lists(n[doc[peak]], of_block[at_term]), ints),
        column(pa.array([n.astype("<i4").tobytes()]), packed, pa.binary()), column(pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.nulls(rows), pa.list_(pa.int64())),
    ]
    return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in INDEX.split(", ")])


def index(docs: DataFrame, text: str = "text", segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """The index of all documents, a table in the shared folder: rows of INDEX."""
    def run(batches):
        number, waiting, size = TaskContext.get().partitionId() << 24, [], 0

        def made():
            table = pa.Table.from_batches(waiting).combine_chunks()
            return segment_rows(number, table.column("doc_id").combine_chunks(), *texts(table.column(text)))

        for batch in batches:
            for a, b in chunks(batch, text, segment_bytes):
                part = batch.slice(a, b - a)
                own = int(texts(part.column(text))[1][-1])
                if waiting and size + own > segment_bytes:
                    yield made()
                    number, waiting, size = number + 1, [], 0
                waiting.append(part)
                size += own
        if waiting:
            yield made()

    path = shared_path(docs.sparkSession, "index")
    docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(run, INDEX).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def query_terms(queries: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item, term): the distinct terms of each query."""
    def run(batches):
        for batch in batches:
            for a, b in chunks(batch, text):
                part = batch.slice(a, b - a)
                terms, code, doc, *_ = postings(*texts(part.column(text)))
                yield pa.RecordBatch.from_arrays([part.column("item").take(pa.array(doc)), terms.cast(pa.binary()).take(pa.array(code))], ["item", "term"])

    return queries.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("item"), text).mapInArrow(run, "item long, term binary").distinct()


class Postings:
    """One term's list in a segment, unpacked block by block when it is asked for."""

    def __init__(self, row: dict, maxima: np.ndarray, m: np.ndarray):
        self.first, self.last, self.width, self.packed, self.maxima, self.m = row["first"], row["last"], row["width"], row["packed"], maxima, m
        size = np.full(len(self.last), BLOCK, np.int64)
        size[-1] = row["docs"] - BLOCK * (len(size) - 1)
        self.size, self.at = size, np.concatenate(([0], np.cumsum(size * (self.width // 8 + self.width % 8))))
        self.blocks: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of a block."""
        if b not in self.blocks:
            size, wg, wt, at = int(self.size[b]), int(self.width[b]) // 8, int(self.width[b]) % 8, int(self.at[b])
            gap = np.frombuffer(self.packed, f"<u{wg}", size, at).astype(np.int64)
            gap[0] = self.first[b]
            tf = np.frombuffer(self.packed, f"<u{wt}", size, at + size * wg).astype(np.int64)
            doc = np.cumsum(gap)
            self.blocks[b] = doc, impact(tf, self.m[doc])
        return self.blocks[b]


class Best:
    """The n best documents of a query so far."""

    def __init__(self, n: int):
        self.n, self.score, self.doc, self.threshold = n, np.zeros(0, np.int64), np.zeros(0, np.int64), 1

    def add(self, score: np.ndarray, doc: np.ndarray) -> None:
        score, doc = np.concatenate((self.score, score)), np.concatenate((self.doc, doc))
        order = np.lexsort((doc, -score))[: self.n]
        self.score, self.doc = score[order], doc[order]
        if len(order) == self.n:
            self.threshold = max(1, int(self.score[-1]))  # an equal score may still win by its doc_id


def block_max_wand(lists: list[tuple[int, Postings]], ids: np.ndarray, best: Best) -> int:
    """Adds a segment's best documents for a query of (weight, list); returns how many documents were scored."""
    # between these ends no list changes its block: shallow moves go from one to the next
    end = np.unique(np.concatenate([np.concatenate((p.last, p.first - 1)) for _, p in lists]))
    end = end[end >= 0]
    bound, where = np.zeros(len(end), np.int64), []
    for w, p in lists:
        b = np.searchsorted(p.last, end)
        there = b < len(p.last)
        there[there] = p.first[b[there]] <= end[there]
        bound[there] += w * p.maxima[b[there]]
        where.append(b)
    j, scored = 0, 0
    while True:
        live = np.flatnonzero(bound[j:] >= best.threshold)
        if not len(live):
            return scored
        j += int(live[0])  # the pivot's interval
        start = int(end[j - 1]) + 1 if j else 0
        dead = np.flatnonzero(bound[j:] < best.threshold)
        stop = j + int(dead[0]) if len(dead) else len(end)
        stop = min(stop, max(j + 1, int(np.searchsorted(end, start + STRETCH))))
        upto = int(end[stop - 1])
        total = np.zeros(upto - start + 1, np.int64)
        for (w, p), b in zip(lists, where, strict=True):
            for k in range(int(b[j]), min(int(b[stop - 1]) + 1, len(p.last))):
                if p.first[k] > upto:
                    break
                doc, value = p.block(k)
                lo, hi = np.searchsorted(doc, (start, upto + 1))
                total[doc[lo:hi] - start] += w * value[lo:hi]
        hit = np.flatnonzero(total >= best.threshold)
        if len(hit):
            best.add(total[hit], ids[hit + start])
        scored += len(total)
        j = stop


def _segment(rows: pa.Table, n_docs: int, n_terms: int) -> tuple[np.ndarray, list[Postings]]:
    """The doc_ids of a segment, and the lists of its other rows; the first row is that of the documents."""
    ids = rows.column("ids")[0].values.fill_null(NO_DOC).to_numpy(zero_copy_only=False)
    n = np.frombuffer(rows.column("packed")[0].as_py(), "<i4").astype(np.int64)
    m = 100 - 50 + (50 * n * n_docs) // n_terms
    rest = rows.slice(1).combine_chunks()
    if not rest.num_rows:
        return ids, []
    flat = {c: rest.column(c).combine_chunks() for c in ("first", "last", "width", "peaks", "peak_tf", "peak_n")}
    tf, length, peaks = (flat[c].flatten().to_numpy().astype(np.int64) for c in ("peak_tf", "peak_n", "peaks"))
    value = impact(tf, 100 - 50 + (50 * length * n_docs) // n_terms)
    maxima = np.maximum.reduceat(value, np.cumsum(peaks) - peaks)
    at = flat["last"].offsets.to_numpy() - flat["last"].offsets[0].as_py()
    first, last, width = (flat[c].flatten().to_numpy() for c in ("first", "last", "width"))
    packed, docs = rest.column("packed").combine_chunks(), rest.column("docs").to_numpy()
    return ids, [Postings({"first": first[a:b], "last": last[a:b], "width": width[a:b], "packed": packed[k].as_buffer(), "docs": docs[k]}, maxima[a:b], m) for k, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True))]


def _searched(n: int, n_docs: int, n_terms: int):
    """(item, doc_id, score) of a task's n best documents of each query, from rows sorted by part, segment and term."""
    def found(best: dict[int, Best]) -> Iterator[pa.RecordBatch]:
        some = {i: b for i, b in best.items() if len(b.score)}
        if some:
            doc = np.concatenate([b.doc for b in some.values()])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat([*some], [len(b.score) for b in some.values()])), pa.array(doc, mask=doc == NO_DOC), pa.array(np.concatenate([b.score for b in some.values()]))], ["item", "doc_id", "score"])

    def run(batches):
        part, best = None, {}
        for table in by_group(batches, ("part", "segment")):
            key = np.stack([table.column(k).to_numpy() for k in ("part", "segment")], 1)
            cut = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            for a, b in zip(np.append(0, cut), np.append(cut, len(key)), strict=True):
                if key[a, 0] != part:
                    yield from found(best)
                    part, best = key[a, 0], {}
                rows = table.slice(int(a), int(b - a))
                ids, lists = _segment(rows, n_docs, n_terms)
                asked: dict[int, list] = {}
                for p, items, df in zip(lists, rows.column("items").to_pylist()[1:], rows.column("df").to_pylist()[1:], strict=True):
                    w = weight(n_docs, df)
                    for i in items:
                        asked.setdefault(i, []).append((w, p))
                for i, terms in asked.items():
                    block_max_wand(terms, ids, best.setdefault(i, Best(n)))
        yield from found(best)

    return run


def search(index_: DataFrame, terms: DataFrame, n: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): the n best documents of each query, from an index and (item, term)."""
    spark = index_.sparkSession
    path = shared_path(spark, "queries")
    terms.write.parquet(path)
    terms = spark.read.parquet(path)
    items, pairs = terms.agg(F.count_distinct("item"), F.count(F.lit(1))).first()
    n_docs, n_terms = index_.where("term IS NULL").agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
    parts = max(1, -(-items // QUERIES_AT_ONCE))
    lists = index_.where("term IS NOT NULL")
    met = small(terms.select("term").distinct(), BROADCAST_PAIRS)
    df = lists.select("term", "docs").join(met, "term", "left_semi").groupBy("term").agg(F.sum("docs").alias("df"))
    part = F.pmod(F.xxhash64("item"), F.lit(parts))
    wanted = terms.groupBy(part.alias("part"), "term").agg(F.collect_list("item").alias("items")).join(df, "term")
    # a part's rows have some 1024 items at most
    wanted = F.broadcast(wanted) if pairs <= BROADCAST_PAIRS else wanted
    rows = lists.join(wanted, "term")
    own = index_.where("term IS NULL").withColumns({"part": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))), "items": F.lit(None).cast("array<long>"), "df": F.lit(None).cast("long")})
    columns = ["part", "segment", "term", "docs", "first", "last", "width", "peaks", "peak_tf", "peak_n", "packed", "ids", "items", "df"]
    met = rows.select(columns).unionByName(own.select(columns)).repartition("part", "segment").sortWithinPartitions("part", "segment", F.col("term").asc_nulls_first())
    best = met.mapInArrow(_searched(n, n_docs, max(n_terms, 1)), "item long, doc_id long, score long")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    return best.withColumn("rank", place).where(F.col("rank") <= n).select(F.col("item").alias("item_id"), "rank", "doc_id", "score")


def op12_block_max_wand(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return search(index(docs), query_terms(items))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS t FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM d) GROUP BY ALL),
n AS (SELECT doc_id, len(t) AS n FROM d WHERE len(t) > 0),
s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM n),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
w AS (SELECT item_id, term, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT AS w FROM q JOIN df USING (term), s),
scored AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // terms))))::BIGINT AS score
           FROM w JOIN tf USING (term) JOIN n USING (doc_id), s GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""
