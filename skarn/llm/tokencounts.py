"""Token counts: an exact histogram of encoded lengths, whose suffix sums answer for every context limit.

Documents are encoded whole by the byte-level BPE of ``bpe`` and aggregated by length. The histogram has
one row for each length that occurs. For a limit L equal to a length: how many documents are at least
that long, how many tokens they have, and how many tokens remain in all if every document is cut at L;
``share_below`` gives quantiles. Any other limit is answered from the next length above (see ``cut_at``).

Suffix sums run over ranges of lengths and inside a range, so no task sees all lengths.

Defined results: a null or empty text has length 0; an empty table gives no rows; repeated rows count
as often as they occur; other columns are not read.
"""
from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import codec, vocabulary_path
from .common import checkpointed
from .textkernel import chunks, texts

#: Lengths of a range.
RANGE = 4096


def lengths(docs: DataFrame, keys: tuple[str, ...] = (), text: str = "text", path: str | None = None) -> DataFrame:
    """The key columns and n_tokens of each document."""
    inner = docs.select(*keys, text)
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in inner.schema.fields[:-1]) + "n_tokens long"

    def run(batches):
        c = codec(path or vocabulary_path())
        for batch in batches:
            for a, b in chunks(batch, text):
                part = batch.slice(a, b - a)
                _, first = c.encode(*texts(part.column(text)))
                yield pa.RecordBatch.from_arrays([part.column(k) for k in keys] + [pa.array(np.diff(first))], [*keys, "n_tokens"])
        pa.default_memory_pool().release_unused()

    return inner.mapInArrow(run, schema)


def histogram(lengths_: DataFrame) -> DataFrame:
    """(n_tokens, docs, docs_at_least, tokens_at_least, tokens_if_cut, share_below) by length, from (n_tokens)."""
    h = lengths_.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("docs"))
    h = checkpointed(h.withColumn("range", F.floor(F.col("n_tokens") / RANGE)))
    all_docs, all_tokens = h.agg(F.sum("docs"), F.sum(F.col("docs") * F.col("n_tokens"))).first()
    sums = (F.sum("docs").alias("docs_"), F.sum(F.col("docs") * F.col("n_tokens")).alias("tokens_"))
    # one row for each range: as many as the longest text has ranges
    totals = h.groupBy("range").agg(*sums)
    above = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    totals = totals.select("range", *[F.coalesce(F.sum(c).over(above), zero).alias(c) for c in ("docs_", "tokens_")])
    upto = Window.partitionBy("range").orderBy(F.desc("n_tokens"))
    h = h.withColumns({"docs_in": F.sum("docs").over(upto), "tokens_in": F.sum(F.col("docs") * F.col("n_tokens")).over(upto)}).join(totals, "range")
    docs_at, tokens_at = F.col("docs_in") + F.col("docs_"), F.col("tokens_in") + F.col("tokens_")
    return h.select(
        "n_tokens", "docs", docs_at.alias("docs_at_least"), tokens_at.alias("tokens_at_least"),
        (F.lit(all_tokens) - tokens_at + docs_at * F.col("n_tokens")).cast("long").alias("tokens_if_cut"),
        ((F.lit(all_docs) - docs_at).cast("double") / F.lit(all_docs)).alias("share_below"),
    )


def cut_at(hist: DataFrame, limit: int) -> DataFrame:
    """One row (documents over the limit, tokens in all, tokens left if documents are cut at it) for any limit."""
    over = F.col("n_tokens") > limit
    left = F.sum(F.col("docs") * F.least(F.col("n_tokens"), F.lit(limit)))
    return hist.agg(F.coalesce(F.sum(F.when(over, F.col("docs"))), F.lit(0)).alias("docs_over"), F.coalesce(F.sum(F.col("docs") * F.col("n_tokens")), F.lit(0)).alias("tokens"), F.coalesce(left, F.lit(0)).alias("tokens_left"))


def quantile(hist: DataFrame, q: float | str | Fraction) -> DataFrame:
    """One row (n_tokens): the smallest length that at least a share q of the documents don't exceed.

    q counts as the fraction that it is written as (0.1 is one tenth), and whole numbers are compared.
    """
    q = Fraction(str(q))
    wide = lambda c: c.cast("decimal(38,0)")
    all_docs = hist.agg(F.max("docs_at_least").alias("all_docs"))
    upto = F.col("all_docs") - (F.col("docs_at_least") - F.col("docs"))
    enough = wide(upto) * F.lit(q.denominator) >= wide(F.col("all_docs")) * F.lit(q.numerator)
    return hist.join(F.broadcast(all_docs)).where(enough).agg(F.min("n_tokens").alias("n_tokens"))  # one row beside each


def op1_length_histogram(spark, sf_dir):
    return histogram(lengths(spark.read.parquet(f"{sf_dir}/documents.parquet")))
