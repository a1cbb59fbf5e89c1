"""Spelling variants: words one edit apart, met on deletion keys from rolling hashes, and grouped under their frequent form.

Words are counted by documents first. Each frequent word gets an integer key for each of its code points deleted, and one
for the whole: from prefix and suffix polynomial hashes modulo 2 ** 61 - 1 of a whole batch of words at once. Deleting any letter of a
run of equal letters gives the same string, so a run has one key with its first and last place. Keys are partitioned by
their high bits and sorted; what shares its key with nothing goes. The others are joined with their words, and from
here on the strings themselves decide: words with the same string after a deletion at the same place differ by
one replaced letter; a word that is another's string after a deletion differs by one inserted or deleted letter. So two
words meet once, in one group of few words (a place of a string has as many variants as there are letters), and links are counted in groups or from rows, never as all pairs.

A word's form is its near word with most occurrences, if they are at least RATIO times its own; forms are followed to
the last by pointer doubling.

Words: maximal runs ``[A-Za-z\\u00C0-\\u00FF]+``, only A-Z lower-cased; a run loses a code point where a checksum of document and run says so (see ``counts``).

Defined results: a null or empty text has no words; a null doc_id counts as an empty one in the checksum; repeated rows count as often
as they occur; ties go to the smaller word in code point order; words and texts of any length are taken whole; an empty table gives
no rows; other columns are not read.
"""
from __future__ import annotations

import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed
from .textkernel import Words, by_group, chunks, texts

#: One in so many checksums deletes a letter; code points and occurrences of a word at least; how much more frequent a form is.
DELETES, LEAST_POINTS, LEAST_COUNT, RATIO = 199, 6, 5, 5
#: Text bytes counted at once, about.
COUNTED = 8 << 20
PRIME = (1 << 61) - 1
BASE = 0x1F3D5B79A2C4E687 % PRIME
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True


def _marked(data: np.ndarray) -> np.ndarray:
    """Bytes of the letters: A-Z, a-z, and U+00C0 to U+00FF, which are C3 and one byte more."""
    out = LETTER[data]
    lead = data == 0xC3
    out |= lead
    out[1:] |= lead[:-1]
    return out


def counts(docs: DataFrame, text: str = "text", least: int = LEAST_POINTS) -> DataFrame:
    """(word, n) of all words of at least so many code points.

    A run loses the code point h % length if DELETES divides h, the crc32 of ``<doc_id>:<run>``: the same for all
    occurrences in a document, so it is worked out once for each document and run.
    """
    def run(batches):
        for batch in batches:
            for a, b in chunks(batch, text, COUNTED):
                part = batch.slice(a, b - a)
                data, offsets = texts(part.column(text))
                found = Words(data, offsets, _marked(data))
                if not len(found.start):
                    continue
                words, code = found.numbered(lower=True)
                key, times = np.unique(found.doc.astype(np.int64) * len(words) + code, return_counts=True)
                doc, code = key // len(words), key % len(words)
                raw = words.to_pylist()
                prefix = [zlib.crc32(b":" if d is None else b"%d:" % d) for d in part.column("doc_id").to_pylist()]
                h = np.fromiter((zlib.crc32(raw[c], prefix[d]) for c, d in zip(code.tolist(), doc.tolist(), strict=True)), np.int64, len(code))
                hit = h % DELETES == 0
                n = np.bincount(code[~hit], times[~hit], len(raw)).astype(np.int64)
                total = {w.decode(): int(k) for w, k in zip(raw, n, strict=True) if k}
                for c, k, x in zip(code[hit].tolist(), times[hit].tolist(), h[hit].tolist(), strict=True):
                    w = raw[c].decode()
                    w = w[: x % len(w)] + w[x % len(w) + 1 :]
                    total[w] = total.get(w, 0) + k
                total = {w: k for w, k in total.items() if len(w) >= least}
                yield pa.RecordBatch.from_arrays([pa.array([*total], pa.string()), pa.array([*total.values()], pa.int64())], ["word", "n"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def times(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    """Products modulo PRIME of values below it, by halves of 31 bits."""
    b = np.asarray(b, np.uint64)
    low, half = np.uint64((1 << 31) - 1), np.uint64(31)
    a1, a0, b1, b0 = a >> half, a & low, b >> half, b & low
    mid = a1 * b0 + a0 * b1
    return _reduced(np.uint64(2) * a1 * b1 + (mid >> np.uint64(30)) + ((mid & np.uint64((1 << 30) - 1)) << half) + a0 * b0)


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & np.uint64(PRIME)) + (x >> np.uint64(61))
    return np.where(x >= np.uint64(PRIME), x - np.uint64(PRIME), x)


def _minus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _reduced(a + np.uint64(PRIME) - b)


def powers(n: int) -> np.ndarray:
    """Powers of the base modulo PRIME, from 0 to n - 1 at least."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate((out, times(out, pow(BASE, len(out), PRIME))))
    return out


@cache
def _usual_powers() -> np.ndarray:
    return powers(1 << 10)


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, word, lo, hi): a key for each word (places -1) and for each run of equal code points from which one is deleted.

    A word's hash is the sum of c[k] * BASE ** k. Without place i it is the prefix before i and the suffix
    after i, the latter one power lower.
    """
    size = np.array([len(w) for w in words], np.int64)
    point = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    start = np.cumsum(size) - size
    word = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(point)) - start[word]
    most = int(size.max()) if len(size) else 0
    power = _usual_powers() if most <= 1 << 10 else powers(most)
    term = times(point + np.uint64(1), power[place])
    # prefix sums of both halves, so that nothing overflows
    half = np.uint64(31)
    low, high = (np.concatenate((np.zeros(1, np.uint64), np.cumsum(x))) for x in (term & np.uint64((1 << 31) - 1), term >> half))

    def between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _reduced(times(_reduced(high[b] - high[a]), 1 << 31) + _reduced(low[b] - low[a]))

    begins = np.ones(len(point), bool)
    begins[1:] = (point[1:] != point[:-1]) | (word[1:] != word[:-1])
    at = np.flatnonzero(begins)
    hi = place[np.append(at[1:], len(point)) - 1] if len(at) else at
    own = start[word[at]]
    prefix, suffix = between(own, at), between(at + 1, own + size[word[at]])
    key = _reduced(prefix + times(suffix, pow(BASE, -1, PRIME)))
    whole = between(start, start + size)
    none = np.full(len(words), -1)
    return np.concatenate((whole, key)).view(np.int64), np.concatenate((np.arange(len(words)), word[at])), np.concatenate((none, place[at])), np.concatenate((none, hi))


def _keyed(batches):
    for batch in batches:
        for a, b in chunks(batch, "word", 1 << 20):
            part = batch.slice(a, b - a)
            key, word, lo, hi = deletion_keys(part.column("word").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(key), part.column("id").take(pa.array(word)), pa.array(lo), pa.array(hi)], ["key", "id", "lo", "hi"])


def _shared(batches):
    """The rows of keys that several rows have; rows come sorted by key."""
    for table in by_group(batches, ("key",)):
        key = table.column("key").to_numpy()
        same = np.zeros(len(key) + 1, bool)
        same[1:-1] = key[1:] == key[:-1]
        kept = np.flatnonzero(same[1:] | same[:-1])
        if len(kept):
            yield from table.select(["id", "lo", "hi"]).take(pa.array(kept)).to_batches()


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best): words with near words, how many, and struct(negative n, word) of the most frequent; from (id, word, n)."""
    rows = words.select("id", "word").mapInArrow(_keyed, "key long, id long, lo long, hi long")
    # by the high bits of the keys, then sorted
    met = rows.repartition(F.shiftright("key", 40)).sortWithinPartitions("key").mapInArrow(_shared, "id long, lo long, hi long")
    lo = F.col("lo").cast("int")
    rest = F.when(lo < 0, F.col("word")).otherwise(F.concat(F.substring("word", F.lit(1), lo), F.substring("word", lo + 2, F.length("word"))))
    own = F.struct((-F.col("n")).alias("negative"), "word").alias("own")
    met = checkpointed(met.join(words, "id").select(rest.alias("rest"), "lo", "hi", own))
    deleted = met.where("lo >= 0")
    one = F.lit(1).cast("long").alias("n_near")
    # a word that is what a deletion leaves of another
    pairs = checkpointed(deleted.select("rest", "own").join(met.where("lo < 0").select("rest", F.col("own").alias("other")), "rest"))
    found = pairs.select("own.word", one, F.col("other").alias("best")).unionByName(pairs.select("other.word", one, F.col("own").alias("best")))
    # words with a letter each at one place of one string
    group = deleted.withColumn("at", F.explode(F.sequence("lo", "hi"))).groupBy("rest", "at").agg(F.sort_array(F.collect_list("own")).alias("all")).where(F.size("all") > 1)
    each = group.select((F.size("all") - 1).cast("long").alias("n_near"), F.slice("all", 1, 2).alias("top"), F.posexplode("all").alias("i", "own"))
    best = F.when(F.col("i") == 0, F.col("top")[1]).otherwise(F.col("top")[0])
    found = found.unionByName(each.select("own.word", "n_near", best.alias("best")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last of each word's forms, from (word, form). Forms grow in number RATIO-fold, so chains are short; doubling halves them."""
    out = checkpointed(forms.select("word", F.col("form").alias("root")))
    while True:
        on = out.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = checkpointed(out.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        out = step.drop("moved")
        if step.where("moved").isEmpty():
            return out


def group_spellings(docs: DataFrame, text: str = "text", least_count: int = LEAST_COUNT, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all frequent words."""
    words = checkpointed(counts(docs, text).where(F.col("n") >= least_count).withColumn("id", F.monotonically_increasing_id()))
    found = words.select("word", "n").join(near_words(words), "word", "left")
    more = -F.col("best.negative")
    is_form = more >= ratio * F.col("n")
    found = checkpointed(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.word")).alias("form"), F.when(is_form, more).alias("form_n")))
    out = found.join(roots(found.where("form IS NOT NULL").select("word", "form")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_deletion_keys(spark, sf_dir):
    return group_spellings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
