"""SimHash near-duplicates: fingerprints within a few bits of one another, found by pivot distance tables.

Each text has a 64-bit fingerprint of its three-word shingles. Equal fingerprints are one node. A pivot table holds
a node's Hamming distances to reference fingerprints; distances to one reference of two nodes that differ in k bits
are at most k apart, so pairs whose largest coordinate difference is over MOST_BITS are discarded and
the others are verified bit by bit.

Which nodes meet follows from the same tables: the bits are cut into MOST_BITS + 1 parts, and two
nodes within MOST_BITS agree in one part at least, so there all distances to the references, counted over that
part, are equal. A node is in one bucket for each part, named by these distances. A bucket of over BUCKET
nodes is split in the same way on the bits that its part leaves, again and again, until no bucket is large: nodes differ,
so a bucket whose nodes agree in all but r bits has 2 ** r nodes at most. No pair is lost and no bucket is capped.
A bucket gives a forest of its links, not pairs; connected components of the forests are the classes.

Fingerprint: A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, shingles of three words joined by spaces, with repeats;
XXH64 of each with seed 42; a bit is 1 if more than half of the hashes have it.

Defined results: a text of one or two words has one shingle, all its words; a null text or one without words has
fingerprint zero, which links like any other; a null doc_id is passed on, and names a class only if the class has no other; repeated rows are copies; texts of any length
are taken whole; an empty table gives no rows; other columns are not read.
"""
from __future__ import annotations

from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed
from .graph import components
from .jaccard import _join_labels
from .textkernel import LOWER, Words, by_group, chunks, mix64, texts

SHINGLE, SEED = 3, 42
#: Differing bits of a link, at most.
MOST_BITS = 2
#: References of a table over all bits, and of one over a part.
PIVOTS, PART_PIVOTS = 24, 16
#: Nodes of a bucket that is compared, at most.
BUCKET = 128
#: Bits that are too few to split on.
FEW_BITS = 7
#: Shingles hashed, and pairs compared, in one call.
HASHED, COMPARED = 1 << 16, 1 << 15


@cache
def references(n: int, seed: int = 11) -> np.ndarray:
    """Reference fingerprints, the same everywhere."""
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 64, n, np.uint64)


def distances(prints: np.ndarray, n: int = PIVOTS, mask: np.ndarray | int = 2**64 - 1) -> np.ndarray:
    """The pivot table: a row of distances to n references for each fingerprint, over the bits of the mask (one, or one each)."""
    mask = np.broadcast_to(np.asarray(mask, np.uint64), prints.shape)
    return np.bitwise_count((prints[:, None] ^ references(n)[None, :]) & mask[:, None]).astype(np.int8)


def fingerprints(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The fingerprint of each text of a chunk."""
    from xxhash import xxh64_intdigest

    words = Words(data, offsets)
    n_docs, size = len(words.count), words.end - words.start
    out = np.zeros(n_docs, np.uint64)
    if not len(size):
        return out
    # the words in lower case with one space after each
    ends = np.cumsum(size + 1)
    joined = np.full(int(ends[-1]), 0x20, np.uint8)
    joined[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = LOWER[data[words.marked]]
    begins, ends = ends - size - 1, ends - 1
    # a shingle begins at each word that has two words after it, or at the first of fewer
    many = np.where(words.count > 0, np.maximum(words.count - SHINGLE + 1, 1), 0)
    doc = np.repeat(np.arange(n_docs), many)
    first = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many) + words.first[doc]
    last = np.minimum(first + SHINGLE, words.first[doc + 1]) - 1
    raw = joined.tobytes()
    ones = np.zeros((n_docs, 64), np.int64)
    for a in range(0, len(doc), HASHED):
        b = min(len(doc), a + HASHED)
        h = np.fromiter((xxh64_intdigest(raw[x:y], SEED) for x, y in zip(begins[first[a:b]].tolist(), ends[last[a:b]].tolist(), strict=True)), np.uint64, b - a)
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        here = doc[a:b]
        start = np.flatnonzero(np.diff(here, prepend=-1))
        ones[here[start]] += np.add.reduceat(bits, start, axis=0, dtype=np.int32)
    out = np.packbits(2 * ones > many[:, None], axis=1, bitorder="little").view("<u8").reshape(-1)
    return out.astype(np.uint64)


def with_fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, print): fingerprints as signed 64-bit integers."""
    def run(batches):
        for batch in batches:
            for a, b in chunks(batch, text):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fingerprints(*texts(part.column(text))).view(np.int64))], ["doc_id", "print"])

    return docs.select("doc_id", text).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, print long")


def parts(mask: int, n: int = MOST_BITS + 1) -> list[int]:
    """The mask's bits dealt into n masks in turn."""
    bits = [1 << k for k in range(64) if mask >> k & 1]
    return [sum(bits[i::n]) for i in range(n)]


def _split(most_bits: int):
    """(bucket, rest, print): each node's bucket for each part of the bits that are left, from the same with the bucket so far."""
    def run(batches):
        for batch in batches:
            prints, bucket, rest = (batch.column(c).to_numpy().view(np.uint64) for c in ("print", "bucket", "rest"))
            out = [[], [], []]
            for left in np.unique(rest):
                some = rest == left
                for i, mask in enumerate(parts(int(left), most_bits + 1)):
                    key = mix64(bucket[some] + np.uint64(i + 1))
                    table = distances(prints[some], PART_PIVOTS, mask).view(np.uint64)
                    for column in table.T:
                        key = mix64(key * np.uint64(0xD6E8FEB86659FD93) + column)
                    out[0].append(key)
                    out[1].append(np.full(len(key), int(left) & ~mask, np.uint64))
                    out[2].append(prints[some])
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in out], ["bucket", "rest", "print"])

    return run


def near(prints: np.ndarray, group: np.ndarray, most_bits: int = MOST_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs within ``most_bits`` in the same group; groups lie together."""
    table = distances(prints)
    left, right = [], []
    row, d = np.arange(len(prints)), 0
    while len(row):
        d += 1
        row = row[row + d < len(prints)]
        row = row[group[row] == group[row + d]]
        for a in range(0, len(row), COMPARED):
            some = row[a : a + COMPARED]
            some = some[np.abs(table[some] - table[some + d]).max(1) <= most_bits]
            some = some[np.bitwise_count(prints[some] ^ prints[some + d]) <= most_bits]
            left.append(some)
            right.append(some + d)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64),) * 2


def _compared(most_bits: int):
    """(u, v): a forest of each bucket's links, from rows sorted by bucket."""
    def run(batches):
        for table in by_group(batches, ("bucket",)):
            prints, bucket = table.column("print").to_numpy().view(np.uint64), table.column("bucket").to_numpy()
            left, right = near(prints, np.cumsum(np.diff(bucket, prepend=bucket[0]) != 0), most_bits)
            label = _join_labels(len(prints), left, right)
            linked = np.flatnonzero(label != np.arange(len(prints)))
            yield pa.RecordBatch.from_arrays([pa.array(prints[x].view(np.int64)) for x in (linked, label[linked])], ["u", "v"])

    return run


def links(nodes: DataFrame, most_bits: int = MOST_BITS, bucket: int = BUCKET) -> DataFrame:
    """(u, v): forests that connect the distinct fingerprints (print) as their links do."""
    rows = nodes.select(F.lit(0).cast("long").alias("bucket"), F.lit(-1).cast("long").alias("rest"), "print")
    found = []
    while True:
        rows = checkpointed(rows.mapInArrow(_split(most_bits), "bucket long, rest long, print long"))
        size = checkpointed(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
        rows = rows.join(size, "bucket")
        ready = (F.col("size") <= bucket) | (F.bit_count("rest") <= FEW_BITS)
        met = rows.where(ready).select("bucket", "print").repartition("bucket").sortWithinPartitions("bucket", "print")
        found.append(checkpointed(met.mapInArrow(_compared(most_bits), "u long, v long").distinct()))
        rows = rows.where(~ready).drop("size")
        if rows.isEmpty():
            return reduce(DataFrame.unionByName, found).distinct()


def near_duplicates(docs: DataFrame, text: str = "text", most_bits: int = MOST_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id): component_id is the smallest doc_id that links reach."""
    own = checkpointed(with_fingerprints(docs, text))
    nodes = checkpointed(own.groupBy("print").agg(F.min("doc_id").alias("least")))
    member = components(links(nodes, most_bits))
    member = member.join(nodes, F.col("node") == F.col("print")).select("node", "component", "least")
    classes = checkpointed(member.groupBy("component").agg(F.min("least").alias("class_least")))
    member = checkpointed(member.join(classes, "component").select("node", "class_least"))
    nodes = checkpointed(nodes.join(member, F.col("print") == F.col("node"), "left").select(F.col("print").alias("node"), F.coalesce("class_least", "least").alias("component_id")))
    return own.join(nodes, F.col("print") == F.col("node")).select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op11_pivot_tables(spark, sf_dir):
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
