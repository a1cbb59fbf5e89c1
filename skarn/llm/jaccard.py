"""N-gram Jaccard join: pairs of texts whose sets of five-word shingles have similarity of 0.8 or more.

Chosen-path join. Texts with equal sets are one node (their copies are never expanded into pairs). In each
of several runs a set of n shingles is sent down the path of each shingle whose random value is below
1 / (0.8 n): a pair at the threshold shares about one. A path's bucket with few nodes is compared by brute
force on sketches. What looks alike is kept as a forest, not as pairs, and only the connected components of
all these forests matter.

A large bucket is first dealt into random blocks, each compared in itself: that connects near copies. If the bucket
then lies in one component, nothing in it is left to find. Otherwise it is split on what its nodes don't all have: the
shingles that most of a sample of it has are its common part, and of the rest of its set each node takes
some shingles as longer paths. A linked pair of sizes n and m shares 4/9 (n + m) shingles, so of its rests at least
0.8 n less what is common in n; the smaller that is, the more of its rest a node takes (all of it, if it may be one
shingle), until a pair is missed with 1 - RECALL. Nodes of texts of one template share no more than the template, so their rests part
them at once, however many they are. The new buckets are treated in the same way until all are small. Buckets
with the same common part are one, so that a template's many shingles split its nodes once. A bucket of medium
size, or with few nodes outside of its main component, isn't split: those nodes are compared with all, block by block. So is what is
left if a split doesn't halve the rows in large buckets, so rows shrink with each split.

Only pairs that are linked by common shingles alone could share nothing of their rests: one of the two then has nine tenths
(8/9) of its set in common with the bucket, the other 0.8. These nodes, where they lie outside of the bucket's main
component, are compared in blocks with those that can link to them. A bucket's size alone links nothing.

An exact check inside the components follows, on the whole sets, in pairs of blocks of bounded size: it
counts each node's links and returns the forest of true links. So rows grow with nodes and blocks, not
with pairs, and each link counts once.

Shingles are 52-bit hashes of five words (runs of ``[^\\x20\\x09-\\x0D]``, as they stand); nodes are 64-bit
hashes of sets.

Defined results: a text of one to four words has one shingle, all its words; a text without words has
none, and is a class of its own without links; nulls are texts without words; a null doc_id is passed on
and counts as a document; repeated rows are copies; an empty table gives no rows; other columns are not
read.
"""
from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, fresh, small
from .graph import components
from .textkernel import Words, by_group, chunks, mix64, texts, windows

SHINGLE = 5
#: Similarity as a fraction, so that the check is exact.
NUMERATOR, DENOMINATOR = 4, 5
LEVEL = NUMERATOR / DENOMINATOR
#: Pairs at the threshold that candidate search may miss: one in ten thousand.
RECALL = 0.9999
RUNS = math.ceil(-math.log(1 - RECALL))
BINS = 128
#: Nodes of a bucket that is compared by brute force, at most, and of a block of larger buckets, about.
SMALL_BUCKET = 128
#: Nodes of a large bucket that tell its common part, about.
COMMON_FROM = 32
#: Nodes whose documents are picked out before their shingles are made, at most: a broadcast of one doc_id each.
PICKED = 1_000_000
#: Blocks of a large bucket, or of its nodes outside of its main component, up to which these are compared with all: about as many
#: rows for each node as a split makes.
MEDIUM_BLOCKS, FEW_BLOCKS = 16, 16
#: Shingles of common parts that are broadcast, at most.
BROADCAST_SHINGLES = 1_000_000
#: Nodes of a block of the exact check, about.
BLOCK = 384
#: Pairs of sketches compared in one call.
COMPARED = 1 << 14
#: Documents of a chunk, as their numbers share a word with the shingles.
MOST_DOCS = 4096


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles (52 bits, ascending) of each text one after the other, and where each text's begin."""
    words = Words(data, offsets)
    hashes = words.hashes()
    value, place = windows(hashes, words.first, SHINGLE)
    doc = words.doc[place]
    few = np.flatnonzero((words.count > 0) & (words.count < SHINGLE))
    if len(few):
        own = np.zeros(len(few), np.uint64)
        for k in range(SHINGLE - 1):
            more = words.count[few] > k
            own[more] = mix64(own[more] * np.uint64(0xD6E8FEB86659FD93) + hashes[words.first[few[more]] + k])
        value = np.concatenate((value, mix64(own + np.uint64(1))))
        doc = np.concatenate((doc, few))
    both = np.unique((doc.astype(np.uint64) << np.uint64(52)) | (value >> np.uint64(12)))
    doc = (both >> np.uint64(52)).astype(np.int64)
    return both & np.uint64((1 << 52) - 1), np.searchsorted(doc, np.arange(len(offsets)))


def _sums(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value)))
    return total[first[1:]] - total[first[:-1]]


def node_ids(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each set."""
    n = np.diff(first).astype(np.uint64)
    return mix64(_sums(mix64(value + np.uint64(0x51ED270B)), first) ^ mix64(_sums(mix64(value ^ np.uint64(0x9E3779B97F4A7C15)), first) + n)).view(np.int64)


def sketches(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One-permutation sketches: 16 bits of the smallest value in each of BINS bins, 0 for an empty one."""
    n_docs = len(first) - 1
    h = mix64(value + np.uint64(0xA24BAED4963EE407))
    doc = np.repeat(np.arange(n_docs), np.diff(first))
    least = np.full(n_docs * BINS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, doc * BINS + (h >> np.uint64(57)).astype(np.int64), h & np.uint64((1 << 57) - 1))
    short = (mix64(least) >> np.uint64(48)).astype(np.uint16)
    return np.where(least == np.iinfo(np.uint64).max, 0, np.maximum(short, 1)).astype(np.uint16).reshape(n_docs, BINS)


def _limits(n: np.ndarray) -> np.ndarray:
    """Random values below this are chosen: a share of 1 / (LEVEL n)."""
    return np.minimum(2.0**64 / (LEVEL * np.maximum(n, 1)), 2.0**64 - 4096).astype(np.uint64)


def first_paths(value: np.ndarray, first: np.ndarray, runs: int = RUNS) -> tuple[np.ndarray, np.ndarray]:
    """The paths of all runs of each set, one after the other, and where each set's begin."""
    n = np.diff(first)
    limit = np.repeat(_limits(n), n)
    doc = np.repeat(np.arange(len(n)), n)
    path, of = [], []
    for run in range(runs):
        u = mix64(value + np.uint64((run * 0x9FB21C651E98DF25 + 0x2545F491) & (2**64 - 1)))
        hit = np.flatnonzero(u < limit)
        path.append(mix64(u[hit] + np.uint64(run)))
        of.append(doc[hit])
    path, of = np.concatenate(path), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return path[order].view(np.int64), np.searchsorted(of[order], np.arange(len(n) + 1))


def _shingled(docs: DataFrame, text: str, columns, schema: str) -> DataFrame:
    """doc_id and what ``columns`` makes of the sets of a chunk."""
    def run(batches):
        for batch in batches:
            for a, b in chunks(batch, text, rows=MOST_DOCS):
                part = batch.slice(a, b - a)
                made = columns(*shingles(*texts(part.column(text))))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *made.values()], ["doc_id", *made])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text).mapInArrow(run, f"doc_id {kind}, {schema}")


def _binary(rows: np.ndarray, first: np.ndarray | None = None) -> pa.Array:
    """Rows of a matrix, or runs of a flat array, as binary values."""
    raw = np.ascontiguousarray(rows)
    ends = np.arange(len(raw) + 1) * raw[:1].nbytes if first is None else first * raw.itemsize
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(raw)])


def _sketch_columns(value, first):
    path, at = first_paths(value, first)
    return {"node": pa.array(node_ids(value, first)), "n": pa.array(np.diff(first)), "sketch": _binary(sketches(value, first)), "paths": pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(path))}


def _set_columns(value, first):
    return {"node": pa.array(node_ids(value, first)), "n": pa.array(np.diff(first)), "tokens": _binary(value, first)}


def _token_columns(value, first):
    return {"node": pa.array(node_ids(value, first)), "tokens": pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(value.view(np.int64)))}


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint16, (at[-1] - at[0]) // 2, at[0]).reshape(len(column), BINS)


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sketches allow the threshold: their share of equal bins is no more than four deviations below it."""
    used = np.maximum(((a | b) != 0).sum(1), 1)
    same = ((a == b) & (a != 0)).sum(1)
    return same / used >= np.maximum(LEVEL - 4 * np.sqrt(LEVEL * (1 - LEVEL) / used), 0.25)


def _join_labels(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest row of each row's connected component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _brute_force(batches):
    """(u, v) forests of the nodes that look alike in the same blocks but lie in different components; rows come sorted by path, i, j."""
    keys = ("path", "i", "j")
    for table in by_group(batches, keys):
        node, component, sketch = table.column("node").to_numpy(), table.column("c").to_numpy(), _matrix(table.column("sketch"))
        change = np.zeros(len(node), bool)
        for k in keys:
            c = table.column(k).to_numpy()
            change[1:] |= c[1:] != c[:-1]
        group = np.cumsum(change)
        left, right = [], []
        row = np.arange(len(node))
        for d in range(1, len(node)):
            row = row[row + d < len(node)]
            row = row[group[row] == group[row + d]]
            if not len(row):
                break
            apart = row[component[row] != component[row + d]]
            for a in range(0, len(apart), COMPARED):
                some = apart[a : a + COMPARED]
                hit = some[alike(sketch[some], sketch[some + d])]
                left.append(hit)
                right.append(hit + d)
        if left:
            label = _join_labels(len(node), np.concatenate(left), np.concatenate(right))
            linked = np.flatnonzero(label != np.arange(len(node)))
            yield pa.RecordBatch.from_arrays([pa.array(node[linked]), pa.array(node[label[linked]])], ["u", "v"])


def _buckets(rows: DataFrame) -> DataFrame:
    """Adds bucket, the number of nodes on the same path, and leaves out nodes that are alone.

    The sizes are kept before the join, so that both its sides are plain shuffles and the rows of a very
    common path can be split over tasks.
    """
    size = checkpointed(rows.groupBy("path").agg(F.count(F.lit(1)).alias("bucket")).where("bucket > 1"))
    return checkpointed(rows.join(size, "path"))


def _compared(rows: DataFrame, sketch: DataFrame) -> DataFrame:
    """(u, v): a forest of what looks alike among (path, i, j, node, c) with the same path, i and j, and another c."""
    met = rows.join(sketch, "node").select("path", "i", "j", "node", "c", "sketch")
    met = met.repartition("path", "i", "j").sortWithinPartitions("path", "i", "j")
    return checkpointed(met.mapInArrow(_brute_force, "u long, v long").distinct())


def _mixed(rows: DataFrame) -> DataFrame:
    """The rows (path, node, c, ...) of buckets whose nodes lie in several components; adds main, the component with most of the bucket's nodes, others, the number of nodes outside of it, and bucket, that of all."""
    size = rows.groupBy("path", "c").agg(F.count(F.lit(1)).alias("size"))
    most = size.groupBy("path").agg(F.max_by("c", F.struct("size", "c")).alias("main"), (F.sum("size") - F.max("size")).alias("others"), F.sum("size").alias("bucket"))
    return checkpointed(rows.join(checkpointed(most.where("others > 0")), "path"))


def _across(every: DataFrame, some: DataFrame) -> DataFrame:
    """(path, i, j, node, c): of each path, ``some`` nodes in blocks i meet ``every`` one in blocks j."""
    def blocks(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("path").agg(F.ceil(F.count(F.lit(1)) / SMALL_BUCKET).alias(name))

    size = checkpointed(blocks(some, "ni").join(blocks(every, "nj"), "path"))
    zero, own = F.lit(0).cast("long"), F.xxhash64("node", "path")
    left = some.join(size, "path").select("path", F.pmod(own, F.col("ni")).alias("i"), F.explode(F.sequence(zero, F.col("nj") - 1)).alias("j"), "node", "c")
    right = every.join(size, "path").select("path", F.explode(F.sequence(zero, F.col("ni") - 1)).alias("i"), F.pmod(own, F.col("nj")).alias("j"), "node", "c")
    return left.unionByName(right)


def _named(rows: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, node, c) of large buckets by their common part, and the common parts (path, shared).

    The common part is what most of some COMMON_FROM nodes of the bucket have; path becomes a hash of it, so
    buckets with the same common part are one. Any common part gives right results; this one gives small rests.
    """
    some = rows.where(F.pmod(F.xxhash64("node", "path", F.lit(13)), F.ceil(F.col("bucket") / COMMON_FROM)) == 0).select("path", "node")
    size = some.groupBy("path").agg(F.count(F.lit(1)).alias("size"))
    often = some.join(sets, "node").select("path", F.explode("tokens").alias("token")).groupBy("path", "token").agg(F.count(F.lit(1)).alias("k")).join(size, "path").where("2 * k > size")
    common = often.groupBy("path").agg(F.sort_array(F.collect_list("token")).alias("shared"))
    common = rows.select("path").distinct().join(common, "path", "left").withColumn("shared", F.coalesce("shared", F.array().cast("array<long>")))
    common = checkpointed(common.withColumn("name", F.xxhash64("shared")))
    names = small(common.select("path", "name"))
    named = rows.join(names, "path").select(F.col("name").alias("path"), "node", "c").distinct()
    return checkpointed(named), checkpointed(common.dropDuplicates(["name"]).select(F.col("name").alias("path"), "shared"))


def _rests(named: DataFrame, common: DataFrame, sets: DataFrame) -> DataFrame:
    """(path, node, c, n, common, rest): a node's shingles beyond its bucket's common part, and how many are common."""
    total = common.agg(F.coalesce(F.sum(F.size("shared")), F.lit(0)) + F.count(F.lit(1))).first()[0]
    rows = named.select("path", "node", "c").join(F.broadcast(common) if total <= BROADCAST_SHINGLES else common, "path")
    out = rows.join(sets, "node").select("path", "node", "c", F.size("tokens").alias("n"), F.array_except("tokens", "shared").alias("rest"))
    return checkpointed(out.withColumn("common", F.col("n") - F.size("rest")))


def _longer(rests: DataFrame) -> DataFrame:
    """(path, node, c): the nodes on longer paths, each with one shingle of its rest more."""
    least = F.greatest(F.lit(1.0), F.ceil(F.col("n") * F.lit(NUMERATOR) / DENOMINATOR - F.col("common")).cast("double"))
    # a shingle is taken with the same random value by all nodes; the pair's smaller share counts, and with it its larger ``least``
    share = F.when(least > 1, 1 - F.pow(F.lit(1 - RECALL), 1 / least)).otherwise(1.0)
    chosen = F.filter("rest", lambda t: F.pmod(F.xxhash64(t, F.col("path"), F.lit(7)), F.lit(1 << 30)) < F.col("limit"))
    rows = rests.withColumn("limit", F.ceil(share * (1 << 30)).cast("long"))
    return rows.select("path", "node", "c", F.explode(chosen).alias("t")).select(F.xxhash64("path", "t", F.lit(9)).alias("path"), "node", "c").distinct()


def candidates(nodes: DataFrame, sets) -> DataFrame:
    """(u, v): a forest over nodes that may be linked, from (node, sketch, paths).

    sets: a function from some of the nodes (node) to (node, tokens), their shingles; called for nodes of large buckets only.
    """
    # sketches are long, so rows on paths are kept without them
    sketch = nodes.select("node", "sketch")
    level = _buckets(nodes.select("node", F.col("node").alias("c"), F.explode(F.array_distinct("paths")).alias("path")))
    large, one = F.col("bucket") > SMALL_BUCKET, F.lit(0).cast("long")
    found, known, before = [], None, None
    outside = F.col("c") != F.col("main")
    while True:
        found.append(_compared(level.where(~large).select("path", one.alias("i"), one.alias("j"), "node", "c"), sketch))
        level = level.where(large)
        if level.isEmpty():
            break
        rows = level.withColumn("block", F.pmod(F.xxhash64("path", "node"), F.ceil(F.col("bucket") / SMALL_BUCKET)))
        found.append(_compared(rows.select("path", F.col("block").alias("i"), F.col("block").alias("j"), "node", "c"), sketch))
        member = components(reduce(DataFrame.unionByName, found))
        rows = rows.drop("c").join(member, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
        rows = _mixed(checkpointed(rows.drop("bucket")))
        if rows.isEmpty():
            break
        if known is None:
            known = checkpointed(sets(rows.select("node").distinct()))
            sketch = checkpointed(sketch.join(known.select("node"), "node", "left_semi"))
        named, common = _named(rows, known)
        rows = _mixed(named)
        ready = (F.col("bucket") <= MEDIUM_BLOCKS * SMALL_BUCKET) | (F.col("others") <= FEW_BLOCKS * SMALL_BUCKET)
        now = rows.where(~ready).count()
        stuck = before is not None and 2 * now > before
        some = rows if stuck else rows.where(ready)
        found.append(_compared(_across(some, some.where(outside)), sketch))
        if stuck or not now:
            break
        before = now
        rests = _rests(rows.where(~ready), common, known)
        # linked by common shingles alone: one of the two is nearly all common
        able = _mixed(rests.where(NUMERATOR * F.col("n") <= DENOMINATOR * F.col("common")))
        core = (NUMERATOR + DENOMINATOR) * F.col("common") >= 2 * NUMERATOR * F.col("n")
        found += [_compared(_across(able.where(core), able.where(outside)), sketch), _compared(_across(able.where(~core), able.where(core & outside)), sketch)]
        level = _buckets(_longer(rests))
    return reduce(DataFrame.unionByName, found).distinct()


def _exact(batches):
    """Links of each node inside a pair of blocks, and a forest of the linked: (node, links, documents, to)."""
    for table in by_group(batches, ("component", "i", "j")):
        keys = np.stack([table.column(k).to_numpy() for k in ("component", "i", "j")], 1)
        cut = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
        node, n, copies, block = (table.column(k).to_numpy() for k in ("node", "n", "copies", "block"))
        token_column = table.column("tokens").combine_chunks().cast(pa.large_binary())
        at = np.frombuffer(token_column.buffers()[1], np.int64)[token_column.offset : token_column.offset + len(n) + 1] // 8
        tokens = np.frombuffer(token_column.buffers()[2], np.uint64)
        out = [[], [], [], []]
        for a, b in zip(np.concatenate(([0], cut)), np.append(cut, len(n)), strict=True):
            a, b = int(a), int(b)
            m = b - a
            inter = _intersections(tokens[at[a] : at[b]], np.diff(at[a : b + 1]))
            linked = (NUMERATOR + DENOMINATOR) * inter >= NUMERATOR * (n[a:b, None] + n[None, a:b])
            np.fill_diagonal(linked, False)
            i, j = keys[a, 1], keys[a, 2]
            if i != j:  # pairs inside a block are counted where it meets itself
                linked &= block[a:b, None] != block[None, a:b]
            left, right = np.nonzero(np.triu(linked))
            label = _join_labels(m, left, right)
            some = linked.any(1)
            out[0].append(node[a:b][some])
            out[1].append(linked.sum(1)[some])
            out[2].append((linked * copies[None, a:b]).sum(1)[some])
            out[3].append(node[a:b][label[some]])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in out], ["node", "links", "documents", "to"])


def _intersections(tokens: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Common tokens of each two sets, from the sets one after the other."""
    m = len(size)
    own = np.repeat(np.arange(m), size)
    order = np.argsort(tokens, kind="stable")
    value, own = tokens[order], own[order]
    new = np.concatenate(([True], value[1:] != value[:-1])) if len(value) else np.zeros(0, bool)
    number = np.cumsum(new) - 1
    often = np.bincount(number) if len(value) else np.zeros(0, np.int64)
    shared = often[number] > 1
    _, column = np.unique(number[shared], return_inverse=True)
    own = own[shared]
    inter = np.zeros((m, m), np.float32)
    width = int(column.max()) + 1 if len(column) else 0
    for start in range(0, width, 4096):
        part = (column >= start) & (column < start + 4096)
        x = np.zeros((m, min(4096, width - start)), np.float32)
        x[own[part], column[part] - start] = 1
        inter += x @ x.T
    return inter.astype(np.int64)


def similar(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row for each document: doc_id, text_id, class_id, n_copies, n_links, n_linked_texts.

    text_id: the smallest doc_id with the same set; class_id: the smallest doc_id of its class, the
    documents connected by links and copies; n_links: documents linked to it, copies among them;
    n_linked_texts: different sets linked to it.
    """
    rows = checkpointed(_shingled(docs, text, _sketch_columns, "node long, n long, sketch binary, paths array<long>"))
    own = rows.select("doc_id", "node", "n")
    with_words = rows.where("n > 0")
    nodes = checkpointed(with_words.groupBy("node").agg(F.min("doc_id").alias("text_id"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("paths").alias("paths")))
    # sets of fewer shingles have no other set within the threshold
    member = components(candidates(nodes.where(F.col("n") >= NUMERATOR), lambda some: _node_sets(docs, text, nodes, some)))
    links, forest = _verified(docs, text, nodes, member)
    group = components(forest).select("node", "component")
    per_node = nodes.select("node", "text_id", "copies").join(links, "node", "left").join(group, "node", "left")
    per_node = checkpointed(per_node.withColumn("component", F.coalesce("component", "node")))
    # kept before the join, so that the nodes of a large class can be split over tasks
    classes = checkpointed(per_node.groupBy("component").agg(F.min("text_id").alias("class_id")))
    per_node = per_node.join(classes, "component").drop("component").withColumnRenamed("node", "node_")
    out = own.join(per_node, (F.col("node") == F.col("node_")) & (F.col("n") > 0), "left")
    zero = F.lit(0).cast("long")
    return out.select(
        "doc_id", F.coalesce("text_id", "doc_id").alias("text_id"), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"),
        (F.coalesce("documents", zero) + F.coalesce("copies", F.lit(1)) - 1).cast("long").alias("n_links"), F.coalesce("links", zero).alias("n_linked_texts"),
    )


def _picked(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The documents that may be the ones in text_id, if these are few enough to be broadcast; else all, as texts aren't shuffled."""
    ids = wanted.where("text_id IS NOT NULL").select(F.col("text_id").alias("id_")).distinct()
    if ids.limit(PICKED + 1).count() > PICKED:
        return docs
    return docs.join(F.broadcast(ids), F.col("doc_id") == F.col("id_"), "left_semi").unionByName(docs.where("doc_id IS NULL"))


def _node_sets(docs: DataFrame, text: str, nodes: DataFrame, some: DataFrame) -> DataFrame:
    """(node, tokens) of some nodes, from one document each."""
    wanted = checkpointed(nodes.join(some, "node", "left_semi").select(F.col("node").alias("node_"), "text_id"))
    made = _shingled(_picked(docs, wanted), text, _token_columns, "node long, tokens array<long>")
    made = made.join(small(wanted), (F.col("node") == F.col("node_")) & F.col("doc_id").eqNullSafe(F.col("text_id")))
    return made.select("node", "tokens").dropDuplicates(["node"])


def _verified(docs: DataFrame, text: str, nodes: DataFrame, member: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, links, documents) of the linked nodes, and the forest (u, v) of true links."""
    size = checkpointed(member.groupBy("component").agg(F.count(F.lit(1)).alias("size")))
    wanted = member.join(size, "component").join(nodes.select("node", "text_id", "copies"), "node")
    wanted = checkpointed(wanted.select(F.col("node").alias("node_"), "component", "size", "text_id", "copies"))
    sets = _shingled(_picked(docs, wanted), text, _set_columns, "node long, n long, tokens binary")
    # one document of each node brings its set
    sets = sets.join(small(wanted), (F.col("node") == F.col("node_")) & F.col("doc_id").eqNullSafe(F.col("text_id"))).dropDuplicates(["node"])
    blocks = F.ceil(F.col("size") / BLOCK)
    sets = sets.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    sets = sets.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    paired = sets.select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "n", "copies", "block", "tokens")
    paired = paired.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
    found = checkpointed(paired.mapInArrow(_exact, "node long, links long, documents long, to long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"), F.sum("documents").alias("documents"))
    return links, found.where("node <> to").select(F.col("node").alias("u"), F.col("to").alias("v")).distinct()


def one_of_each(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents of which one stays for each class: the one with the class's smallest doc_id.

    Documents without a doc_id can't be named and all stay; rows that repeat the doc_id that stays are
    reduced to one.
    """
    found = similar(docs.select("doc_id", text), text)
    (name,) = fresh(docs, "gone")
    gone = found.where(F.col("doc_id") != F.col("class_id")).select(F.col("doc_id").alias(name)).distinct()
    repeated = found.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1")
    out = docs.join(gone, F.col("doc_id") == F.col(name), "left_anti")
    if repeated.isEmpty():
        return out
    return out.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).unionByName(out.where("doc_id IS NULL"))


def op6_chosen_path(spark, sf_dir):
    return similar(spark.read.parquet(f"{sf_dir}/documents.parquet"))
