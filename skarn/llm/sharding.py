"""Sharding by extendible hashing: a directory over hash-prefix bits whose oversized buckets alone split.

Every document goes to the bucket that its hash prefix names. The directory starts with one bucket
of no bits; a bucket over the byte limit splits on its next bit, until each fits. The bucket sizes of
all depths come from one pre-aggregated histogram of leaf prefixes (about eight leaves a shard), so
texts are read once and only (key, hash, bytes) rows are shuffled.

Defined results: a null text has 0 bytes; a null key hashes as the empty string; an empty table gives
no rows; repeated keys share a hash, and where all bits are used up and a bucket of one hash is still
too large, its rows are dealt into numbered overflow shards (suffix ``+n``), each within the limit. A
single document over the limit has a shard of its own. Columns of the input are not passed on.
"""
from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, hash60, small

#: Bytes of a shard at most.
SHARD_BYTES = 8 << 20
HASH_BITS = 60
#: Leaf prefixes have so many bits more than an even split needs.
SLACK_BITS = 3


def _splits(leaves: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """Directory entries (bits, prefix, shard_bytes, fits) at depths low+1..high below oversized buckets.

    leaves: (leaf, n_bytes), leaf being a prefix of ``high`` bits. Entries of ``high`` bits that are
    still oversized come with fits = false.
    """
    depth = F.explode(F.sequence(F.lit(low), F.lit(high - 1))).alias("d")
    bit = F.expr(f"shiftright(leaf, {high} - d - 1) & 1")
    sums = (
        leaves.select("leaf", "n_bytes", "n_rows", depth)
        .select("d", F.expr(f"shiftright(leaf, {high} - d)").alias("p"), "n_bytes", "n_rows", bit.alias("bit"))
        .groupBy("d", "p")
        .agg(
            F.sum("n_bytes").alias("all_bytes"),
            *[F.sum(F.when(F.col("bit") == b, F.col(c))).alias(f"{c}{b}") for b in (0, 1) for c in ("n_bytes", "n_rows")],
        )
        .where(F.col("all_bytes") > limit)
    )
    child = F.explode(F.array(*[F.struct((F.col("p") * 2 + b).alias("prefix"), F.col(f"n_bytes{b}").alias("shard_bytes"), F.col(f"n_rows{b}").alias("n")) for b in (0, 1)]))
    return (
        sums.select((F.col("d") + 1).alias("bits"), child.alias("c"))
        .select("bits", "c.prefix", "c.shard_bytes", "c.n")
        .where((F.col("n") > 0) & ((F.col("shard_bytes") <= limit) | (F.col("bits") == high)))
        .withColumn("fits", F.col("shard_bytes") <= limit)
    )


def _leaf_map(directory: DataFrame, high: int) -> DataFrame:
    """One row for each leaf prefix of ``high`` bits with the directory entry that covers it."""
    first = F.expr(f"shiftleft(prefix, {high} - bits)")
    last = F.expr(f"shiftleft(prefix + 1, {high} - bits) - 1")
    return directory.withColumn("leaf", F.explode(F.sequence(first, last)))


def shard(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = SHARD_BYTES) -> DataFrame:
    """Assigns every row to a shard of ``limit`` bytes at most.

    Returns (key, n_bytes, shard, shard_bits, shard_bytes); shard is the bucket's prefix in binary digits.
    """
    rows = docs.select(F.col(key).alias(key), F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("n_bytes"))
    rows = checkpointed(rows.withColumn("h", hash60(F.col(key))))
    total = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    if total <= limit:
        return rows.select(key, "n_bytes", F.lit("").alias("shard"), F.lit(0).alias("shard_bits"), F.lit(total).cast("long").alias("shard_bytes"))
    high = min(HASH_BITS, math.ceil(math.log2(total / limit)) + SLACK_BITS)
    rows = rows.withColumn("leaf", F.expr(f"shiftright(h, {HASH_BITS - high})"))
    sums = [F.sum("n_bytes").alias("n_bytes"), F.count(F.lit(1)).alias("n_rows")]
    directory = checkpointed(_splits(rows.groupBy("leaf").agg(*sums), 0, high, limit))
    entry = [F.lpad(F.conv("prefix", 10, 2), F.col("bits"), "0").alias("shard"), F.col("bits").alias("shard_bits"), "shard_bytes"]
    mapped = small(checkpointed(_leaf_map(directory.where("fits"), high).select("leaf", *entry)))
    over = directory.where(~F.col("fits")).select(F.col("prefix").alias("leaf"))
    placed = rows.join(mapped, "leaf").select(key, "n_bytes", "shard", "shard_bits", "shard_bytes")
    if over.isEmpty():
        return placed
    # the partition is taken down before rows of one hash are brought together
    rows = rows.withColumn("pid", F.spark_partition_id())
    return placed.unionByName(_deep(rows.join(small(over), "leaf", "left_semi"), key, high, limit))


def _deep(rows: DataFrame, key: str, low: int, limit: int) -> DataFrame:
    """Splits what leaf buckets hold too much of on all further bits, then rows of one hash by running bytes."""
    sums = [F.sum("n_bytes").alias("n_bytes"), F.count(F.lit(1)).alias("n_rows")]
    by_hash = rows.groupBy(F.col("h").alias("leaf")).agg(*sums)
    directory = checkpointed(_splits(by_hash, low, HASH_BITS, limit))
    # a bucket covers few hashes that occur, so hashes are matched by prefix at each depth in use
    depths = [r[0] for r in directory.where("fits").select("bits").distinct().collect()]  # 60 values at most
    own = rows.withColumn("at", F.explode(F.array(*[F.struct(F.lit(d).alias("bits"), F.expr(f"shiftright(h, {HASH_BITS - d})").alias("prefix")) for d in depths]))) if depths else None
    entry = [F.lpad(F.conv("prefix", 10, 2), F.col("bits"), "0").alias("shard"), F.col("bits").alias("shard_bits")]
    parts = []
    if own is not None:
        parts.append(own.select(key, "n_bytes", "at.*").join(directory.where("fits"), ["bits", "prefix"]).select(key, "n_bytes", *entry, "shard_bytes"))
    same = rows.join(directory.where(~F.col("fits")).select(F.col("prefix").alias("h")), "h", "left_semi")
    # rows of one hash: numbered inside the input partition (pid) first, then offset by the partitions before it
    same = checkpointed(same.withColumn("big", F.col("n_bytes") > limit // 2))
    size = F.when(F.col("big"), F.lit(1)).otherwise(F.col("n_bytes"))
    inner = Window.partitionBy("h", "big", "pid").orderBy("n_bytes").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("h", "big").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    offset = same.groupBy("h", "big", "pid").agg(F.sum(size).alias("s")).withColumn("base", F.coalesce(F.sum("s").over(before), zero)).drop("s")
    at = F.col("base") + F.coalesce(F.sum(size).over(inner), zero)
    numbered = same.withColumn("w", size).join(offset, ["h", "big", "pid"]).withColumn("start", at)
    n = F.when(F.col("big"), F.col("start")).otherwise(F.expr(f"start div {max(1, limit // 2)}"))
    name = F.concat(F.lpad(F.conv("h", 10, 2), F.lit(HASH_BITS), "0"), F.when(F.col("big"), F.lit("+b")).otherwise(F.lit("+")), n.cast("string"))
    dealt = numbered.select(key, "n_bytes", name.alias("shard"), F.lit(HASH_BITS).alias("shard_bits"))
    total = dealt.groupBy("shard").agg(F.sum("n_bytes").alias("shard_bytes"))
    parts.append(dealt.join(total, "shard").select(key, "n_bytes", "shard", "shard_bits", "shard_bytes"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def op8_extendible_hashing(spark, sf_dir):
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def small_shards(spark, sf_dir):
    """Shards of 200 KB at most, so that small tables split too; no single document is that long there."""
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"), limit=200_000)


def oracle(limit: int = SHARD_BYTES, depth: int = 24) -> str:
    """The same assignment as DuckDB SQL, for directories of up to ``depth`` bits."""
    return f"""
WITH d AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
                  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
     l AS (SELECT *, h >> ({HASH_BITS} - b) AS p FROM d, (SELECT unnest(range({depth + 1})) AS b)),
     s AS (SELECT *, sum(n_bytes) OVER (PARTITION BY b, p)::BIGINT AS shard_bytes FROM l)
SELECT doc_id, n_bytes, CASE WHEN b = 0 THEN '' ELSE right(repeat('0', 60) || format('{{:b}}', p), b) END AS shard,
       b::INTEGER AS shard_bits, shard_bytes
FROM s WHERE shard_bytes <= {limit} QUALIFY b = min(b) OVER (PARTITION BY doc_id)
"""
