"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

A source's documents, in a seeded order, are one stream of words cut into blocks of ``block`` words.
Targets come from the weights, limited to ``repeats`` times what a source has, the excess being shared
again by weight. The blocks of the mix go to sources by highest quotients target / (2 j - 1); as that
method is house-monotone, the quotas of output shard k are the seats of house size k less those of
k - 1. Each shard takes its quota of a source's blocks from the seeded stream, where the shard before it
left off; the first begins at a seeded block, and the stream starts over at its end. So no block is taken
twice before all of its source are taken once.

Words taken of a document follow from its place in the stream by arithmetic, so no row is made for a
block. Places come from prefix sums in two levels, (source, hash bucket) and inside a bucket, so that a
source with a third of all rows is spread over many tasks.

Defined results: a null text has size 0 and is taken 0 times; null sources are one source, sorted
last; an empty table gives no rows; repeated rows are separate documents; other columns are not read.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpointed, hash60, prefix_sums, small

BLOCK_WORDS = 32
SHARD_BLOCKS = 65_536
REPEATS = 3
SEED = 17
#: Documents in a bucket of the prefix sums, about.
BUCKET_ROWS = 4096
#: Copies of a row that one task makes, at most.
COPIES = 512


def targets(sources: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """Adds idx, w and target to (source, source_size): weights 1, 2, 3, repeating, in code point order."""
    t = prefix_sums(sources, [F.col("source").asc_nulls_last()], before=F.lit(1))
    t = t.withColumn("idx", F.col("before") + 1).withColumn("w", F.col("before") % 3 + 1)
    total, w_all = t.agg(F.sum("source_size"), F.sum("w")).first()
    # sources that reach their limit first come first; the first that doesn't sets the level for the rest
    order = [F.col("source_size") / F.col("w"), F.col("idx")]
    t = prefix_sums(t, order, full_size=F.col("source_size") * repeats, full_w=F.col("w"))
    t = t.withColumn("left_size", F.lit(total) - F.col("full_size")).withColumn("left_w", F.lit(w_all) - F.col("full_w"))
    t = checkpointed(t)
    fits = F.col("left_size") * F.col("w") <= F.col("source_size") * repeats * F.col("left_w")
    level = t.where(fits).agg(F.max(F.struct("left_w", "left_size")).alias("level")).first().level
    left_w, left_size = level or (1, 0)
    share = F.lit(left_size).cast("double") * F.col("w") / F.lit(left_w)
    capped = F.col("left_w") > left_w
    own = (F.col("source_size") * repeats).cast("double")
    return t.withColumn("target", F.when(capped, own).otherwise(F.least(own, share))).select("source", "source_size", "n_docs", "idx", "w", "target")


def shard_quotas(t: DataFrame, block: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, repeats: int = REPEATS) -> DataFrame:
    """Integer block quotas (idx, shard, first, blocks) of each output shard by Sainte-Lague; first: the source's blocks in earlier shards.

    Starts from rounding target / divisor, which is right for some house size near, and then gives the
    missing seats to the highest next quotients or takes the surplus from the lowest.
    """
    everything = t.agg(F.sum("target")).first()[0] or 0.0
    t = t.withColumn("cap", F.ceil(F.col("source_size") / block) * repeats).withColumn("all", F.lit(everything))
    t = t.where(F.col("target") > 0).withColumn("house", F.round(F.col("all") / block).cast("long"))
    shards = F.sequence(F.lit(1).cast("long"), F.ceil(F.col("house") / shard_blocks))
    t = t.withColumn("shard", F.explode(F.when(F.col("house") > 0, shards)))
    t = t.withColumn("seats", F.least(F.col("shard") * shard_blocks, F.col("house")))
    t = t.withColumn("q0", F.least(F.floor(F.col("target") * F.col("seats") / F.col("all") + 0.5), F.col("cap")))
    t = t.withColumn("diff", F.col("seats") - F.sum("q0").over(Window.partitionBy("shard")))
    # seats to add: j = q0+1 .. q0+diff; seats to take: j = q0 .. q0+diff+1
    low = F.when(F.col("diff") > 0, F.col("q0") + 1).otherwise(F.greatest(F.lit(1), F.col("q0") + F.col("diff") + 1))
    high = F.when(F.col("diff") > 0, F.least(F.col("q0") + F.col("diff"), F.col("cap"))).otherwise(F.col("q0"))
    seats = F.when((F.col("diff") != 0) & (high >= low), F.sequence(low, high))
    c = t.select("idx", "shard", "q0", "diff", "target", F.explode_outer(seats).alias("j"))
    quotient = F.col("target") / (2 * F.col("j") - 1)
    rank = F.row_number().over(Window.partitionBy("shard").orderBy(F.when(F.col("j").isNull(), 1).otherwise(0), F.when(F.col("diff") > 0, -quotient).otherwise(quotient), F.when(F.col("diff") > 0, F.col("idx")).otherwise(-F.col("idx"))))
    moved = F.when(F.col("j").isNotNull() & (rank <= F.abs("diff")), F.signum("diff")).otherwise(0).cast("long")
    q = checkpointed(c.withColumn("moved", moved).groupBy("idx", "shard").agg((F.first("q0") + F.sum("moved")).alias("q")))
    before = q.select("idx", (F.col("shard") + 1).alias("shard"), F.col("q").alias("first"))
    q = q.join(before, ["idx", "shard"], "left").fillna(0, ["first"])
    return q.select("idx", "shard", "first", (F.col("q") - F.col("first")).alias("blocks"))


def sized(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, h) of every row: words, and the hash that orders a source's stream."""
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), hash60(F.lit(seed), F.col("doc_id"), F.md5(F.col("text"))).alias("h"))


def placed(rows: DataFrame, block: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, repeats: int = REPEATS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The sized documents with their places in their source's stream, and the quotas of the shards.

    at: words of the stream before the document; nb, quota: blocks of the source, and of those taken in all
    shards; start: the block that the first shard begins with.
    """
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    plan = targets(sources, repeats)
    shards = checkpointed(shard_quotas(plan, block, shard_blocks, repeats))
    quota = shards.groupBy("idx").agg(F.sum("blocks").alias("quota"))
    plan = plan.join(quota, "idx", "left").withColumn("nb", F.ceil(F.col("source_size") / block)).fillna(0, ["quota"])
    plan = plan.withColumn("start", F.when(F.col("nb") > 0, F.pmod(hash60(F.lit(seed), F.col("source")), F.col("nb"))).otherwise(0))
    plan = plan.withColumn("bits", F.greatest(F.lit(0), F.ceil(F.log2(F.col("n_docs") / BUCKET_ROWS))).cast("int"))
    plan = checkpointed(plan.select("source", "idx", "source_size", "target", "quota", "start", "nb", "bits"))
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    rows = rows.alias("r").join(small(plan).alias("p"), same("r", "p")).select("r.*", *[f"p.{c}" for c in plan.columns if c != "source"])
    rows = rows.withColumn("bucket", F.expr("shiftright(h, 60 - bits)"))
    zero = F.lit(0).cast("long")
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("source", "bucket").agg(F.sum("size").alias("s")).select("source", "bucket", F.coalesce(F.sum("s").over(earlier), zero).alias("base"))
    inside = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("size").over(inside), zero))
    rows = rows.alias("r").join(base.alias("b"), same("r", "b") & (F.col("r.bucket") == F.col("b.bucket"))).select("r.*", "b.base")
    return rows.withColumn("at", F.col("base") + F.col("inner")).drop("bucket", "bits", "base", "inner"), shards


def _words_at(b: Column, block: int) -> Column:
    """The first word of block b of the stream repeated without end."""
    return F.when(F.col("nb") > 0, F.expr("source_size") * F.floor(b / F.col("nb")) + F.least(F.pmod(b, F.col("nb")) * block, F.col("source_size"))).otherwise(F.lit(0)).cast("long")


def _pieces(lo: Column, hi: Column, repeats: int) -> Column:
    """What lies between two words of the repeated stream, of each copy of the document: (copy, from_word, words)."""
    def of(copy):
        begin = F.col("source_size") * copy + F.col("at")
        from_word = F.greatest(lo - begin, F.lit(0).cast("long"))
        return F.struct(copy.alias("copy"), from_word.alias("from_word"), (F.least(hi - begin, F.col("size")) - from_word).alias("words"))

    return F.filter(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(repeats).cast("long")), of), lambda p: p.words > 0)


def mix(docs: DataFrame, block: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, repeats: int = REPEATS, seed: int = SEED) -> DataFrame:
    """Returns (doc_id, source, h, at, size, source_size, target, taken, pieces, first_shard).

    pieces: (copy, from_word, words) of each copy that is taken, whole or in part; first_shard: the output
    shard that the first word taken of it goes to, null if none is.
    """
    rows, shards = placed(checkpointed(sized(docs, seed)), block, shard_blocks, repeats, seed)
    lo, hi = _words_at(F.col("start"), block), _words_at(F.col("start") + F.col("quota"), block)
    rows = rows.withColumn("pieces", _pieces(lo, hi, repeats))
    rows = rows.withColumn("taken", F.aggregate("pieces", F.lit(0).cast("long"), lambda a, p: a + p.words))
    first = F.try_element_at("pieces", F.lit(1))
    word = F.col("at") + first.from_word
    rows = rows.withColumn("block", F.expr("nb") * first.copy + F.floor(word / block) - F.col("start"))
    rows = rows.withColumn("block", F.when(F.col("taken") > 0, F.col("block")))
    found = _in_shard(rows.where("taken > 0"), shards, shard_blocks, "block", "block").withColumnRenamed("shard", "first_shard")
    columns = ["doc_id", "source", "h", "at", "size", "source_size", "target", "taken", "pieces"]
    none = rows.where("taken = 0").withColumn("first_shard", F.lit(None).cast("long"))
    return found.select(*columns, "first_shard").unionByName(none.select(*columns, "first_shard"))


def _in_shard(rows: DataFrame, shards: DataFrame, shard_blocks: int, low: str, high: str) -> DataFrame:
    """Joins rows that hold blocks low..high of those taken from their source with the shards that these go to: shard, first, blocks.

    A shard's quotas are within ``slack`` blocks of its share, so only shards near that place are met, on (idx, shard).
    """
    house = shards.groupBy("shard").agg(F.sum("blocks").alias("b"))
    all_blocks = house.agg(F.sum("b")).first()[0] or 1
    quota = shards.groupBy("idx").agg(F.sum("blocks").alias("quota"))
    near = shards.join(quota, "idx").withColumn("share", F.col("quota") * F.least(F.col("shard") * shard_blocks, F.lit(all_blocks)) / F.lit(all_blocks))
    slack = near.agg(F.ceil(F.max(F.abs(F.col("first") + F.col("blocks") - F.col("share"))))).first()[0] or 0
    rate = F.lit(float(all_blocks)) / (F.col("quota") * shard_blocks)
    last = -(-all_blocks // shard_blocks)
    a = F.greatest(F.lit(1), F.floor((F.col(low) - slack - 1) * rate) + 1)
    b = F.least(F.lit(last), F.floor((F.col(high) + slack + 1) * rate) + 1)
    rows = rows.withColumn("shard", F.explode(F.sequence(a.cast("long"), b.cast("long"))))
    found = rows.join(small(shards), ["idx", "shard"])
    return found.where((F.col(low) < F.col("first") + F.col("blocks")) & (F.col(high) >= F.col("first")))


def mixed_pieces(rows: DataFrame, block: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, repeats: int = REPEATS, seed: int = SEED, by_shard: bool = False) -> DataFrame:
    """(source, h, size, copy, from_word, words) of all that is taken of sized documents; by_shard: cut where an output shard ends, with its shard."""
    columns = ["source", "h", "size", "copy", "from_word", "words"]
    rows, shards = placed(rows, block, shard_blocks, repeats, seed)
    lo, hi = _words_at(F.col("start"), block), _words_at(F.col("start") + F.col("quota"), block)
    rows = rows.select("*", F.inline(_pieces(lo, hi, repeats)))
    if not by_shard:
        return rows.select(*columns)
    word = F.col("at") + F.col("from_word")
    rows = rows.withColumn("low", F.col("nb") * F.col("copy") + F.floor(word / block) - F.col("start"))
    rows = rows.withColumn("high", F.col("nb") * F.col("copy") + F.floor((word + F.col("words") - 1) / block) - F.col("start"))
    rows = _in_shard(rows, shards, shard_blocks, "low", "high")
    begin = F.col("source_size") * F.col("copy") + F.col("at")
    a = F.greatest(begin + F.col("from_word"), _words_at(F.col("start") + F.col("first"), block))
    b = F.least(begin + F.col("from_word") + F.col("words"), _words_at(F.col("start") + F.col("first") + F.col("blocks"), block))
    rows = rows.withColumns({"from_word": a - begin, "words": b - a}).where("words > 0")
    return rows.select("shard", *columns)


def mixed_documents(docs: DataFrame, by_shard: bool = False, **how) -> DataFrame:
    """The mix itself: every document as often as it is taken, copies that are taken in part cut to these words.

    A copy that is cut joins its words by single spaces. by_shard: documents are cut where an output shard
    ends, and a column ``shard`` names it. Of rows with the same source, doc_id and text, the first by all
    columns stands for all; it goes out as often as they are taken together.
    """
    shard = ["shard"] if by_shard else []
    some = checkpointed(sized(docs, how.get("seed", SEED)))
    pieces = mixed_pieces(some, by_shard=by_shard, **how)
    # equal rows make equal pieces, few of which are cut: those at the ends of a source's run and of shards
    pieces = pieces.groupBy("source", "h", "size", "from_word", "words", *shard).agg(F.count(F.lit(1)).alias("n"))
    one = F.struct(*shard, F.when(F.col("words") < F.col("size"), F.struct("from_word", "words")).alias("cut"), "n")
    plan = checkpointed(pieces.groupBy("source", "h").agg(F.collect_list(one).alias("pieces")))
    own = hash60(F.lit(how.get("seed", SEED)), F.col("doc.doc_id"), F.md5(F.col("doc.text")))
    rows = docs.select(F.struct(*docs.columns).alias("doc")).withColumn("own", own).withColumn("from", F.col("doc.source"))
    repeated = checkpointed(some.groupBy("source", "h").count().where("count > 1").select("source", "h"))
    if not repeated.isEmpty():
        same = (F.col("own") == F.col("h")) & F.col("from").eqNullSafe(F.col("source"))
        again = rows.join(repeated, same, "left_semi").groupBy("from", "own").agg(F.min("doc").alias("doc"))
        rows = rows.join(repeated, same, "left_anti").unionByName(again)
    joined = rows.join(plan, (F.col("own") == F.col("h")) & F.col("from").eqNullSafe(F.col("source")))
    joined = joined.select("doc", F.explode("pieces").alias("p")).withColumn("n", F.col("p.n"))
    zero = F.lit(0).cast("long")
    if not plan.where(F.exists("pieces", lambda p: p.n > COPIES)).isEmpty():
        # what goes out very often is dealt to tasks before its copies are made
        dealt = joined.withColumn("part", F.explode(F.sequence(zero, F.floor((F.col("n") - 1) / COPIES))))
        joined = dealt.withColumn("n", F.least(F.lit(COPIES), F.col("n") - F.col("part") * COPIES)).repartition(F.col("doc.doc_id"), F.col("part")).drop("part")
    joined = joined.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    words = F.array_join(F.slice(F.regexp_extract_all("doc.text", F.lit(WORD), F.lit(0)), F.col("p.cut.from_word").cast("int") + 1, F.col("p.cut.words").cast("int")), " ")
    is_cut = F.col("p.cut").isNotNull()
    out = joined.withColumn("words", F.when(is_cut, words).otherwise(F.col("doc.text"))).withColumn("is_cut", is_cut)
    made = {c: F.col("doc")[c] for c in docs.columns} | {"text": F.col("words")}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.when(F.col("is_cut"), F.length("words").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("doc.n_chars"))
    return out.select(*[c.alias(name) for name, c in made.items()], *[F.col(f"p.{c}") for c in shard])


def op9_sainte_lague(spark, sf_dir):
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken", "first_shard")


#: DuckDB SQL of the same mix: quotas by ranking all quotients at once, places by one window.
ORACLE = rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
             ('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(md5(text), '')), 1, 15))::BIGINT AS h
           FROM documents),
     s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS idx FROM d GROUP BY source),
     w AS (SELECT *, (idx - 1) % 3 + 1 AS w FROM s),
     a AS (SELECT *, sum(source_size) OVER ()::BIGINT - coalesce(sum({REPEATS} * source_size) OVER f, 0)::BIGINT AS left_size,
             sum(w) OVER ()::BIGINT - coalesce(sum(w) OVER f, 0)::BIGINT AS left_w
           FROM w WINDOW f AS (ORDER BY source_size / w, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
     v AS (SELECT left_size AS ls, left_w AS lw FROM a WHERE left_size * w <= {REPEATS} * source_size * left_w ORDER BY left_w DESC LIMIT 1),
     t AS (SELECT *, CASE WHEN left_w > lw THEN ({REPEATS} * source_size)::DOUBLE
             ELSE least(({REPEATS} * source_size)::DOUBLE, ls::DOUBLE * w / lw) END AS target,
             ceil(source_size / {BLOCK_WORDS})::BIGINT AS nb FROM a, v),
     seat AS (SELECT * FROM
             (SELECT idx, j, row_number() OVER (ORDER BY target / (2 * j - 1) DESC, idx) AS r,
                round((SELECT sum(target) FROM t) / {BLOCK_WORDS}) AS house
              FROM t, LATERAL (SELECT unnest(range(1, {REPEATS} * nb + 1)) AS j) WHERE target > 0) WHERE r <= house),
     q AS (SELECT idx, count(*) AS quota FROM seat GROUP BY idx),
     p AS (SELECT t.*, coalesce(quota, 0) AS quota, CASE WHEN nb > 0 THEN ('0x' || substr(md5('{SEED}|' || coalesce(source, '')), 1, 15))::BIGINT % nb ELSE 0 END AS start
           FROM t LEFT JOIN q USING (idx)),
     x AS (SELECT d.*, idx, source_size, target, nb, start, quota, CASE WHEN nb > 0 THEN quota // nb ELSE 0 END AS passes, CASE WHEN nb > 0 THEN quota % nb ELSE 0 END AS rest,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS at_
           FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
     y AS (SELECT *, (passes * size + CASE WHEN rest > 0 THEN
             greatest(0, least(at_ + size, (start + rest) * {BLOCK_WORDS}, source_size) - greatest(at_, start * {BLOCK_WORDS}))
             + greatest(0, least(at_ + size, (start + rest - nb) * {BLOCK_WORDS}) - at_) ELSE 0 END)::BIGINT AS taken FROM x),
     z AS (SELECT *, CASE WHEN taken > 0 THEN CASE WHEN at_ + size > start * {BLOCK_WORDS} AND at_ < least((start + quota) * {BLOCK_WORDS}, source_size)
             THEN greatest(at_, start * {BLOCK_WORDS}) // {BLOCK_WORDS} - start ELSE nb + at_ // {BLOCK_WORDS} - start END END AS b FROM y)
SELECT doc_id, size, source_size, target, taken, ((r - 1) // {SHARD_BLOCKS} + 1)::BIGINT AS first_shard
FROM z LEFT JOIN seat ON z.idx = seat.idx AND z.b + 1 = seat.j
"""
