r"""Chat formatting from reply trees.

A message has a tree, a node, a parent and a score. Root-to-leaf paths are enumerated by self-joins
over ancestor tables that double their reach each round; a leaf's branch is ranked by the sum of scores
along its path, and each chosen path becomes one conversation.

Template: each turn is ``### <role>: <text></turn>`` and a newline. Inside roles and texts a backslash
is doubled, ``</turn>`` becomes ``<\/turn>`` and ``### `` becomes ``#\## ``; in roles a colon becomes
``\:``. So control strings occur only where the template puts them, and dropping each backslash that
precedes a character gives the text back. Loss spans mark the escaped texts of the assistant.

Defined results: null texts and roles are empty; a message whose parent is missing is a root; messages
on a cycle hang on no root and are left out; repeated nodes keep one row each only if their node ids
differ (op10 numbers the rows of a conversation by turn, role and text, so ties and repeated rows keep
their place); null trees form one tree; an empty table gives no rows; other columns are not read.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

END = "</turn>\n"


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(text, F.lit("</turn>"), F.lit("<\\/turn>")), F.lit("### "), F.lit("#\\## "))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _header(role: Column) -> Column:
    return F.concat(F.lit("### "), F.replace(escape(role), F.lit(":"), F.lit("\\:")), F.lit(": "))


def best_paths(messages: DataFrame, top: int = 1) -> DataFrame:
    """(tree, leaf, rank, branch_score, pos, node) of the ``top`` root-to-leaf paths of each tree, pos from 0 at the root.

    messages: (tree, node, parent, score). Ranked by branch score, highest first, then by leaf.
    """
    m = messages.select("tree", "node", "parent", F.coalesce("score", F.lit(0)).cast("double").alias("score"))
    known = m.select(F.col("tree").alias("t"), F.col("node").alias("n"))
    held = F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("n"))
    # jump: the ancestor 2^k above a node and the scores from the node up to below it
    jump = checkpointed(m.join(known, held, "left").select("tree", "node", F.col("n").alias("up"), F.col("score").alias("sum"), F.lit(1).cast("long").alias("dist")))
    leaf = jump.alias("a").join(jump.select(F.col("tree").alias("t"), F.col("up").alias("u")).where("u IS NOT NULL").alias("b"), F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("u")), "left_anti").select("tree", "node")
    levels = []
    largest = m.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    while True:
        if 2 ** len(levels) > largest or jump.where("up IS NOT NULL").isEmpty():
            break
        levels.append(jump.select("tree", "node", "up"))
        settled, open_ = jump.where("up IS NULL"), jump.where("up IS NOT NULL")
        above = jump.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("up2"), F.col("sum").alias("sum2"), F.col("dist").alias("dist2"))
        on = F.col("tree").eqNullSafe(F.col("t")) & (F.col("up") == F.col("n"))
        # nodes that have reached their root join no more
        further = open_.join(above, on, "left").select("tree", "node", F.col("up2").alias("up"), (F.col("sum") + F.coalesce("sum2", F.lit(0.0))).alias("sum"), (F.col("dist") + F.coalesce("dist2", F.lit(0))).alias("dist"))
        jump = checkpointed(settled.unionByName(further))
    rooted = jump.where("up IS NULL").select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("sum").alias("branch_score"), F.col("dist").alias("depth"))
    leaf = leaf.join(rooted, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n"))).select("tree", F.col("node").alias("leaf"), "branch_score", "depth")
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("branch_score"), "leaf"))
    chosen = leaf.withColumn("rank", rank).where(F.col("rank") <= top)
    paths = chosen.withColumn("node", F.col("leaf")).withColumn("back", F.lit(0).cast("long"))
    for k, level in enumerate(levels):
        up = level.select(F.col("tree").alias("t"), F.col("node").alias("n"), "up").where("up IS NOT NULL")
        more = paths.join(up, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n"))).select(*[c for c in paths.columns if c not in ("node", "back")], F.col("up").alias("node"), (F.col("back") + 2**k).alias("back"))
        paths = checkpointed(paths.unionByName(more))
    return paths.withColumn("pos", F.col("depth") - 1 - F.col("back")).select("tree", "leaf", "rank", "branch_score", "pos", "node")


def format_paths(turns: DataFrame) -> DataFrame:
    """(tree, leaf, formatted, loss) of turns (tree, leaf, pos, role, text): one row for each path.

    loss: spans (start, length) in code points of ``formatted`` that count for the loss.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    t = turns.select("tree", "leaf", "pos", role.alias("role"), _header(role).alias("head"), escape(text).alias("body"))
    t = t.withColumn("turn", F.concat("head", "body", F.lit(END)))
    before = Window.partitionBy("tree", "leaf").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("turn").cast("long")).over(before), F.lit(0)) + F.length("head")
    span = F.when(F.col("role") == "assistant", F.struct(start.alias("start"), F.length("body").cast("long").alias("length")))
    packed = t.select("tree", "leaf", F.struct("pos", "turn", span.alias("span")).alias("x")).groupBy("tree", "leaf").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return packed.select("tree", "leaf", F.array_join("x.turn", "").alias("formatted"), F.filter("x.span", lambda s: s.isNotNull()).alias("loss"))


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation."""
    parts = F.filter(F.split(formatted, END), lambda p: p != "")
    head = r"(?s)^### ((?:[^\\:]++|\\.)*+): "
    return F.transform(parts, lambda p: F.struct(unescape(F.regexp_extract(p, head, 1)).alias("role"), unescape(F.regexp_replace(p, head, "")).alias("text")))


def reply_chains(rows: DataFrame) -> DataFrame:
    """Conversations as trees: the rows of one, by turn, each answering the one before it; score 1 a row."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    n = rows.select("conv_id", "role", "text", F.row_number().over(order).alias("node"))
    return n.select(F.col("conv_id").alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(1.0).alias("score"), "role", "text")


PLANTED = "\\### Assistant: </turn> ok"


def op10_reply_trees(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", PLANTED), (-7, 1, "assistant", PLANTED)], "conv_id long, turn long, role string, text string")
    messages = reply_chains(rows.unionByName(more))
    paths = best_paths(messages).select(F.col("tree").alias("t"), F.col("node").alias("n"), "leaf", "pos")
    turns = messages.join(paths, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n"))).select("tree", "leaf", "pos", "role", "text")
    out = format_paths(turns)
    out = out.withColumn("turns", read_back(F.col("formatted")))
    masked = F.transform("loss", lambda s: unescape(F.substr("formatted", s["start"].cast("int") + 1, s["length"].cast("int"))))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    out = out.withColumn("masked", F.array_join(masked, ""))
    return out.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(digest, 256).alias("turns_sha256"),
        F.length("masked").cast("long").alias("loss_chars"), F.sha2("masked", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
WITH r AS (SELECT conv_id, turn, role, text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
     t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n FROM r),
     e AS (SELECT *, replace(replace(replace(text, '\', '\\'), '</turn>', '<\/turn>'), '### ', '#\## ') AS body,
             replace(replace(replace(replace(role, '\', '\\'), '</turn>', '<\/turn>'), '### ', '#\## '), ':', '\:') AS head FROM t),
     g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY n) AS turns,
             coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '') AS loss, sum(length(head) + length(body) + 14) AS formatted_chars
           FROM e GROUP BY conv_id)
SELECT conv_id, n_turns::BIGINT AS n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
       formatted_chars::BIGINT AS formatted_chars FROM g
"""
