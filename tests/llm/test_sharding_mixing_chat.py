import hashlib
import os
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from skarn.llm import chat, mixing, sharding


def test_directory_matches_sql_with_small_shards(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = sorted(map(tuple, sharding.shard(docs, limit=20_000).select("doc_id", "n_bytes", "shard", "shard_bits", "shard_bytes").collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(f"SELECT doc_id, n_bytes, shard, shard_bits, shard_bytes FROM ({sharding.oracle(20_000)})").fetchall()
    big = {r[0] for r in got if r[1] > 20_000}
    want = sorted(want)
    assert [r for r in got if r[0] not in big and r[4] <= 20_000] == want
    assert len({r[2] for r in got}) > 10


def test_hot_key_and_large_documents_fit_or_stand_alone(spark):
    rows = [(7, "x" * 30)] * 400 + [(7, "y" * 700)] * 3 + [(i, "z" * 50) for i in range(100)] + [(None, None), (None, ""), (500, "q" * 5000)]
    docs = spark.createDataFrame([(*r, "1") for r in rows], "doc_id long, text string, shard string").repartition(5)
    got = sharding.shard(docs, limit=1000).collect()
    total, number = defaultdict(int), Counter()
    for r in got:
        total[r.shard] += r.n_bytes
        number[r.shard] += 1
    assert len(got) == len(rows) and sum(r.n_bytes for r in got) == sum(len(t or "") for _, t in rows)
    assert all(b <= 1000 or number[s] == 1 for s, b in total.items()) and all(r.shard_bytes == total[r.shard] for r in got)
    assert sharding.shard(docs.limit(0), limit=10).count() == 0


def mix_sql(docs, how):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, source VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", docs)
    sql = mixing.ORACLE.replace(f"/ {mixing.BLOCK_WORDS}", f"/ {how['block']}").replace(f"* {mixing.BLOCK_WORDS}", f"* {how['block']}")
    sql = sql.replace(str(mixing.SHARD_BLOCKS), "50")
    return sorted(con.execute(f"SELECT doc_id, size, source_size, target, taken, first_shard FROM ({sql})").fetchall(), key=str)


@pytest.mark.parametrize("block", [1, 4, 32])
def test_mix_matches_sql_and_stays_near_targets(spark, block):
    words = lambda i, n: " ".join(f"w{i}x{k}" for k in range(n))
    rows = [(i, f"s{i % 7}" if i % 11 else None, words(i, i * 7 % 90)) for i in range(400)] + [(900, "tiny", words(1, 40)), (901, "zero", None), (902, "zero", "")]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, source string, text string, target double")
    got = mixing.mix(df, block=block, shard_blocks=50)
    plain = [tuple(r) for r in got.select("doc_id", "size", "source_size", "target", "taken", "first_shard").collect()]
    assert len({r[-1] for r in plain}) > 1
    assert sorted(plain, key=str) == mix_sql(rows, {"block": block})
    taken, target = defaultdict(int), {}
    for r in got.collect():
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 4 * block for s in target)
    assert abs(sum(target.values()) - sum(r[1] for r in plain)) < 1e-6


def test_mixed_documents_have_the_words_taken(spark):
    rows = [(i, "ab"[i % 2], " ".join(f"w{i}x{k}" for k in range(10 + i % 5)), 1, "x", 5, "y", "z") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, n_chars long, lang string, h long, cut string, words string")
    out = mixing.mixed_documents(df, block=4)
    assert out.columns == df.columns
    words = defaultdict(int)
    for r in out.collect():
        n = len(r.text.split())
        words[r.doc_id] += n
        assert set(r.text.split()) <= {f"w{r.doc_id}x{k}" for k in range(99)}
    assert words == {r.doc_id: r.taken for r in mixing.mix(df, block=4).collect() if r.taken}
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mixed_documents(df.limit(0)).count() == 0


def sources_of_all_kinds(repeats):
    """Sources of one document, of one very long one among short ones, and rows that repeat."""
    words = lambda i, n: " ".join(f"w{i}x{k}" for k in range(n))
    rows = [(i, f"s{i:02}", words(i, 300 + 97 * i)) for i in range(12)]
    rows += [(100 + i, "t", words(100 + i, 9 + i)) for i in range(20)] + [(150, "t", words(150, 3000)), (151, None, words(151, 400)), (152, None, None)]
    return rows + [(200 + i % 5, "u", words(200 + i % 5, 40 + i % 5)) for i in range(5 * repeats)]


@pytest.mark.parametrize(("block", "repeats"), [(32, 1), (32, 7), (5, 4)])
def test_words_written_are_the_words_taken(spark, block, repeats):
    rows = sources_of_all_kinds(repeats)
    df = spark.createDataFrame([(*r, len(r[2] or "")) for r in rows], "doc_id long, source string, text string, n_chars long")
    taken, size = Counter(), {}
    for r in mixing.mix(df, block=block, shard_blocks=20).collect():
        taken[r.doc_id] += r.taken
        size[r.doc_id] = r.size
        assert r.taken == sum(p.words for p in r.pieces) <= 3 * r.size and all(0 <= p.from_word <= p.from_word + p.words <= r.size for p in r.pieces)
    text = {r[0]: (r[2] or "").split() for r in rows}
    for by_shard in (False, True):
        written, times = Counter(), defaultdict(Counter)
        for r in mixing.mixed_documents(df, by_shard=by_shard, block=block, shard_blocks=20).collect():
            got = r.text.split()
            first = text[r.doc_id].index(got[0])
            assert got == text[r.doc_id][first : first + len(got)] and r.n_chars == len(r.text)
            written[r.doc_id] += len(got)
            times[r.doc_id].update(got)
        assert written == {k: v for k, v in taken.items() if v}
        n_rows = Counter(r[0] for r in rows)
        assert all(max(c.values()) <= 3 * n_rows[d] for d, c in times.items())


def test_each_shard_has_its_quota_of_each_source(spark):
    rows = sources_of_all_kinds(1)
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    block, shard_blocks = 8, 25
    out = defaultdict(Counter)
    for r in mixing.mixed_documents(df, by_shard=True, block=block, shard_blocks=shard_blocks).collect():
        out[r.shard][r.source] += len(r.text.split())
    placed, shards = mixing.placed(mixing.sized(df), block=block, shard_blocks=shard_blocks)
    name = {r.idx: (r.source, r.source_size) for r in placed.collect()}
    quota = defaultdict(dict)
    for r in shards.collect():
        quota[r.shard][name[r.idx][0]] = r.blocks
    assert len(quota) > 10 and set(out) == set(quota)
    for shard, of in quota.items():
        for source, blocks in of.items():
            short = blocks * block - out[shard][source]  # a stream's last block may have fewer words
            assert 0 <= short < 3 * block if blocks else not out[shard][source]
        assert sum(of.values()) == shard_blocks or shard == max(quota)
    plain = Counter()
    for r in mixing.mixed_documents(df, block=block, shard_blocks=shard_blocks).collect():
        plain[r.source] += len(r.text.split())
    assert plain == sum(out.values(), Counter())


def test_quotas_are_sainte_lague_at_every_shard(spark):
    t = spark.createDataFrame([(1, 5300.0, 9000), (2, 2100.0, 9000), (3, 1400.0, 9000), (4, 1200.0, 400)], "idx int, target double, source_size long")
    q = mixing.shard_quotas(t, block=10, shard_blocks=37)
    got = defaultdict(dict)
    for r in q.collect():
        got[r.shard][r.idx] = r.blocks
    cap = {1: 2700, 2: 2700, 3: 2700, 4: 120}
    target = {1: 5300, 2: 2100, 3: 1400, 4: 1200}
    seats = sorted(((-target[i] / (2 * j - 1), i) for i in target for j in range(1, cap[i] + 1)))[:1000]
    for shard in got:
        part = Counter(i for _, i in seats[37 * (shard - 1) : 37 * shard])
        assert {i: n for i, n in got[shard].items() if n} == dict(part)


def test_paths_of_a_branching_tree(spark):
    rows = [("t", 1, None, 0), ("t", 2, 1, 5), ("t", 3, 1, 1), ("t", 4, 3, 9), ("t", 5, 2, 1), ("t", 6, 5, 0), (None, 1, None, 0), (None, 2, 1, None), ("c", 1, 2, 1), ("c", 2, 1, 1), ("o", 8, 77, 3)]
    m = spark.createDataFrame([(*r[:3], r[3] if r[3] is None else float(r[3])) for r in rows], "tree string, node long, parent long, score double")
    got = defaultdict(list)
    for r in chat.best_paths(m, top=5).collect():
        got[r.tree, r["rank"]].append((r.pos, r.node))
    assert {k: [n for _, n in sorted(v)] for k, v in got.items()} == {("t", 1): [1, 3, 4], ("t", 2): [1, 2, 5, 6], (None, 1): [1, 2], ("o", 1): [8]}
    long = spark.createDataFrame([("l", i, i - 1 if i else None, 1.0) for i in range(70)], "tree string, node long, parent long, score double")
    assert [r.node for r in chat.best_paths(long).orderBy("pos").collect()] == list(range(70))


TEXTS = [chat.PLANTED, "", None, "a\\", "</turn>\n### user: x</turn>", "### ", "#### \\\\# </turn", "é漢🙂", "\\\\", "x" * 100000]


def test_round_trip_and_loss_mask(spark):
    rows = [(c, t, role, TEXTS[(c + t) % len(TEXTS)], "z") for c in range(12) for t, role in enumerate(["system", "user", "assistant", "as:sist\\ant", None, "assistant"])]
    rows += [(50, 1, "assistant", "b", "z"), (50, 1, "assistant", "b", "z"), (50, 1, "assistant", "a", "z"), (None, None, "user", "n", "z")]
    m = chat.reply_chains(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string"))
    paths = chat.best_paths(m)
    p = paths.select(F.col("tree").alias("t"), F.col("node").alias("n"), "leaf", "pos")
    turns = m.join(p, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n"))).select("tree", "leaf", "pos", "role", "text")
    out = chat.format_paths(turns).withColumn("turns", chat.read_back(F.col("formatted"))).collect()
    want = defaultdict(list)
    for c, t, role, text, _ in rows:
        want[c].append((t or 0, role or "", text or ""))
    assert len(out) == len(want)
    for r in out:
        expected = [(role, text) for _, role, text in sorted(want[r.tree])]
        assert [(t.role, t.text) for t in r.turns] == expected
        masked = [re.sub(r"(?s)\\(.)", r"\1", r.formatted[s.start : s.start + s.length]) for s in r.loss]
        assert masked == [text for role, text in expected if role == "assistant"]


def test_query_has_the_planted_conversation(spark, sf):
    rows = {r.conv_id: r for r in chat.op10_reply_trees(spark, sf).collect()}
    text = chat.PLANTED
    assert rows[-7].n_turns == 2 and rows[-7].loss_sha256 == hashlib.sha256(text.encode()).hexdigest() and rows[-7].loss_chars == len(text)
    assert rows[-7].turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert os.path.isdir(sf) and len(rows) == spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id").distinct().count() + 1


def test_chat_of_an_empty_table(spark):
    none = chat.reply_chains(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert none.count() == 0 and chat.best_paths(none).count() == 0
    paths = chat.best_paths(none).select(F.col("tree").alias("t"), F.col("node").alias("n"), "leaf", "pos")
    turns = none.join(paths, (F.col("tree") == F.col("t")) & (F.col("node") == F.col("n"))).select("tree", "leaf", "pos", "role", "text")
    assert chat.format_paths(turns).count() == 0


def test_copies_of_a_repeated_row_are_dealt_to_tasks(spark, monkeypatch):
    rows = [(1, "a b c d", "s")] * 90 + [(i, f"w{i} x y z", "s") for i in range(2, 12)] + [(99, "q r", "t")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = Counter(map(tuple, mixing.mixed_documents(docs).select("doc_id", "text", "source").collect()))
    monkeypatch.setattr(mixing, "COPIES", 7)
    assert Counter(map(tuple, mixing.mixed_documents(docs).select("doc_id", "text", "source").collect())) == want
    assert max(want.values()) > 40
