import numpy as np
import pytest

from skarn.llm import bpe, tokencounts


def test_histogram_answers_every_limit(spark):
    rng = np.random.default_rng(1)
    n = [int(x) for x in rng.integers(0, 5000, 700)] + [0, 0, 1024, 1024]
    hist = tokencounts.histogram(spark.createDataFrame([(x,) for x in n], "n_tokens long"))
    for r in hist.collect():
        over = [x for x in n if x >= r.n_tokens]
        assert (r.docs, r.docs_at_least, r.tokens_at_least) == (n.count(r.n_tokens), len(over), sum(over))
        assert r.tokens_if_cut == sum(min(x, r.n_tokens) for x in n)
        assert abs(r.share_below - (len(n) - len(over)) / len(n)) < 1e-12
    cut = tokencounts.cut_at(hist, 777).first()
    assert tuple(cut) == (sum(x > 777 for x in n), sum(n), sum(min(x, 777) for x in n))
    assert tokencounts.quantile(hist, 0.5).first()[0] == sorted(n)[(len(n) + 1) // 2 - 1]


def test_quantiles_are_exact(spark):
    hist = tokencounts.histogram(spark.createDataFrame([(x,) for x in range(1, 11)], "n_tokens long"))
    assert [tokencounts.quantile(hist, q / 10).first()[0] for q in range(1, 11)] == list(range(1, 11))
    assert [tokencounts.quantile(hist, q).first()[0] for q in ("0.1", "0.11", "1/3")] == [1, 2, 4]


def test_lengths_of_odd_texts(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "a b", 0), (3, "a b", 0), (4, "x" * 50000, 0)], "doc_id long, text string, n_tokens int")
    got = sorted((r.doc_id, r.n_tokens) for r in tokencounts.lengths(docs, ("doc_id",)).collect())
    assert got[:4] == [(1, 0), (2, 0), (3, 2), (3, 2)] and got[4][1] > 1000
    assert tokencounts.histogram(tokencounts.lengths(docs.limit(0))).count() == 0


def test_query_counts_all_documents(spark, sf):
    rows = tokencounts.op1_length_histogram(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert sum(r.docs for r in rows) == docs.count()
    whole = bpe.encode_decode(docs).agg({"n_tokens": "sum"}).first()[0]
    assert sum(r.docs * r.n_tokens for r in rows) == whole


def test_query_matches_the_tokenizer_library(spark, sf):
    public_tokenizers, tiktoken = pytest.importorskip("public_tokenizers"), pytest.importorskip("tiktoken")
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(bpe.vocabulary_path()), special_tokens={})
    n = [len(encoding.encode_ordinary(r.text or "")) for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    rows = {r.n_tokens: r for r in tokencounts.op1_length_histogram(spark, sf).collect()}
    assert set(rows) == set(n)
    for limit, r in rows.items():
        over = [x for x in n if x >= limit]
        assert (r.docs, r.docs_at_least, r.tokens_at_least, r.tokens_if_cut) == (n.count(limit), len(over), sum(over), sum(min(x, limit) for x in n))
        assert abs(r.share_below - sum(x < limit for x in n) / len(n)) < 1e-12
