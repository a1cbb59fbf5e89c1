import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skarn.llm import quality, quality_rules
from skarn.llm.stats import COUNTS, FEATURES, statistics
from skarn.llm.textkernel import Words, texts
from skarn.llm.trees import boost, lasso_logistic, sigmoid


def counts_of(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(zip(words, words[1:], words[2:]))
    hit = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from("aab  \n\t\r\x0b\x0c\x1cé#*|漢"), max_size=40)), max_size=10))
@settings(max_examples=300, deadline=None)
def test_counts_match_their_definition(found):
    s = statistics(*texts(pa.array(found, pa.string())))
    assert [tuple(int(s[c][i]) for c in COUNTS) for i in range(len(found))] == [counts_of(t) for t in found]


def sample(n=3000, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.random((n, len(FEATURES)))
    y = ((x[:, 2] < 0.4) & (x[:, 5] < 0.7) | (x[:, 8] > 0.9)).astype(float)
    return x, y


def test_rules_score_alike_in_spark_and_numpy_and_are_sparse(spark):
    x, y = sample()
    model = quality.RuleEnsemble.fit(x, y)
    score = model.score(x)
    assert ((score >= 0.5) == y).mean() > 0.97 and 0 < len(model.rules) < 60
    df = spark.createDataFrame([tuple(map(float, r)) for r in x[:200]], list(FEATURES))
    got = [r[0] for r in df.select(model.column()).collect()]
    assert np.allclose(got, score[:200])


def test_monotone_trees_only_fall():
    x, y = sample()
    y = np.where(np.random.default_rng(3).random(len(y)) < 0.2, 1 - y, y)
    forest = boost(x, y, monotone={2: -1, 8: 1})
    assert ((sigmoid(forest.margin(x)) >= 0.5) == y).mean() > 0.75
    for f, sign in ((2, -1), (8, 1)):
        base = np.repeat(x[:50], 21, 0)
        base[:, f] = np.tile(np.linspace(0, 1, 21), 50)
        assert (np.diff(forest.margin(base).reshape(50, 21)) * sign >= -1e-12).all()


def test_flat_nodes_equal_a_walk():
    x, y = sample(500)
    forest = boost(x, y, trees=7)
    def walk(row):
        total = forest.base
        for node in forest.roots:
            while forest.left[node] != node:
                node = forest.left[node] if row[forest.feature[node]] <= forest.threshold[node] else forest.right[node]
            total += forest.value[node]
        return total
    assert np.allclose(forest.margin(x), [walk(r) for r in x])


def test_single_label_and_empty_samples():
    assert len(boost(np.zeros((0, 3)), np.zeros(0)).roots) == 0
    assert len(boost(np.ones((5, 3)), np.ones(5)).roots) == 0
    assert quality.RuleEnsemble.fit(np.zeros((0, len(FEATURES))), np.zeros(0)).rules == []
    assert lasso_logistic(np.zeros((0, 0)), np.zeros(0), 0.1)[1].size == 0


LONG = "plain words follow one another here and there " * 12
ODD = [(1, LONG, "x"), (2, None, "y"), (3, "", None), (3, "", None), (None, "a b c", "z"), (5, "JUNK!! " * 9000, "w")]


def test_operators_on_odd_documents(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (5, None, 0), (77, 1, 0)], "doc_id long, quality int, toxic int")
    for model in (quality.train(docs, labels), quality.RuleEnsemble(0.0, [])):
        rows = quality.classify(docs, model).collect()
        assert len(rows) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
        assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    judged = {r.doc_id: r for r in quality_rules.judge(docs, quality_rules.train(docs, labels)).collect()}
    for doc_id, text, _ in ODD:
        r = judged[doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts_of(text)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
    assert quality.classify(docs.limit(0), quality.RuleEnsemble(0.0, [])).count() == 0
    clash = docs.withColumnsRenamed({"score": "kept"}).withColumn("stat_n_words", F.lit(1))
    kept = quality_rules.kept(clash, quality_rules.train(clash, labels.limit(0)))
    assert kept.columns == clash.columns and kept.count() == 0
    assert quality.accepted(clash, quality.RuleEnsemble(0.0, [])).count() == len(ODD)


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01"])
def test_held_out_accuracy(spark, folder):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [r for r in quality.op3_rule_ensemble(spark, folder).collect() if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in rows) / len(rows) > 0.95
    rows = [r for r in quality_rules.op7_boosted_rules(spark, folder).collect() if r.doc_id in labels and not r.base_failed]
    assert sum(r.kept == labels[r.doc_id] for r in rows) / len(rows) > 0.95


def features_of(text):
    """The features by their plain definitions."""
    text = text or ""
    n, chars, symbols, dup, repeated = counts_of(text)
    words, lines = re.findall(r"[^\x20\x09-\x0D]+", text), sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in text.split("\n"))
    count = lambda pattern: len(re.findall(pattern, text))
    share = lambda a, b: a / max(b, 1)
    seen = Counter(words)
    return {
        "log_words": math.log1p(n), "mean_word": share(chars, n), "symbol_share": share(symbols, n), "dup_line_share": share(dup, lines), "repeat_share": share(repeated, n),
        "upper_share": share(count("[A-Z]"), count("[A-Za-z]")), "digit_share": share(count("[0-9]"), chars), "punct_share": share(count(r"""[!"'(),\-./:;?@\[\\\]^_`{}~=+]"""), n), "distinct_share": share(len(seen), n),
        "same_as_last_share": share(sum(a == b for a, b in zip(words, words[1:])), n), "bang_share": share(count("!(?<=!!)"), n), "words_per_line": share(n, lines), "short_word_share": share(sum(len(w) <= 3 for w in words), n),
        "top_word_share": share(max(seen.values(), default=0), n),
    }


def test_queries_match_brute_force(spark, sf):
    """Both queries' scores over all documents, from plain definitions, rule by rule and node by node."""
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rules, forest = quality.train(docs, labels), quality_rules.train(docs, labels)
    found = {r.doc_id: (r.text, features_of(r.text)) for r in docs.collect()}
    scored, judged = quality.op3_rule_ensemble(spark, sf).collect(), quality_rules.op7_boosted_rules(spark, sf).collect()
    assert len(scored) == len(judged) == docs.count() and rules.rules and len(forest.roots)
    for r in scored:
        x = found[r.doc_id][1]
        z = rules.intercept + sum(w for w, path in rules.rules if all((x[FEATURES[f]] <= t) == low for f, low, t in path))
        assert abs(r.score - 1 / (1 + math.exp(-z))) < 1e-9 and r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    for r in judged:
        text, x = found[r.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts_of(text)
        z = forest.base
        for node in forest.roots:
            while forest.left[node] != node:
                node = forest.left[node] if x[FEATURES[forest.feature[node]]] <= forest.threshold[node] else forest.right[node]
            z += forest.value[node]
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert abs(r.score - 1 / (1 + math.exp(-z))) < 1e-9 and r.base_failed == failed and r.kept == (not failed and r.score >= 0.3)


def test_texts_that_collide_in_polynomial_hashes_stay_apart():
    """Thue-Morse strings and their complements have equal polynomial hashes modulo 2 ** 64 for every base."""
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    data, offsets = texts(pa.array([f"{a}\n{b}", f"{a}\n{a}", f"{a} x y {b} x y"]))
    found = statistics(data, offsets)
    assert found["n_dup_lines"].tolist() == [0, 1, 0]
    assert found["n_repeat_words"].tolist() == [0, 0, 0]
    assert found["distinct_share"].tolist() == [1.0, 0.5, 4 / 6]
    assert len(set(Words(data, offsets).hashes().tolist())) == 4
