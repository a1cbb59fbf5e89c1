import re
from collections import Counter

import pytest

import corpus_pipeline
from skarn.llm import bpe, jaccard, mixing
from skarn.llm.common import checkpointed


def test_stages_keep_columns_and_decisions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, sf)
        assert out.columns == columns
        kept = out.count()
        assert 0 < kept < n or name == "quality_rules" and 0 < kept <= n
        docs, n = spark.createDataFrame(out.collect(), out.schema), kept
    assert all(r.n_links == 0 for r in jaccard.similar(docs).collect())


def test_run_encodes_the_mix_word_for_word(spark, sf):
    """Each source's words in the result are the words that the mix takes of what near-duplicate search keeps."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = checkpointed(stage(spark, docs, sf))
    taken, target = Counter(), {}
    for r in mixing.mix(docs).collect():
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert taken and all(abs(taken[s] - target[s]) <= 4 * mixing.BLOCK_WORDS for s in target)
    vocabulary = {v: k for k, v in bpe.ranks(bpe.vocabulary_path()).items()}
    word, words, seen = re.compile(r"[^\x20\x09-\x0D]+"), Counter(), Counter()
    whole = {r.doc_id: r.text for r in docs.collect()}
    for r in corpus_pipeline.run(spark, sf).collect():
        text = b"".join(vocabulary[i] for i in r.ids).decode()
        assert r.n_tokens == len(r.ids)
        words[r.source] += len(word.findall(text))
        seen[r.doc_id] += 1
        assert text == whole[r.doc_id] or " ".join(word.findall(text)) in " ".join(word.findall(whole[r.doc_id]))
    assert words == Counter({s: n for s, n in taken.items() if n}) and max(seen.values()) <= mixing.REPEATS + 1


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stages_take_empty_tables(spark, sf, stage):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    assert stage[1](spark, docs, sf).count() == 0
