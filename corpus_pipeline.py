"""The corpus pipeline: each stage calls one operator and hands on what it keeps.

Quality classifier and quality rules drop the documents they reject, the n-gram Jaccard join leaves one
document of each class, mixing repeats and cuts documents to the target weights, and the last stage encodes
what is left. Between the stages the documents are written as Parquet to the shared folder and read again.
"""
from __future__ import annotations

from skarn.llm import bpe, jaccard, mixing, quality, quality_rules
from skarn.llm.common import shared_path


def _labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_classifier(spark, docs, sf_dir):
    return quality.accepted(docs, quality.train(docs, _labels(spark, sf_dir)))


def boosted_rules(spark, docs, sf_dir):
    return quality_rules.kept(docs, quality_rules.train(docs, _labels(spark, sf_dir)))


def near_duplicates(spark, docs, sf_dir):
    return jaccard.one_of_each(docs)


def mix_sources(spark, docs, sf_dir):
    return mixing.mixed_documents(docs)


def encode(spark, docs, sf_dir):
    """doc_id, source, n_tokens, ids and decoded of each row of the mix."""
    return bpe.encode_decode(docs, keys=("doc_id", "source"), digests=False).drop("decoded")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", boosted_rules),
    ("ngram_jaccard_join", near_duplicates),
    ("mix_sources", mix_sources),
    ("bpe", encode),
]

#: SQL can't express the fitted models; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
