"""Corpus pipeline: five stages, each an operator of ``innlytics.llm``.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, written as Parquet and reread as the docs of the next.
All but the last return the columns of documents. ``run`` applies them to the
documents table, writing between stages to the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from innlytics import session
from innlytics.llm import classifier, exact_dedup, ngram_join, packing, suffix_dedup
from innlytics.llm.common import cut, drop, read


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be of good quality."""
    session.tune(spark)
    return classifier.keep_good(docs, read(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row, that of the largest doc_id."""
    session.tune(spark)
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows one, that of the smallest doc_id."""
    session.tune(spark)
    return ngram_join.drop_near_copies(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes covered by repeated 400-byte strings."""
    session.tune(spark)
    return suffix_dedup.strip_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 ids, along the curve."""
    import public_tokenizers
    session.tune(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).drop("ids")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("repeated_passages", repeated_passages),
    ("packed", packed),
]

#: A trained network, fingerprint filters and a tokenizer are beyond SQL; the
#: stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        docs, last = cut(stage(spark, docs, sf_dir), name), before
        if last is not None:
            drop(last)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
