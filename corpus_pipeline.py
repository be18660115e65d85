"""A corpus pipeline of four stages, each on all that the one before it kept.

Quality and toxicity filters drop the documents they reject, near-duplicate detection (five
words, a similarity of 0.8 or more) keeps the document with the smallest id of each group,
and packing lays what is left into sequences. Each stage's result is written as Parquet in
the shared folder and read again as the next stage's documents. Models learn from
``labels`` in ``sf_dir``.

Defined results: each stage's are those of its operator. A null or empty text is judged by
its statistics and, if kept, is no duplicate of anything and one piece of a sequence; very
long texts are read whole and cut into pieces; of repeated rows one stays (rows without id
all stay); further columns are carried up to the last stage; empty tables give no rows, and
without labels nothing is rejected.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tokoro.llm import minhash, packing, quality, toxicity
from tokoro.llm.common import shared_dir, table, written


#: Per cent of shingles that near-duplicates share.
SIMILARITY = 80


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep(docs, SIMILARITY)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), 0, 2048)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("toxicity", toxicity_filter),
    ("minhash_near_dedup", near_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: Trained models and a tokenizer library aren't expressible in SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, at = table(spark, sf_dir, "documents"), shared_dir(spark)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"{at}/{name}")
    return docs
