"""From raw documents to packed sequences: quality classifier, exact, near and passage deduplication, packing.

Each stage is a function of (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last return the
columns of documents. Between stages documents are written as Parquet and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cleanloom.llm import curve_packing, exact_dedup, minhash_bayes, suffix_dedup, weak_quality
from cleanloom.llm.common import bounded, cut, documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded(spark)
    return weak_quality.keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded(spark)
    return exact_dedup.drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded(spark)
    return minhash_bayes.drop_near_copies(docs, 0.8)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded(spark)
    return suffix_dedup.cut_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded(spark)
    # Workers go on to other stages of later runs, so they keep fewer words than the operator alone does.
    return curve_packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"), most=300_000).drop("ids")


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("passages", passages), ("packing", packing)]

#: SQL can't express the classifier; the run is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
