"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import byte_bpe, conversation_repair, curve_packing, exact_dedup, language_crf, minhash_bayes, multi_index, piece_bpe, ring_sharding, source_divergence, suffix_dedup, toxicity, weak_quality
from .common import documents

QUERIES = {
    "op2_exact_dedup": lambda spark, sf_dir: exact_dedup.query(documents(spark, sf_dir)),
    "op5_byte_bpe": lambda spark, sf_dir: byte_bpe.query(documents(spark, sf_dir)),
    "op4_ring_sharding": lambda spark, sf_dir: ring_sharding.query(documents(spark, sf_dir)),
    "op9_curve_packing": lambda spark, sf_dir: curve_packing.query(documents(spark, sf_dir)),
    "op10_minhash_bayes": lambda spark, sf_dir: minhash_bayes.query(documents(spark, sf_dir)),
    "op1_suffix_dedup": lambda spark, sf_dir: suffix_dedup.query(documents(spark, sf_dir)),
    "op7_weak_quality": lambda spark, sf_dir: weak_quality.query(documents(spark, sf_dir)),
    "op3_toxicity": lambda spark, sf_dir: toxicity.query(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")),
    "op8_multi_index": lambda spark, sf_dir: multi_index.query(spark.read.parquet(f"{sf_dir}/embeddings.parquet")),
    "op6_language_crf": lambda spark, sf_dir: language_crf.query(documents(spark, sf_dir)),
    "op13_conversation_repair": lambda spark, sf_dir: conversation_repair.query(spark.read.parquet(f"{sf_dir}/conversations.parquet")),
    "op11_source_divergence": lambda spark, sf_dir: source_divergence.query(documents(spark, sf_dir)),
    "op12_piece_bpe": lambda spark, sf_dir: piece_bpe.query(documents(spark, sf_dir)),
}

ORACLE = {"op2_exact_dedup": exact_dedup.SQL, "op11_source_divergence": source_divergence.SQL, "op13_conversation_repair": conversation_repair.SQL}
