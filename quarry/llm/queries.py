"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, huffman_ids, license_scan, lm_score, minhash_dedup, pii, quality_rules, sentencepiece_bpe, token_counts, toxicity
from .common import read_table


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file; the same on the driver and the executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return sentencepiece_bpe.encode_decode(docs, tokenizer_path("piece_bpe_32k.model"), values=False)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read_table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return lm_score.score(docs, lm_score.train(docs), seen=True)


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(read_table(spark, sf_dir, "documents"), shingle=2)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents")
    return token_counts.named_counts(docs, tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, end_id=50256)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman_ids.read_files(huffman_ids.store(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(read_table(spark, sf_dir, "documents"), redacted=False)


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_license_scan": op3_license_scan,
    "op4_toxicity": op4_toxicity,
    "op5_lm_score": op5_lm_score,
    "op6_minhash_dedup": op6_minhash_dedup,
    "op7_token_counts": op7_token_counts,
    "op8_quality_rules": op8_quality_rules,
    "op9_huffman_ids": op9_huffman_ids,
    "op10_pii": op10_pii,
}

ORACLES: dict[str, str] = {
    "op3_license_scan": license_scan.oracle_sql(),
    "op6_minhash_dedup": minhash_dedup.oracle_sql(),
    "op8_quality_rules": quality_rules.oracle_sql(),
}
