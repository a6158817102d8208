"""The corpus pipeline: quality rules, near-dedup, decontamination, personal data, SentencePiece ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontaminate, minhash_dedup, pii, quality_rules, sentencepiece_bpe
from quarry.llm.common import materialise, read_table
from quarry.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, with all columns of docs.

    A null or empty text has no words, so it goes. A null lang counts with the languages that are no stratum; null ids and
    repeated rows are judged like others, each for itself. Empty labels give no cutoffs.
    """
    return quality_rules.keep(docs, read_table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id: five-word shingles, 0.8 or more.

    Rows are told apart by themselves and not by their id: different texts under one id both stay, of repeated rows one
    does, and null ids count like others, last in their group. Rows without words all stay. All columns of docs stay.
    """
    return minhash_dedup.keep_one(docs, shingle=5)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item, with all columns of docs.

    A null or empty text holds no item and stays, as do null ids; repeated rows go or stay alike. An empty benchmark
    takes nothing out.
    """
    return decontaminate.clean(docs, read_table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a tag in the place of personal data; n_chars, if docs has it, follows the text.

    A null text stays null, with a null n_chars; an empty one stays empty. Repeated rows and null ids pass through, and
    so do all other columns.
    """
    done = pii.redact(docs)
    return done.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else done


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids, decoded) of each document.

    A null or empty text has the begin and end ids only. Repeated rows and null ids have a row each. Other columns of
    docs aren't read.
    """
    return sentencepiece_bpe.encode_decode(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [
    ("quality rules", quality),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", benchmark_free),
    ("personal data", personal_data),
    ("SentencePiece", encode),
]

#: SentencePiece ids and fitted cutoffs have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
