"""A training-data pipeline over `documents`: quality rules, SimHash near-dedup, secret scan, best-fit packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it
kept. All but the last return the columns of `documents`; the last returns the
packed pieces.

Edge cases, for all stages: nulls in any column, texts of any length, ties,
repeated rows and empty tables are handled as each stage says; further columns
are kept by all stages but the last, whatever their names; whole texts count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rankloom.llm import packing, quality, secrets, similar
from rankloom.llm.queries import tokenizer_file
from rankloom.llm.work import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; null and empty texts fail the base rule, a null language is judged by the nearest one."""
    return quality.keep(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of a five-word shingle similarity of 0.8 or more stays: that of the smallest doc_id.

    Rows without an id take part; texts that share an id are judged one by one; null and empty texts are alike.
    """
    return similar.one_of_similar(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; its secrets are masked wherever they occur in it; a null text stays null."""
    return secrets.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document; null and empty texts hold the end id alone."""
    return packing.pack_documents(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: Groups by Hamming distance and the packing have no SQL form; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
