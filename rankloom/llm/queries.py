"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import alignment, bitslices, bpe, extraction, idfiles, packing, phrases, quality, secrets, simhash, sketches, urls, warc
from rankloom.llm.work import documents, pages


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_template_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return urls.judge(pages(spark, sf_dir), urls.labelled_urls(labels))


def op2_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_archives(warc.write_archives(pages(spark, sf_dir))).drop("url")


def op3_ranked_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idfiles.read_digests(idfiles.write_files(documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"), end_id=2))


def op4_island_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"))


def op5_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.fingerprints(documents(spark, sf_dir))


def op6_forced_boundary_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"))


def op7_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(documents(spark, sf_dir))


def op8_style_tree_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(pages(spark, sf_dir))


def op9_forest_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir))


def op10_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_report(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir))


def op13_bit_sliced_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitslices.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.pmod("vec_id", F.lit(100)) == 0)


QUERIES = {
    "op1_template_tree": op1_template_tree,
    "op2_warc_round_trip": op2_warc_round_trip,
    "op3_ranked_id_files": op3_ranked_id_files,
    "op4_island_packing": op4_island_packing,
    "op5_scaled_sketch": op5_scaled_sketch,
    "op6_forced_boundary_bpe": op6_forced_boundary_bpe,
    "op7_divergence_rules": op7_divergence_rules,
    "op8_style_tree_text": op8_style_tree_text,
    "op9_forest_secrets": op9_forest_secrets,
    "op10_simhash_trie": op10_simhash_trie,
    "op11_token_alignment": op11_token_alignment,
    "op12_phrase_collocations": op12_phrase_collocations,
    "op13_bit_sliced_search": op13_bit_sliced_search,
}

ORACLES: dict[str, str] = {
    "op7_divergence_rules": quality.SQL,
    "op12_phrase_collocations": phrases.SQL,
    "op13_bit_sliced_search": bitslices.SQL,
    "op2_warc_round_trip": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
             d AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS digest FROM p),
             r AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM d)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
               CASE WHEN n >= 100 AND first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 100 AND first < page_id THEN first END AS refers_to
        FROM r""",
}
