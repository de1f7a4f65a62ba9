"""The queries opN_<name> over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from skylattice.llm import block_search, bpe_codec, html_extract, language_id, line_dedup, merkle, mixing, near_dedup, ngram_join, pair_sql, pivot_search, token_counts, toxicity, whitening
from skylattice.llm.common import table

VOCABULARY = "byte_bpe_50k.json"


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = language_id.language_id(spark, table(spark, sf_dir, "documents"))
    return out.select("doc_id", "held_out", "lang_pred", "score")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(spark, table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(spark, table(spark, sf_dir, "documents"), words=4, percent=80)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(spark, table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(spark, table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), limit=512)


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.round_trip(spark, table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_search.exact_top_k(spark, table(spark, sf_dir, "embeddings"), k=5, every=50)


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_search.nearest(spark, table(spark, sf_dir, "embeddings"), k=10, every=100)


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(spark, table(spark, sf_dir, "pages"))


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(spark, table(spark, sf_dir, "documents"), words=4, percent=85)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark, table(spark, sf_dir, "embeddings"), components=16, scale=64)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified_manifest(spark, table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_mix_sources": op2_mix_sources,
    "op3_toxicity": op3_toxicity,
    "op4_near_dedup": op4_near_dedup,
    "op5_line_dedup": op5_line_dedup,
    "op6_token_counts": op6_token_counts,
    "op7_bpe_codec": op7_bpe_codec,
    "op8_exact_top_k": op8_exact_top_k,
    "op9_nearest_neighbours": op9_nearest_neighbours,
    "op10_main_text": op10_main_text,
    "op11_ngram_join": op11_ngram_join,
    "op12_whitening": op12_whitening,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLES: dict[str, str] = {
    "op4_near_dedup": pair_sql.linked_documents(4, 80, "least(d.doc_id, coalesce(c.component_id, d.doc_id)) = d.doc_id AS kept"),
    "op5_line_dedup": line_dedup.SQL,
    "op8_exact_top_k": pivot_search.SQL,
    "op9_nearest_neighbours": block_search.SQL,
    "op11_ngram_join": pair_sql.linked_documents(4, 85, "coalesce(k.n_links, 0) AS n_links"),
    "op13_merkle_manifest": merkle.SQL,
}
