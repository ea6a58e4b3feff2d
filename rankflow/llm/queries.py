"""The registered queries over the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rankflow.llm.digest import digest_sql, document_digests
from rankflow.llm.divergence import divergence_sql, divergences
from rankflow.llm.html_text import extract
from rankflow.llm.media import text_media
from rankflow.llm.mixing import mixing_sql, mixing_table
from rankflow.llm.packing import pack
from rankflow.llm.pivot_index import near_vectors
from rankflow.llm.privacy import personal_data
from rankflow.llm.quality import quality_scores
from rankflow.llm.simhash import simhash_classes
from rankflow.llm.suffix_dedup import suffix_dedup
from rankflow.llm.token_file import token_file
from rankflow.llm.vector_codes import vector_codes, vector_codes_sql


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(_table(spark, sf_dir, "documents")).drop("span_starts", "span_ends")


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_classes(_table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(_table(spark, sf_dir, "documents"))


def op3_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_table(spark, sf_dir, "pages"))


def op8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_table(_table(spark, sf_dir, "documents"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(_table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(_table(spark, sf_dir, "embeddings"))


def op12_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_digests(_table(spark, sf_dir, "documents"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergences(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_suffix_dedup, op2_pack, op3_pivot_index, op4_simhash, op5_quality, op6_privacy, op7_html, op8_tokens, op9_mixing, op10_media,
        op11_vector_codes, op12_digest, op13_divergence,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op9_mixing": mixing_sql(), "op11_vector_codes": vector_codes_sql(), "op12_digest": digest_sql(), "op13_divergence": divergence_sql()}
