"""The query of each operator, over its whole table, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .chat import conversation_digests
from .common import table
from .exact_dedup import duplicate_classes
from .fingerprints import fingerprint_table
from .language import languages
from .mixing import mixed_schedule
from .packing import pack_documents
from .quality import quality_scores
from .secrets import scan
from .simhash import near_duplicate_classes
from .token_shards import token_table


def vocabulary(name: str) -> str:
    """The file of a public tokenizer."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_table(spark, table(spark, sf_dir, "documents"))


def op2_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_table(spark, table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=0)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_classes(spark, table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(spark, table(spark, sf_dir, "documents"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conversation_digests(spark, given.unionByName(extra))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(spark, table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_schedule(spark, table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark, table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=1, capacity=4096)


QUERIES = {
    "op1_fingerprints": op1_fingerprints,
    "op2_token_shards": op2_token_shards,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_simhash": op4_simhash,
    "op5_chat": op5_chat,
    "op6_language": op6_language,
    "op7_mixing": op7_mixing,
    "op8_quality": op8_quality,
    "op9_packing": op9_packing,
    "op10_secrets": op10_secrets,
}

ORACLE_SQL = {
    "op3_exact_dedup": r"""
        WITH k AS (
          SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
          FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, text_sha256
        FROM k WINDOW w AS (PARTITION BY text_sha256)
    """,
}
