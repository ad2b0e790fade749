"""Queries of the numbered operators over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stratagraph.llm import exact_dedup, importance, jaccard, lattice, licenses, mixing, packing, pii, quality, secrets, substring, token_files, trie
from stratagraph.llm.scratch import Scratch


#: Tokenizer files: which library file, what becomes of a space, the end id.
PACKING_TOKENS = ("word_bpe_49k.json", "drop", 2)
FILE_TOKENS = ("byte_bpe_50k.json", "prefix", 0)


def _tokenizer(choice: tuple[str, str, int]) -> tuple[str, str, int]:
    import public_tokenizers

    return (public_tokenizers.path(choice[0]), *choice[1:])


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(_table(spark, sf_dir, "documents"))


def op3_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.similar_vectors(_table(spark, sf_dir, "embeddings"))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(_table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(_table(spark, sf_dir, "documents"))


def op6_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_dedup(_table(spark, sf_dir, "documents")).drop("kept_text")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return mixing.poisson_mix(docs, mixing.tempered(docs))


def op8_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), *_tokenizer(PACKING_TOKENS)).drop("row_key", "ids")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{Scratch(spark, 'tokens').root}/files"
    token_files.write_tokens(_table(spark, sf_dir, "documents"), path, *_tokenizer(FILE_TOKENS))
    return token_files.read_tokens(spark, path).drop("ids")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.conversation_trie(_table(spark, sf_dir, "conversations"))


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find_licenses(_table(spark, sf_dir, "documents"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_jaccard_join": op2_jaccard_join,
        "op3_lattice_dedup": op3_lattice_dedup,
        "op4_personal_data": op4_personal_data,
        "op5_quality": op5_quality,
        "op6_recompression": op6_recompression,
        "op7_poisson_mix": op7_poisson_mix,
        "op8_retrieval_packing": op8_retrieval_packing,
        "op9_secrets": op9_secrets,
        "op10_token_files": op10_token_files,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_licenses": op12_licenses,
        "op13_importance": op13_importance,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": exact_dedup.ORACLE, "op7_poisson_mix": mixing.ORACLE, "op11_prefix_trie": trie.ORACLE, "op12_licenses": licenses.ORACLE, "op13_importance": importance.ORACLE}
