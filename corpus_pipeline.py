"""A corpus from raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept,
and returns the columns of documents; the last returns packed pieces. Results
are written between stages. A doc_id names one document here: of rows that
share an id, all go if one is dropped as a copy. Rows without an id stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratagraph.llm import exact_dedup, jaccard, mixing, packing, quality
from stratagraph.llm.queries import PACKING_TOKENS, _tokenizer
from stratagraph.llm.scratch import Scratch


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    return docs.join(dropped.select("doc_id"), "doc_id", "left_anti").select(docs.columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    weights = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = "_" * (1 + max(map(len, docs.columns))) + "quality"  # longer than any column's name
    scored = quality.with_score(docs, weights, score_col=name)
    return scored.filter(scored[name] >= quality.THRESHOLD).select(docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id."""
    return _without(docs, exact_dedup.exact_dedup(docs).filter("not kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the one with the smallest id."""
    return _without(docs, jaccard.similar_documents(docs).filter("not kept"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents that bring sources to tempered weights, shuffled."""
    return mixing.poisson_mix(docs, mixing.tempered(docs), keys=False)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of related ones."""
    return packing.pack(docs, *_tokenizer(PACKING_TOKENS)).drop("ids")


STAGES = [
    ("quality", keep_quality),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]

#: A trained model decides in the first stage: no SQL gives the same rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
