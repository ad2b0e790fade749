"""Ranked text search over elements, relationships and views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagraph.functions.text import score_text
from stratagraph.sources.documents import Graph


def search(graph: Graph, query: str, most: int | None = 50) -> DataFrame:
    """(kind, id, name, type, score): the best rows, ties in document order. A
    top-k needs no sort of all rows: each task keeps its own best."""
    half = lambda c: score_text(F.col(c), query) / 2
    full = lambda c: score_text(F.col(c), query).cast("double")
    e = graph.elements.select(F.lit(0).alias("rank"), "ord", F.lit("element").alias("kind"), "id", "name", "type", F.greatest(full("name"), full("id"), half("type"), half("description")).alias("score"))
    r = graph.relationships.select(F.lit(1), "ord", F.lit("relationship"), "id", "name", "type", F.greatest(full("name"), half("type"), half("statement")))
    v = graph.views.select(F.lit(2), "ord", F.lit("view"), F.col("view_id"), F.col("view_name"), F.lit(None).cast("string"), F.greatest(full("view_name"), full("view_id")))
    out = e.unionAll(r).unionAll(v).filter("score > 0").orderBy(F.desc("score"), "rank", "ord", "id")
    return (out if most is None else out.limit(most)).select("kind", "id", "name", "type", "score")
