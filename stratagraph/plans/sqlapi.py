"""Structural queries: projection views for Spark SQL, and a read-only gate."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from stratagraph.operators.traverse import semantic_edges
from stratagraph.sources.documents import Graph

LONGEST = 20_000
_NOISE = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", re.DOTALL)
_READS = re.compile(r"\s*\(*\s*(select|with|from|values|describe|desc|show|explain|table)\b", re.IGNORECASE)
_WRITES = re.compile(r"\b(insert|update|delete|merge|create|drop|alter|truncate|replace\s+table|load|msck|refresh|cache|uncache|set|reset|add|use|grant|revoke|call)\b", re.IGNORECASE)


class QueryRefused(ValueError):
    """A query that is empty, too long or could write."""


def read_only(text: str) -> str:
    """The query, if it can only read; strings and comments don't count."""
    if not text or not text.strip():
        raise QueryRefused("QUERY_REQUIRED")
    if len(text) > LONGEST:
        raise QueryRefused("QUERY_TOO_LONG")
    bare = _NOISE.sub(" ", text)
    if ";" in bare.strip().rstrip(";"):
        raise QueryRefused("QUERY_HAS_SEVERAL_STATEMENTS")
    if not _READS.match(bare):
        raise QueryRefused("QUERY_NOT_READ_ONLY")
    found = _WRITES.search(bare)
    if found and re.match(r"\s*(show|describe|desc)\b", bare, re.IGNORECASE) is None:
        raise QueryRefused(f"QUERY_NOT_READ_ONLY: {found[0]}")
    return text.strip().rstrip(";")


def register(graph: Graph) -> None:
    """Temporary views over a graph: elements, relationships, views, members, edges."""
    for name in ("elements", "relationships", "views", "view_elements", "view_relationships"):
        getattr(graph, name).createOrReplaceTempView(name)
    semantic_edges(graph.relationships).createOrReplaceTempView("semantic_edges")


def query(spark: SparkSession, text: str, **args) -> DataFrame:
    """Run a read-only query; ``args`` bind its named parameters."""
    return spark.sql(read_only(text), args=args or None)


def schema(spark: SparkSession) -> list[dict[str, object]]:
    """Names and columns of the projection views."""
    return [{"view": n, "columns": dict(spark.table(n).dtypes)} for n in ("elements", "relationships", "views", "view_elements", "view_relationships", "semantic_edges")]
