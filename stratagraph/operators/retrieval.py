"""Vector retrieval: thresholds for each channel, top rows, queryability.

A query vector is a literal; scores are plain array expressions, so a scan is
one stage inside code generation, and only what passes leaves it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The least score of a hit in each channel.
THRESHOLDS = {"Element": 0.80, "ArchitectureRelationship": 0.78, "View": 0.76}


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null where a norm is zero or lengths differ."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm)


def scored(records: DataFrame, query: Sequence[float], scale: str = "cosine") -> DataFrame:
    """Records with a score; scale "unit" maps the cosine to 0..1."""
    q = F.array(*[F.lit(float(x)) for x in query])
    s = cosine(F.col("vector"), q)
    out = records.withColumn("score", (1 + s) / 2 if scale == "unit" else s)
    return out.filter(F.col("score").isNotNull() & ~F.isnan("score"))


def threshold_all(records: DataFrame, query: Sequence[float], thresholds: dict[str, float] | None = None, scale: str = "cosine") -> DataFrame:
    """Every record at or above its channel's threshold, without a cap."""
    least = F.create_map(*[F.lit(x) for kv in (thresholds or THRESHOLDS).items() for x in kv])
    return scored(records, query, scale).filter(F.col("score") >= F.element_at(least, F.col("channel")))


def top_per_channel(records: DataFrame, query: Sequence[float], n: int, scale: str = "cosine") -> DataFrame:
    """The best ``n`` of each channel, ties by ord; ranks are cut before the shuffle
    ends (a window group limit), so no channel is sorted whole."""
    w = Window.partitionBy("channel").orderBy(F.desc("score"), "ord")
    return scored(records, query, scale).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def queryable(records: DataFrame, touched: DataFrame, least: float = 0.999) -> DataFrame:
    """(canonical_identity, found): touched records that are in the index and as
    near to themselves as a search for them needs."""
    own = touched.select("canonical_identity", F.col("vector").alias("wanted"))
    held = records.select("canonical_identity", "vector")
    out = own.join(held, "canonical_identity", "left")
    return out.select("canonical_identity", (F.coalesce(cosine(F.col("vector"), F.col("wanted")), F.lit(0.0)) >= least).alias("found"))


def seeds_summary(seeds: DataFrame, n: int = 8, most: int = 50) -> DataFrame:
    """The best ``n`` seeds of each channel, at most ``most``."""
    w = Window.partitionBy("channel").orderBy(F.desc("score"), "ord")
    return seeds.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= min(n, most))
