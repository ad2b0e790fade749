"""Retrieval quality by purpose, and the gate over it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def purpose_metrics(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """(purpose, mandatory, hits, closure_ok, forced_hits, precision).

    ``expected`` has purpose, id, role ("seed" or "closure"); ``observed`` has
    purpose, id, forced. Nothing observed counts as a precision of one.
    """
    seen = observed.select("purpose", "id", "forced").distinct()
    hit = expected.join(seen.select("purpose", "id", F.lit(True).alias("hit")).distinct(), ["purpose", "id"], "left")
    by = hit.groupBy("purpose").agg(
        F.count_if(F.col("role") == "seed").alias("mandatory"),
        F.count_if((F.col("role") == "seed") & F.col("hit").isNotNull()).alias("hits"),
        (F.count_if((F.col("role") == "closure") & F.col("hit").isNull()) == 0).alias("closure_ok"),
    )
    known = expected.select("purpose", "id").distinct().withColumn("good", F.lit(True))
    shown = seen.join(known, ["purpose", "id"], "left").groupBy("purpose").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("good").isNotNull()).alias("good"), F.count_if(F.col("forced")).alias("forced_hits"))
    out = by.join(shown, "purpose", "left")
    return out.select("purpose", "mandatory", "hits", "closure_ok", F.coalesce("forced_hits", F.lit(0)).alias("forced_hits"), F.coalesce(F.col("good") / F.col("n"), F.lit(1.0)).alias("precision"))


def quality_gate(metrics: DataFrame) -> DataFrame:
    """One row: recall, closure_correctness, forced_hits, precision, passed."""
    one = lambda c: F.coalesce(c, F.lit(1.0))
    m = metrics.agg(
        one(F.try_divide(F.sum("hits"), F.sum("mandatory"))).alias("recall"),
        one(F.avg(F.col("closure_ok").cast("double"))).alias("closure_correctness"),
        F.coalesce(F.sum("forced_hits"), F.lit(0)).alias("forced_hits"),
        one(F.avg("precision")).alias("precision"),
    )
    ok = (F.col("recall") == 1) & (F.col("closure_correctness") == 1) & (F.col("forced_hits") == 0) & F.col("precision").between(0, 1)
    return m.withColumn("passed", ok)
