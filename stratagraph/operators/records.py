"""Checks of records on their way into an index: all reasons of a row in one pass.

Rows with a reason go to quarantine, the others on to ``lifecycle.apply_delta``; both
are written by the pass that checks them, which also counts the reasons.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from stratagraph.operators.lifecycle import CHANNELS

#: Texts that a record must have.
TEXTS = ["canonical_identity", "channel", "canonical_version", "content_version", "index_version", "provider", "model", "model_version"]
REASONS = [*[f"{c} is blank" for c in TEXTS], "unknown channel", "bad dimensions", "bad vector", "other profile", "run id"]


def _blank(column: str) -> Column:
    return F.trim(F.coalesce(F.col(column), F.lit(""))) == ""


def _reasons(checks: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(reason)) for reason, bad in checks.items()]))


def checked(records: DataFrame, profile: dict[str, object]) -> DataFrame:
    """Records with ``reasons``, empty if they may go in. ``profile`` has the provider,
    model, model_version and dimensions of the index. A column run_id may be there if it
    is null: runs leave no mark on what is kept."""
    size = F.col("dimensions")
    whole = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    checks = {f"{c} is blank": _blank(c) for c in TEXTS}
    checks["unknown channel"] = ~_blank("channel") & ~F.col("channel").isin(CHANNELS)
    checks["bad dimensions"] = size <= 0
    checks["bad vector"] = F.col("vector").isNull() | (F.size("vector") != size) | ~whole
    checks["other profile"] = reduce(Column.__or__, [~F.col(c).eqNullSafe(F.lit(v)) for c, v in profile.items()])
    if "run_id" in records.columns:
        checks["run id"] = F.col("run_id").isNotNull()
    return records.withColumn("reasons", _reasons(checks))


def checked_tombstones(rows: DataFrame) -> DataFrame:
    """Tombstones (canonical_identity, channel, canonical_version), trimmed, with ``reasons``."""
    checks = {f"{c} is blank": _blank(c) for c in ("canonical_identity", "canonical_version")} | {"unknown channel": ~F.coalesce(F.col("channel"), F.lit("")).isin(CHANNELS)}
    if "run_id" in rows.columns:
        checks["run id"] = F.col("run_id").isNotNull()
    out = rows.withColumn("reasons", _reasons(checks))
    return out.withColumns({c: F.trim(c) for c in ("canonical_identity", "canonical_version")})


def quarantine(rows: DataFrame, path: str) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Write checked rows below ``path``, accepted and quarantined ones apart; both, and
    the number of rows with each reason, counted by the same pass."""
    spark, seen = rows.sparkSession, Observation()
    counts = [F.count_if(F.array_contains("reasons", r)).alias(r) for r in REASONS]
    told = rows.observe(seen, F.count(F.lit(1)).alias("rows"), *counts)
    told.withColumn("accepted", F.size("reasons") == 0).write.mode("overwrite").partitionBy("accepted").parquet(path)
    back = spark.read.schema(rows.withColumn("accepted", F.lit(True)).schema).parquet(path)
    return back.filter("accepted").drop("accepted", "reasons"), back.filter("not accepted").drop("accepted"), {r: n for r, n in seen.get.items() if n}
