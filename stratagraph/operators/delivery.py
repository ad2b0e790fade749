"""Delivery status of tested elements: the least fixpoint over dependencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagraph.plans.fixpoint import MERGE, Rounds
from stratagraph.sources.documents import shared_key


def rollup(results: DataFrame) -> DataFrame:
    """(element_id, passed, n_passed, n_failed) of tested elements."""
    p = F.coalesce("passed", F.lit(False))
    return results.groupBy(*shared_key(results), "element_id").agg(F.bool_and(p).alias("passed"), F.count_if(p).alias("n_passed"), F.count_if(~p).alias("n_failed"))


def delivery_status(spark: SparkSession, results: DataFrame, edges: DataFrame) -> DataFrame:
    """(element_id, status): delivered if all results passed and all tested
    dependencies are delivered; cycles and what needs them are not.

    Each round settles the elements whose last open dependency was settled by the
    round before: a round touches new rows alone, not the whole graph.
    """
    tables, key = Rounds(spark), shared_key(results, edges)
    at = [*key, "element_id"]
    tested = tables.save(rollup(results).select(*at, "passed"))
    ids = tested.select(*at)
    need = edges.filter("kind = 'dependency' and from_id <> to_id").select(*key, "from_id", "to_id").distinct()
    for end in ("from_id", "to_id"):
        need = need.join(ids.withColumnRenamed("element_id", end), [*key, end], "left_semi")
    need = tables.save(need)
    tally = lambda rows, name: rows.groupBy(*key, "from_id").agg(F.count(F.lit(1)).alias(name)).withColumnRenamed("from_id", "element_id")
    state = tested.filter("passed").join(tally(need, "n"), at, "left").select(*at, F.coalesce("n", F.lit(0)).alias("open"))
    state = tables.save(state)
    new = tables.save(state.filter("open = 0").select(*at))
    done, rounds = new, 0
    while True:
        met = tally(need.join(new.withColumnRenamed("element_id", "to_id"), [*key, "to_id"]), "met")
        state = tables.save(state.filter("open > 0").join(met, at, "left").select(*at, (F.col("open") - F.coalesce("met", F.lit(0))).alias("open")))
        new = tables.save(state.filter("open = 0").select(*at))
        if new.isEmpty():
            break
        done, rounds = done.unionAll(new), rounds + 1
        if rounds % MERGE == 0:
            done = tables.save(done)
    ok = done.withColumn("ok", F.lit(True))
    return ids.join(ok, at, "left").select(*at, F.when(F.col("ok"), "delivered").otherwise("not_delivered").alias("status"))


def status_changes(now: DataFrame, before: DataFrame) -> DataFrame:
    """(element_id, was, status) of tested elements whose status differs."""
    at = [*shared_key(now, before), "element_id"]
    old = before.select(*at, F.col("status").alias("was"))
    return now.join(old, at, "left").filter("not (was <=> status)").select(*at, "was", "status")


def run_summary(results: DataFrame) -> DataFrame:
    """One row: total, passed, failed, missing (criteria)."""
    p = F.col("passed")
    return results.agg(F.count(F.lit(1)).alias("total"), F.count_if(p).alias("passed"), F.count_if(~p).alias("failed"), F.count_if(p.isNull()).alias("missing"))
