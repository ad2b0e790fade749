"""Places in a sorted order without a group, or the order itself, in one task.

Rows are dealt by ranges of the order, numbered inside each range, and the counts
of the ranges before are added. Equal rows spread over ranges too.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratagraph.llm.scratch import Scratch

#: A key that more than one row in so many has is joined by a broadcast.
HOT = 10_000


def _dealt(df: DataFrame, order: list[Column], scratch: Scratch) -> DataFrame:
    # The last key tells equal rows apart; the rows are written at once.
    return scratch.save(df.repartitionByRange(*order, F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id()))


def first_ranks(df: DataFrame, order: list[Column], draw, scratch: Scratch) -> DataFrame:
    """``df`` with ``rank`` from 1 in ``order`` for the first ``draw(rows)`` rows, else null."""
    saved = _dealt(df, order, scratch)
    counts = sorted(tuple(r) for r in saved.groupBy("part").count().collect())  # one row a range
    most = draw(sum(n for _, n in counts))
    starts = [(p, s) for (p, _), s in zip(counts, accumulate([0] + [n for _, n in counts]), strict=False) if s < most]
    if not starts:
        return saved.drop("part").withColumn("rank", F.lit(None).cast("long"))
    offsets = df.sparkSession.createDataFrame(starts, "part int, start long")
    drawn = saved.join(F.broadcast(offsets), "part")
    place = F.col("start") + F.row_number().over(Window.partitionBy("part").orderBy(*order))
    drawn = drawn.withColumn("rank", F.when(place <= most, place)).drop("part", "start")
    rest = saved.filter(F.col("part") > starts[-1][0]).drop("part").withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest)


def places(df: DataFrame, group: str, order: list[Column], scratch: Scratch) -> DataFrame:
    """``df`` with ``place`` from 0 in ``order`` within each group of any size."""
    saved = _dealt(df, [F.col(group), *order], scratch)
    spans = saved.groupBy(group, "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # Only the first group of a range can have begun before: one row a range at most.
    before = spans.withColumn("before", F.sum("n").over(earlier)).filter("before > 0").drop("n")
    place = F.row_number().over(Window.partitionBy(group, "part").orderBy(*order)) - 1
    out = saved.withColumn("place", place.cast("long")).join(F.broadcast(before), [group, "part"], "left")
    return out.withColumn("place", F.col("place") + F.coalesce("before", F.lit(0))).drop("before", "part")


def lookup(rows: DataFrame, table: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``table``, whose keys are unique. ``weight`` is at
    least the number of rows that have the key and adds up to at most ``total``, so
    at most HOT keys are hot; these are broadcast, and no other key has many rows."""
    hot = table.filter(F.col(weight) * HOT > total).drop(weight).withColumn("_hot", F.lit(True))
    cold = table.filter(F.col(weight) * HOT <= total).drop(weight)
    marked = rows.join(F.broadcast(hot), key, "left")
    found = marked.filter("_hot").drop("_hot")
    others = marked.filter("_hot is null").select(rows.columns)
    return found.unionByName(others.join(cold, key))
