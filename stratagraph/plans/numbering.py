"""Numbers in a sorted order, without all rows in one task."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratagraph.plans.fixpoint import Rounds


def numbered(rows: DataFrame, order: list[Column], tables: Rounds, column: str, first: int = 1) -> DataFrame:
    """``rows`` with their numbers in ``order``, from ``first`` on. Rows are dealt to
    ranges of the order, sorted in each and written once with their places; the
    driver sees one count a range. What is read later only adds a range's start."""
    # The last key tells equal rows apart. An id has the range above 33 bits, the place in it below.
    dealt = rows.repartitionByRange(*order, F.monotonically_increasing_id()).sortWithinPartitions(*order)
    dealt = tables.save(dealt.withColumn("range_place", F.monotonically_increasing_id()))
    dealt = dealt.withColumn("range_no", F.shiftright("range_place", 33).cast("int"))
    counts = sorted(tuple(r) for r in dealt.groupBy("range_no").count().collect())
    starts = [(p, s) for (p, _), s in zip(counts, accumulate([first] + [n for _, n in counts]), strict=False)]
    offsets = rows.sparkSession.createDataFrame(starts, "range_no int, range_start long")
    here = F.col("range_place").bitwiseAND(F.lit((1 << 33) - 1))
    return dealt.join(F.broadcast(offsets), "range_no").withColumn(column, F.col("range_start") + here).drop("range_no", "range_start", "range_place")
