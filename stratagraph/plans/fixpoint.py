"""Fixpoints as rounds of joins, with a written table after each round."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable
from itertools import count

from pyspark.sql import DataFrame, SparkSession

#: Rounds after which the rows so far are written as one table.
MERGE = 16


class Rounds:
    """Written tables in the folder that all executors share."""

    def __init__(self, spark: SparkSession):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = tempfile.mkdtemp(prefix="stratagraph-")
        self.spark, self.root, self.n = spark, f"{base}/rounds-{uuid.uuid4().hex}", 0
        atexit.register(self.clear)

    def save(self, df: DataFrame) -> DataFrame:
        """Write and read again: lost executors never recompute the rounds before."""
        self.n += 1
        path, schema = f"{self.root}/{self.n}", df.schema
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def save_dealt(self, df: DataFrame) -> DataFrame:
        """``save``; tables that are dealt by some of the columns of a join stay where they are."""
        all_keys = "spark.sql.requireAllClusterKeysForCoPartition"
        before = self.spark.conf.get(all_keys)
        self.spark.conf.set(all_keys, "false")
        try:
            return self.save(df)
        finally:
            self.spark.conf.set(all_keys, before)

    def clear(self) -> None:
        with contextlib.suppress(Exception):
            sc = self.spark.sparkContext
            p = sc._jvm.org.apache.hadoop.fs.Path(self.root)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def grow(spark: SparkSession, first: DataFrame, further: Callable[[DataFrame], DataFrame], keys: list[str], most: int | None = None) -> DataFrame:
    """``first`` and all rows that ``further`` gives of new rows, one a key, until
    a round gives none or ``most`` rounds, if given, are over. Later rows never
    replace earlier ones."""
    tables = Rounds(spark)
    new = tables.save(first)
    reached = new
    for k in count() if most is None else range(most):
        found = further(new).select(first.columns).dropDuplicates(keys)
        new = tables.save(found.join(reached.select(*keys), keys, "left_anti"))
        if new.isEmpty():
            break
        reached = reached.unionAll(new)
        if k % MERGE == MERGE - 1:
            reached = tables.save(reached)
    return reached
