"""Keyed steps of a job as folders of Parquet: a step written twice is there once.

Each step of a table has a folder of its own, replaced as a whole when the step is
done again. A step counts once it stands in the table of finished steps, which is
written last: what a broken-off step left behind is never read, and is replaced
when the step is done again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_DONE = "step string, at timestamp"


def file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = file_system(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    p, fs = file_system(spark, path)
    fs.delete(p, True)


class Steps:
    """Tables below ``path`` that are written step by step."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def write(self, table: str, step: str, rows: DataFrame) -> None:
        """Put the rows of a step in a table, in place of what it had there."""
        rows.withColumn("step", F.lit(step)).write.mode("overwrite").parquet(f"{self.path}/{table}/{step}")

    def finish(self, step: str) -> None:
        """From now on the step counts."""
        done = self.spark.range(1).select(F.current_timestamp().alias("at"))
        self.write("done", step, done.coalesce(1))

    def done(self) -> DataFrame:
        """(step, at) of finished steps."""
        return self._rows("done", _DONE)

    def read(self, table: str, schema: str) -> DataFrame:
        """Rows of finished steps, with their step."""
        return self._rows(table, f"{schema}, step string").join(self.done().select("step"), "step", "left_semi")

    def remove(self, steps: list[str], tables: list[str]) -> None:
        """Take steps out: first they count no more, then their rows go."""
        for table in ["done", *tables]:
            for step in steps:
                delete(self.spark, f"{self.path}/{table}/{step}")

    def _rows(self, table: str, schema: str) -> DataFrame:
        if not exists(self.spark, f"{self.path}/{table}"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{self.path}/{table}")
