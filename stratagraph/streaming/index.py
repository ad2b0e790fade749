"""An index kept up to date from a stream of mutations.

Each micro-batch is reduced to the last state of every id and written as a new
version of the table; the version that a batch makes is named by its number, so
a batch that runs again after a failure writes the same folder anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stratagraph.operators.mutate import apply_log


def version_path(root: str, version: int) -> str:
    return f"{root}/version={version:012d}"


def latest(spark: SparkSession, root: str, before: int | None = None) -> int | None:
    """The newest finished version below ``before``."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    found = [int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(p) if s.getPath().getName().startswith("version=") and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return max((v for v in found if before is None or v < before), default=None)


def maintain(log: DataFrame, root: str, fields: list[str], checkpoint: str) -> StreamingQuery:
    """Apply a streamed log (seq, type, id, fields) to the table under ``root``."""
    schema = "id string, " + ", ".join(f"{f} string" for f in fields)

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = latest(spark, root, number + 1)
        rows = spark.read.schema(schema).parquet(version_path(root, old)) if old is not None else spark.createDataFrame([], schema)
        apply_log(rows, batch, fields).write.mode("overwrite").parquet(version_path(root, number + 1))

    return log.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def activity(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Mutations by type in tumbling windows; rows later than ``late`` are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select("window.start", "event_type", "n", "total")
