"""Intermediate tables in the folder that all executors share.

Written tables cut the lineage: a lost executor costs a reread, never a
recomputation of the whole plan. They also carry no partitioning, so joins on
them shuffle both sides and adaptive execution can split hot keys.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary one only if unset."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _OWN[app] = tempfile.mkdtemp(prefix="stratagraph-")
    return _OWN[app]


@contextlib.contextmanager
def _shuffles_removed(spark: SparkSession):
    """Shuffle files of what is written meanwhile go once it is written."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


class Scratch:
    """A folder of written tables; removed when the Python process ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        atexit.register(self.clear)

    def save(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and read it back; the plan of the result is one scan."""
        self._n += 1
        path = f"{self.root}/{self._n}"
        schema = df.schema
        with _shuffles_removed(self.spark):
            df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        self._delete(df._scratch_path)

    def clear(self) -> None:
        with contextlib.suppress(Exception):
            self._delete(self.root)

    def _delete(self, path: str) -> None:
        sc = self.spark.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
