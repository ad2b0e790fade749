"""Snapshots of graphs: versions that can be read as of a time, compared and restored.

A save writes the five tables of some graphs into a folder of its own and, last, one
row a graph into the list of versions. A graph's version counts from that row on. The
newest ``keep`` versions of each graph stay; older ones are struck from the list at
once, and a folder goes at a later save when no graph's version is left in it.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratagraph.plans.fixpoint import Rounds
from stratagraph.sources.documents import Graph
from stratagraph.sources.steps import exists, file_system

TABLES = ("elements", "relationships", "views", "view_elements", "view_relationships")
KEEP = 10
_VERSION = "graph_key string, version long, at timestamp, folder string, gone boolean"


class Snapshots:
    def __init__(self, spark: SparkSession, path: str, keep: int = KEEP):
        self.spark, self.path, self.keep = spark, path, keep

    def versions(self) -> DataFrame:
        """(graph_key, version, at, folder) of all versions there are."""
        return self._log().groupBy("graph_key", "version").agg(F.bool_or("gone").alias("gone"), F.max("at").alias("at"), F.max("folder").alias("folder")).filter("not gone").drop("gone")

    def save(self, graph: Graph, at: str | None = None) -> None:
        """A new version of every graph that has a row in any table. ``at``: its time,
        else now. Versions beyond the newest ``keep`` of these graphs go."""
        self.publish(self.stage(graph), at)

    def stage(self, graph: Graph) -> str:
        """Write tables to a new folder that no version points to as yet; its name."""
        folder = uuid.uuid4().hex
        for t in TABLES:
            rows = getattr(graph, t)
            rows.withColumn("graph_key", F.col("graph_key").cast("string")).write.parquet(f"{self.path}/data/{folder}/{t}")
        return folder

    def keys(self, folder: str) -> DataFrame:
        """(graph_key) of the graphs that have a row in a folder."""
        return reduce(DataFrame.unionAll, [self._rows(t, folder).select("graph_key") for t in TABLES]).distinct()

    def publish(self, folder: str, at: str | None = None) -> None:
        """A new version of every graph in a folder."""
        self._add(self.keys(folder).withColumn("folder", F.lit(folder)), at)

    def _add(self, places: DataFrame, at: str | None = None) -> None:
        """New versions of graphs (graph_key, folder)."""
        last = self._log().groupBy("graph_key").agg(F.max("version").alias("last"))
        when = F.current_timestamp() if at is None else F.lit(at).cast("timestamp")
        rows = places.join(last, "graph_key", "left").select("graph_key", (F.coalesce("last", F.lit(0)) + 1).alias("version"), when.alias("at"), "folder", F.lit(False).alias("gone"))
        self._append(rows)
        self.expire()

    def expire(self) -> None:
        """Strike versions beyond the newest ones of each graph, drop empty folders."""
        newest = Window.partitionBy("graph_key").orderBy(F.desc("version"))
        self._strike(self.versions().withColumn("out", F.row_number().over(newest) > self.keep))

    def forget(self, graphs: DataFrame) -> None:
        """Strike all versions of some graphs (graph_key)."""
        named = graphs.select("graph_key").distinct().withColumn("out", F.lit(True))
        self._strike(self.versions().join(named, "graph_key", "left").withColumn("out", F.coalesce("out", F.lit(False))))

    def _strike(self, versions: DataFrame) -> None:
        all_ = Rounds(self.spark).save(versions)
        old = all_.filter("out")
        if old.isEmpty():
            return
        self.clean()  # what was struck before: readers have had a save's time to end
        self._append(old.select("graph_key", "version", "at", "folder", F.lit(True).alias("gone")))

    def clean(self) -> None:
        """Delete folders in which no graph has a version, those of broken-off saves too.
        One process at a time may write."""
        p, fs = file_system(self.spark, f"{self.path}/data")
        live = {r["folder"] for r in self.versions().select("folder").distinct().collect()}  # one a save that is of use
        for status in fs.listStatus(p):
            if status.getPath().getName() not in live:
                fs.delete(status.getPath(), True)

    def as_of(self, at: str | None = None, keys: DataFrame | None = None) -> Graph:
        """Each graph (of ``keys``, if given) in its last version up to a time."""
        rows = self.versions() if at is None else self.versions().filter(F.col("at") <= F.lit(at).cast("timestamp"))
        rows = rows if keys is None else rows.join(keys.select("graph_key"), "graph_key", "left_semi")
        return self._read(rows.groupBy("graph_key").agg(F.max_by("folder", "version").alias("folder")))

    def version(self, wanted: DataFrame) -> Graph:
        """Graphs in given versions (graph_key, version)."""
        return self._read(self.versions().join(wanted.select("graph_key", "version"), ["graph_key", "version"]).select("graph_key", "folder"))

    def restore(self, wanted: DataFrame) -> Graph:
        """Make old versions (graph_key, version) the newest ones; these graphs as they are then.
        New versions point to the old ones' folders, which stay as long as a version does."""
        old = self.versions().join(wanted.select("graph_key", "version"), ["graph_key", "version"], "left_semi")
        self._add(old.groupBy("graph_key").agg(F.max_by("folder", "version").alias("folder")))  # old versions may go with this
        return self.as_of(keys=wanted)

    def _read(self, chosen: DataFrame) -> Graph:
        tables = Rounds(self.spark)
        chosen = tables.save(chosen)
        folders = [r["folder"] for r in chosen.select("folder").distinct().collect()]  # one a save that is still of use
        out = []
        for t in TABLES:
            parts = [f"{self.path}/data/{f}/{t}" for f in folders]
            schema = self._schema(t)
            rows = self.spark.read.schema(schema).parquet(*parts) if parts else self.spark.createDataFrame([], schema)
            rows = rows.withColumn("folder", F.regexp_extract(F.input_file_name(), r"/data/([0-9a-f]{32})/", 1))
            out.append(rows.join(chosen, ["graph_key", "folder"], "left_semi").select([c.name for c in schema]))
        return Graph(*out)

    def _rows(self, table: str, folder: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/data/{folder}/{table}")

    def _schema(self, table: str):
        any_ = self.versions().select("folder").first()
        if any_ is None:
            raise ValueError("no snapshot was saved")
        return self._rows(table, any_["folder"]).schema

    def _log(self) -> DataFrame:
        if not exists(self.spark, f"{self.path}/versions"):
            return self.spark.createDataFrame([], _VERSION)
        return self.spark.read.schema(_VERSION).parquet(f"{self.path}/versions")

    def _append(self, rows: DataFrame) -> None:
        # The log is read to make its new rows: they are written elsewhere first.
        Rounds(self.spark).save(rows).coalesce(1).write.mode("append").parquet(f"{self.path}/versions")


def capped(log: DataFrame, most: int, order: str = "seq") -> DataFrame:
    """Of a log of commands (undo, redo) the newest ``most`` of each graph."""
    newest = Window.partitionBy("graph_key").orderBy(F.desc(order))
    return log.withColumn("nth", F.row_number().over(newest)).filter(F.col("nth") <= most).drop("nth")
