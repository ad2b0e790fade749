"""Graphs as stored tables, with the state of their upkeep.

A write puts all tables of the graphs that it has into a folder of its own and then
points these graphs there (``sources.snapshots`` with one version a graph), so that a
table in which a graph has no rows any more has none, and readers see a graph before or
after. It marks the graphs dirty before they are pointed there and clean last, with the digest of what was
written, so that one that broke off is found and done again. Keys of graphs are texts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagraph.operators.lifecycle import verify_projection
from stratagraph.plans.fixpoint import Rounds
from stratagraph.sources.documents import Graph
from stratagraph.sources.snapshots import TABLES, Snapshots
from stratagraph.sources.steps import exists

STATE = "graph_key string, dirty boolean, digest string, elements long, relationships long, views long"


def _kept(spark: SparkSession, path: str) -> Snapshots:
    return Snapshots(spark, path, keep=1)


def read_projection(spark: SparkSession, path: str, keys: DataFrame | None = None) -> Graph:
    """All graphs, or those of ``keys`` (graph_key)."""
    return _kept(spark, path).as_of(keys=keys)


def content(graph: Graph) -> DataFrame:
    """(graph_key, table, n, digest) of each table's rows, with all their columns, in any
    order: four sums modulo 2^32 of the rows' SHA-256."""
    parts = []
    for t in TABLES:
        rows = getattr(graph, t)
        body = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(rows.columns)])), 256)
        parts.append(rows.select("graph_key", F.lit(t).alias("table"), body.alias("body")))
    sums = [F.hex(F.pmod(F.sum(F.conv(F.substring("body", 8 * k + 1, 8), 16, 10).cast("long")), F.lit(1 << 32))) for k in range(4)]
    return reduce(DataFrame.unionAll, parts).groupBy("graph_key", "table").agg(F.count(F.lit(1)).alias("n"), F.concat_ws(":", *sums).alias("digest"))


def digests(graph: Graph) -> DataFrame:
    """(graph_key, digest): one digest of a graph's five tables."""
    return _digests(content(graph))


def _digests(told: DataFrame) -> DataFrame:
    whole = told.groupBy("graph_key").agg(F.array_sort(F.collect_list(F.struct("table", "n", "digest"))).alias("x"))  # five rows
    return whole.select("graph_key", F.sha2(F.to_json("x"), 256).alias("digest"))


def sync_state(spark: SparkSession, path: str) -> DataFrame:
    """The last state of each graph: a log of states, of which the newest counts."""
    if not exists(spark, f"{path}/state"):
        return spark.createDataFrame([], STATE)
    log = spark.read.schema(f"{STATE}, at timestamp").parquet(f"{path}/state")
    fields = [c.split()[0] for c in STATE.split(", ")][1:]
    return log.groupBy("graph_key").agg(F.max_by(F.struct(*fields), "at").alias("x")).select("graph_key", "x.*")


def _mark(rows: DataFrame, path: str) -> None:
    rows.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{path}/state")


def mark_dirty(graphs: DataFrame, path: str) -> None:
    """Say of graphs (graph_key) that their projection is behind."""
    empty = [F.lit(None).cast(k).alias(c) for c, k in (x.split() for x in STATE.split(", ")[2:])]
    _mark(graphs.select("graph_key", F.lit(True).alias("dirty"), *empty), path)


def write_projection(graph: Graph, path: str) -> DataFrame:
    """Write graphs in place of what is there of them, check what was written, and mark
    them clean. Returns what differs (graph_key, kind, id, side), for tables whose rows
    differ in content a row without id: with a row there the graph stays dirty."""
    spark = graph.elements.sparkSession
    tables = Rounds(spark)
    kept = _kept(spark, path)
    folder = kept.stage(graph)
    keys = tables.save(kept.keys(folder))
    mark_dirty(keys, path)
    kept.publish(folder)
    written = read_projection(spark, path, keys)
    mine, theirs = content(graph), tables.save(content(written))
    at = ["graph_key", "table"]
    both = mine.join(theirs.select(*at, F.col("n").alias("m"), F.col("digest").alias("d")), at, "full_outer").filter("not (digest <=> d) or not (n <=> m)")
    differs = both.select("graph_key", F.concat(F.lit("rows of "), "table").alias("kind"), F.lit(None).cast("string").alias("id"), F.lit("both").alias("side"))
    off = differs = tables.save(differs)
    bad = differs.select("graph_key").distinct()
    if not differs.isEmpty():  # rows of the same digest have the same ids
        of = lambda g: Graph(*(getattr(g, t).join(bad, "graph_key", "left_semi") for t in TABLES))
        off = tables.save(verify_projection(of(graph), of(written)).unionByName(differs))
    kinds = [F.coalesce(F.sum(F.when(F.col("table") == t, F.col("n"))), F.lit(0)).alias(t) for t in ("elements", "relationships", "views")]
    good = _digests(theirs).join(theirs.groupBy("graph_key").agg(*kinds), "graph_key").join(bad, "graph_key", "left_anti")
    _mark(good.select("graph_key", F.lit(False).alias("dirty"), "digest", "elements", "relationships", "views"), path)
    return off


def clear_graphs(graphs: DataFrame, path: str) -> None:
    """Take graphs (graph_key) out of a projection."""
    _kept(graphs.sparkSession, path).forget(graphs)


def stale(canonical: Graph, state: DataFrame) -> DataFrame:
    """(graph_key) whose projection is dirty, missing or of another content."""
    both = digests(canonical).withColumnRenamed("digest", "now").join(state.select("graph_key", "dirty", "digest"), "graph_key", "left")
    return both.filter(F.coalesce("dirty", F.lit(True)) | ~F.col("digest").eqNullSafe(F.col("now"))).select("graph_key")


def recover(canonical: Graph, path: str) -> DataFrame:
    """Write again the graphs that are behind; the rest stays as it is."""
    spark = canonical.elements.sparkSession
    behind = Rounds(spark).save(stale(canonical, sync_state(spark, path)))  # the state changes below
    part = Graph(*(getattr(canonical, t).join(behind, "graph_key", "left_semi") for t in TABLES))
    if not behind.isEmpty():
        write_projection(part, path)
    return behind
