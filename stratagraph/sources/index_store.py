"""A stored index whose upkeep and check cost what changed, not what is there.

Records lie in ``parts`` partitions by a hash of their identity. Every partition has
a summary for each graph and channel: the number of records and the sum (four sums
modulo 2^32) of hashes of identity and content. A delta reads and writes only the partitions of its
rows, and their summaries. Whoever keeps such summaries of the canonical side as well,
from the same deltas, sees by comparing a few rows whether both sides agree, and in
which partition they don't.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagraph.operators.lifecycle import CHANNELS, apply_delta
from stratagraph.plans.fixpoint import Rounds
from stratagraph.sources.documents import shared_key
from stratagraph.sources.steps import delete, exists

_SUMS = ["s0", "s1", "s2", "s3"]


def _part(parts: int) -> Column:
    return F.pmod(F.xxhash64("canonical_identity"), F.lit(parts)).cast("int")


def summaries(rows: DataFrame, parts: int) -> DataFrame:
    """(part, channel, n, s0..s3) of records (canonical_identity, channel, content_version)."""
    body = F.sha2(F.concat_ws("\x1f", F.col("canonical_identity"), F.coalesce("content_version", F.lit(""))), 256)
    rows = rows.select(*shared_key(rows), _part(parts).alias("part"), "channel", body.alias("body"))
    sums = [F.pmod(F.sum(F.conv(F.substring("body", 8 * k + 1, 8), 16, 10).cast("long")), F.lit(1 << 32)).alias(s) for k, s in enumerate(_SUMS)]
    return rows.groupBy(*shared_key(rows), "part", "channel").agg(F.count(F.lit(1)).alias("n"), *sums)


def moved(summary: DataFrame, gone: DataFrame, come: DataFrame, parts: int) -> DataFrame:
    """A summary after records went and others came: from these records alone."""
    at = [*shared_key(summary, gone, come), "part", "channel"]
    signed = lambda t, f: t.select(*at, *[(F.col(c) * f).alias(c) for c in ("n", *_SUMS)])
    rows = signed(summary, 1).unionByName(signed(summaries(gone, parts), -1)).unionByName(signed(summaries(come, parts), 1))
    out = rows.groupBy(*at).agg(F.sum("n").alias("n"), *[F.pmod(F.sum(s), F.lit(1 << 32)).alias(s) for s in _SUMS])
    return out.filter("n <> 0")


def coherence(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(channel, n_expected, n_actual, parts_off, coherent) by two summaries."""
    at = [*shared_key(expected, actual), "part", "channel"]
    a = expected.select(*at, F.col("n").alias("n_a"), F.struct("n", *_SUMS).alias("a"))
    b = actual.select(*at, F.col("n").alias("n_b"), F.struct("n", *_SUMS).alias("b"))
    off = F.count_if(~F.col("a").eqNullSafe(F.col("b")))
    out = a.join(b, at, "full_outer").groupBy(*at[:-2], "channel").agg(F.coalesce(F.sum("n_a"), F.lit(0)).alias("n_expected"), F.coalesce(F.sum("n_b"), F.lit(0)).alias("n_actual"), off.alias("parts_off"))
    return out.withColumn("coherent", F.col("parts_off") == 0)


def coherent(states: DataFrame) -> DataFrame:
    """One row a graph: coherent if every channel is there and agrees."""
    return states.groupBy(*shared_key(states)).agg(((F.count_distinct("channel") == len(CHANNELS)) & F.bool_and("coherent")).alias("coherent"))


def touched_records(wanted: DataFrame, touched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records of touched objects (canonical_identity), and those that don't exist."""
    at = [*shared_key(wanted, touched), "canonical_identity"]
    ids = touched.select(*at).distinct()
    return wanted.join(ids, at, "left_semi"), ids.join(wanted.select(*at), at, "left_anti")


class IndexStore:
    """An index below ``path``. The columns of its records are those of the first write;
    canonical_identity, channel and content_version are among them."""

    def __init__(self, spark: SparkSession, path: str, parts: int = 64):
        self.spark, self.path, self.parts = spark, path, parts

    def create(self, rows: DataFrame) -> None:
        self._put("records", rows.withColumn("part", _part(self.parts)), None)
        self._put("summary", summaries(rows, self.parts), None)

    def records(self, parts: list[int] | None = None) -> DataFrame:
        return self._table("records", parts)

    def summary(self, parts: list[int] | None = None) -> DataFrame:
        return self._table("summary", parts)

    def find(self, ids: DataFrame) -> DataFrame:
        """Records of some identities, out of their partitions alone."""
        at = [*shared_key(self.records(), ids), "canonical_identity"]
        return self.records(self._parts(ids)).join(ids.select(*at), at, "left_semi").drop("part")

    def apply(self, upserts: DataFrame, tombstones: DataFrame) -> list[int]:
        """Take in a delta; the partitions that it touched. Each of these is written anew,
        all others are neither read nor written."""
        key = shared_key(self.records(), upserts, tombstones)
        at = [*key, "canonical_identity"]
        parts = self._parts(upserts.select("canonical_identity").unionByName(tombstones.select("canonical_identity")))
        if not parts:
            return parts
        tables = Rounds(self.spark)
        old = self.records(parts).drop("part")
        upserts = tables.save(upserts.select(old.columns))
        named = upserts.select(*at).unionByName(tombstones.select(*at)).distinct()
        gone = tables.save(old.join(named, at, "left_semi"))
        summary = tables.save(moved(self.summary(parts), gone, upserts, self.parts))
        rows = tables.save(apply_delta(old, upserts, tombstones).withColumn("part", _part(self.parts)))
        self._put("records", rows, parts)
        self._put("summary", summary, parts)
        tables.clear()
        return parts

    def _parts(self, ids: DataFrame) -> list[int]:
        return sorted(r["p"] for r in ids.select(_part(self.parts).alias("p")).distinct().collect())  # at most ``parts``

    def _folders(self, table: str) -> dict[int, str]:
        """Where each partition of a table lies: a small table, replaced as a whole."""
        if not exists(self.spark, f"{self.path}/{table}-places"):
            return {}
        rows = self.spark.read.schema("part int, folder string, no long").parquet(f"{self.path}/{table}-places")
        last = rows.groupBy("part").agg(F.max_by("folder", "no").alias("folder"))
        return {r["part"]: r["folder"] for r in last.collect()}

    def _put(self, table: str, rows: DataFrame, parts: list[int] | None) -> None:
        """Write partitions to new folders, then let the table point there, then drop
        the old ones: readers see a partition before or after, and no half."""
        before = self._folders(table)
        parts = list(range(self.parts)) if parts is None else parts
        home = f"{self.path}/{table}/{uuid.uuid4().hex}"
        rows.repartition("part").withColumn("part_", F.col("part")).write.partitionBy("part_").parquet(home)
        there = {p for p in parts if exists(self.spark, f"{home}/part_={p}")}
        at = self.spark.range(1).select(F.unix_micros(F.current_timestamp()).alias("no"))
        places = self.spark.createDataFrame([(p, f"{home}/part_={p}" if p in there else None) for p in parts], "part int, folder string")
        places.crossJoin(F.broadcast(at)).coalesce(1).write.mode("append").parquet(f"{self.path}/{table}-places")
        if not exists(self.spark, f"{self.path}/{table}-schema"):
            rows.limit(0).coalesce(1).write.parquet(f"{self.path}/{table}-schema")
        for p in parts:
            if before.get(p):
                delete(self.spark, before[p])

    def _table(self, table: str, parts: list[int] | None) -> DataFrame:
        schema = self.spark.read.parquet(f"{self.path}/{table}-schema").schema
        found = [f for p, f in self._folders(table).items() if f and (parts is None or p in parts)]
        return self.spark.read.schema(schema).parquet(*found) if found else self.spark.createDataFrame([], schema)
