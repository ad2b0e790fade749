"""A backfill of vectors in batches, with attempts, isolated failures and checkpoints.

Records are dealt to batches by a hash of their identity. An attempt at a batch asks the
provider for the vectors of its records that have none yet, writes the vectors, then
the failures, and last that the attempt is done (``sources.steps``). One that breaks off
between any two of these is done again under the same name and leaves the same rows.
A run makes at most ``attempts`` attempts at a record; a later run goes on with those
that failed. Another canonical version begins anew. Progress is a query over what is
stored: no list of identities passes through the driver or through one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagraph.plans.fixpoint import Rounds
from stratagraph.sources.documents import shared_key
from stratagraph.sources.steps import Steps

#: What a record's failure is called if the provider gives no category.
UNNAMED = "PROVIDER_RECORD_FAILED"
_ID = "canonical_identity string, channel string, content_version string"
#: A provider takes (canonical_identity, channel, content_version, attempt) and gives
#: (canonical_identity, vector, category); no vector is a failure, as is no row.
Provider = Callable[[DataFrame], DataFrame]


class Backfill:
    """The stored state of the backfill of one index."""

    def __init__(self, wanted: DataFrame, path: str, version: str, batches: int = 8):
        """``wanted``: what the index shall have, ``_ID`` and ``graph_key``, if any."""
        self.spark, self.version, self.batches = wanted.sparkSession, version, batches
        self.key = shared_key(wanted)
        self.wanted = wanted.select(*self.key, "canonical_identity", "channel", "content_version")
        self.at = [*self.key, "canonical_identity"]
        # Steps of other versions lie elsewhere: their checkpoints don't count.
        self.steps = Steps(self.spark, f"{path}/{hashlib.sha256(version.encode()).hexdigest()[:24]}")
        self.keys = "graph_key string, " if self.key else ""

    def records(self) -> DataFrame:
        """Vectors so far, with the versions that they are of."""
        rows = self.steps.read("records", f"{self.keys}{_ID}, vector array<double>, attempt int").drop("step")
        return rows.withColumn("canonical_version", F.lit(self.version)).withColumn("index_version", F.concat(F.lit("index:"), "content_version"))

    def attempts(self) -> DataFrame:
        """All failures: identity, channel, category, attempt (from 1 over all runs)."""
        return self.steps.read("failures", f"{self.keys}{_ID}, category string, attempt int").drop("step")

    def failures(self) -> DataFrame:
        """The last failure of each identity, whether or not it came through later."""
        return merge_failures(self.attempts())

    def pending(self) -> DataFrame:
        on = [*self.at, "content_version"]
        return self.wanted.join(self.records().select(*on), on, "left_anti")

    def progress(self) -> DataFrame:
        """(channel, total, completed, retries, failed, status): failed are those that
        have a failure and no vector."""
        at = [*self.key, "channel"]
        on = [*self.at, "content_version"]
        have = self.records().select(*on).distinct().withColumn("have", F.lit(True))
        bad = self.attempts().groupBy(*self.at).agg(F.count(F.lit(1)).alias("bad"))
        rows = self.wanted.join(have, on, "left").join(bad, self.at, "left")
        out = rows.groupBy(*at).agg(
            F.count(F.lit(1)).alias("total"), F.count("have").alias("completed"), F.coalesce(F.sum("bad"), F.lit(0)).alias("retries"),
            F.count_if(F.col("bad").isNotNull() & F.col("have").isNull()).alias("failed"),
        )
        begun = (F.col("completed") > 0) | (F.col("retries") > 0)
        return out.withColumn("status", F.when(F.col("completed") == F.col("total"), "complete").when(begun, "partial").otherwise("pending"))

    def run(self, provider: Provider, attempts: int = 2) -> DataFrame:
        """Go through all batches; the progress after it."""
        finished = {r["step"] for r in self.steps.done().select("step").collect()}  # batches times attempts of all runs
        for batch in range(self.batches):
            before = max([int(s.rsplit("-", 1)[1]) for s in finished if s.startswith(f"batch-{batch}-")], default=0)
            for attempt in range(before + 1, before + attempts + 1):
                if not self._attempt(provider, batch, attempt):
                    break
        return self.progress()

    def _attempt(self, provider: Provider, batch: int, attempt: int) -> bool:
        """Whether there was something to do."""
        tables, step = Rounds(self.spark), f"batch-{batch}-{attempt}"
        mine = F.pmod(F.xxhash64("canonical_identity"), F.lit(self.batches)) == batch
        todo = tables.save(self.pending().filter(mine).withColumn("attempt", F.lit(attempt)))
        if todo.isEmpty():
            return False
        said = provider(todo).select(*self.at, F.col("vector").cast("array<double>").alias("vector"), "category")
        said = said.groupBy(*self.at).agg(F.max_by("vector", F.col("vector").isNotNull()).alias("vector"), F.max("category").alias("category"))
        both = tables.save(todo.join(said, self.at, "left"))  # the provider is asked once
        kept = [*self.key, "canonical_identity", "channel", "content_version"]
        self.steps.write("records", step, both.filter("vector is not null").select(*kept, "vector", "attempt"))
        self.steps.write("failures", step, both.filter("vector is null").select(*kept, F.coalesce("category", F.lit(UNNAMED)).alias("category"), "attempt"))
        self.steps.finish(step)
        tables.clear()
        return True


def merge_failures(failures: DataFrame) -> DataFrame:
    """Of each identity its last failure."""
    rest = [c for c in failures.columns if c not in ("graph_key", "canonical_identity")]
    at = [*shared_key(failures), "canonical_identity"]
    return failures.groupBy(*at).agg(F.max_by(F.struct(*rest), "attempt").alias("x")).select(*at, "x.*")
