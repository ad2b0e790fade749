"""Gates before a release: benchmarks, capacity evidence, order of deliveries.

Each gate is an ordered list of rules, and the first one that a row fails is its
category; a rule whose columns are null is failed. The tables:

- ``benchmarks`` (benchmark_id); ``purposes`` (benchmark_id, place, purpose, has_results,
  cardinality, precision, forced_hits): what a benchmark says of each purpose. A
  cardinality that is null was not told;
- ``evidence`` (benchmark_id, place, role, id): the ids behind a purpose, by ``ROLES``.
  Blank ids don't count, repeated ones do. A place is one purpose of a benchmark.

Ids stay rows: they are counted by id and then by purpose, so neither a benchmark nor a
purpose has to fit into one task. Results are counted only where has_results is true.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratagraph.operators.closure import PURPOSES

ROLES = ["mandatory", "expected", "recalled", "observed", "result"]
#: Deliveries that come before a release.
WAVES = ["W2", "W3", "W4", "W5", "W6"]
_BLANKS = " \t\n\r\f\v"


def first_failing(rules: dict[str, Column]) -> Column:
    """The name of the first rule whose condition, true for a fault, holds or is null."""
    return F.coalesce(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in rules.items()])


def _in_range(precision: str) -> Column:
    return F.col(precision).between(0, 1) & ~F.isnan(precision)


def _mismatch() -> Column:
    return F.coalesce(F.col("cardinality") != F.col("result"), F.lit(False))


def measured(purposes: DataFrame, evidence: DataFrame) -> DataFrame:
    """``purposes`` with the number of ids of each role, ``missing`` (mandatory ones that
    were not recalled), ``closure_correct`` and ``failing``, the first rule that fails."""
    at = ["benchmark_id", "place"]
    ids = evidence.withColumn("id", F.trim("id", F.lit(_BLANKS))).filter("id <> ''")
    by_id = ids.groupBy(*at, "id").agg(*[F.count_if(F.col("role") == r).alias(r) for r in ROLES])
    each = by_id.groupBy(*at).agg(
        *[F.sum(r).alias(r) for r in ROLES], F.sum(F.when(F.col("recalled") == 0, F.col("mandatory"))).alias("missing"), F.count_if((F.col("expected") > 0) & (F.col("observed") == 0)).alias("open")
    )
    name = F.when(F.trim(F.coalesce("purpose", F.lit("")), F.lit(_BLANKS)) == "", F.concat(F.lit("purpose-"), (F.col("place") + 1).cast("string"))).otherwise(F.col("purpose"))
    out = purposes.withColumn("purpose", name).join(each, at, "left").fillna(0, [*ROLES, "missing", "open"])
    none = lambda role: F.col(role) == 0
    rules = {
        "DT18_MANDATORY_KEY_SEEDS_MISSING": none("mandatory"),
        "DT18_EXPECTED_CLOSURE_EVIDENCE_MISSING": none("expected"),
        "DT18_ACTUAL_RECALL_EVIDENCE_MISSING": none("recalled"),
        "DT18_ACTUAL_CLOSURE_EVIDENCE_MISSING": none("observed"),
        "DT18_RESULT_EVIDENCE_REQUIRED": ~F.col("has_results"),
        "DT18_RESULT_CARDINALITY_MISMATCH": _mismatch(),
        "DT18_PRECISION_OUT_OF_RANGE": ~_in_range("precision"),
        "DT18_UNRELATED_FORCED_HITS_EVIDENCE_MISSING": F.col("forced_hits").isNull(),
        "DT18_UNRELATED_FORCED_HITS_NEGATIVE": F.col("forced_hits") < 0,
    }
    return out.withColumns({"closure_correct": F.col("open") == 0, "failing": first_failing(rules)}).drop("open")


def benchmark(benchmarks: DataFrame, measured: DataFrame) -> DataFrame:
    """(benchmark_id, status, category, place, key_seed_recall, closure_correctness,
    forced_hits, precision) of each benchmark. A category of one purpose is that of the
    first purpose, at ``place``, that fails. Figures are null where a benchmark is blocked."""
    whole = reduce(Column.__and__, [F.bool_or(F.coalesce(F.col("purpose") == p, F.lit(False))) for p in PURPOSES])
    fails = F.when(F.col("failing").isNotNull(), F.col("place"))
    by = measured.groupBy("benchmark_id").agg(
        F.count(F.lit(1)).alias("n"), whole.alias("whole"), F.min_by("failing", fails).alias("failing"), F.min(fails).alias("place"),
        F.sum("missing").alias("missing"), F.sum("mandatory").alias("mandatory"), F.count_if(F.col("closure_correct")).alias("correct"),
        F.sum("forced_hits").alias("forced_hits"), F.avg("precision").alias("precision"),
    )
    out = benchmarks.select("benchmark_id").distinct().join(by, "benchmark_id", "left")
    shape = first_failing({"DT18_BENCHMARK_EMPTY": F.col("n").isNull(), "DT18_BENCHMARK_INCOMPLETE": (F.col("n") != len(PURPOSES)) | ~F.col("whole")})
    quality = first_failing({
        "DT18_KEY_SEED_RECALL_NOT_100_PERCENT": F.col("missing") > 0,
        "DT18_CLOSURE_CORRECTNESS_NOT_100_PERCENT": F.col("correct") < F.col("n"),
        "DT18_UNRELATED_FORCED_HITS": F.col("forced_hits") > 0,
    })
    out = out.withColumn("category", F.coalesce(shape, F.col("failing"), quality))
    ok = F.col("category").isNull()
    figures = {"key_seed_recall": 1 - F.col("missing") / F.col("mandatory"), "closure_correctness": F.col("correct") / F.col("n"), "forced_hits": F.col("forced_hits"), "precision": F.col("precision")}
    return out.select(
        "benchmark_id", F.when(ok, "passed").otherwise("blocked").alias("status"), "category",
        F.when(shape.isNull(), F.col("place")).alias("place"), *[F.when(ok, c).alias(n) for n, c in figures.items()],
    )


def capacity(requests: DataFrame, declared: DataFrame, benchmarks: DataFrame, measured: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Verdicts (request_id, status, category, purpose) of ``requests`` (request_id,
    benchmark_id) for capacity evidence, and what was measured (request_id, ord, purpose,
    cardinality, precision) for those that pass.

    ``declared`` has request_id, ord, purpose; a purpose that is declared again counts
    once. Of a benchmark's purposes with one name the first one answers."""
    said = declared.withColumn("purpose", F.trim("purpose", F.lit(_BLANKS))).filter("purpose <> ''").groupBy("request_id", "purpose").agg(F.min("ord").alias("ord"))
    answer = F.min_by(F.struct("has_results", "result", "cardinality", "precision"), "place").alias("x")
    told = measured.groupBy("benchmark_id", "purpose").agg(answer)
    there = benchmarks.select("benchmark_id").distinct().join(told.select("benchmark_id", F.lit(True).alias("any")).distinct(), "benchmark_id", "left")
    asked = requests.join(there.withColumn("known", F.lit(True)), "benchmark_id", "left")
    each = said.join(requests, "request_id").join(told, ["benchmark_id", "purpose"], "left").select("request_id", "ord", "purpose", F.col("x").isNotNull().alias("answered"), "x.*")
    rules = {
        "DT19_DECLARED_PURPOSE_EVIDENCE_INCOMPLETE": ~F.col("answered"),
        "DT19_RESULT_CARDINALITY_NOT_RECORDED": ~F.col("has_results"),
        "DT18_RESULT_CARDINALITY_MISMATCH": _mismatch(),
        "DT19_MEASURED_PRECISION_NOT_RECORDED": ~_in_range("precision"),
    }
    each = each.withColumn("failing", first_failing(rules))
    fails = F.when(F.col("failing").isNotNull(), F.col("ord"))
    by = each.groupBy("request_id").agg(F.lit(True).alias("declared"), F.min_by("failing", fails).alias("failing"), F.min_by("purpose", fails).alias("purpose"))
    before = first_failing({"DT19_QUALITY_EVIDENCE_REQUIRED": ~F.col("known"), "DT19_DECLARED_PURPOSE_EVIDENCE_INCOMPLETE": ~F.col("declared") | ~F.coalesce("any", F.lit(False))})
    category = F.coalesce(before, F.col("failing"))
    verdicts = asked.join(by, "request_id", "left").select(
        "request_id", F.when(category.isNull(), "passed").otherwise("blocked").alias("status"), category.alias("category"), F.when(before.isNull(), F.col("purpose")).alias("purpose")
    )
    passed = verdicts.filter("status = 'passed'").select("request_id")
    return verdicts, each.join(passed, "request_id", "left_semi").select("request_id", "ord", "purpose", F.col("result").alias("cardinality"), "precision")


def delivery(requests: DataFrame, waves: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(request_id, status, category, missing_waves) of ``requests`` (request_id,
    benchmark_id): all earlier waves (request_id, wave) first, then a benchmark that
    passed with whole figures, as ``benchmark`` gives them."""
    done = waves.withColumn("wave", F.trim("wave", F.lit(_BLANKS))).filter(F.col("wave").isin(WAVES)).groupBy("request_id").agg(F.collect_set("wave").alias("done"))
    missing = F.array_except(F.array(*map(F.lit, WAVES)), F.coalesce("done", F.array().cast("array<string>")))
    figures = (F.col("key_seed_recall") == 1) & (F.col("closure_correctness") == 1) & (F.col("forced_hits") == 0) & _in_range("precision")
    good = verdicts.select("benchmark_id", (F.col("status").eqNullSafe("passed") & figures).alias("good"))
    out = requests.join(done, "request_id", "left").join(good, "benchmark_id", "left").withColumn("missing_waves", missing)
    category = first_failing({"DELIVERY_PREREQUISITES_INCOMPLETE": F.size("missing_waves") > 0, "W7_QUALITY_BENCHMARK_REQUIRED": ~F.col("good")})
    return out.select("request_id", F.when(category.isNull(), "allowed").otherwise("blocked").alias("status"), category.alias("category"), "missing_waves")
