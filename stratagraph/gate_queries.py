"""Queries of release gates over the star schema.

Every supplier is a benchmark: the parts that it delivers are the ids, by line number the
purposes. The supplier's number modulo 13 plants one fault, modulo 26 a second one in an
earlier purpose. Customers ask for releases; their orders say which waves are done.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagraph.operators import gates
from stratagraph.operators.closure import PURPOSES
from stratagraph.queries import query
from stratagraph.sources import star

#: When a line of part p, place k, supplier s counts in a role.
_ROLES = {
    "mandatory": "p % 5 = 0 AND NOT (s % 13 = 1 AND k = 2)",
    "expected": "NOT (s % 13 = 2 AND k = 3)",
    "recalled": "p % 5 = 0 AND NOT (s % 13 = 3 AND k = 1) AND NOT (s % 13 = 4 AND p % 10 = 0)",
    "observed": "NOT (s % 13 = 5 AND p % 7 = 0)",
    "result": "p % 2 = 0 AND NOT (s % 13 = 6 AND k = 4)",
}


def _measured(spark, d) -> tuple[DataFrame, DataFrame]:
    """Benchmarks, and their purposes as measured."""
    suppliers = star.table(spark, d, "supplier").selectExpr("cast(s_suppkey as long) AS s", "concat('supplier-', s_suppkey) AS benchmark_id")
    rows = star.table(spark, d, "lineitem").selectExpr("concat('supplier-', l_suppkey) AS benchmark_id", "cast(l_linenumber % 5 as int) AS k", "l_partkey AS p", "l_suppkey AS s")
    roles = F.array_compact(F.array(*[F.when(F.expr(when), F.lit(role)) for role, when in _ROLES.items()]))
    evidence = rows.select("benchmark_id", F.col("k").alias("place"), F.explode(roles).alias("role"), F.concat(F.lit("part-"), F.col("p").cast("string")).alias("id"))
    purposes = (
        suppliers.filter("s % 13 <> 12")
        .select("s", "benchmark_id", F.posexplode(F.array(*map(F.lit, PURPOSES))).alias("place", "purpose"))
        .filter("not (s % 13 = 11 and place = 4)")
        .selectExpr(
            "benchmark_id", "place", "CASE WHEN s % 39 = 0 AND place = 0 THEN ' ' ELSE purpose END AS purpose", "NOT (s % 13 = 6 AND place = 4) AS has_results",
            "CASE WHEN s % 13 = 7 AND place = 2 THEN -1L END AS cardinality", "CASE WHEN s % 13 = 8 AND place = 0 OR s % 26 = 2 AND place = 1 THEN 1.5D ELSE 0.5D + place / 16D END AS precision",
            "CASE WHEN s % 13 = 9 AND place = 1 THEN NULL WHEN s % 13 = 10 AND place = 3 THEN 1L ELSE 0L END AS forced_hits",
        )
    )
    return suppliers.select("benchmark_id"), gates.measured(purposes, evidence)


def _requests(spark, d) -> DataFrame:
    return star.table(spark, d, "customer").selectExpr("concat('customer-', c_custkey) AS request_id", "CASE WHEN c_custkey % 17 <> 0 THEN concat('supplier-', c_custkey % 26 * 13 % 100 + c_custkey % 3) END AS benchmark_id")


_MEASURED = """,
sup AS (SELECT s_suppkey AS s, 'supplier-' || s_suppkey AS benchmark_id FROM supplier),
pur AS (
  SELECT s, benchmark_id, place, CASE WHEN s % 39 = 0 AND place = 0 THEN 'purpose-1' ELSE purpose END AS purpose,
    CASE WHEN s % 13 = 8 AND place = 0 OR s % 26 = 2 AND place = 1 THEN 1.5 ELSE 0.5 + place / 16.0 END::DOUBLE AS precision,
    CASE WHEN s % 13 = 9 AND place = 1 THEN NULL WHEN s % 13 = 10 AND place = 3 THEN 1 ELSE 0 END AS forced
  FROM sup, (VALUES (0, 'intent-decision'), (1, 'implementation-design'), (2, 'coding-repair'), (3, 'audit'), (4, 'graph-tidy')) t(place, purpose)
  WHERE s % 13 <> 12 AND NOT (s % 13 = 11 AND place = 4)),
l AS (SELECT l_suppkey AS s, l_linenumber % 5 AS k, l_partkey AS p FROM lineitem),
cnt AS (
  SELECT s, k,
    count(*) FILTER (p % 5 = 0 AND NOT (s % 13 = 1 AND k = 2)) AS mandatory, count(*) FILTER (NOT (s % 13 = 2 AND k = 3)) AS expected,
    count(*) FILTER (p % 5 = 0 AND NOT (s % 13 = 3 AND k = 1) AND NOT (s % 13 = 4 AND p % 10 = 0)) AS recalled, count(*) FILTER (NOT (s % 13 = 5 AND p % 7 = 0)) AS observed,
    count(*) FILTER (p % 2 = 0 AND NOT (s % 13 = 6 AND k = 4)) AS result,
    count(*) FILTER (p % 5 = 0 AND (s % 13 = 3 AND k = 1 OR s % 13 = 4 AND p % 10 = 0) AND NOT (s % 13 = 1 AND k = 2)) AS missing,
    count(*) FILTER (s % 13 = 5 AND p % 7 = 0) = 0 AS closure_correct
  FROM l GROUP BY s, k),
mea AS (
  SELECT pur.*, coalesce(mandatory, 0) AS mandatory, coalesce(expected, 0) AS expected, coalesce(recalled, 0) AS recalled, coalesce(observed, 0) AS observed, coalesce(result, 0) AS result,
    coalesce(missing, 0) AS missing, coalesce(closure_correct, true) AS closure_correct
  FROM pur LEFT JOIN cnt ON cnt.s = pur.s AND cnt.k = pur.place),
fai AS (
  SELECT *, CASE WHEN mandatory = 0 THEN 'DT18_MANDATORY_KEY_SEEDS_MISSING' WHEN expected = 0 THEN 'DT18_EXPECTED_CLOSURE_EVIDENCE_MISSING' WHEN recalled = 0 THEN 'DT18_ACTUAL_RECALL_EVIDENCE_MISSING'
    WHEN observed = 0 THEN 'DT18_ACTUAL_CLOSURE_EVIDENCE_MISSING' WHEN s % 13 = 6 AND place = 4 THEN 'DT18_RESULT_EVIDENCE_REQUIRED' WHEN s % 13 = 7 AND place = 2 THEN 'DT18_RESULT_CARDINALITY_MISMATCH'
    WHEN precision > 1 THEN 'DT18_PRECISION_OUT_OF_RANGE' WHEN forced IS NULL THEN 'DT18_UNRELATED_FORCED_HITS_EVIDENCE_MISSING' END AS failing
  FROM mea),
ben AS (
  SELECT s, count(*) AS n, count(*) FILTER (purpose <> 'purpose-1') AS named, arg_min(failing, place) FILTER (failing IS NOT NULL) AS failing, min(place) FILTER (failing IS NOT NULL) AS place,
    sum(missing) AS missing, bool_and(closure_correct) AS correct, sum(forced) AS forced, avg(precision) AS precision FROM fai GROUP BY s),
ver AS (
  SELECT sup.benchmark_id, CASE WHEN n IS NULL THEN 'DT18_BENCHMARK_EMPTY' WHEN n <> 5 OR named <> 5 THEN 'DT18_BENCHMARK_INCOMPLETE' WHEN failing IS NOT NULL THEN failing
    WHEN missing > 0 THEN 'DT18_KEY_SEED_RECALL_NOT_100_PERCENT' WHEN NOT correct THEN 'DT18_CLOSURE_CORRECTNESS_NOT_100_PERCENT' WHEN forced > 0 THEN 'DT18_UNRELATED_FORCED_HITS' END AS category,
    CASE WHEN n = 5 AND named = 5 THEN place END AS place, precision FROM sup LEFT JOIN ben USING (s)),
req AS (SELECT c_custkey AS c, 'customer-' || c_custkey AS request_id, CASE WHEN c_custkey % 17 <> 0 THEN 'supplier-' || (c_custkey % 26 * 13 % 100 + c_custkey % 3) END AS benchmark_id FROM customer)
"""


@query(_MEASURED + """SELECT benchmark_id, CASE WHEN category IS NULL THEN 'passed' ELSE 'blocked' END AS status, category, place, CASE WHEN category IS NULL THEN 1.0::DOUBLE END AS key_seed_recall,
  CASE WHEN category IS NULL THEN 1.0::DOUBLE END AS closure_correctness, CASE WHEN category IS NULL THEN 0::BIGINT END AS forced_hits, CASE WHEN category IS NULL THEN round(precision, 6) END AS precision FROM ver""")
def quality_benchmarks(spark, d):
    return gates.benchmark(*_measured(spark, d)).withColumn("precision", F.round("precision", 6))


# Customers declare the purposes from the last to the first, some twice, some an unknown
# one at the end, some none.


def _capacity(spark, d) -> tuple[DataFrame, DataFrame]:
    requests, names = _requests(spark, d), [*reversed(PURPOSES), " audit", "other"]
    rows = star.table(spark, d, "customer").select("c_custkey", F.concat(F.lit("customer-"), F.col("c_custkey").cast("string")).alias("request_id"), F.posexplode(F.array(*map(F.lit, names))).alias("ord", "purpose"))
    declared = rows.filter("c_custkey % 19 <> 0 and (purpose <> 'other' or c_custkey % 23 = 0) and (c_custkey % 2 = 0 or ord > 1)").drop("c_custkey")
    return gates.capacity(requests, declared, *_measured(spark, d))


_CAPACITY = _MEASURED + """,
dec AS (
  SELECT c, request_id, benchmark_id, ord, purpose
  FROM req, (VALUES (0, 'graph-tidy'), (1, 'audit'), (2, 'coding-repair'), (3, 'implementation-design'), (4, 'intent-decision'), (5, 'audit'), (6, 'other')) t(ord, purpose)
  WHERE c % 19 <> 0 AND (purpose <> 'other' OR c % 23 = 0) AND (c % 2 = 0 AND ord <> 5 OR c % 2 = 1 AND ord > 1)),
ans AS (
  SELECT d.*, m.result, m.precision, CASE WHEN m.s IS NULL THEN 'DT19_DECLARED_PURPOSE_EVIDENCE_INCOMPLETE' WHEN m.s % 13 = 6 AND m.place = 4 THEN 'DT19_RESULT_CARDINALITY_NOT_RECORDED'
    WHEN m.s % 13 = 7 AND m.place = 2 THEN 'DT18_RESULT_CARDINALITY_MISMATCH' WHEN m.precision > 1 THEN 'DT19_MEASURED_PRECISION_NOT_RECORDED' END AS failing
  FROM dec d LEFT JOIN mea m ON m.benchmark_id = d.benchmark_id AND m.purpose = d.purpose),
fst AS (SELECT request_id, arg_min(failing, ord) FILTER (failing IS NOT NULL) AS failing, arg_min(purpose, ord) FILTER (failing IS NOT NULL) AS purpose FROM ans GROUP BY request_id),
cap AS (
  SELECT r.request_id, CASE WHEN u.s IS NULL THEN 'DT19_QUALITY_EVIDENCE_REQUIRED' WHEN f.request_id IS NULL OR u.s % 13 = 12 THEN 'DT19_DECLARED_PURPOSE_EVIDENCE_INCOMPLETE' ELSE f.failing END AS category,
    CASE WHEN u.s IS NOT NULL AND u.s % 13 <> 12 THEN f.purpose END AS purpose
  FROM req r LEFT JOIN sup u USING (benchmark_id) LEFT JOIN fst f ON f.request_id = r.request_id)
"""


@query(_CAPACITY + "SELECT request_id, CASE WHEN category IS NULL THEN 'passed' ELSE 'blocked' END AS status, category, purpose FROM cap")
def capacity_verdicts(spark, d):
    return _capacity(spark, d)[0]


@query(_CAPACITY + "SELECT a.request_id, a.ord, a.purpose, a.result AS cardinality, a.precision FROM ans a JOIN cap c USING (request_id) WHERE c.category IS NULL")
def capacity_measured(spark, d):
    return _capacity(spark, d)[1]


@query(_MEASURED + """,
done AS (SELECT DISTINCT o_custkey AS c, o_orderkey % 7 AS w FROM orders),
mis AS (SELECT c, string_agg('W' || w, ',' ORDER BY w) AS missing FROM (SELECT c, w FROM req, range(2, 7) t(w) EXCEPT SELECT c, w FROM done) GROUP BY c)
SELECT request_id, CASE WHEN missing IS NULL AND v.benchmark_id IS NOT NULL AND category IS NULL THEN 'allowed' ELSE 'blocked' END AS status,
  CASE WHEN missing IS NOT NULL THEN 'DELIVERY_PREREQUISITES_INCOMPLETE' WHEN v.benchmark_id IS NULL OR category IS NOT NULL THEN 'W7_QUALITY_BENCHMARK_REQUIRED' END AS category, coalesce(missing, '') AS missing_waves
FROM req LEFT JOIN mis USING (c) LEFT JOIN ver v ON v.benchmark_id = req.benchmark_id""")
def delivery_sequence(spark, d):
    waves = star.table(spark, d, "orders").selectExpr("concat('customer-', o_custkey) AS request_id", "concat(' W', o_orderkey % 7) AS wave")
    out = gates.delivery(_requests(spark, d), waves, gates.benchmark(*_measured(spark, d)))
    return out.withColumn("missing_waves", F.array_join("missing_waves", ","))
