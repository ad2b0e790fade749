from stratagraph.operators import gates
from stratagraph.operators.closure import PURPOSES

GOOD = [("mandatory", "a"), ("expected", "a"), ("expected", "b"), ("recalled", " a "), ("observed", "a"), ("observed", "b"), ("result", "a"), ("result", "a")]
SAID = {"has_results": True, "cardinality": 2, "precision": 0.5, "forced_hits": 0}


def judge(spark, changes, places=range(5), drop=(), empty=False):
    """The verdict of one benchmark with ``changes`` of purposes by place and without
    the evidence ``drop`` (place, role, id)."""
    purposes = [("b", k, p, *{**SAID, **changes.get(k, {})}.values()) for k, p in enumerate(PURPOSES) if k in places]
    evidence = [("b", k, role, id_) for k in places for role, id_ in GOOD if (k, role, id_) not in drop]
    p = spark.createDataFrame([] if empty else purposes, "benchmark_id string, place int, purpose string, has_results boolean, cardinality long, precision double, forced_hits long")
    e = spark.createDataFrame(evidence, "benchmark_id string, place int, role string, id string")
    (out,) = gates.benchmark(spark.createDataFrame([("b",)], "benchmark_id string"), gates.measured(p, e)).collect()
    return out


def test_the_first_failing_rule_of_the_first_failing_purpose_counts(spark):
    nan = float("nan")
    cases = [
        ({}, {}, None, None),
        ({}, {"empty": True}, "DT18_BENCHMARK_EMPTY", None),
        ({}, {"places": range(4)}, "DT18_BENCHMARK_INCOMPLETE", None),
        ({3: {"precision": nan}, 1: {"forced_hits": None}}, {}, "DT18_UNRELATED_FORCED_HITS_EVIDENCE_MISSING", 1),
        ({3: {"precision": nan, "forced_hits": -1}}, {}, "DT18_PRECISION_OUT_OF_RANGE", 3),
        ({3: {"forced_hits": -1}}, {}, "DT18_UNRELATED_FORCED_HITS_NEGATIVE", 3),
        ({2: {"has_results": None, "precision": None}}, {}, "DT18_RESULT_EVIDENCE_REQUIRED", 2),
        ({2: {"cardinality": 1}}, {}, "DT18_RESULT_CARDINALITY_MISMATCH", 2),
        ({2: {"cardinality": None}}, {}, None, None),
        ({}, {"drop": [(4, "mandatory", "a")]}, "DT18_MANDATORY_KEY_SEEDS_MISSING", 4),
        ({4: {"forced_hits": 7}}, {"drop": [(0, "observed", "b")]}, "DT18_CLOSURE_CORRECTNESS_NOT_100_PERCENT", None),
        ({4: {"forced_hits": 7}}, {}, "DT18_UNRELATED_FORCED_HITS", None),
    ]
    for changes, more, category, place in cases:
        out = judge(spark, changes, **more)
        assert (out["category"], out["place"], out["status"]) == (category, place, "blocked" if category else "passed"), (changes, more)
    assert tuple(judge(spark, {}))[4:] == (1.0, 1.0, 0, 0.5)


def test_deliveries_wait_for_waves_then_for_the_benchmark(spark):
    row = lambda b, status, recall: (b, status, recall, 1.0, 0, 0.5)
    verdicts = spark.createDataFrame([row("b", "passed", 1.0), row("c", "passed", 0.5)], "benchmark_id string, status string, key_seed_recall double, closure_correctness double, forced_hits long, precision double")
    requests = spark.createDataFrame([("1", "b"), ("2", "c"), ("3", None), ("4", "b"), ("5", "b")], "request_id string, benchmark_id string")
    waves = spark.createDataFrame([(k, f" W{w} ") for k in "123" for w in range(1, 9)] + [("4", "W3"), ("4", "W3"), ("4", None)], "request_id string, wave string")
    got = {r["request_id"]: (r["category"], r["missing_waves"]) for r in gates.delivery(requests, waves, verdicts).collect()}
    late, bad = "DELIVERY_PREREQUISITES_INCOMPLETE", "W7_QUALITY_BENCHMARK_REQUIRED"
    assert got == {"1": (None, []), "2": (bad, []), "3": (bad, []), "4": (late, ["W2", "W4", "W5", "W6"]), "5": (late, gates.WAVES)}
