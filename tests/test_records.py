from pyspark.sql import functions as F

from stratagraph.operators import records, resolve


def test_all_reasons_are_told_and_counted_by_one_pass(spark, tmp_path):
    schema = "canonical_identity string, channel string, canonical_version string, content_version string, index_version string, provider string, model string, model_version string, dimensions int, vector array<double>, run_id string"
    good = ("Element:a", "Element", "1", "1", "1", "p", "m", "1", 2, [1.0, 2.0], None)
    change = lambda **x: tuple(x.get(c.split()[0], v) for c, v in zip(schema.split(", "), good, strict=True))
    rows = [good, change(vector=[1.0]), change(vector=[1.0, float("nan")]), change(vector=[1.0, float("-inf")]), change(vector=None), change(channel="X", run_id="r"), change(channel=None), change(dimensions=None), change(model=" ")]
    profile = {"provider": "p", "model": "m", "model_version": "1", "dimensions": 2}
    ok, bad, n = records.quarantine(records.checked(spark.createDataFrame(rows, schema), profile), str(tmp_path / "out"))
    assert [r["canonical_identity"] for r in ok.collect()] == ["Element:a"] and ok.columns == [c.split()[0] for c in schema.split(", ")]
    assert sorted(r["reasons"] for r in bad.collect()) == sorted(
        [["bad vector"]] * 4 + [["unknown channel", "run id"], ["channel is blank"], ["bad dimensions", "bad vector", "other profile"], ["model is blank", "other profile"]]
    )
    assert n == {"rows": 9, "bad vector": 5, "unknown channel": 1, "run id": 1, "channel is blank": 1, "bad dimensions": 1, "other profile": 2, "model is blank": 1}


def test_tombstones(spark):
    rows = spark.createDataFrame([(" Element:a ", "Element", "1"), ("", "View", "1"), ("x", "Other", None)], "canonical_identity string, channel string, canonical_version string")
    got = {r["canonical_identity"]: r["reasons"] for r in records.checked_tombstones(rows).collect()}
    assert got == {"Element:a": [], "": ["canonical_identity is blank"], "x": ["canonical_version is blank", "unknown channel"]}


def test_requests_are_resolved_within_their_graph(spark):
    rows = [("g", k, f"n{k}", "same", "Node") for k in range(30)] + [("g", 99, "a", "A", "Node"), ("h", 0, "b", "same", "Node"), ("g", 100, "a", "other", "Node")]
    e = spark.createDataFrame(rows, "graph_key string, ord long, id string, name string, type string")
    asks = [("g", "1", "a", "same"), ("g", "2", None, "same"), ("h", "3", "", "same"), ("h", "4", "a", None), ("g", "5", None, ""), ("g", "6", None, "no"), ("g", "2", None, "same")]
    out = resolve.resolve(spark.createDataFrame(asks, "graph_key string, request_id string, element_id string, element_name string"), e, most=3)
    got = {r["request_id"]: (r["status"], r["element_id"], r["n_matches"], [c["id"] for c in r["candidates"]]) for r in out.collect()}
    assert out.count() == 7 and out.filter(F.col("error").isNull()).count() == 2
    assert got == {"1": ("passed", "a", 1, []), "2": ("ambiguous", None, 30, ["n0", "n1", "n2"]), "3": ("passed", "b", 1, []), "4": ("failed", None, 0, []), "5": ("failed", None, 0, []), "6": ("failed", None, 0, [])}
