"""What plans shuffle, where it decides whether a large graph fits."""

import re

import pytest

from stratagraph import queries
from stratagraph.operators import scan, validate
from stratagraph.sources import star
from stratagraph.sources.documents import Graph


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_names_are_joined_by_numbers(spark, sf, no_broadcast):
    plan = star.relationships(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(source_key" in plan and "hashpartitioning(source_id" not in plan and "hashpartitioning(target_id" not in plan


def test_named_links_are_the_links(spark, sf):
    cols = ["graph_key", "ord", "id", "type", "source_id", "target_id"]
    named = star.relationships(spark, sf, illegal=True)
    plain = star.links(spark, sf, illegal=True)
    assert named.select(cols).exceptAll(plain.select(cols)).isEmpty() and plain.select(cols).exceptAll(named.select(cols)).isEmpty()
    assert named.filter("source_name is null or target_name is null").isEmpty()


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_links_pass_by_hashed_elements(spark, sf, no_broadcast):
    plan = _plan(queries.rule_dangling(spark, sf))
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan


def test_ids_are_dealt_before_they_are_counted(spark, sf):
    plan = _plan(queries.rule_duplicate_ids(spark, sf))
    assert plan.count("REPARTITION_BY_NUM") == 3
    ids = spark.createDataFrame([("g", k % 40, None) for k in range(50)], "graph_key string, id string, view_id string")
    found = validate.duplicate_ids(Graph(ids, ids.limit(0), ids.limit(0), ids, ids))
    assert sorted(int(r["id"]) for r in found.collect()) == list(range(10))


def test_pairs_are_dealt_before_they_are_distinct(spark, sf, no_broadcast):
    plan = _plan(queries.path_two_hops(spark, sf))
    assert "REPARTITION_BY_NUM" in plan and "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan


def test_values_are_searched_once(spark, sf):
    plan = queries.sensitive_scan(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[0-9a-f]{40}") == 1
    texts = ["a@b.co", "x" * 30_000 + " @", "@b.co", " .@b.co", "a@@b.co", "a@b.c1", "a b@c.d.ee9", "éa@b.co", "%%@-.-.ab"]
    rows = spark.createDataFrame([(str(k), "k", t) for k, t in enumerate(texts)], "path string, key string, value string")
    found = {int(r["path"]) for r in scan.sensitive(rows).collect() if r["type"] == "email"}
    assert found == {k for k, t in enumerate(texts) if re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", t[-100:])}


def test_boundary_makes_its_nodes_once(spark, sf):
    from stratagraph.operators import traverse

    edges = queries._edges(spark, sf)
    nodes = traverse.intent_context(queries._customers(spark, sf), edges)[0]
    reads = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")
    assert reads(traverse.boundary(nodes, edges)) == reads(edges) + 3


@pytest.mark.parametrize("name", ["backfill_pending", "reconcile_delta"])
def test_index_is_compared_where_its_rows_are(name, spark, sf, no_broadcast, monkeypatch):
    all_keys, plans = "spark.sql.requireAllClusterKeysForCoPartition", []
    before = spark.conf.get(all_keys)
    monkeypatch.setattr(queries.Rounds, "save", lambda self, df: plans.append(_plan(df)) or df)
    queries.QUERIES[name](spark, sf)
    (plan,) = plans
    moved = re.findall(r"hashpartitioning\(([^)]*)\)", plan)
    assert moved and not any(c in m for m in moved for c in ("canonical_identity", "content_version"))
    assert len(re.findall(r"SortMergeJoin \[place", plan)) == 1 and spark.conf.get(all_keys) == before


def test_place_tells_nothing_apart_that_identity_does_not(spark):
    from stratagraph.operators import lifecycle

    cols = "place long, canonical_identity string, channel string, content_version string"
    want = spark.createDataFrame([(1, "a", "E", "v"), (2, "b", "E", "v"), (2, "c", "E", "v"), (2, "c", "E", "v"), (3, "d", "E", "v")], cols)
    have = spark.createDataFrame([(1, "a", "E", "v"), (1, "a", "E", "v"), (2, "b", "E", "old"), (9, "e", "E", "v")], cols)
    assert sorted(r["canonical_identity"] for r in lifecycle.pending(want, have).collect()) == ["b", "c", "c", "d"]
    for drop in ((), ("place",)):
        got = lifecycle.reconcile(want.drop(*drop).distinct(), have.drop(*drop).distinct()).collect()
        assert sorted((r["canonical_identity"], r["action"]) for r in got) == [("b", "upsert"), ("c", "upsert"), ("d", "upsert"), ("e", "tombstone")]
