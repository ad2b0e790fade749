"""Exports, handoffs, purposes and stored projections on small tables."""

import json
from dataclasses import replace

from pyspark.sql import functions as F

from stratagraph.operators import catalog, closure, diff, handoff, traverse, views
from stratagraph.sources import documents, projection
from stratagraph.sources.documents import Graph

from test_graph import DOC, ids


def test_categories_take_the_first_family(spark):
    df = spark.createDataFrame([("Class", None), ("UseCase", ""), (None, "StateNode"), ("", "Sequence"), (None, None)], "meta_type string, type string")
    key = catalog.type_key("meta_type", "type")
    got = df.select(catalog.category(key, catalog.ELEMENT_FAMILIES, F.lit("generic")).alias("e"), catalog.diagram_category(key).alias("d"), catalog.matches_any(key, ["CLASS"]).alias("m")).collect()
    assert [tuple(r) for r in got] == [("class", "class", True), ("use_case", "use_case", False), ("state_machine", "state_machine", False), ("generic", "interaction", False), ("generic", "uml", False)]


def test_scopes_and_message_labels(spark):
    places = spark.createDataFrame([("a", "diagram_reference"), ("a", "owned"), ("b", "connector"), ("b", "diagram_reference"), ("c", "other")], "id string, scope string")
    assert ids(catalog.merged_scopes(places, "id"), "id", "scope") == [("a", "owned"), ("b", "diagram_reference"), ("c", "other")]
    c = spark.createDataFrame([("m1", "send", "7"), ("m2", "send", None), ("m3", "2.1 reply", "4"), ("m4", "", "5"), ("m5", "ask", "3")], "id string, name string, sequence_no string")
    links = spark.createDataFrame([("m5", 1, "x", "SeqNo=4.2;", None), ("m5", 0, "", None, None), ("m2", 0, None, None, "1.3 go")], "connector_id string, ord int, geometry string, path string, style string")
    got = {r["id"]: (r["sequence"], r["label"]) for r in catalog.message_labels(c, links).collect()}
    assert got == {"m1": ("7", "7: send"), "m2": ("1.3", "1.3: send"), "m3": ("4", "2.1 reply"), "m4": ("5", ""), "m5": ("4.2", "4.2: ask")}
    shown = spark.createDataFrame([(1, True), (2, False), (3, None)], "id int, hidden boolean")
    assert catalog.shown_links(shown).count() == 2


def test_handoff_rules(spark):
    rule = lambda df: sorted((r["rule"], r["id"]) for r in df.collect())
    t = spark.createDataFrame([("d", "t1", ["t2", "t9"]), ("d", "t2", ["t2"]), ("d", "t2", None), ("e", "t9", [])], "document string, task_id string, needs array<string>")
    assert rule(handoff.tasks(t)) == [("duplicate_task", "t2"), ("missing_task", "t1"), ("task_needs_itself", "t2")]
    c = spark.createDataFrame([("e", "plain", "node tests/run.js --all"), ("e", "shell", "bash -c ls"), ("e", "quoted", "node 'x'"), ("e", "piped", "a | b"), ("e", "none", None)], "element_id string, testcase string, criteria string")
    assert {(r["id"], r["message"]) for r in handoff.criteria(c).collect()} == {("shell", "runs a shell"), ("quoted", "has quotes"), ("piped", "has operators"), ("none", "is empty")}
    a = spark.createDataFrame([("d", 0, "command", "direct", ["x"]), ("d", 1, "magic", "maybe", ["y"]), ("d", 2, "mcp-tool", "indirect", [])], "document string, place int, kind string, implements string, contract_paths array<string>")
    assert rule(handoff.anchors(a, spark.createDataFrame([("x",)], "path string"))) == [("anchor_implements", "anchorProposals[1]"), ("anchor_kind", "anchorProposals[1]"), ("anchor_path", "anchorProposals[1]"), ("anchor_paths", "anchorProposals[2]")]
    good = {**handoff.TRACE, "lifecycle": "other"}
    assert rule(handoff.trace(spark.createDataFrame([("d", *good.values())], "document string, " + ", ".join(f"{k} string" for k in good)))) == [("trace_field", "lifecycle")]


def test_purposes_have_reasons_and_leave_others_out(spark):
    made = [("g1", "Triggering", closure.SELECTOR, "grag-audit-policy"), ("g2", "Triggering", closure.SELECTOR, "grag-repair-policy"), ("a1", "Access", "grag-audit-policy", "log"), ("a2", "Influence", "log", "grag-audit-policy"), ("a3", "Influence", "log", "far")]
    rels = spark.createDataFrame(made, "id string, type string, source_id string, target_id string")
    policies = closure.purpose_policies(spark)
    anchors = spark.createDataFrame([("audit", "log")], "purpose string, id string")
    nodes, drawn = closure.purpose_scope(policies, anchors, rels)
    audit = nodes.filter("purpose = 'audit'")
    assert ids(audit, "id", "depth", "reason") == [("grag-audit-policy", 0, "declared-purpose-policy"), (closure.SELECTOR, 0, "archimate-mandatory-dependency"), ("log", 0, "semantic-seed")]
    assert ids(drawn.filter("purpose = 'audit'"), "relationship_id") == [("a1",), ("a2",), ("g1",)]
    elements = spark.createDataFrame([("log", "Log", "Data Object")], "id string, name string, type string")
    out = {r["id"]: r for r in closure.purpose_result(policies, audit, elements).collect()}
    assert out["log"]["name"] == "Log" and out[closure.SELECTOR]["type"] == "Application Function" and "audit" not in out["log"]["excluded"] and len(out["log"]["excluded"]) == 4


def two_documents(spark, tmp_path):
    other = json.loads(json.dumps(DOC))
    other["elements"] = other["elements"][:2]
    other["relationships"][0]["type"] = "Access"
    for name, doc in (("one", DOC), ("two", other)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "SystemArchitecture.json").write_text(json.dumps(doc))
    return documents.explode_documents(documents.read_documents(spark, [str(tmp_path / n / "SystemArchitecture.json") for n in ("one", "two")]))


def part(g, name):
    return Graph(*(getattr(g, t).filter(F.col("graph_key").like(f"%/{name}/%")) for t in projection.TABLES))


def test_results_of_two_graphs_are_those_of_each(spark, tmp_path):
    g = two_documents(spark, tmp_path)

    def each(f, *cols):
        alone = [tuple(r) for n in ("one", "two") for r in f(part(g, n)).select("graph_key", *cols).collect()]
        assert sorted(map(repr, alone)) == sorted(repr(tuple(r)) for r in f(g).select("graph_key", *cols).collect())

    starts = lambda g: g.elements.select("graph_key", F.col("id").alias("root"), "id")
    edges = lambda g: traverse.semantic_edges(g.relationships)
    each(lambda g: traverse.traverse(starts(g), edges(g), 2), "root", "id", "depth")
    each(lambda g: traverse.upstream(spark, starts(g), edges(g)), "root", "id", "depth")
    each(lambda g: traverse.view_anchors(g.elements.filter("id = 'b'").select("graph_key", "id"), g.elements, g.views, g.view_elements), "id")
    each(lambda g: traverse.paths(g.elements.withColumn("parent", F.coalesce("parent", F.lit("")))), "id", "path")
    each(views.view_context, "view_id", "n_elements", "n_relationships", "n_missing", "n_children")
    each(views.circle_layout, "view_id", "id", "x", "y")
    each(views.drawn_edges, "view_id", "id")
    each(lambda g: views.subgraph(g, g.elements.filter("id <> 'c'").select("graph_key", "id")).view_elements, "view_id", "element_id")
    each(lambda g: closure.complete(g, g.elements.filter("id = 'a'").select("graph_key", F.lit("Element").alias("kind"), "id")), "kind", "id", "step", "reason")
    each(lambda g: closure.subset(g, g.relationships.select("graph_key", F.lit("ArchitectureRelationship").alias("kind"), "id"))[1], "error", "id")
    each(lambda g: diff.tree_edges(g.elements.select("graph_key", "id"), g.relationships), "parent", "child", "label")


def test_circles_of_parents_keep_their_rows(spark):
    e = spark.createDataFrame([("a", "A", "b"), ("b", "B", "a"), ("c", "C", "")], "id string, name string, parent string")
    assert ids(traverse.paths(e), "id", "path") == [("a", "A"), ("b", "B"), ("c", "C")]


def test_projections_are_written_per_graph_and_recovered(spark, tmp_path):
    g = two_documents(spark, tmp_path)
    path = str(tmp_path / "projection")
    assert projection.write_projection(g, path).count() == 0
    clean = projection.sync_state(spark, path)
    assert clean.count() == 2 and clean.filter("dirty").count() == 0 and projection.stale(g, clean).count() == 0
    edited = replace(g, elements=g.elements.withColumn("id", F.when(F.col("graph_key").like("%/two/%") & (F.col("id") == "b"), "b2").otherwise(F.col("id"))))
    behind = projection.recover(edited, path)
    assert [r["graph_key"].split("/")[-2] for r in behind.collect()] == ["two"]
    assert sorted(r["id"] for r in part(projection.read_projection(spark, path), "two").elements.collect()) == ["a", "b2"]
    assert part(projection.read_projection(spark, path), "one").elements.count() == 3
    key = part(g, "one").elements.first()["graph_key"]
    projection.mark_dirty(spark.createDataFrame([(key,)], "graph_key string"), path)
    assert ids(projection.stale(edited, projection.sync_state(spark, path)), "graph_key") == [(key,)]
    projection.clear_graphs(spark.createDataFrame([(key,)], "graph_key string"), path)
    spark.catalog.clearCache()
    assert part(projection.read_projection(spark, path), "one").elements.count() == 0


def test_diagram_text_of_changes(spark):
    e = spark.createDataFrame([("a", "added", "Goal", 'A "x"'), ("b", "removed", "Goal", "B")], "id string, status string, type string, name string")
    r = spark.createDataFrame([("r", "Access", "a", "b")], "id string, type string, source_id string, target_id string")
    text = diff.plantuml(e, r)
    assert text.startswith("@startuml") and "rectangle \"A 'x' (Goal)\" as n0 #palegreen" in text and "n0 --> n1 : Access" in text


def test_a_rewrite_leaves_nothing_of_what_a_graph_lost(spark, tmp_path):
    path = str(tmp_path / "projection")
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    keys = ("007", "b")  # texts, though one looks like a number
    g = Graph(
        make([(k, 0, "e", f"{k} e", "Node", None, "") for k in keys], "graph_key string, ord long, id string, name string, type string, parent string, description string"),
        make([(k, 0, "r", "s", "n", "Flow", "e", "e") for k in keys], "graph_key string, ord long, id string, statement string, name string, type string, source_id string, target_id string"),
        make([(k, 0, "v", "V", None, None) for k in keys], "graph_key string, ord long, view_id string, view_name string, parent_element_id string, parent_element_name string"),
        make([(k, "v", "e", 0) for k in keys], "graph_key string, view_id string, element_id string, ord long"),
        make([(k, "v", "r", 0) for k in keys], "graph_key string, view_id string, relationship_id string, ord long"),
    )
    only = lambda t, k: t.filter(F.col("graph_key") == k)
    first = Graph(*(only(getattr(g, t), "007") for t in projection.TABLES))
    assert projection.write_projection(g, path).isEmpty()
    # Members and relationships go from one graph; the other stays as it is.
    less = replace(first, view_elements=first.view_elements.limit(0), relationships=first.relationships.limit(0), view_relationships=first.view_relationships.limit(0))
    assert projection.write_projection(less, path).isEmpty()
    now = projection.read_projection(spark, path)
    assert [[r["graph_key"] for r in getattr(now, t).orderBy("graph_key").collect()] for t in projection.TABLES] == [["007", "b"], ["b"], ["007", "b"], ["b"], ["b"]]
    state = projection.sync_state(spark, path)
    assert state.filter("dirty").isEmpty() and {r["graph_key"]: r["relationships"] for r in state.collect()} == {"007": 0, "b": 1}
    now = Graph(*(make(t.collect(), t.schema) for t in (getattr(now, n) for n in projection.TABLES)))
    # Content and members count, not ids alone; recovery ends.
    named = replace(now, elements=now.elements.withColumn("name", F.lit("other")))
    assert sorted(r[0] for r in projection.recover(named, path).collect()) == ["007", "b"]
    assert projection.recover(named, path).isEmpty()
    moved = replace(named, view_elements=named.view_elements.withColumn("ord", F.lit(9).cast("long")))
    assert [r[0] for r in projection.recover(moved, path).collect()] == ["b"] and projection.recover(moved, path).isEmpty()
