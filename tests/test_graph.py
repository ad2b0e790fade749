"""Hand-made graphs: cycles, self-loops, lost ends, nested views, logs."""

import hashlib
import json
import zlib
from collections import Counter
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from stratagraph.functions import text as tx
from stratagraph.operators import closure, delivery, diff, lifecycle, mutate, scan, traverse, validate, views
from stratagraph.plans import sqlapi
from stratagraph.queries import QUERIES
from stratagraph.sources import documents, star
from stratagraph.streaming import index

REL = "id string, ord long, type string, source_id string, target_id string"


def rels(spark, rows):
    return spark.createDataFrame([(f"r{k}", k, *r) for k, r in enumerate(rows)], REL)


def ids(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_edges_have_both_ways_but_loops_one(spark):
    e = traverse.semantic_edges(rels(spark, [("Access", "a", "b"), ("Flow", "a", "c"), ("Association", "a", "d"), ("Access", "a", "a"), ("Other", "a", "b")]))
    assert ids(e, "from_id", "to_id", "kind") == sorted(
        [("a", "b", "dependency"), ("b", "a", "dependent"), ("a", "c", "dependent"), ("c", "a", "dependency"), ("a", "d", "association"), ("d", "a", "association"), ("a", "a", "dependency")]
    )


def test_traversal_takes_the_least_depth(spark):
    e = traverse.semantic_edges(rels(spark, [("Access", "a", "b"), ("Access", "b", "c"), ("Access", "a", "c"), ("Access", "c", "a")]))
    start = spark.createDataFrame([("a", "a")], "root string, id string")
    assert ids(traverse.traverse(start, e, 3), "id", "depth") == [("a", 0), ("b", 1), ("c", 1)]
    assert ids(traverse.traverse(start, e, 0), "id", "depth") == [("a", 0)]
    assert ids(traverse.upstream(spark, start, e), "id", "depth") == [("a", 0), ("b", 1), ("c", 1)]


def test_delivery_of_chains_and_cycles(spark):
    e = traverse.semantic_edges(rels(spark, [("Access", "a", "b"), ("Access", "b", "c"), ("Access", "x", "y"), ("Access", "y", "x"), ("Access", "z", "x"), ("Access", "f", "g"), ("Access", "a", "free")]))
    r = spark.createDataFrame([(i, "t", i != "g") for i in "abcxyzfg"] + [("c", "u", True)], "element_id string, testcase string, passed boolean")
    got = dict(ids(delivery.delivery_status(spark, r, e), "element_id", "status"))
    assert {k for k, v in got.items() if v == "delivered"} == {"a", "b", "c"}


DOC = {
    "name": "S", "description": "d", "attributes": [],
    "elements": [
        {"id": "a", "name": "A", "type": "Grouping", "subdiagram_views": [{"view_id": "v2", "view_name": "V2"}]},
        {"id": "b", "name": "B", "type": "Business Role", "parent": "a"}, {"id": "c", "name": "C", "type": "Goal", "parent": "b"},
    ],
    "relationships": [{"id": "r", "type": "Association", "name": "r", "source_id": "a", "target_id": "b", "source_name": "A", "target_name": "B", "statement": "A --(Association)--> B"}],
    "views": [
        {"view_id": "v1", "view_name": "SystemArchitecture", "included_elements": ["a", "b", "a", "lost"], "included_relationships": ["r"]},
        {"view_id": "v2", "view_name": "V2", "parent_element_id": "a", "parent_element_name": "A", "included_elements": ["c"], "included_relationships": []},
    ],
}


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    p = tmp_path_factory.mktemp("doc") / "SystemArchitecture.json"
    p.write_text(json.dumps(DOC, indent=1))
    docs = documents.read_documents(spark, str(p))
    return docs, documents.explode_documents(docs)


def test_documents_round_trip(graph, spark, tmp_path):
    docs, g = graph
    back = documents.assemble_documents(docs, g)
    documents.write_documents(back, str(tmp_path / "out"))
    got = json.loads(next((tmp_path / "out").glob("part-*.json")).read_text())
    assert [e["id"] for e in got["elements"]] == ["a", "b", "c"]
    assert got["views"][0]["included_elements"] == ["a", "b", "a", "lost"]
    assert got["relationships"] == DOC["relationships"]


def test_discovery(spark, tmp_path):
    for p in ("one/design/KG", "two/deep/design/KG", "one/inner/design/KG", ".hidden/design/KG", "three/design"):
        (tmp_path / p).mkdir(parents=True)
        (tmp_path / p / "SystemArchitecture.json").write_text("{}")
    got = documents.discover(spark, str(tmp_path)).collect()
    assert [r["project"] for r in got] == ["deep", "one"]


def test_view_members_and_anchors(graph):
    _, g = graph
    assert ids(views.members(g).filter("view_id = 'v1'"), "ord", "element_id") == [(0, "a"), (1, "b"), (2, "a")]
    assert ids(views.missing_members(g), "view_id", "id") == [("v1", "lost")]
    start = g.elements.filter("id = 'c'").select("id")
    assert ids(traverse.view_anchors(start, g.elements, g.views, g.view_elements), "id") == [("a",), ("b",), ("c",)]
    s = views.subgraph(g, g.elements.filter("id <> 'c'").select("id"))
    assert ids(s.views, "view_id") == [("v1",)] and s.relationships.count() == 1


def test_deep_hierarchies_are_followed_to_their_end(spark):
    chain = [(f"e{k}", f"n{k}", f"e{k - 1}" if k else None) for k in range(70)]
    e = spark.createDataFrame(chain, "id string, name string, parent string").coalesce(1)
    got = dict(ids(traverse.paths(e.filter("int(substr(id, 2)) < 20")), "id", "path"))
    assert len(got) == 20 and got["e19"] == "/".join(f"n{k}" for k in range(20))
    none = spark.createDataFrame([], "view_id string, parent_element_id string")
    members = spark.createDataFrame([], "view_id string, element_id string")
    assert traverse.view_anchors(e.filter("id = 'e69'").select("id"), e, none, members).count() == 70


def test_anchors_of_included_relationships(graph):
    _, g = graph
    r = g.relationships.select("id")
    in_v2 = g.view_relationships.withColumn("view_id", F.lit("v2"))
    none = g.elements.limit(0).select("id")
    assert ids(traverse.view_anchors(none, g.elements, g.views, g.view_elements, r, in_v2), "id") == [("a",)]
    assert ids(traverse.view_anchors(none, g.elements, g.views, g.view_elements, r, g.view_relationships), "id") == []


def plain_version(kinds, name="System"):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    dump = lambda x: json.dumps(x, separators=(",", ":"), ensure_ascii=False)
    rows = [(sha(i)[:4], {"kind": k, "id": i, "n": n}) for k, found in kinds.items() for i, n in Counter(found).items()]
    for digits in (2, 0):
        parts = {}
        for p, item in rows:
            parts.setdefault(p, []).append(item)
        whole = {p: sha(dump(sorted(items, key=lambda x: tuple(x.values())))) for p, items in parts.items()}
        rows = [(p[:digits], {"part": p, "sha": s}) for p, s in whole.items()]
    return "canonical:" + sha(dump({"name": name, "parts": sorted((r for _, r in rows), key=lambda x: x["part"])}))


def test_canonical_version_is_that_of_all_ids(spark, sf):
    g = star.graph(spark, sf)
    g = replace(g, elements=g.elements.unionAll(g.elements.filter("id = 'part-1'")))
    kinds = {k: [r[0] for r in t.collect()] for k, t in (("elements", g.elements.select("id")), ("relationships", g.relationships.select("id")), ("views", g.views.select("view_id")))}
    assert ids(lifecycle.canonical_version(g), "graph_key", "canonical_version") == [("star", plain_version(kinds))]


def test_index_queries_cover_all_channels(spark, sf):
    want = {f"{k}:{r[0]}": k for k, t in (("Element", star.elements(spark, sf).select("id")), ("ArchitectureRelationship", star.links(spark, sf).select("id")), ("View", star.views(spark, sf).select("view_id"))) for r in t.collect()}
    n = {i: zlib.crc32(i.encode()) % 10 for i in want}
    assert ids(QUERIES["backfill_pending"](spark, sf), "canonical_identity", "channel") == sorted((i, k) for i, k in want.items() if n[i] < 2)
    assert ids(QUERIES["reconcile_delta"](spark, sf), "canonical_identity", "action") == sorted([*((i, "upsert") for i in want if n[i] < 2), ("Element:gone", "tombstone")])


def test_validation_finds_each_fault(graph, spark):
    _, g = graph
    got = {r["rule"] for r in validate.validate(g, spark.createDataFrame([], "rel_type string, src_type string, dst_type string")).collect()}
    assert got == {"missing_member_element"}
    bad = replace(
        g,
        elements=g.elements.unionByName(g.elements.filter("id = 'b'").withColumn("type", F.lit("Nothing")).withColumn("parent", F.lit("no"))),
        relationships=g.relationships.withColumn("type", F.lit("Serving")).withColumn("target_id", F.lit("no")),
        view_relationships=g.view_relationships.withColumn("view_id", F.lit("v2")),
    )
    got = {r["rule"] for r in validate.validate(bad).collect()}
    assert {"duplicate_element", "element_type", "missing_parent", "missing_target", "statement", "source_not_in_view", "target_not_in_view"} <= got


def test_subset_is_whole_or_nothing(graph, spark):
    _, g = graph
    part = spark.createDataFrame([("Element:a",), ("ArchitectureRelationship:r",)], "qualified_id string")
    rows, errors = closure.subset(g, closure.qualified(part))
    assert rows.count() == 0 and errors.count() == 1
    rows, errors = closure.subset(g, closure.qualified(part.unionAll(spark.createDataFrame([("Element:b",)], part.schema))))
    assert rows.count() == 3 and errors.count() == 0


def test_diff_and_functional_points(spark):
    a = spark.createDataFrame([("10", "Goal", "x"), ("9", "Goal", "y"), ("z", "Goal", "z")], "id string, type string, name string")
    b = spark.createDataFrame([("10", "Goal", "x2"), ("9", "Goal", "y"), ("new", "Other", "n")], a.schema)
    assert ids(diff.diff(a, b), "id", "status") == [("10", "affected"), ("new", "added"), ("z", "removed")]
    points = spark.range(1).select(tx.functional_points(F.lit("FP1 FP-AB-2, FP1 xFP3 FP4x")).alias("p")).first()["p"]
    assert points == ["FP1", "FP-AB-2"]


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(tx.summarize(F.lit(" a \u00a0\n b "))) == "a b"
    assert len(one(tx.summarize(F.lit("ab " * 100)))) == 180
    assert [one(tx.format_size(F.lit(x))) for x in (2.0, 1.5)] == ["2", "1.5"]
    assert [one(tx.next_version(F.lit(x))) for x in ("v9", "v")] == ["v10", "v-indexed"]
    assert one(tx.slug(F.lit("9 My__Graph!"))) == "db-9-my-graph"
    assert one(tx.safe_integer(F.lit(9007199254740993))) == '"9007199254740993"'
    assert one(tx.rtf_empty(F.lit(r"{\rtf1\ansi }"))) and not one(tx.rtf_empty(F.lit(r"{\rtf1 word}")))
    assert one(tx.canonical_type(F.lit("ArchiMate_BusinessRole"), ["Business Role"], "Grouping")) == "Business Role"
    assert one(tx.sequence_token(F.lit(" 1.2.3 go"))) == "1.2.3"


def test_sensitive_fields_of_json(spark):
    text = json.dumps({"api_key": "x", "a": [{"mail": "me@site.org"}, "plain sk-abcdefgh1234", ["x"], None, {}], "commit": "0" * 40, "path": "C:\\x", "n": 5, "tel": "13800000000"})
    got = ids(scan.sensitive(scan.json_fields(spark.createDataFrame([(text,), (None,)], "json string"))), "type", "path")
    assert got == [("commit_key", "commit"), ("credential_key", "api_key"), ("email", "a[0].mail"), ("git_hash", "commit"), ("path", "path"), ("phone", "tel")]
    deep = {"key": "last token"}
    for k in range(30):
        deep = [deep] if k % 2 else {"name": "my token", "in": deep}
    got = scan.json_fields(spark.createDataFrame([(7, json.dumps(deep)), (8, "[]"), (9, '"top"')], "doc_id long, json string")).collect()
    assert {r["doc_id"] for r in got} == {7} and sum(r["key"] == "name" for r in got) == 15
    assert [r["path"] for r in got if r["value"] == "last token"] == ["[0].in" * 15 + ".key"]


def test_log_and_its_inverse(spark):
    rows = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "id string, name string")
    log = spark.createDataFrame([(1, "update", "a", "x"), (2, "remove", "b", None), (3, "add", "d", "4"), (4, "add", "c", "no"), (5, "remove", "d", None), (6, "add", "d", "5"), (7, "update", "none", "z")], "seq long, type string, id string, name string")
    log = log.filter("seq <> 4")
    out = mutate.apply_log(rows, log, ["name"])
    assert ids(out, "id", "name") == [("a", "x"), ("c", "3"), ("d", "5")]
    back = mutate.apply_log(out, mutate.inverse(rows, out, ["name"]), ["name"])
    assert ids(back, "id", "name") == ids(rows, "id", "name")


def test_scoped_removal_and_new_links(graph, spark):
    _, g = graph
    scope = spark.createDataFrame([("v1", "b")], "view_id string, element_id string")
    out = mutate.remove_from_views(g, scope)
    assert ids(out.elements, "id") == [("a",), ("c",)] and out.relationships.count() == 0
    new = g.relationships.withColumn("id", F.lit("r9")).withColumn("target_id", F.lit("c"))
    out = mutate.add_relationships(g, new, spark.createDataFrame([("v2", "r9")], "view_id string, relationship_id string"))
    assert ids(out.view_elements.filter("view_id = 'v2'"), "ord", "element_id") == [(0, "c"), (1, "a")]
    out, refused = mutate.add_views(g, g.views.filter("view_id = 'v1'"))
    assert refused.count() == 1 and out.views.count() == 2
    assert ids(mutate.rename_views(g, spark.createDataFrame([("v2", "w")], "view_id string, new_id string")).view_elements.filter("view_id = 'w'"), "element_id") == [("c",)]
    assert mutate.subdiagram_repairs(g.elements, g.views).count() == 0
    assert mutate.missing_subdiagrams(g.elements, g.views.filter("view_id <> 'v2'")).count() == 1


def test_index_resumes_and_sees_edits(graph):
    _, g = graph
    want = lifecycle.identities(g)
    half = want.filter("channel <> 'View'")
    assert lifecycle.pending(want, half).count() == 2
    done = lifecycle.apply_delta(half, lifecycle.pending(want, half), want.limit(0))
    assert lifecycle.aligned(lifecycle.readiness(want, done)).first()["aligned"]
    edited = lifecycle.identities(replace(g, elements=g.elements.withColumn("name", F.lit("new"))))
    assert lifecycle.pending(edited, done).count() == 3
    assert not lifecycle.aligned(lifecycle.readiness(edited, done)).first()["aligned"]


@pytest.mark.parametrize("text", ["select 1", " with a as (select 'drop table x' as b) select * from a -- delete", "(select 1)", "show tables"])
def test_reads_pass(text):
    assert sqlapi.read_only(text)


@pytest.mark.parametrize("text", ["", " ", "drop table x", "select 1; delete from x", "insert into x values (1)", "with a as (select 1) insert into x select * from a", "create table x as select 1", "set a=b", "x" * 20_001, "merge into a using b on 1=1 when matched then delete"])
def test_writes_do_not(text):
    with pytest.raises(sqlapi.QueryRefused):
        sqlapi.read_only(text)


def test_stream_of_mutations(spark, tmp_path):
    schema = "seq long, type string, id string, name string"
    log = tmp_path / "log"
    for k, rows in enumerate([[(1, "add", "a", "x"), (2, "add", "b", "y")], [(3, "remove", "a", None), (4, "update", "b", "z")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(log))
        s = spark.readStream.schema(schema).parquet(str(log))
        index.maintain(s, str(tmp_path / "index"), ["name"], str(tmp_path / "check")).awaitTermination()
        assert index.latest(spark, str(tmp_path / "index")) == k + 1
    assert ids(spark.read.parquet(index.version_path(str(tmp_path / "index"), 2)), "id", "name") == [("b", "z")]


def test_activity_windows(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    assert index.activity(e).agg(F.sum("n")).first()[0] == e.count()
