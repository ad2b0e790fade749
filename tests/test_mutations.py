"""Ordered batches of mutations against a plain interpreter of the same rules."""

import json
import random
from dataclasses import replace

from pyspark.sql import functions as F

from stratagraph.operators import mutate
from stratagraph.sources.documents import Graph, explode_documents, read_documents

DOC = {
    "name": "S", "description": "d", "attributes": [],
    "elements": [{"id": i, "name": i.upper(), "type": "Business Role"} for i in "pabc"],
    "relationships": [{"id": "r1", "type": "Flow", "source_id": "a", "target_id": "b"}, {"id": "r2", "type": "Flow", "source_id": "b", "target_id": "c"}],
    "views": [
        {"view_id": "top", "view_name": "SystemArchitecture", "included_elements": ["p", "a", "b", "c"], "included_relationships": ["r1", "r2"]},
        {"view_id": "sub", "view_name": "Sub", "parent_element_id": "p", "parent_element_name": "P", "included_elements": ["a", "b"], "included_relationships": ["r1"]},
    ],
}


def plain(doc, batch):
    """The document after a batch, one mutation at a time; None if one is refused."""
    els = {e["id"]: dict(e) for e in doc["elements"]}
    rels = {r["id"]: dict(r) for r in doc["relationships"]}
    views = {v["view_id"]: {**v, "e": list(v["included_elements"]), "r": list(v["included_relationships"])} for v in doc["views"]}

    def uses(view, element, but=None):
        return any(element in (rels[r]["source_id"], rels[r]["target_id"]) for r in view["r"] if r != but and r in rels)

    for m in sorted(batch, key=lambda m: m["seq"]):
        kind, i, scope = m["type"], m["id"], m.get("view_ids")
        if any(v not in views for v in scope or []):
            return None
        fields = {k: v for k, v in m.items() if k in ("name", "source_id", "target_id", "parent_element_id") and v is not None}
        if kind == "addElement":
            els.setdefault(i, {"id": i, "type": m["kind"], **fields})
            for v in scope:
                views[v]["e"] += [i] * (i not in views[v]["e"])
        elif kind == "addRelationship":
            rels.setdefault(i, {"id": i, "type": m["kind"], **fields})
            for v in scope:
                for x in (m["source_id"], m["target_id"]):
                    views[v]["e"] += [x] * (x not in views[v]["e"])
                views[v]["r"] += [i] * (i not in views[v]["r"])
        elif kind == "addView":
            if i in views:
                return None
            views[i] = {"view_id": i, "view_name": m["name"], "parent_element_id": m.get("parent_element_id"), "e": [], "r": []}
        elif i not in (els if "Element" in kind else rels if "Relationship" in kind else views):
            return None
        elif kind == "updateElement":
            els[i].update(fields)
        elif kind == "updateView":
            views[i].update({k: v for k, v in (("view_name", m.get("name")), ("parent_element_id", m.get("parent_element_id"))) if v is not None})
        elif kind == "removeView":
            del views[i]
        elif kind == "updateRelationship":
            old = {rels[i]["source_id"], rels[i]["target_id"]}
            rels[i].update(fields)
            new = {rels[i]["source_id"], rels[i]["target_id"]}
            for v in views.values():
                if i in v["r"]:
                    v["e"] += [x for x in sorted(new) if x not in v["e"]]
                    v["e"] = [x for x in v["e"] if x not in old - new or uses(v, x, i)]
        elif kind == "removeRelationship":
            for v in [views[x] for x in scope] if scope is not None else [v for v in views.values() if i in v["r"]]:
                v["r"] = [r for r in v["r"] if r != i]
                v["e"] = [x for x in v["e"] if x not in (rels[i]["source_id"], rels[i]["target_id"]) or uses(v, x, i)]
            if not any(i in v["r"] for v in views.values()):
                del rels[i]
        else:
            if any(v.get("parent_element_id") == i for v in views.values()):
                return None
            mine = {r for r, x in rels.items() if i in (x["source_id"], x["target_id"])}
            for v in [views[x] for x in scope] if scope is not None else list(views.values()):
                v["e"] = [x for x in v["e"] if x != i]
                v["r"] = [r for r in v["r"] if r not in mine]
            if not any(i in v["e"] for v in views.values()):
                for v in views.values():
                    v["r"] = [r for r in v["r"] if r not in mine]
                del els[i]
            for r in mine:
                if not any(r in v["r"] for v in views.values()):
                    del rels[r]
    return (
        sorted((i, e["name"]) for i, e in els.items()), sorted((i, r["source_id"], r["target_id"]) for i, r in rels.items()), sorted((i, v["view_name"]) for i, v in views.items()),
        sorted((i, x) for i, v in views.items() for x in v["e"]), sorted((i, x) for i, v in views.items() for x in v["r"]),
    )


def state(g):
    rows = lambda t, *c: sorted(tuple(r) for r in t.select(*c).collect())
    return rows(g.elements, "id", "name"), rows(g.relationships, "id", "source_id", "target_id"), rows(g.views, "view_id", "view_name"), rows(g.view_elements, "view_id", "element_id"), rows(g.view_relationships, "view_id", "relationship_id")


BATCHES = [
    [("addElement", "d", {"kind": "Business Role", "name": "D", "view_ids": ["top", "sub"]}), ("addRelationship", "r3", {"kind": "Flow", "source_id": "c", "target_id": "d", "view_ids": ["sub"]}), ("updateElement", "d", {"name": "D2"})],
    [("updateRelationship", "r1", {"target_id": "c"}), ("removeRelationship", "r1", {"view_ids": ["sub"]}), ("removeElement", "a", {})],
    [("removeElement", "a", {"view_ids": ["sub"]}), ("removeElement", "a", {"view_ids": ["top"]}), ("addView", "new", {"name": "New", "parent_element_id": "b"}), ("updateView", "new", {"name": "Newer"}), ("removeView", "sub", {}), ("removeElement", "p", {})],
    [("updateElement", "a", {"name": "x"}), ("removeElement", "p", {})],
    [("addView", "sub", {"name": "again"})],
    [("addElement", "e", {"kind": "Goal", "name": "E", "view_ids": ["nowhere"]})],
    [("updateElement", "none", {"name": "x"})],
]


def test_batches_follow_the_rules_in_order(spark, tmp_path):
    path = tmp_path / "SystemArchitecture.json"
    path.write_text(json.dumps(DOC))
    g = explode_documents(read_documents(spark, str(path)))
    rng = random.Random(4)
    some = list(BATCHES)
    for _ in range(1):
        some.append([(rng.choice(["updateRelationship"]), rng.choice(["r1", "r2"]), {"source_id": rng.choice("abc"), "target_id": rng.choice("abcp")}) for _ in range(3)] + [("removeRelationship", rng.choice(["r1", "r2"]), rng.choice([{}, {"view_ids": ["top"]}]))])
    schema = [c.split()[0] for c in mutate.BATCH.split(", ")]
    for steps in some:
        batch = [{"seq": k, "type": t, "id": i, **f} for k, (t, i, f) in enumerate(steps)]
        df = spark.createDataFrame([tuple(m.get(c) for c in schema) for m in batch], mutate.BATCH)
        out, touched, refused = mutate.apply_batch(g, df)
        want = plain(DOC, batch)
        if want is None:
            assert refused.count() > 0 and state(out) == state(g) and touched.count() == 0, steps
        else:
            assert refused.count() == 0 and state(out) == want, steps
            assert {(m["type"][-4:], m["id"]) for m in batch} <= {(r["kind"][-4:], r["id"]) for r in touched.collect()}


def test_new_members_stand_in_the_order_of_steps_and_views_have_limits(spark, tmp_path):
    path = tmp_path / "SystemArchitecture.json"
    path.write_text(json.dumps(DOC))
    g = explode_documents(read_documents(spark, str(path)))
    add = lambda k, i, *views: (k, "addElement", i, "Goal", i, *[None] * 5, list(views))
    steps = [add(1, "z", "sub"), add(2, "y", "top"), add(3, "z", "top"), add(4, "x", "top"), (5, "addRelationship", "r9", "Flow", None, None, None, "x", "c", None, ["sub"])]
    df = spark.createDataFrame(steps, mutate.BATCH)
    out, _, refused = mutate.apply_batch(g, df, limit=7)
    held = lambda v: [r["element_id"] for r in out.view_elements.filter(F.col("view_id") == v).orderBy("ord").collect()]
    assert refused.count() == 0
    assert held("top") == ["p", "a", "b", "c", "y", "z", "x"] and held("sub") == ["a", "b", "z", "x", "c"]
    assert sorted((r["kind"], r["id"], r["change"]) for r in mutate.changes(g, out).collect()) == [*(("element", i, "created") for i in "xyz"), ("relationship", "r9", "created")]
    out, touched, refused = mutate.apply_batch(g, df, limit=6)
    assert [tuple(r) for r in refused.collect()] == [(None, "top", "more than 6 elements")]
    assert state(out) == state(g) and touched.count() == 0


def test_a_batch_has_any_number_of_steps(spark, tmp_path):
    path = tmp_path / "SystemArchitecture.json"
    path.write_text(json.dumps(DOC))
    g = explode_documents(read_documents(spark, str(path)))
    n, cols = 30_000, {c.split()[0]: c.split(maxsplit=1)[1] for c in mutate.BATCH.split(", ")}
    k = F.col("id")
    row = {"seq": k, "type": F.when(k < n // 2, "addElement").otherwise("updateElement"), "id": F.concat(F.lit("n"), (k % (n // 2)).cast("string")), "name": k.cast("string"), "kind": F.when(k < n // 2, "Goal"), "view_ids": F.when(k < n // 2, F.array(F.lit("top")))}
    out, _, refused = mutate.apply_batch(g, spark.range(n).select(*[row.get(c, F.lit(None)).cast(t).alias(c) for c, t in cols.items()]))
    assert refused.count() == 0
    assert out.elements.filter("id like 'n%' and cast(name as long) = cast(substr(id, 2) as long) + 15000").count() == n // 2
    assert [r["element_id"] for r in out.view_elements.filter("view_id = 'top' and ord in (4, 15003)").orderBy("ord").collect()] == ["n0", "n14999"]


def test_types_are_fixed_and_views_are_needed(spark, tmp_path):
    path = tmp_path / "SystemArchitecture.json"
    path.write_text(json.dumps(DOC))
    g = explode_documents(read_documents(spark, str(path)))
    rows = [(1, "updateElement", "a", "Goal", *[None] * 7), (2, "addElement", "z", "Goal", *[None] * 7), (3, "paintElement", "a", *[None] * 8)]
    df = spark.createDataFrame(rows, mutate.BATCH)
    got = {(r["seq"], r["reason"]) for r in mutate.apply_batch(g, df)[2].collect()}
    assert got == {(1, "type cannot be updated"), (2, "needs a view"), (3, "unsupported type")}


def test_one_graph_never_changes_another(spark, tmp_path):
    for name in ("one", "two"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "SystemArchitecture.json").write_text(json.dumps(DOC))
    g = explode_documents(read_documents(spark, [str(tmp_path / n / "SystemArchitecture.json") for n in ("one", "two")]))
    ids = g.elements.filter("id = 'a' and graph_key like '%/one/%'").select("graph_key", "id")
    out, refused = mutate.remove_elements(g, ids)
    two = lambda x: replace(x, **{t: getattr(x, t).filter(F.col("graph_key").like("%/two/%")) for t in ("elements", "relationships", "views", "view_elements", "view_relationships")})
    assert refused.count() == 0 and state(two(out)) == state(two(g))
    assert out.elements.count() == 7 and out.relationships.count() == 3
    scope = g.view_elements.filter("element_id = 'b' and graph_key like '%/one/%'").select("graph_key", "view_id", "element_id")
    assert state(two(mutate.remove_from_views(g, scope))) == state(two(g))


def test_a_batch_moves_only_what_it_can_change(spark):
    far = [("g", 10 + k, f"far-{k}", "Flow", "x", f"y{k}") for k in range(5)]
    g = Graph(
        spark.createDataFrame([("g", k, i, i, "Node", None, "") for k, i in enumerate("abcxy")], "graph_key string, ord long, id string, name string, type string, parent string, description string"),
        spark.createDataFrame([("g", 0, "r", "Flow", "a", "b"), ("g", 1, "s", "Flow", "b", "c"), ("g", 2, "t", "Flow", "c", "x"), *far], "graph_key string, ord long, id string, type string, source_id string, target_id string"),
        spark.createDataFrame([("g", 0, "v", "V", None, None), ("g", 1, "w", "W", None, None)], "graph_key string, ord long, view_id string, view_name string, parent_element_id string, parent_element_name string"),
        spark.createDataFrame([("g", "v", "a", 0), ("g", "v", "b", 1), ("g", "v", "c", 2), ("g", "w", "x", 0)], "graph_key string, view_id string, element_id string, ord long"),
        spark.createDataFrame([("g", "v", "r", 0), ("g", "v", "s", 1), ("g", "w", "far-0", 0)], "graph_key string, view_id string, relationship_id string, ord long"),
    )
    empty = dict.fromkeys(c.split()[0] for c in mutate.BATCH.split(", "))
    steps = [{**empty, "seq": 1, "type": "removeRelationship", "id": "r"}, {**empty, "seq": 2, "type": "removeElement", "id": "c"}]
    batch = spark.createDataFrame([tuple(s.values()) for s in steps], mutate.BATCH)
    near, elements, rest = mutate.part(g, batch)
    assert {r["id"] for r in near.elements.collect()} == {"c"} and {r["id"] for r in elements.collect()} == set("abxy")
    # s is drawn beside r, so it keeps its end b there; nothing needs far-0, which another view has.
    assert {r["id"] for r in near.relationships.collect()} == {"r", "s", "t"} and {r["id"] for r in rest.collect()} == {f[2] for f in far}
    after, _, refused = mutate.apply_batch(g, batch)
    assert refused.count() == 0 and {r["id"] for r in after.relationships.collect()} == {f[2] for f in far}
    assert {(r["view_id"], r["element_id"]) for r in after.view_elements.collect()} == {("v", "b"), ("w", "x")}
    assert {tuple(r)[1:] for r in mutate.changes(g, after).collect()} == {("relationship", i, "removed") for i in "rst"} | {("element", "c", "removed")}
