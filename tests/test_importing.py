from pyspark.sql import functions as F

from stratagraph.operators import importing
from stratagraph.sources.documents import Graph


def graph(spark, elements, relationships=(), views=(), held=(), drawn=()):
    return Graph(
        spark.createDataFrame(elements, "graph_key string, ord long, id string, name string, type string, parent string"),
        spark.createDataFrame(list(relationships), "graph_key string, ord long, id string, name string, type string, source_id string, target_id string"),
        spark.createDataFrame(list(views), "graph_key string, ord long, view_id string, view_name string, parent_element_id string, parent_element_name string"),
        spark.createDataFrame(list(held), "graph_key string, view_id string, element_id string, ord long"),
        spark.createDataFrame(list(drawn), "graph_key string, view_id string, relationship_id string, ord long"),
    )


def brute(elements):
    """New ids as a reader of one document gives them, by recursion."""
    data = {e[2]: e for e in elements if e[2].strip()}
    made = {}

    def make(i, on=()):
        if i in made or i in on:
            return i in made
        up = data[i][5]
        if up and up != "0" and up in data and not make(up, (*on, i)):
            return False
        made[i] = len(made) + 1
        return True

    for e in elements:
        if e[2].strip():
            make(e[2])
    return made


def test_ids_follow_the_order_of_making(spark):
    parents = {"e1": "e5", "e5": "e9", "e9": None, "e2": "e9", "e3": "0", "e4": "gone", "e6": "e1", "c1": "c2", "c2": "c3", "c3": "c1", "below": "c2", "e7": "e6", " ": None, "e8": " "}
    rows = [("g", k, i, i.upper(), "Node", up) for k, (i, up) in enumerate(parents.items())]
    rows.append(("g", 50, "e2", "renamed", "Node", "e3"))  # the last content, the first place
    made = importing.import_graph(graph(spark, rows))
    got = {r["id"]: r for r in made.elements.collect()}
    assert {i: r["new_id"] for i, r in got.items()} == brute(rows)
    assert (got["e2"]["name"], got["e2"]["owner_id"]) == ("renamed", got["e3"]["new_id"])
    assert got["e7"]["level"] == 4 and got["e3"]["owner_id"] is None
    assert sorted((r["id"], r["reason"]) for r in made.rejects.collect()) == [(" ", "no id"), ("below", "cycle of parents"), ("c1", "cycle of parents"), ("c2", "cycle of parents"), ("c3", "cycle of parents")]


def test_what_the_repository_has_keeps_its_id(spark):
    g = graph(
        spark,
        [("g", 0, "a", "A", "Node", "b"), ("g", 1, "b", "B", "Node", None), ("h", 0, "b", "other", "Node", None)],
        [("g", 0, "r", "R", "Flow", "a", "b"), ("g", 1, "r", "again", "Flow", "b", "a"), ("g", 2, "x", "X", "Flow", "a", "z"), ("h", 0, "y", "Y", "Flow", "a", "b")],
        [("g", 0, "v", "V", "a", "A"), ("g", 1, "v", "taken", None, None), ("g", 2, "w", "W", None, None)],
        [("g", "v", "a", 3), ("g", "v", "z", 4), ("g", "v", "b", 9), ("h", "v", "b", 0)],
        [("g", "v", "r", 0), ("g", "w", "x", 0)],
    )
    there = spark.createDataFrame([("g", "b", 77)], "graph_key string, id string, new_id long")
    declared = spark.createDataFrame([("g", "w", "no", "b", 0), ("g", "new", "New", "a", 1), ("g", "lost", "L", "z", 2)], "graph_key string, view_id string, view_name string, id string, ord long")
    made = importing.import_graph(g, there, declared)
    assert {(r["graph_key"], r["id"]): (r["new_id"], r["owner_id"], r["made"]) for r in made.elements.collect()} == {("g", "a"): (1, 77, True), ("g", "b"): (77, None, False), ("h", "b"): (2, None, True)}
    assert sorted((r["new_id"], r["name"], r["source_id"], r["target_id"]) for r in made.relationships.collect()) == [(1, "R", 1, 77), (2, "again", 77, 1)]
    assert {r["view_id"]: (r["view_name"], r["owner_id"]) for r in made.views.collect()} == {"v": ("V", 1), "w": ("W", 77), "new": ("New", 1)}
    assert sorted((r["element_id"], r["ord"], r["left"], r["bottom"]) for r in made.view_elements.collect()) == [(1, 0, 40, 120), (77, 2, 560, 120)]
    assert [r["connector_id"] for r in made.view_relationships.collect()] == [2]
    assert sorted((r["graph_key"], r["kind"], r["id"], r["reason"]) for r in made.rejects.collect()) == [
        ("g", "relationship", "x", "missing target"), ("g", "view element", "z", "missing element"), ("g", "view relationship", "x", "missing relationship"), ("h", "relationship", "y", "missing source")
    ]


def test_nothing_to_import(spark):
    g = graph(spark, [("g", 0, "a", "A", "Node", None)])
    none = Graph(*(getattr(g, t).limit(0) for t in ("elements", "relationships", "views", "view_elements", "view_relationships")))
    made = importing.import_graph(none)
    assert made.elements.count() == 0 and made.rejects.count() == 0 and made.views.filter(F.lit(True)).count() == 0


def test_relationships_at_one_place_are_numbered_by_id(spark):
    ends = [(7, f"{kind}-{k:03d}", "", "t", "a", "b") for k in range(40) for kind in ("sp", "op")]
    for rows in (ends, ends[::-1]):
        g = graph(spark, [("g", 1, "a", "A", "t", None), ("g", 2, "b", "B", "t", None)], [("g", *r) for r in rows])
        got = importing.import_graph(g).relationships.orderBy("new_id").collect()
        assert [r["id"] for r in got] == sorted(r[1] for r in ends)
        assert [r["new_id"] for r in got] == list(range(1, 81))


def test_elements_cost_nothing_of_the_links(spark):
    g = graph(spark, [("g", 1, "a", "A", "t", None)], [("g", 1, "r", "", "t", "a", "a")])
    g = Graph(g.elements, g.relationships.withColumn("id", F.raise_error(F.lit("links were read")).cast("string")), g.views, g.view_elements, g.view_relationships)
    assert [r["new_id"] for r in importing.import_graph(g).elements.collect()] == [1]


def test_numbers_are_read_without_another_shuffle(spark):
    from stratagraph.plans.fixpoint import Rounds
    from stratagraph.plans.numbering import numbered

    rows = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k"))
    out = numbered(rows.repartition(5), [F.col("k")], Rounds(spark), "n", 1)
    assert "Exchange hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["k"], r["n"]) for r in out.collect()) == [(k, k + 1) for k in range(1000)]
