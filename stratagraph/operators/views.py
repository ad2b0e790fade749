"""Views: members, missing members, child views, layout, closure and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratagraph.sources.documents import Graph, shared_key


def members(graph: Graph) -> DataFrame:
    """(view_id, ord, element_id, name, type): members that exist, duplicates too."""
    key = shared_key(graph.elements, graph.view_elements)
    names = graph.elements.select(*key, F.col("id").alias("element_id"), "name", "type")
    return graph.view_elements.join(names, [*key, "element_id"]).select(*key, "view_id", "ord", "element_id", "name", "type")


def missing_members(graph: Graph) -> DataFrame:
    """(view_id, kind, id) of listed members that don't exist."""
    out = []
    for kind, listed, rows in (("element", graph.view_elements, graph.elements), ("relationship", graph.view_relationships, graph.relationships)):
        key = shared_key(listed, rows)
        lost = listed.join(rows.select(*key, F.col("id").alias(f"{kind}_id")), [*key, f"{kind}_id"], "left_anti")
        out.append(lost.select(*key, "view_id", F.lit(kind).alias("kind"), F.col(f"{kind}_id").alias("id")))
    return out[0].unionAll(out[1])


def child_views(graph: Graph) -> DataFrame:
    """(view_id, child): the views that a view's members declare as their diagrams
    (``subdiagram_views``); where elements have no such column, those whose parent
    a member is."""
    key = shared_key(graph.elements, graph.view_elements, graph.views)
    held = graph.view_elements.select(*key, "view_id", "element_id").distinct()
    if "subdiagram_views" in graph.elements.columns:
        told = graph.elements.select(*key, F.col("id").alias("element_id"), F.explode("subdiagram_views").alias("v")).select(*key, "element_id", F.col("v.view_id").alias("child"))
        told = told.join(graph.views.select(*key, F.col("view_id").alias("child")), [*key, "child"], "left_semi")
    else:
        told = graph.views.select(*key, F.col("parent_element_id").alias("element_id"), F.col("view_id").alias("child"))
    return held.join(told, [*key, "element_id"]).select(*key, "view_id", "child").distinct()


def view_context(graph: Graph) -> DataFrame:
    """One row for each view: its parent, members, relationships, lost members and
    child views, counted."""
    key = shared_key(graph.elements, graph.relationships, graph.views, graph.view_elements, graph.view_relationships)

    def tally(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(*key, "view_id", F.lit(name).alias("what"))

    def known(listed: DataFrame, rows: DataFrame, column: str) -> DataFrame:
        return listed.join(rows.select(*key, F.col("id").alias(column)).withColumn("there", F.lit(True)), [*key, column], "left")

    # Members and lost members come from one join of each list.
    listed = known(graph.view_elements, graph.elements, "element_id").select(*key, "view_id", F.when(F.col("there"), "n_elements").otherwise("n_missing").alias("what"))
    drawn = known(graph.view_relationships, graph.relationships, "relationship_id").select(*key, "view_id", F.when(F.col("there"), "n_relationships").otherwise("n_missing").alias("what"))
    rows = listed.unionAll(drawn).unionAll(tally(child_views(graph), "n_children"))
    names = ("n_elements", "n_relationships", "n_missing", "n_children")
    counts = rows.groupBy(*key, "view_id").agg(*[F.count_if(F.col("what") == n).alias(n) for n in names])
    parents = graph.elements.select(*key, F.col("id").alias("parent_element_id"), F.col("type").alias("parent_type"))
    out = graph.views.select(*key, "view_id", "view_name", "parent_element_id").join(parents, [*key, "parent_element_id"], "left").join(counts, [*key, "view_id"], "left")
    return out.select(*key, "view_id", "view_name", "parent_element_id", "parent_type", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])


def _half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("long")


def circle_layout(graph: Graph, radius: int = 160) -> DataFrame:
    """(view_id, id, x, y): members on a circle, by their place in the list
    before lost members are left out."""
    key = shared_key(graph.elements, graph.view_elements)
    w = Window.partitionBy(*key, "view_id")
    rank = F.row_number().over(w.orderBy("ord")) - 1
    placed = graph.view_elements.withColumn("i", rank).withColumn("n", F.count(F.lit(1)).over(w))
    angle = F.lit(2.0) * F.lit(3.141592653589793) * F.col("i") / F.greatest("n", F.lit(1))
    known = graph.elements.select(*key, F.col("id").alias("element_id"), "name", "type")
    half = F.lit(radius / 2.0)
    return placed.withColumn("angle", angle).join(known, [*key, "element_id"]).select(
        *key, "view_id", F.col("element_id").alias("id"), "name", "type", _half_up(half + radius * F.cos("angle")).alias("x"), _half_up(half + radius * F.sin("angle")).alias("y")
    )


def drawn_edges(graph: Graph) -> DataFrame:
    """(view_id, id, type, source_id, target_id): a view's relationships with both
    ends among its members, in order of its list: the edges of its drawing."""
    key = shared_key(graph.relationships, graph.view_elements, graph.view_relationships)
    rels = graph.relationships.select(*key, F.col("id").alias("relationship_id"), "type", "source_id", "target_id")
    out = graph.view_relationships.select(*key, "view_id", "relationship_id", F.col("ord").alias("place")).join(rels, [*key, "relationship_id"])
    held = graph.view_elements.select(*key, "view_id", "element_id").distinct()
    for end in ("source_id", "target_id"):
        out = out.join(held.withColumnRenamed("element_id", end), [*key, "view_id", end], "left_semi")
    return out.select(*key, "view_id", "place", F.col("relationship_id").alias("id"), "type", "source_id", "target_id")


def grid_layout(rows: DataFrame, columns: int | None = 5, width: int = 160, height: int = 100) -> DataFrame:
    """Columns x and y of rows by ``ord`` within ``view_id``; None: a square grid."""
    w = Window.partitionBy(*shared_key(rows), "view_id")
    i = F.row_number().over(w.orderBy("ord")) - 1
    side = F.lit(columns) if columns else F.greatest(F.ceil(F.sqrt(F.count(F.lit(1)).over(w).cast("double"))), F.lit(1))
    return rows.withColumn("_i", i).withColumn("_n", side).withColumn("x", (F.col("_i") % F.col("_n")) * width).withColumn("y", F.floor(F.col("_i") / F.col("_n")) * height).drop("_i", "_n")


def subgraph(graph: Graph, ids: DataFrame) -> Graph:
    """The part of a graph over a set of ids: elements, relationships with both
    ends, and the views that touch it with their lists trimmed."""
    from stratagraph.operators.traverse import connecting

    key = shared_key(ids, graph.elements, graph.relationships, graph.views, graph.view_elements, graph.view_relationships)
    elements = graph.elements.join(ids.select(*key, "id"), [*key, "id"], "left_semi")
    rels = connecting(graph.relationships, ids.select(*key, "id"))
    held = graph.view_elements.join(ids.select(*key, F.col("id").alias("element_id")), [*key, "element_id"], "left_semi")
    drawn = graph.view_relationships.join(rels.select(*key, F.col("id").alias("relationship_id")), [*key, "relationship_id"], "left_semi")
    views = graph.views.join(held.select(*key, "view_id").distinct(), [*key, "view_id"], "left_semi")
    return Graph(elements, rels, views, held, drawn)


def containing(graph: Graph, ids: DataFrame) -> DataFrame:
    """(id, view_id): the views that each id is in, as element or relationship."""
    key = shared_key(ids, graph.view_elements, graph.view_relationships)
    e = graph.view_elements.select(*key, F.col("element_id").alias("id"), "view_id")
    r = graph.view_relationships.select(*key, F.col("relationship_id").alias("id"), "view_id")
    return e.unionAll(r).join(ids.select(*key, "id"), [*key, "id"], "left_semi").distinct()
