"""Integrity rules of graphs, each a query; violations are (rule, kind, id, message).

Rules are anti-joins, grouped counts and filters over normalized tables: no rule
looks at one document at a time, so a million graphs are validated in one job.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratagraph.model import ELEMENT_TYPES, ID_PATTERN, RELATIONSHIP_TYPES, ROOT_VIEW, SYMMETRIC, VIEW_LIMIT
from stratagraph.sources.documents import Graph


def _found(rows: DataFrame, rule: str, kind: str, key: str, message: Column) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), F.lit(kind).alias("kind"), F.col(key).alias("id"), message.alias("message"))


def _say(*parts) -> Column:
    return F.concat(*[F.coalesce(F.col(p[1:]), F.lit("")) if p.startswith("$") else F.lit(p) for p in parts])


def duplicate_ids(graph: Graph) -> DataFrame:
    """Ids are dealt to as many tasks as the session has for shuffles: a count before the shuffle
    would hold an entry for nearly each row, in tasks that adaptive plans make large."""
    out = []
    for rows, kind, key in ((graph.elements, "element", "id"), (graph.relationships, "relationship", "id"), (graph.views, "view", "view_id")):
        dealt = rows.select("graph_key", key).repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "graph_key", key)
        twice = dealt.groupBy("graph_key", key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        out.append(_found(twice, f"duplicate_{kind}", kind, key, _say(f"duplicate {kind} id: ", f"${key}")))
    return reduce(DataFrame.unionAll, out)


def unsupported_types(graph: Graph) -> DataFrame:
    e = graph.elements.filter(~F.col("type").isin(ELEMENT_TYPES))
    r = graph.relationships.filter(~F.col("type").isin(RELATIONSHIP_TYPES))
    return _found(e, "element_type", "element", "id", _say("unsupported type: ", "$type")).unionAll(_found(r, "relationship_type", "relationship", "id", _say("unsupported type: ", "$type")))


def bad_ids(graph: Graph) -> DataFrame:
    e = graph.elements.filter(~F.col("id").rlike(ID_PATTERN))
    r = graph.relationships.filter(~F.col("id").rlike(ID_PATTERN))
    return _found(e, "element_id", "element", "id", F.lit("malformed id")).unionAll(_found(r, "relationship_id", "relationship", "id", F.lit("malformed id")))


def missing_parents(graph: Graph) -> DataFrame:
    ids = graph.elements.select("graph_key", F.col("id").alias("parent"))
    lost = graph.elements.filter("parent is not null and parent <> ''").join(ids, ["graph_key", "parent"], "left_anti")
    return _found(lost, "missing_parent", "element", "id", _say("missing parent: ", "$parent"))


def dangling(graph: Graph) -> DataFrame:
    """Relationships pass by hashed elements: sorted, they would need memory and spill."""
    out = []
    for end in ("source", "target"):
        ids = graph.elements.select("graph_key", F.col("id").alias(f"{end}_id")).hint("shuffle_hash")
        lost = graph.relationships.join(ids, ["graph_key", f"{end}_id"], "left_anti")
        out.append(_found(lost, f"missing_{end}", "relationship", "id", _say(f"missing {end}: ", f"${end}_id")))
    return reduce(DataFrame.unionAll, out)


def name_mismatches(graph: Graph) -> DataFrame:
    out = []
    for end in ("source", "target"):
        names = graph.elements.select("graph_key", F.col("id").alias(f"{end}_id"), F.col("name").alias("real"))
        off = graph.relationships.join(names, ["graph_key", f"{end}_id"]).filter(~F.col(f"{end}_name").eqNullSafe(F.col("real")))
        out.append(_found(off, f"{end}_name", "relationship", "id", _say(f"{end} is named ", "$real")))
    return reduce(DataFrame.unionAll, out)


def statements(graph: Graph) -> DataFrame:
    want = F.format_string("%s --(%s)--> %s", "source_name", "type", "target_name")
    off = graph.relationships.filter(~F.col("statement").eqNullSafe(want)).withColumn("want", want)
    return _found(off, "statement", "relationship", "id", _say("statement must be ", "$want"))


def view_structure(graph: Graph) -> DataFrame:
    """One top view of the fixed name; other views have a parent that exists."""
    top = F.col("parent_element_id").isNull() | (F.col("parent_element_id") == "")
    tops = graph.views.groupBy("graph_key").agg(F.count_if(top & (F.col("view_name") == ROOT_VIEW)).alias("n"), F.count_if(top).alias("all"))
    one = _found(tops.filter("n <> 1"), "top_view", "graph", "graph_key", F.lit(f"one top view must be named {ROOT_VIEW}"))
    loose = _found(graph.views.filter(top & (F.col("view_name") != ROOT_VIEW)), "view_without_parent", "view", "view_id", F.lit("sub-view without parent"))
    names = graph.elements.select("graph_key", F.col("id").alias("parent_element_id"), F.col("name").alias("real"))
    kids = graph.views.filter(~top).join(names, ["graph_key", "parent_element_id"], "left")
    lost = _found(kids.filter("real is null"), "missing_view_parent", "view", "view_id", _say("missing parent: ", "$parent_element_id"))
    off = _found(kids.filter("real is not null and not (parent_element_name <=> real)"), "view_parent_name", "view", "view_id", _say("parent is named ", "$real"))
    return one.unionAll(loose).unionAll(lost).unionAll(off)


def view_members(graph: Graph) -> DataFrame:
    """Members exist, and relationships have both ends in the same view."""
    from stratagraph.operators.views import missing_members

    lost = missing_members(graph).select(F.concat(F.lit("missing_member_"), "kind").alias("rule"), F.lit("view").alias("kind"), F.col("view_id").alias("id"), F.concat(F.lit("missing member: "), "id").alias("message"))
    held = graph.view_elements.select("graph_key", "view_id", "element_id").distinct()
    drawn = graph.view_relationships.join(graph.relationships.select("graph_key", F.col("id").alias("relationship_id"), "source_id", "target_id"), ["graph_key", "relationship_id"])
    for end in ("source", "target"):
        inside = held.withColumnRenamed("element_id", f"{end}_id")
        out = drawn.join(inside, ["graph_key", "view_id", f"{end}_id"], "left_anti")
        lost = lost.unionAll(_found(out, f"{end}_not_in_view", "view", "view_id", _say("$relationship_id", f" has no {end} here")))
    return lost


def orphans(graph: Graph) -> DataFrame:
    """Elements and relationships in no view."""
    e = graph.elements.join(graph.view_elements.select("graph_key", F.col("element_id").alias("id")), ["graph_key", "id"], "left_anti")
    r = graph.relationships.join(graph.view_relationships.select("graph_key", F.col("relationship_id").alias("id")), ["graph_key", "id"], "left_anti")
    return _found(e, "orphan_element", "element", "id", F.lit("in no view")).unionAll(_found(r, "orphan_relationship", "relationship", "id", F.lit("in no view")))


def view_limits(graph: Graph, limit: int = VIEW_LIMIT) -> DataFrame:
    n = graph.view_elements.groupBy("graph_key", "view_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit)
    return _found(n, "view_limit", "view", "view_id", F.concat(F.col("n").cast("string"), F.lit(f" members, at most {limit}")))


def endpoint_matrix(graph: Graph, allowed: DataFrame) -> DataFrame:
    """Relationships whose (type, source type, target type) isn't in ``allowed``
    (rel_type, src_type, dst_type). Links of the symmetric kind are free unless
    an end is a junction."""
    kinds = graph.elements.select("graph_key", "id", "type")
    rows = graph.relationships.select("graph_key", "id", "type", "source_id", "target_id")
    for end, name in (("source", "src_type"), ("target", "dst_type")):
        rows = rows.join(kinds.select("graph_key", F.col("id").alias(f"{end}_id"), F.col("type").alias(name)), ["graph_key", f"{end}_id"])
    free = F.col("type").isin(SYMMETRIC) & ~F.col("src_type").contains("Junction") & ~F.col("dst_type").contains("Junction")
    off = rows.filter(~free).join(allowed.withColumnRenamed("rel_type", "type"), ["type", "src_type", "dst_type"], "left_anti")
    return _found(off, "endpoint_types", "relationship", "id", _say("$type", " may not go from ", "$src_type", " to ", "$dst_type"))


RULES = {
    "duplicate_ids": duplicate_ids,
    "unsupported_types": unsupported_types,
    "bad_ids": bad_ids,
    "missing_parents": missing_parents,
    "dangling": dangling,
    "name_mismatches": name_mismatches,
    "statements": statements,
    "view_structure": view_structure,
    "view_members": view_members,
    "orphans": orphans,
    "view_limits": view_limits,
}


def validate(graph: Graph, allowed: DataFrame | None = None) -> DataFrame:
    """All violations of all rules."""
    out = [rule(graph) for rule in RULES.values()]
    if allowed is not None:
        out.append(endpoint_matrix(graph, allowed))
    return reduce(DataFrame.unionAll, out)
