"""Dependency edges, bounded traversal, context, boundary and view anchors.

A traversal of small depth is an unrolled chain of joins: no action runs, and
each step joins only the nodes of the step before. Starts are rows, so one plan
serves one element or all of them. Where starts and edges have ``graph_key``,
nothing leads from one graph to another, and results have it too.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagraph.model import SOURCE_DEPENDS, SYMMETRIC, TARGET_DEPENDS
from stratagraph.sources.documents import shared_key


def semantic_edges(relationships: DataFrame) -> DataFrame:
    """(relationship_id, ord, type, from_id, to_id, kind), both ways of each link.

    The kind says what the far end is to the near one: dependency, dependent or
    association. Links of unknown types have no edges; a self-loop has one. Each
    way is a select with the kind as a case of the type, so that a filter on the
    kind reaches the links themselves.
    """

    def kind(down: str, up: str):
        return F.when(F.col("type").isin(SOURCE_DEPENDS), down).when(F.col("type").isin(TARGET_DEPENDS), up).when(F.col("type").isin(SYMMETRIC), "association").alias("kind")

    own = [*shared_key(relationships), F.col("id").alias("relationship_id"), "ord", "type"]
    there = relationships.select(*own, F.col("source_id").alias("from_id"), F.col("target_id").alias("to_id"), kind("dependency", "dependent"))
    back = relationships.filter("source_id <> target_id").select(*own, F.col("target_id").alias("from_id"), F.col("source_id").alias("to_id"), kind("dependent", "dependency"))
    return there.unionAll(back).filter("kind is not null")


def traverse(starts: DataFrame, edges: DataFrame, depth: int, kind: str = "dependency") -> DataFrame:
    """(root, id, depth): nodes within ``depth`` edges of one kind of each root.

    ``starts`` has root and id; depth below 1 reaches the start alone.
    """
    key = shared_key(starts, edges)
    step = edges.filter(F.col("kind") == kind).select(*key, F.col("from_id").alias("id"), "to_id")
    levels = [starts.select(*key, "root", "id").distinct()]
    for _ in range(depth):
        levels.append(levels[-1].join(step, [*key, "id"]).select(*key, "root", F.col("to_id").alias("id")).distinct())
    every = reduce(DataFrame.unionAll, [rows.withColumn("depth", F.lit(d)) for d, rows in enumerate(levels)])
    return every.groupBy(*key, "root", "id").agg(F.min("depth").alias("depth"))


def traversed_relationships(reached: DataFrame, edges: DataFrame, depth: int, kind: str = "dependency") -> DataFrame:
    """(root, relationship_id): all edges that leave a node short of ``depth``."""
    key = shared_key(reached, edges)
    step = edges.filter(F.col("kind") == kind).select(*key, F.col("from_id").alias("id"), "relationship_id")
    return reached.filter(F.col("depth") < depth).join(step, [*key, "id"]).select(*key, "root", "relationship_id").distinct()


def intent_context(starts: DataFrame, edges: DataFrame, dependency: int = 2, dependent: int = 1, association: int = 1, expand: int = 0) -> tuple[DataFrame, DataFrame]:
    """Nodes (root, id, direction, depth) and relationships (root, relationship_id,
    direction) of the three traversals; ``expand`` follows dependencies of
    associated elements that far."""
    key = shared_key(starts, edges)
    nodes, rels = [], []

    def add(begin: DataFrame, depth: int, kind: str) -> DataFrame:
        got = traverse(begin, edges, depth, kind)
        nodes.append(got.select(*key, "root", "id", F.lit(kind).alias("direction"), "depth"))
        rels.append(traversed_relationships(got, edges, depth, kind).withColumn("direction", F.lit(kind)))
        return got

    add(starts, dependency, "dependency")
    add(starts, dependent, "dependent")
    near = add(starts, max(association, 1), "association")
    if expand > 0:
        add(near.filter("depth > 0").select(*key, "root", "id"), expand, "dependency")
    out = reduce(DataFrame.unionAll, nodes).groupBy(*key, "root", "id", "direction").agg(F.min("depth").alias("depth"))
    return out, reduce(DataFrame.unionAll, rels).distinct()


def boundary(nodes: DataFrame, edges: DataFrame, dependent: int = 1) -> DataFrame:
    """(root, id, direction, remaining, relationship_ids) of edges that leave a
    context: dependency or association edges of its nodes on those ways, and
    dependent edges of nodes at the last depth of that way."""
    from stratagraph.plans.fixpoint import Rounds

    key = shared_key(nodes, edges)
    nodes = Rounds(nodes.sparkSession).save(nodes)  # read three times below
    inside = nodes.select(*key, "root", F.col("id").alias("to_id")).distinct()
    near = nodes.filter("direction in ('dependency', 'association')").select(*key, "root", "id").distinct().withColumn("direction", F.lit("dependency"))
    far = nodes.filter((F.col("direction") == "dependent") & (F.col("depth") >= dependent)).select(*key, "root", "id").withColumn("direction", F.lit("dependent"))
    way = F.when(F.col("kind") == "dependent", "dependent").otherwise("dependency")
    step = edges.select(*key, F.col("from_id").alias("id"), "to_id", "relationship_id", way.alias("direction"))
    out = near.unionAll(far).join(step, [*key, "id", "direction"]).join(inside, [*key, "root", "to_id"], "left_anti")
    out = out.groupBy(*key, "root", "id", "direction").agg(F.array_sort(F.collect_set("relationship_id")).alias("relationship_ids"))
    return out.select(*key, "root", "id", "direction", F.size("relationship_ids").cast("long").alias("remaining"), "relationship_ids")


def view_anchors(included: DataFrame, elements: DataFrame, views: DataFrame, view_elements: DataFrame, relationships: DataFrame | None = None, view_relationships: DataFrame | None = None) -> DataFrame:
    """Fixpoint (id): parents of included elements, and of the views that they
    or the included ``relationships`` (id) are in.

    One step adds the parent of each element and of each view that touches it;
    both are edges of one table, so a round is one join with what is new. The
    included relationships stay the same, so their views count once, at first.
    """
    from stratagraph.plans.fixpoint import grow

    key = shared_key(included, elements, views, view_elements)
    up = elements.filter("parent is not null").select(*key, "id", F.col("parent").alias("up"))
    seen = view_elements.join(views.filter("parent_element_id is not null"), [*key, "view_id"]).select(*key, F.col("element_id").alias("id"), F.col("parent_element_id").alias("up"))
    known = elements.select(*key, F.col("id").alias("up"))
    steps = up.unionAll(seen).distinct().join(known, [*key, "up"], "left_semi")
    first = included.select(*key, "id")
    if relationships is not None and view_relationships is not None:
        touched = view_relationships.join(relationships.select(*key, F.col("id").alias("relationship_id")), [*key, "relationship_id"], "left_semi").select(*key, "view_id")
        parents = views.join(touched, [*key, "view_id"], "left_semi").select(*key, F.col("parent_element_id").alias("up"))
        first = first.unionAll(parents.join(known, [*key, "up"], "left_semi").select(*key, "up"))
    further = lambda new: new.join(steps, [*key, "id"]).select(*key, F.col("up").alias("id"))
    return grow(included.sparkSession, first.distinct(), further, [*key, "id"])


def upstream(spark: SparkSession, starts: DataFrame, edges: DataFrame, depth: int | None = None, kind: str = "dependency") -> DataFrame:
    """(root, id, depth) as ``traverse``, for depths too large to unroll; without
    a depth as far as links lead."""
    from stratagraph.plans.fixpoint import grow

    key = shared_key(starts, edges)
    step = edges.filter((F.col("kind") == kind) & (F.col("from_id") != F.col("to_id"))).select(*key, F.col("from_id").alias("id"), "to_id")
    first = starts.select(*key, "root", "id").distinct().withColumn("depth", F.lit(0))

    def further(new: DataFrame) -> DataFrame:
        return new.join(step, [*key, "id"]).select(*key, "root", F.col("to_id").alias("id"), (F.col("depth") + 1).alias("depth"))

    return grow(spark, first, further, [*key, "root", "id"], depth)


def connecting(relationships: DataFrame, ids: DataFrame) -> DataFrame:
    """Relationships with both ends in a set of ids."""
    key = shared_key(relationships, ids)
    out = relationships
    for end in ("source_id", "target_id"):
        out = out.join(ids.select(*key, F.col("id").alias(end)), [*key, end], "left_semi")
    return out.select(relationships.columns)


def paths(elements: DataFrame) -> DataFrame:
    """(id, path): names from the outermost parent down, joined by slashes. An
    element whose parents form a circle is on no path from an outermost one: its
    path is its own name."""
    from stratagraph.plans.fixpoint import grow

    key = shared_key(elements)
    parts = elements.select(*key, "id", "name", "parent")
    roots = parts.join(parts.select(*key, F.col("id").alias("parent")), [*key, "parent"], "left_anti").select(*key, "id", F.col("name").alias("path"))
    kids = parts.select(*key, F.col("id").alias("kid"), F.col("name").alias("kid_name"), F.col("parent").alias("id"))
    further = lambda new: new.join(kids, [*key, "id"]).select(*key, F.col("kid").alias("id"), F.concat_ws("/", "path", "kid_name").alias("path"))
    found = grow(elements.sparkSession, roots, further, [*key, "id"])
    rest = parts.join(found.select(*key, "id"), [*key, "id"], "left_anti").select(*key, "id", F.col("name").alias("path"))
    return found.unionAll(rest)
