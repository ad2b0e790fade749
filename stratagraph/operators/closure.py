"""Policy closure of seeds, structural completion, provenance, canonical subsets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratagraph.plans.fixpoint import Rounds
from stratagraph.sources.documents import Graph, shared_key

#: Ways that a closure goes along a link from a node.
FORWARD, BACKWARD, BOTH = ["Triggering", "Access"], ["Serving", "Realization", "Assignment"], ["Association"]


def policy_edges(relationships: DataFrame, policy: str | None = None) -> DataFrame:
    """(from_id, to_id, relationship_id) along which a closure goes; a link of
    another type only towards the policy anchor."""
    key = shared_key(relationships)
    forward = F.col("type").isin(FORWARD + BOTH)
    if policy is not None:
        forward = forward | (~F.col("type").isin(BACKWARD) & (F.col("target_id") == policy))
    a = relationships.filter(forward).select(*key, F.col("source_id").alias("from_id"), F.col("target_id").alias("to_id"), F.col("id").alias("relationship_id"))
    b = relationships.filter(F.col("type").isin(BACKWARD + BOTH)).select(*key, F.col("target_id").alias("from_id"), F.col("source_id").alias("to_id"), F.col("id").alias("relationship_id"))
    return a.unionAll(b)


def policy_closure(anchors: DataFrame, relationships: DataFrame, depth: int = 2, policy: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(id, depth) of reached elements and (relationship_id) of their links short
    of ``depth``. ``anchors`` has id."""
    key = shared_key(anchors, relationships)
    edges = policy_edges(relationships, policy).select(*key, F.col("from_id").alias("id"), "to_id", "relationship_id")
    levels = [anchors.select(*key, "id").distinct()]
    for _ in range(depth):
        levels.append(levels[-1].join(edges, [*key, "id"]).select(*key, F.col("to_id").alias("id")).distinct())
    every = reduce(DataFrame.unionAll, [rows.withColumn("depth", F.lit(d)) for d, rows in enumerate(levels)])
    reached = every.groupBy(*key, "id").agg(F.min("depth").alias("depth"))
    inner = reached.filter(F.col("depth") < depth).select(*key, "id")
    return reached, edges.join(inner, [*key, "id"], "left_semi").select(*key, "relationship_id").distinct()


def endpoint_closure(relationships: DataFrame, elements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Relationships with both end rows, and those of which an end is missing."""
    key = shared_key(relationships, elements)
    ends = elements.select(*key, "id", F.struct("id", "name", "type").alias("end"))
    out = relationships
    for end in ("source", "target"):
        out = out.join(ends.select(*key, F.col("id").alias(f"{end}_id"), F.col("end").alias(end)), [*key, f"{end}_id"], "left")
    whole = F.col("source").isNotNull() & F.col("target").isNotNull()
    return out.filter(whole), out.filter(~whole).select(*key, "id", F.when(F.col("source").isNull(), "source").otherwise("target").alias("missing_end"))


def view_closure(graph: Graph, view_ids: DataFrame) -> DataFrame:
    """(kind, id, reason) of what selected views bring; other views don't follow."""
    key = shared_key(view_ids, graph.view_elements, graph.view_relationships)
    held = graph.view_elements.join(view_ids, [*key, "view_id"], "left_semi").select(*key, F.lit("Element").alias("kind"), F.col("element_id").alias("id"))
    drawn = graph.view_relationships.join(view_ids, [*key, "view_id"], "left_semi").select(*key, F.lit("ArchitectureRelationship").alias("kind"), F.col("relationship_id").alias("id"))
    return held.unionAll(drawn).distinct().withColumn("reason", F.lit("complete-view"))


def complete(graph: Graph, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """(kind, id, step, reason) for each reason that brings an object in: seeds,
    their policy closure, ends of relationships, members of seed views."""
    key = shared_key(seeds, graph.relationships, graph.view_elements, graph.view_relationships)
    why = lambda rows, kind, column, step, reason: rows.select(*key, F.lit(kind).alias("kind"), F.col(column).alias("id"), F.lit(step).alias("step"), F.lit(reason).alias("reason"))
    seed = seeds.select(*key, "kind", "id", F.lit(0).alias("step"), F.lit("semantic-seed").alias("reason"))
    # Read by several branches below: written once, so none computes it again.
    tables = Rounds(seeds.sparkSession)
    nodes, rels = map(tables.save, policy_closure(seeds.filter("kind = 'Element'").select(*key, "id"), graph.relationships, depth))
    near = why(nodes, "Element", "id", 1, "policy-closure")
    links = why(rels, "ArchitectureRelationship", "relationship_id", 1, "policy-closure")
    chosen = seeds.filter("kind = 'ArchitectureRelationship'").select(*key, "id").unionAll(rels.select(*key, F.col("relationship_id").alias("id"))).distinct()
    ends = graph.relationships.join(chosen, [*key, "id"], "left_semi").select(*key, F.explode(F.array("source_id", "target_id")).alias("id"))
    shown = view_closure(graph, seeds.filter("kind = 'View'").select(*key, F.col("id").alias("view_id"))).select(*key, "kind", "id", F.lit(3).alias("step"), "reason")
    return reduce(DataFrame.unionAll, [seed, near, links, why(ends, "Element", "id", 2, "relationship-endpoint"), shown]).distinct()


def provenance(reasons: DataFrame) -> DataFrame:
    """(kind, id, first_reason, supplementary): the first reason of each object and
    its others, once each, in order of discovery."""
    key = shared_key(reasons)
    steps = reasons.groupBy(*key, "kind", "id", "reason").agg(F.min("step").alias("step"))
    order = F.transform(F.array_sort(F.collect_list(F.struct("step", "reason"))), lambda x: x["reason"])
    return steps.groupBy(*key, "kind", "id").agg(order.alias("r")).select(*key, "kind", "id", F.col("r")[0].alias("first_reason"), F.slice("r", 2, 1 << 20).alias("supplementary"))


def qualified(ids: DataFrame) -> DataFrame:
    """(kind, id) of ids such as ``Element:a``."""
    return ids.select(F.regexp_extract("qualified_id", "^([A-Za-z]+):", 1).alias("kind"), F.regexp_replace("qualified_id", "^[A-Za-z]+:", "").alias("id"))


def subset(graph: Graph, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Canonical objects (kind, id) of the evidence, and what it lacks
    (error, id): ends of its relationships, members and links of its views.
    With a row in the second the first is empty for its graph: a partial answer is
    none."""
    key = shared_key(evidence, graph.elements, graph.relationships, graph.views, graph.view_elements, graph.view_relationships)
    known = reduce(
        DataFrame.unionAll,
        [
            graph.elements.select(*key, F.lit("Element").alias("kind"), "id"),
            graph.relationships.select(*key, F.lit("ArchitectureRelationship").alias("kind"), "id"),
            graph.views.select(*key, F.lit("View").alias("kind"), F.col("view_id").alias("id")),
        ],
    )
    held = evidence.select(*key, "kind", "id").distinct().join(known, [*key, "kind", "id"], "left_semi")
    rels = held.filter("kind = 'ArchitectureRelationship'").select(*key, "id")
    ends = graph.relationships.join(rels, [*key, "id"], "left_semi").select(*key, "id", F.explode(F.array("source_id", "target_id")).alias("need"))
    ends = ends.select(*key, "id", F.lit("Element").alias("kind"), "need", F.lit("SEMANTIC_SUBSET_RELATIONSHIP_MISSING").alias("error"))
    seen = held.filter("kind = 'View'").select(*key, F.col("id").alias("view_id"))
    part = lambda rows, kind, column: rows.select(*key, "view_id", F.lit(kind).alias("kind"), F.col(column).alias("need"))
    parts = part(graph.view_elements, "Element", "element_id").unionAll(part(graph.view_relationships, "ArchitectureRelationship", "relationship_id"))
    parts = parts.join(seen, [*key, "view_id"], "left_semi").select(*key, F.col("view_id").alias("id"), "kind", "need", F.lit("SEMANTIC_SUBSET_VIEW_MISSING").alias("error"))
    errors = ends.unionAll(parts).join(held.withColumnRenamed("id", "need"), [*key, "kind", "need"], "left_anti").select(*key, "error", "id").distinct()
    if key:
        return held.join(errors.select(*key).distinct(), key, "left_anti"), errors
    stop = errors.limit(1).select(F.lit(True).alias("failed"))
    return held.join(F.broadcast(stop), F.lit(True), "left_anti"), errors


# Purposes with the policies that they bind, and what chooses one.
PURPOSES = {
    "intent-decision": ("grag-intent-decision-policy", "w5.intent-decision.v1"),
    "implementation-design": ("grag-implementation-policy", "w5.implementation-design.v1"),
    "coding-repair": ("grag-repair-policy", "w5.coding-repair.v1"),
    "audit": ("grag-audit-policy", "w5.audit-proof.v1"),
    "graph-tidy": ("grag-graph-tidy-policy", "w5.graph-tidy-bypass.v1"),
}
SELECTOR, RETRIEVAL = "grag-purpose-closure", "grag-seed-retrieval"


def purpose_policies(spark: SparkSession, selector: str = SELECTOR) -> DataFrame:
    """(purpose, policy_id, policy_anchor, selector), one row for each purpose."""
    rows = [(p, policy, anchor, selector) for p, (anchor, policy) in PURPOSES.items()]
    return spark.createDataFrame(rows, "purpose string, policy_id string, policy_anchor string, selector string")


def purpose_scope(policies: DataFrame, anchors: DataFrame, relationships: DataFrame, depth: int = 2, retrieval: str = RETRIEVAL) -> tuple[DataFrame, DataFrame]:
    """(purpose, id, depth, reason) and (purpose, relationship_id) of each purpose.

    ``anchors`` has purpose and id. At depth 0 stand the anchors, the policy's own
    and the ends of the link by which the selector triggers it; from there links
    go their ways: Triggering forward (back to ``retrieval``), Access forward,
    Serving, Realization and Assignment back, Association both ways, others only
    to the policy. What the selector triggers for other purposes is out. All
    purposes of all graphs are one plan; the first reason of an element is that
    of its least depth.
    """
    key = shared_key(relationships, anchors)
    kind, src, dst = F.col("type"), F.col("source_id"), F.col("target_id")
    own = F.broadcast(policies)  # one row a purpose
    graphs = relationships.select(*key).distinct() if key else None

    def by_graph(rows: DataFrame) -> DataFrame:
        return rows.crossJoin(graphs) if key else rows

    chosen = relationships.filter(kind == "Triggering").join(own, (src == F.col("selector")) & (dst == F.col("policy_anchor")))
    seeds = anchors.select(*key, "purpose", "id", F.lit(0).alias("rank"), F.lit("semantic-seed").alias("reason"))
    anchor = by_graph(policies.select("purpose", F.col("policy_anchor").alias("id"), F.lit(1).alias("rank"), F.lit("declared-purpose-policy").alias("reason"))).select(seeds.columns)
    begin = chosen.select(*key, "purpose", src.alias("id"), F.lit(2).alias("rank"), F.lit("archimate-mandatory-dependency").alias("reason"))
    tables = Rounds(relationships.sparkSession)
    start = tables.save(reduce(DataFrame.unionAll, [seeds, anchor, begin]))

    ahead = relationships.select(*key, src.alias("from_id"), dst.alias("to_id"), F.col("id").alias("relationship_id"), kind.isin(FORWARD + BOTH).alias("free"), "type", (~kind.isin(FORWARD + BACKWARD + BOTH)).alias("only_policy"), src.alias("source_id"), dst.alias("target_id"))
    back = relationships.filter(kind.isin(BACKWARD + BOTH) | ((kind == "Triggering") & (src == retrieval))).select(*key, dst.alias("from_id"), src.alias("to_id"), F.col("id").alias("relationship_id"), F.lit(True).alias("free"), "type", F.lit(False).alias("only_policy"), src.alias("source_id"), dst.alias("target_id"))
    steps = ahead.filter("free or only_policy").unionAll(back)
    levels, drawn = [start.withColumn("depth", F.lit(0))], [chosen.select(*key, "purpose", F.col("id").alias("relationship_id"))]
    front = start.select(*key, "purpose", "id").distinct()
    for d in range(1, depth + 1):
        out = front.join(own, "purpose").join(steps.withColumnRenamed("from_id", "id"), [*key, "id"])
        other = (F.col("type") == "Triggering") & (F.col("source_id") == F.col("selector")) & (F.col("target_id") != F.col("policy_anchor"))
        out = out.filter(~other & (F.col("free") | (F.col("to_id") == F.col("policy_anchor"))))
        drawn.append(out.select(*key, "purpose", "relationship_id"))
        why = F.when(F.col("to_id") == F.col("policy_anchor"), "declared-purpose-policy").otherwise("archimate-mandatory-dependency")
        found = out.select(*key, "purpose", F.col("to_id").alias("id"), F.lit(2 + d).alias("rank"), why.alias("reason")).distinct()
        levels.append(found.withColumn("depth", F.lit(d)))
        front = found.select(*key, "purpose", "id").distinct().join(reduce(DataFrame.unionAll, [x.select(*key, "purpose", "id") for x in levels[:-1]]), [*key, "purpose", "id"], "left_anti")
    every = reduce(DataFrame.unionAll, levels)
    nodes = every.groupBy(*key, "purpose", "id").agg(F.min("depth").alias("depth"), F.min_by("reason", F.struct("rank", "reason")).alias("reason"))
    return nodes, reduce(DataFrame.unionAll, drawn).distinct()


def purpose_result(policies: DataFrame, nodes: DataFrame, elements: DataFrame) -> DataFrame:
    """(purpose, policy_id, id, name, type, depth, reason, excluded): a purpose's
    scope with the purposes that it leaves out; an id without an element stands
    for itself."""
    key = shared_key(nodes, elements)
    names = elements.select(*key, "id", "name", "type")
    every = F.array(*map(F.lit, PURPOSES))
    out = nodes.join(F.broadcast(policies), "purpose").join(names, [*key, "id"], "left")
    return out.select(
        *key, "purpose", "policy_id", "id", F.coalesce("name", "id").alias("name"), F.coalesce("type", F.lit("Application Function")).alias("type"), "depth", "reason", F.array_except(every, F.array("purpose")).alias("excluded")
    )


def unauthorised(seeds: DataFrame, canonical: DataFrame) -> DataFrame:
    """(canonical_identity, problem) of seeds that the canonical objects lack or
    have in another version: with one row no seed may be used."""
    on = [*shared_key(seeds, canonical), "canonical_identity"]
    both = seeds.select(*on, "content_version").join(canonical.select(*on, F.col("content_version").alias("now")), on, "left")
    problem = F.when(F.col("now").isNull(), "unknown").when(~F.col("content_version").eqNullSafe(F.col("now")), "version differs")
    return both.select(*on, problem.alias("problem")).filter("problem is not null")


def closure_query(spark: SparkSession, graph: Graph, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """Provenance of the complete answer over existing objects."""
    return provenance(complete(graph, seeds, depth))


def first_per_id(rows: DataFrame, key: str = "id", order: str = "ord") -> DataFrame:
    """The first row of each key (of each graph), rows without a key left out."""
    w = Window.partitionBy(*shared_key(rows), key).orderBy(order)
    return rows.filter(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
