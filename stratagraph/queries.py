"""Queries over the star schema as a graph, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagraph.functions import text as tx
from stratagraph.model import ELEMENT_TYPES
from stratagraph.operators import catalog, closure, delivery, diff, handoff, lifecycle, metrics, mutate, retrieval, scan, traverse, validate, views
from stratagraph.operators import search as ranked
from stratagraph.plans import sqlapi
from stratagraph.plans.fixpoint import Rounds
from stratagraph.sources import star

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    """Register a query under its name; ``sql`` follows the graph's tables."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = f"WITH RECURSIVE {star.SQL.strip()}{sql}" if sql.lstrip().startswith(",") else f"WITH RECURSIVE {star.SQL.strip()}\n{sql}"
        return f

    return add


def _customers(spark, d) -> DataFrame:
    ids = star.table(spark, d, "customer").select(F.concat(F.lit("customer-"), F.col("c_custkey").cast("string")).alias("id"))
    return ids.select(F.col("id").alias("root"), "id")


def _edges(spark, d) -> DataFrame:
    return traverse.semantic_edges(star.links(spark, d))


_REACH = """,
d1 AS (SELECT DISTINCT f.from_id AS root, f.to_id AS id FROM semantic_edges f WHERE f.kind = 'dependency' AND f.from_id LIKE 'customer-%'),
d2 AS (SELECT DISTINCT d1.root, f.to_id AS id FROM d1 JOIN semantic_edges f ON f.from_id = d1.id AND f.kind = 'dependency'),
reach AS (
  SELECT root, id, min(depth) AS depth FROM (
    SELECT 'customer-' || c_custkey AS root, 'customer-' || c_custkey AS id, 0 AS depth FROM customer
    UNION ALL SELECT root, id, 1 FROM d1 UNION ALL SELECT root, id, 2 FROM d2) GROUP BY root, id)"""


@query(_REACH + " SELECT root, id, depth FROM reach")
def ctx_dependency_d2(spark, d):
    return traverse.traverse(_customers(spark, d), _edges(spark, d), 2)


@query(_REACH + " SELECT DISTINCT r.root, e.relationship_id FROM reach r JOIN semantic_edges e ON e.from_id = r.id AND e.kind = 'dependency' WHERE r.depth < 2")
def ctx_dependency_relationships(spark, d):
    edges = _edges(spark, d)
    return traverse.traversed_relationships(traverse.traverse(_customers(spark, d), edges, 2), edges, 2)


@query("""SELECT root, id, min(depth) AS depth FROM (
  SELECT 'region-' || r_regionkey AS root, 'region-' || r_regionkey AS id, 0 AS depth FROM region
  UNION ALL SELECT from_id, to_id, 1 FROM semantic_edges WHERE kind = 'dependent' AND from_id LIKE 'region-%') GROUP BY root, id""")
def ctx_dependent_d1(spark, d):
    starts = star.table(spark, d, "region").select(F.concat(F.lit("region-"), F.col("r_regionkey").cast("string")).alias("id"))
    return traverse.traverse(starts.select(F.col("id").alias("root"), "id"), _edges(spark, d), 1, "dependent")


def _one(spark) -> DataFrame:
    return spark.range(1).select(F.lit("customer-1").alias("root"), F.lit("customer-1").alias("id"))


_CONTEXT = """,
p1 AS (SELECT DISTINCT to_id AS id FROM semantic_edges WHERE from_id = 'customer-1' AND kind = 'dependency'),
p2 AS (SELECT DISTINCT e.to_id AS id FROM p1 JOIN semantic_edges e ON e.from_id = p1.id AND e.kind = 'dependency'),
ctx AS (
  SELECT id, direction, min(depth) AS depth FROM (
    SELECT 'customer-1' AS id, 0 AS depth, unnest(['dependency', 'dependent', 'association']) AS direction
    UNION ALL SELECT id, 1, 'dependency' FROM p1 UNION ALL SELECT id, 2, 'dependency' FROM p2
    UNION ALL SELECT to_id, 1, kind FROM semantic_edges WHERE from_id = 'customer-1' AND kind IN ('dependent', 'association')) GROUP BY id, direction)"""


@query(_CONTEXT + " SELECT 'customer-1' AS root, id, direction, depth FROM ctx")
def ctx_intent(spark, d):
    return traverse.intent_context(_one(spark), _edges(spark, d))[0]


@query(_CONTEXT + """,
inside AS (SELECT DISTINCT id FROM ctx),
near AS (SELECT DISTINCT id, 'dependency' AS direction FROM ctx WHERE direction <> 'dependent' UNION ALL SELECT id, 'dependent' FROM ctx WHERE direction = 'dependent' AND depth >= 1)
SELECT 'customer-1' AS root, n.id, n.direction, count(DISTINCT e.relationship_id) AS remaining, list_sort(list(DISTINCT e.relationship_id)) AS relationship_ids
FROM near n JOIN semantic_edges e ON e.from_id = n.id AND CASE WHEN e.kind = 'dependent' THEN 'dependent' ELSE 'dependency' END = n.direction
WHERE e.to_id NOT IN (SELECT id FROM inside) GROUP BY n.id, n.direction""")
def ctx_boundary(spark, d):
    edges = _edges(spark, d)
    return traverse.boundary(traverse.intent_context(_one(spark), edges)[0], edges)


@query(""",
up AS (SELECT id, parent AS up FROM elements WHERE parent IS NOT NULL UNION SELECT m.element_id, v.parent_element_id FROM view_elements m JOIN views v USING (view_id) WHERE v.parent_element_id IS NOT NULL),
grown AS (SELECT id FROM elements WHERE type = 'Business Role' UNION SELECT up.up FROM grown JOIN up USING (id))
SELECT id FROM grown""")
def view_anchors(spark, d):
    g = star.graph(spark, d)
    return traverse.view_anchors(g.elements.filter("type = 'Business Role'"), g.elements, g.views, g.view_elements).drop("graph_key")


@query(""",
up AS (SELECT DISTINCT from_id AS id, to_id FROM semantic_edges WHERE kind = 'dependency' AND from_id <> to_id),
grown AS (SELECT 'part-1' AS id, 0 AS depth UNION SELECT to_id, depth + 1 FROM grown JOIN up USING (id) WHERE depth < 6)
SELECT 'part-1' AS root, id, min(depth) AS depth FROM grown GROUP BY id""")
def upstream_of_part(spark, d):
    start = spark.range(1).select(F.lit("part-1").alias("root"), F.lit("part-1").alias("id"))
    return traverse.upstream(spark, start, _edges(spark, d))


@query("SELECT e.id, coalesce(p.name || '/', '') || e.name AS path FROM elements e LEFT JOIN elements p ON p.id = e.parent WHERE e.type IN ('Location', 'Grouping')")
def element_paths(spark, d):
    return traverse.paths(star.elements(spark, d).filter("type in ('Location', 'Grouping')").withColumn("parent", F.coalesce("parent", F.lit("")))).drop("graph_key")


@query("SELECT m.view_id, m.ord, m.element_id, e.name, e.type FROM view_elements m JOIN elements e ON e.id = m.element_id")
def view_members(spark, d):
    return views.members(star.graph(spark, d)).drop("graph_key")


@query("""SELECT v.view_id, v.view_name, v.parent_element_id, p.type AS parent_type,
  (SELECT count(*) FROM view_elements m WHERE m.view_id = v.view_id) AS n_elements,
  (SELECT count(*) FROM view_relationships m WHERE m.view_id = v.view_id) AS n_relationships, 0 AS n_missing,
  (SELECT count(*) FROM view_elements m JOIN views c ON c.parent_element_id = m.element_id WHERE m.view_id = v.view_id) AS n_children
FROM views v LEFT JOIN elements p ON p.id = v.parent_element_id""")
def view_context(spark, d):
    out = views.view_context(star.graph(spark, d))
    return out.select("view_id", "view_name", "parent_element_id", "parent_type", "n_elements", "n_relationships", "n_missing", "n_children")


@query(""",
placed AS (SELECT view_id, element_id, row_number() OVER (PARTITION BY view_id ORDER BY ord) - 1 AS i, count(*) OVER (PARTITION BY view_id) AS n FROM view_elements)
SELECT p.view_id, p.element_id AS id, e.name, e.type,
  floor(80 + 160 * cos(2.0 * 3.141592653589793 * i / greatest(n, 1)) + 0.5)::BIGINT AS x, floor(80 + 160 * sin(2.0 * 3.141592653589793 * i / greatest(n, 1)) + 0.5)::BIGINT AS y
FROM placed p JOIN elements e ON e.id = p.element_id""")
def view_graph_layout(spark, d):
    return views.circle_layout(star.graph(spark, d)).drop("graph_key")


@query("SELECT 'element' AS kind, id FROM elements WHERE parent = 'region-1' UNION ALL SELECT 'relationship', id FROM links WHERE source_id IN (SELECT id FROM elements WHERE parent = 'region-1') AND target_id IN (SELECT id FROM elements WHERE parent = 'region-1' OR id = 'region-1') UNION ALL SELECT 'element', 'region-1'")
def subgraph_of_region(spark, d):
    g = star.graph(spark, d)
    ids = g.elements.filter("parent = 'region-1' or id = 'region-1'").select("graph_key", "id")
    s = views.subgraph(g, ids)
    return s.elements.select(F.lit("element").alias("kind"), "id").unionAll(s.relationships.select(F.lit("relationship"), "id"))


# Integrity rules. Faults are planted in the graph, the same way on both sides.


def _faulty(spark, d, named=False):
    """The star graph with links to lost elements, wrong names and repeated ids."""
    from dataclasses import replace

    g = star.graph(spark, d, named=named)
    twice = g.elements.filter("type = 'Grouping'")
    r = g.relationships
    n = F.col("ord") % 97
    r = r.withColumn("target_id", F.when(n == 3, F.lit("lost-1")).otherwise(F.col("target_id")))
    if named:
        r = r.withColumn("source_name", F.when(n == 5, F.lit("wrong")).otherwise(F.col("source_name")))
    return replace(g, elements=g.elements.unionAll(twice), relationships=r)


_FAULTY = """,
faulty AS (SELECT id, ord, type, source_id, CASE WHEN ord % 97 = 3 THEN 'lost-1' ELSE target_id END AS target_id,
  CASE WHEN ord % 97 = 5 THEN 'wrong' ELSE source_name END AS source_name, target_name, statement FROM relationships)"""


@query("SELECT 'duplicate_element' AS rule, 'element' AS kind, id, 'duplicate element id: ' || id AS message FROM elements WHERE type = 'Grouping'")
def rule_duplicate_ids(spark, d):
    return validate.duplicate_ids(_faulty(spark, d))


@query(_FAULTY + " SELECT 'missing_target' AS rule, 'relationship' AS kind, id, 'missing target: lost-1' AS message FROM faulty WHERE target_id = 'lost-1'")
def rule_dangling(spark, d):
    return validate.dangling(_faulty(spark, d))


@query(_FAULTY + " SELECT 'source_name' AS rule, 'relationship' AS kind, f.id, 'source is named ' || e.name AS message FROM faulty f JOIN elements e ON e.id = f.source_id WHERE f.source_name <> e.name")
def rule_names(spark, d):
    from dataclasses import replace

    g = _faulty(spark, d, named=True)
    return validate.name_mismatches(replace(g, elements=star.elements(spark, d))).filter("rule = 'source_name'")


@query(_FAULTY + " SELECT 'statement' AS rule, 'relationship' AS kind, id, 'statement must be ' || source_name || ' --(' || type || ')--> ' || target_name AS message FROM faulty WHERE source_name = 'wrong'")
def rule_statement(spark, d):
    return validate.statements(_faulty(spark, d, named=True))


@query("""SELECT 'orphan_element' AS rule, 'element' AS kind, id, 'in no view' AS message FROM elements WHERE id NOT IN (SELECT element_id FROM view_elements)
UNION ALL SELECT 'orphan_relationship', 'relationship', id, 'in no view' FROM links WHERE id NOT IN (SELECT relationship_id FROM view_relationships)""")
def rule_orphans(spark, d):
    return validate.orphans(star.graph(spark, d))


@query("SELECT 'view_limit' AS rule, 'view' AS kind, view_id AS id, count(*) || ' members, at most 15' AS message FROM view_elements GROUP BY view_id HAVING count(*) > 15")
def rule_view_limit(spark, d):
    return validate.view_limits(star.graph(spark, d))


@query("""SELECT 'target_not_in_view' AS rule, 'view' AS kind, m.view_id AS id, m.relationship_id || ' has no target here' AS message
FROM view_relationships m JOIN links l ON l.id = m.relationship_id WHERE NOT EXISTS (SELECT 1 FROM view_elements e WHERE e.view_id = m.view_id AND e.element_id = l.target_id)""")
def rule_view_members(spark, d):
    return validate.view_members(star.graph(spark, d))


@query(""",
bad AS (SELECT view_id, view_name, ord, CASE WHEN ord % 5 = 1 THEN NULL WHEN ord % 5 = 2 AND ord > 0 THEN 'lost-1' ELSE parent_element_id END AS parent_element_id,
  CASE WHEN ord % 5 = 3 THEN 'wrong' ELSE parent_element_name END AS parent_element_name FROM views)
SELECT 'view_without_parent' AS rule, 'view' AS kind, view_id AS id, 'sub-view without parent' AS message FROM bad WHERE parent_element_id IS NULL AND view_name <> 'SystemArchitecture'
UNION ALL SELECT 'missing_view_parent', 'view', view_id, 'missing parent: lost-1' FROM bad WHERE parent_element_id = 'lost-1'
UNION ALL SELECT 'view_parent_name', 'view', view_id, 'parent is named ' || e.name FROM bad JOIN elements e ON e.id = bad.parent_element_id WHERE parent_element_name = 'wrong'""")
def rule_view_structure(spark, d):
    from dataclasses import replace

    g, n = star.graph(spark, d), F.col("ord") % 5
    parent = F.when(n == 1, F.lit(None)).when((n == 2) & (F.col("ord") > 0), "lost-1").otherwise(F.col("parent_element_id"))
    bad = g.views.withColumn("parent_element_id", parent).withColumn("parent_element_name", F.when(n == 3, "wrong").otherwise(F.col("parent_element_name")))
    return validate.view_structure(replace(g, views=bad))


#: What the star graph's links may join.
ALLOWED = [
    ("Aggregation", "Grouping", "Location"),
    ("Assignment", "Business Actor", "Grouping"),
    ("Assignment", "Business Role", "Grouping"),
    ("Access", "Business Actor", "Business Object"),
    ("Access", "Business Role", "Business Object"),
    ("Serving", "Business Role", "Product"),
]


@query("SELECT 'endpoint_types' AS rule, 'relationship' AS kind, id, 'Serving may not go from Business Role to Business Object' AS message FROM illegal")
def rule_endpoint_matrix(spark, d):
    allowed = spark.createDataFrame(ALLOWED, "rel_type string, src_type string, dst_type string")
    return validate.endpoint_matrix(star.graph(spark, d, illegal=True), allowed)


# Structural SQL.


def _sql(spark, d, text, **args):
    sqlapi.register(star.graph(spark, d))
    return sqlapi.query(spark, text, **args)


@query("SELECT type, count(*) AS n FROM elements GROUP BY type")
def elements_by_type(spark, d):
    return _sql(spark, d, "select type, count(*) as n from elements group by type")


@query("SELECT type, count(*) AS n, count(DISTINCT source_id) AS sources FROM links GROUP BY type")
def edge_counts_by_type(spark, d):
    return _sql(spark, d, "select type, count(*) as n, count(distinct source_id) as sources from relationships group by type")


@query("SELECT from_id, count(*) AS degree FROM semantic_edges GROUP BY from_id ORDER BY degree DESC, from_id LIMIT 20")
def degree_topk(spark, d):
    return _sql(spark, d, "select from_id, count(*) as degree from semantic_edges group by from_id order by degree desc, from_id limit :k", k=20)


@query("SELECT DISTINCT a.from_id AS nation, b.to_id AS part FROM semantic_edges a JOIN semantic_edges b ON b.from_id = a.to_id WHERE a.from_id LIKE 'nation-%' AND a.to_id LIKE 'supplier-%' AND b.to_id LIKE 'part-%'")
def path_two_hops(spark, d):
    # Pairs are dealt before they are made distinct and links pass by hashed suppliers, so no task sorts or holds most links.
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pairs = f"select /*+ shuffle_hash(a), repartition({n}, nation, part) */ a.from_id as nation, b.to_id as part from semantic_edges a join semantic_edges b on b.from_id = a.to_id where a.from_id like 'nation-%' and a.to_id like 'supplier-%' and b.to_id like 'part-%'"
    return _sql(spark, d, f"select distinct nation, part from ({pairs})")


@query("SELECT 'star' AS graph_key, (SELECT count(*) FROM elements) AS elements, (SELECT count(*) FROM links) AS relationships, (SELECT count(*) FROM views) AS views")
def projection_counts(spark, d):
    return lifecycle.counts(star.graph(spark, d))


@query("SELECT 'element' AS kind, id, 'expected' AS side FROM elements WHERE ord % 10 = 0")
def projection_verify(spark, d):
    from dataclasses import replace

    g = star.graph(spark, d)
    return lifecycle.verify_projection(g, replace(g, elements=g.elements.filter("ord % 10 <> 0"))).drop("graph_key")


# Vectors. The query vector is that of the first record.


def _first_vector(records: DataFrame) -> list[float]:
    return records.filter("ord = 0").select("vector").first()["vector"]


_SCORED = """,
q AS (SELECT vector AS v FROM records WHERE ord = 0),
scored AS (SELECT r.channel, r.canonical_identity, r.ord, r.label, list_inner_product(r.vector, q.v) / (sqrt(list_inner_product(r.vector, r.vector)) * sqrt(list_inner_product(q.v, q.v))) AS score FROM records r, q)"""
_LOW = {"Element": 0.2, "ArchitectureRelationship": 0.15, "View": 0.1}


@query(_SCORED + """ SELECT canonical_identity, channel, round(score, 6) AS score FROM scored
WHERE score >= CASE channel WHEN 'Element' THEN 0.2 WHEN 'ArchitectureRelationship' THEN 0.15 ELSE 0.1 END""")
def seeds_threshold_all(spark, d):
    r = star.semantic_records(spark, d)
    return retrieval.threshold_all(r, _first_vector(r), _LOW).select("canonical_identity", "channel", F.round("score", 6).alias("score"))


@query(_SCORED + " SELECT canonical_identity, channel, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY score DESC, ord)::INTEGER AS rank FROM scored) WHERE rank <= 5")
def seeds_topk_per_channel(spark, d):
    r = star.semantic_records(spark, d)
    return retrieval.top_per_channel(r, _first_vector(r), 5).select("canonical_identity", "channel", F.round("score", 6).alias("score"), "rank")


@query("SELECT canonical_identity, ord % 7 <> 0 AS found FROM records WHERE ord % 3 = 0")
def touched_queryable(spark, d):
    r = star.semantic_records(spark, d)
    return retrieval.queryable(r.filter("ord % 7 <> 0"), r.filter("ord % 3 = 0"))


# Closure and provenance, from seeds: suppliers, one link and one view.

_CLOSURE = """,
pe AS (
  SELECT source_id AS from_id, target_id AS to_id, id AS relationship_id FROM links WHERE type IN ('Triggering', 'Access', 'Association')
  UNION ALL SELECT target_id, source_id, id FROM links WHERE type IN ('Serving', 'Realization', 'Assignment', 'Association')),
c0 AS (SELECT id FROM elements WHERE id IN ('customer-1', 'nation-3')),
c1 AS (SELECT DISTINCT to_id AS id FROM c0 JOIN pe ON from_id = c0.id),
c2 AS (SELECT DISTINCT to_id AS id FROM c1 JOIN pe ON from_id = c1.id),
reached AS (SELECT id, min(depth) AS depth FROM (SELECT id, 0 AS depth FROM c0 UNION ALL SELECT id, 1 FROM c1 UNION ALL SELECT id, 2 FROM c2) GROUP BY id),
rels AS (SELECT DISTINCT relationship_id FROM pe JOIN reached ON from_id = id WHERE depth < 2)"""


@query(_CLOSURE + " SELECT id, depth FROM reached")
def policy_closure(spark, d):
    g = star.graph(spark, d)
    return closure.policy_closure(g.elements.filter("id in ('customer-1', 'nation-3')").select("graph_key", "id"), star.links(spark, d))[0].drop("graph_key")


@query(_FAULTY + " SELECT id, 'target' AS missing_end FROM faulty WHERE target_id = 'lost-1'")
def endpoint_closure(spark, d):
    g = _faulty(spark, d)
    return closure.endpoint_closure(g.relationships, star.elements(spark, d))[1].drop("graph_key")


@query(_CLOSURE + """,
why AS (
  SELECT 'Element' AS kind, id, 0 AS step, 'semantic-seed' AS reason FROM c0 UNION SELECT 'View', 'view-region-1', 0, 'semantic-seed'
  UNION SELECT 'Element', id, 1, 'policy-closure' FROM reached UNION SELECT 'ArchitectureRelationship', relationship_id, 1, 'policy-closure' FROM rels
  UNION SELECT 'Element', unnest([source_id, target_id]), 2, 'relationship-endpoint' FROM links WHERE id IN (SELECT relationship_id FROM rels)
  UNION SELECT 'Element', element_id, 3, 'complete-view' FROM view_elements WHERE view_id = 'view-region-1'
  UNION SELECT 'ArchitectureRelationship', relationship_id, 3, 'complete-view' FROM view_relationships WHERE view_id = 'view-region-1')
SELECT kind, id, list(reason ORDER BY step, reason)[1] AS first_reason, list(reason ORDER BY step, reason)[2:] AS supplementary FROM why GROUP BY kind, id""")
def provenance_first_reason(spark, d):
    g = star.graph(spark, d)
    seeds = g.elements.filter("id in ('customer-1', 'nation-3')").select(F.lit("Element").alias("kind"), "id").unionAll(spark.range(1).select(F.lit("View"), F.lit("view-region-1")))
    return closure.closure_query(spark, g, seeds)


@query("SELECT 'SEMANTIC_SUBSET_VIEW_MISSING' AS error, 'view-region-1' AS id UNION ALL SELECT 'SEMANTIC_SUBSET_RELATIONSHIP_MISSING', 'na-3'")
def subset_fail_closed(spark, d):
    ids = spark.createDataFrame([("View:view-region-1",), ("Element:nation-3",), ("ArchitectureRelationship:na-3",), ("Element:unknown",)], "qualified_id string")
    return closure.subset(star.graph(spark, d), closure.qualified(ids))[1]


@query("SELECT 'Element' AS kind, 'nation-3' AS id UNION ALL SELECT 'Element', 'region-' || n_regionkey FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 'ArchitectureRelationship', 'na-3'")
def subset_whole(spark, d):
    region = star.table(spark, d, "nation").filter("n_nationkey = 3").select(F.concat(F.lit("Element:region-"), F.col("n_regionkey").cast("string")).alias("qualified_id"))
    ids = spark.createDataFrame([("Element:nation-3",), ("ArchitectureRelationship:na-3",), ("Element:unknown",)], "qualified_id string").unionAll(region)
    return closure.subset(star.graph(spark, d), closure.qualified(ids))[0]


# Versions: after has other customers' segments, no supplier 7, and a new part.


def _after(spark, d):
    e = star.elements(spark, d)
    change = F.when((F.col("type") == "Business Actor") & (F.col("ord") % 11 == 0), F.lit("CHANGED")).otherwise(F.col("description"))
    new = spark.range(1).select(F.lit(star.KEY).alias("graph_key"), F.lit(-1).cast("long").alias("ord"), F.lit("part-new").alias("id"), F.lit("new part").alias("name"), F.lit("Product").alias("type"), F.lit(None).cast("string").alias("parent"), F.lit("").alias("description"))
    return e.filter("not (type = 'Business Role' and ord % 7 = 0)").withColumn("description", change).unionAll(new)


_DIFF = """,
changes AS (
  SELECT id, 'affected' AS status, type, name FROM elements WHERE type = 'Business Actor' AND ord % 11 = 0
  UNION ALL SELECT id, 'removed', type, name FROM elements WHERE type = 'Business Role' AND ord % 7 = 0
  UNION ALL SELECT 'part-new', 'added', 'Product', 'new part')"""


@query(_DIFF + " SELECT id, status, type, name FROM changes")
def graph_diff(spark, d):
    return diff.diff(star.elements(spark, d), _after(spark, d)).drop("graph_key")


@query(_DIFF + " SELECT greatest((SELECT 1.5 * count(*) FROM changes), (SELECT sum(CASE type WHEN 'Assignment' THEN 3 ELSE 1.5 END) FROM links WHERE ord % 101 = 0), 1.5)::DOUBLE AS total_g")
def diff_size(spark, d):
    changes = diff.diff(star.elements(spark, d), _after(spark, d))
    rels = star.links(spark, d).filter("ord % 101 = 0").filter("type <> 'Association'")
    more = star.links(spark, d).filter("ord % 101 = 0").filter("type = 'Association'").withColumn("type", F.lit("Flow"))
    return diff.total_size(changes, rels.unionAll(more))


@query(_DIFF + """,
l AS (SELECT * FROM links WHERE source_id IN (SELECT id FROM changes) AND target_id IN (SELECT id FROM changes))
SELECT (SELECT min(id) FROM changes) AS parent, id AS child, 'impact' AS label FROM changes WHERE id <> (SELECT min(id) FROM changes)""")
def diff_tree(spark, d):
    return diff.tree_edges(diff.diff(star.elements(spark, d), _after(spark, d)), star.links(spark, d)).drop("graph_key")


@query(""",
failed AS (SELECT element_id AS id FROM results GROUP BY element_id HAVING NOT bool_and(passed)),
dep AS (SELECT DISTINCT from_id, to_id FROM semantic_edges WHERE kind = 'dependency' AND from_id <> to_id AND from_id IN (SELECT element_id FROM results) AND to_id IN (SELECT element_id FROM results)),
bad AS (SELECT id FROM failed UNION SELECT dep.from_id FROM bad JOIN dep ON dep.to_id = bad.id)
SELECT DISTINCT element_id, CASE WHEN element_id IN (SELECT id FROM bad) THEN 'not_delivered' ELSE 'delivered' END AS status FROM results""")
def delivery_status(spark, d):
    return delivery.delivery_status(spark, star.results(spark, d), _edges(spark, d))


@query("SELECT count(*) AS total, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed, count(*) FILTER (passed IS NULL) AS missing FROM results")
def test_summary(spark, d):
    return delivery.run_summary(star.results(spark, d))


# Text.


@query(""",
s AS (
  SELECT 'element' AS kind, id, name, type, ord, 0 AS rank, greatest(
    CASE WHEN lower(name) = 'order-1' THEN 100.0 WHEN starts_with(lower(name), 'order-1') THEN 50 WHEN contains(lower(name), 'order-1') THEN 20 ELSE 0 END,
    CASE WHEN lower(id) = 'order-1' THEN 100.0 WHEN starts_with(lower(id), 'order-1') THEN 50 WHEN contains(lower(id), 'order-1') THEN 20 ELSE 0 END,
    CASE WHEN contains(lower(type), 'order-1') THEN 10.0 ELSE 0 END, CASE WHEN contains(lower(description), 'order-1') THEN 10.0 ELSE 0 END) AS score FROM elements
  UNION ALL SELECT 'relationship', id, name, type, ord, 1, CASE WHEN starts_with(lower(statement), 'order-1') THEN 25.0 WHEN contains(lower(statement), 'order-1') THEN 10.0 ELSE 0 END FROM relationships)
SELECT kind, id, name, type, score::DOUBLE AS score FROM s WHERE score > 0 ORDER BY s.score DESC, rank, ord, id LIMIT 50""")
def search_local(spark, d):
    return ranked.search(star.graph(spark, d, named=True), " Order-1 ")


@query("""SELECT doc_id, CASE WHEN length(t) <= 180 THEN t ELSE substr(t, 1, 177) || '...' END AS summary
FROM (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[\\s\\x{00A0}\\x{3000}]+', ' ', 'g'), ' ') AS t FROM documents)""")
def summarize_text(spark, d):
    return star.table(spark, d, "documents").select("doc_id", tx.summarize(F.col("text")).alias("summary"))


@query("""SELECT doc_id, type FROM (
  SELECT doc_id, unnest(list_filter([
    CASE WHEN regexp_matches(text, '(^|[^A-Za-z0-9_])(sk|pk|AKIA|ASIA|ghp|gho|ghu|ghs|ghr|xox[baprs]|eyJ)[-_A-Za-z0-9]{8,}') THEN 'credential_value' END,
    CASE WHEN regexp_matches(text, '[A-Za-z]:[\\\\/]|\\\\\\\\[A-Za-z0-9._-]+\\\\|(^|[^A-Za-z0-9_])/(home|usr|opt|etc|var|root|tmp|srv|mnt|media|proc|sys|data|apps|projects)/|\\$[A-Z_][A-Z0-9_]*|%[A-Z_][A-Z0-9_]*%|~[/\\\\]|(^|[^A-Za-z0-9_])/c/') THEN 'path' END,
    CASE WHEN regexp_matches(text, '(^|[^A-Za-z0-9_])[0-9a-f]{40}($|[^A-Za-z0-9_])') THEN 'git_hash' END,
    CASE WHEN regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}') THEN 'email' END,
    CASE WHEN regexp_matches(text, '(^|[^A-Za-z0-9_])[0-9]{11}($|[^A-Za-z0-9_])') THEN 'phone' END], lambda x: x IS NOT NULL)) AS type FROM documents)""")
def sensitive_scan(spark, d):
    fields = star.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.lit("text").alias("key"), F.col("text").alias("value"))
    return scan.sensitive(fields).select(F.col("path").cast("long").alias("doc_id"), "type")


@query("SELECT id, CASE WHEN type LIKE 'Business%' OR type = 'Product' THEN 'Business' ELSE 'Other' END AS layer, CASE WHEN length(name) <= 4 THEN '****' ELSE substr(name, 1, 4) || '****' END AS masked FROM elements")
def element_labels(spark, d):
    e = star.elements(spark, d)
    kind = tx.canonical_type(F.concat(F.lit("ArchiMate_"), F.regexp_replace("type", " ", "")), ELEMENT_TYPES, "Grouping")
    return e.select("id", tx.layer_of(kind).alias("layer"), tx.mask(F.col("name")).alias("masked"))


# Retrieval quality: labels are purposes, multiples of 5 seeds, of 3 closure.


@query(""",
m AS (SELECT label::VARCHAR AS purpose, count(*) FILTER (ord % 5 = 0) AS mandatory, count(*) FILTER (ord % 5 = 0 AND ord % 4 <> 1) AS hits,
    count(*) FILTER (ord % 3 = 0 AND ord % 4 = 1) = 0 AS closure_ok, count(*) FILTER (ord % 4 <> 1 AND ord % 50 = 7) AS forced_hits,
    count(*) FILTER (ord % 4 <> 1 AND (ord % 5 = 0 OR ord % 3 = 0)) / count(*) FILTER (ord % 4 <> 1) AS precision FROM records GROUP BY label)
SELECT purpose, mandatory, hits, closure_ok, forced_hits, round(precision, 6) AS precision FROM m""")
def quality_metrics(spark, d):
    return _quality(spark, d).withColumn("precision", F.round("precision", 6))


def _quality(spark, d):
    r = star.semantic_records(spark, d).select(F.col("label").cast("string").alias("purpose"), F.col("canonical_identity").alias("id"), "ord")
    expected = r.filter("ord % 5 = 0").withColumn("role", F.lit("seed")).unionAll(r.filter("ord % 3 = 0").withColumn("role", F.lit("closure"))).drop("ord")
    observed = r.filter("ord % 4 <> 1").select("purpose", "id", (F.col("ord") % 50 == 7).alias("forced"))
    return metrics.purpose_metrics(expected, observed)


@query(""",
m AS (SELECT label, count(*) FILTER (ord % 5 = 0) AS mandatory, count(*) FILTER (ord % 5 = 0 AND ord % 4 <> 1) AS hits,
    (count(*) FILTER (ord % 3 = 0 AND ord % 4 = 1) = 0)::INTEGER AS closure_ok, count(*) FILTER (ord % 4 <> 1 AND ord % 50 = 7) AS forced_hits,
    count(*) FILTER (ord % 4 <> 1 AND (ord % 5 = 0 OR ord % 3 = 0)) / count(*) FILTER (ord % 4 <> 1) AS precision FROM records GROUP BY label)
SELECT round(sum(hits) / sum(mandatory), 6) AS recall, round(avg(closure_ok), 6) AS closure_correctness, sum(forced_hits)::BIGINT AS forced_hits, round(avg(precision), 6) AS precision, false AS passed FROM m""")
def quality_gate(spark, d):
    out = metrics.quality_gate(_quality(spark, d))
    return out.select(*[F.round(c, 6).alias(c) if c in ("recall", "closure_correctness", "precision") else F.col(c) for c in out.columns])


# Changes. Events are a log over customers: user, time order, five types.


def _log(spark, d):
    kind = F.element_at(F.array(F.lit("add"), F.lit("update"), F.lit("update"), F.lit("update"), F.lit("remove")), (F.pmod(F.col("event_id"), F.lit(5)) + 1).cast("int"))
    e = star.table(spark, d, "events")
    return e.select(F.col("event_id").alias("seq"), kind.alias("type"), F.concat(F.lit("customer-"), (F.col("user_id") * 7).cast("string")).alias("id"), F.concat(F.lit("name "), F.col("event_id").cast("string")).alias("name"), F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("description"))


@query(""",
log AS (SELECT event_id AS seq, ['add', 'update', 'update', 'update', 'remove'][event_id % 5 + 1] AS type, 'customer-' || user_id * 7 AS id, 'name ' || event_id AS name, CASE WHEN event_id % 2 = 0 THEN event_type END AS description FROM events),
cut AS (SELECT id, max(seq) FILTER (type = 'remove') AS cut FROM log GROUP BY id),
live AS (SELECT log.* FROM log JOIN cut USING (id) WHERE type <> 'remove' AND (cut IS NULL OR seq > cut)),
st AS (SELECT c.id, c.cut, bool_or(l.type = 'add') AS added, arg_max(l.name, l.seq) AS name, arg_max(l.description, l.seq) FILTER (l.description IS NOT NULL) AS description FROM cut c LEFT JOIN live l USING (id) GROUP BY c.id, c.cut),
base AS (SELECT id, name, description FROM elements WHERE type = 'Business Actor')
SELECT b.id, coalesce(st.name, b.name) AS name, coalesce(st.description, b.description) AS description FROM base b LEFT JOIN st USING (id) WHERE st.cut IS NULL
UNION ALL SELECT st.id, st.name, st.description FROM st LEFT JOIN base b USING (id) WHERE coalesce(st.added, false) AND (b.id IS NULL OR st.cut IS NOT NULL)""")
def mutation_apply_batch(spark, d):
    base = star.elements(spark, d).filter("type = 'Business Actor'").select("id", "name", "description")
    return mutate.apply_log(base, _log(spark, d), ["name", "description"])


@query(""",
gone AS (SELECT id FROM elements WHERE id IN ('supplier-1', 'supplier-2', 'customer-5', 'nation-1') AND id NOT IN (SELECT parent_element_id FROM views WHERE parent_element_id IS NOT NULL))
SELECT 'element' AS kind, id FROM elements WHERE id NOT IN (SELECT id FROM gone) AND type LIKE 'Business%'
UNION ALL SELECT 'relationship', id FROM links WHERE type = 'Assignment' AND source_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'refused', 'nation-1'""")
def remove_elements(spark, d):
    g = star.graph(spark, d)
    out, refused = mutate.remove_elements(g, g.elements.filter("id in ('supplier-1', 'supplier-2', 'customer-5', 'nation-1')").select("graph_key", "id"))
    e = out.elements.filter("type like 'Business%'").select(F.lit("element").alias("kind"), "id")
    return e.unionAll(out.relationships.filter("type = 'Assignment'").select(F.lit("relationship"), "id")).unionAll(refused.select(F.lit("refused"), "id"))


@query(""",
left_ AS (SELECT * FROM view_relationships WHERE relationship_id NOT LIKE 'ca-%0'),
was AS (SELECT DISTINCT m.view_id, unnest([l.source_id, l.target_id]) AS element_id FROM view_relationships m JOIN links l ON l.id = m.relationship_id WHERE m.relationship_id LIKE 'ca-%0'),
used AS (SELECT DISTINCT m.view_id, unnest([l.source_id, l.target_id]) AS element_id FROM left_ m JOIN links l ON l.id = m.relationship_id)
SELECT view_id, element_id FROM view_elements v WHERE NOT EXISTS (SELECT 1 FROM was w WHERE w.view_id = v.view_id AND w.element_id = v.element_id AND NOT EXISTS (SELECT 1 FROM used u WHERE u.view_id = w.view_id AND u.element_id = w.element_id))""")
def remove_relationships(spark, d):
    g = star.graph(spark, d)
    return mutate.remove_relationships(g, g.relationships.filter("id like 'ca-%0'").select("graph_key", "id")).view_elements.select("view_id", "element_id")


@query("SELECT parent_element_id AS id, count(*) AS n FROM views WHERE parent_element_id IS NOT NULL AND ord % 3 <> 0 GROUP BY parent_element_id")
def subdiagram_repair(spark, d):
    v = star.views(spark, d)
    kept = mutate.subdiagrams(v.filter("ord % 3 = 0")).drop("graph_key")
    e = star.elements(spark, d).filter("type in ('Location', 'Grouping')").select("id").join(kept, "id", "left")
    return mutate.subdiagram_repairs(e, v.drop("graph_key")).select("id", F.size("wanted").cast("long").alias("n"))


# Index upkeep: the index lacks every fifth part and has stale and extra rows.


def _index(spark, d):
    # Digests are long, so both sides are dealt by short numbers before they are made.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    want = lifecycle.identities(star.graph(spark, d, named=True, dealt=tasks)).drop("graph_key")
    n = F.pmod(F.crc32(F.col("canonical_identity").cast("binary")), F.lit(10))
    have = want.filter(n != 0).withColumn("content_version", F.when(n == 1, F.lit("old")).otherwise(F.col("content_version")))
    extra = spark.createDataFrame([(-1, "Element:gone", "Element", "x")], "place long, canonical_identity string, channel string, content_version string").repartition(tasks, "place")
    return want, have.unionByName(extra)


_IDENTITIES = """,
ids AS (SELECT 'Element' AS channel, 'Element:' || id AS canonical_identity FROM elements
  UNION ALL SELECT 'ArchitectureRelationship', 'ArchitectureRelationship:' || id FROM links UNION ALL SELECT 'View', 'View:' || view_id FROM views),
table32 AS (SELECT i, list_reduce([i] || range(8), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS t FROM (SELECT unnest(range(256)) AS i)),
steps AS (SELECT list(t ORDER BY i) AS t FROM table32),
numbered AS (SELECT channel, canonical_identity, xor(list_reduce([4294967295] || list_transform(range(1, length(canonical_identity) + 1), lambda k: ascii(substr(canonical_identity, k, 1))::BIGINT),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10 AS n FROM ids, steps)"""


@query(_IDENTITIES + " SELECT canonical_identity, channel FROM numbered WHERE n < 2")
def backfill_pending(spark, d):
    want, have = _index(spark, d)
    return Rounds(spark).save_dealt(lifecycle.pending(want, have).select("canonical_identity", "channel"))


@query(_IDENTITIES + " SELECT canonical_identity, 'upsert' AS action FROM numbered WHERE n < 2 UNION ALL SELECT 'Element:gone', 'tombstone'")
def reconcile_delta(spark, d):
    want, have = _index(spark, d)
    return Rounds(spark).save_dealt(lifecycle.reconcile(want, have).drop("place"))


@query(""",
w AS (SELECT 'Element' AS channel, vec_id FROM embeddings)
SELECT channel, count(*) AS expected, count(*) FILTER (vec_id % 4 > 1) AS current, count(*) FILTER (vec_id % 4 = 1) AS stale, count(*) FILTER (vec_id % 4 = 0) AS missing, 0 AS extra, 'SemanticIndexPending' AS state FROM w GROUP BY channel""")
def readiness_alignment(spark, d):
    r = star.table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("canonical_identity"), F.lit("Element").alias("channel"), F.col("vec_id"), F.lit("v1").alias("content_version"))
    have = r.filter("vec_id % 4 <> 0").withColumn("content_version", F.when(F.col("vec_id") % 4 == 1, "v0").otherwise("v1"))
    return lifecycle.readiness(r.drop("vec_id"), have.drop("vec_id"))


@query(""",
ids AS (SELECT 'elements' AS kind, id FROM elements UNION ALL SELECT 'relationships', id FROM links UNION ALL SELECT 'views', view_id FROM views),
item AS (SELECT kind, id, count(*) AS n, sha256(id)[1:4] AS part FROM ids GROUP BY kind, id),
fine AS (SELECT part, sha256('[' || string_agg('{"kind":"' || kind || '","id":"' || id || '","n":' || n || '}', ',' ORDER BY kind, id) || ']') AS sha FROM item GROUP BY part),
coarse AS (SELECT part[1:2] AS part, sha256('[' || string_agg('{"part":"' || part || '","sha":"' || sha || '"}', ',' ORDER BY part) || ']') AS sha FROM fine GROUP BY part[1:2])
SELECT 'star' AS graph_key, 'canonical:' || sha256('{"name":"System","parts":[' || string_agg('{"part":"' || part || '","sha":"' || sha || '"}', ',' ORDER BY part) || ']}') AS canonical_version FROM coarse""")
def canonical_version(spark, d):
    return lifecycle.canonical_version(star.graph(spark, d))


# Whole tables: every customer's context, every part's upstream, every record.


_ALL_CONTEXT = """,
s AS (SELECT 'customer-' || c_custkey AS root FROM customer),
p1 AS (SELECT DISTINCT s.root, e.to_id AS id FROM s JOIN semantic_edges e ON e.from_id = s.root AND e.kind = 'dependency'),
p2 AS (SELECT DISTINCT p1.root, e.to_id AS id FROM p1 JOIN semantic_edges e ON e.from_id = p1.id AND e.kind = 'dependency'),
ctx AS (
  SELECT root, id, direction, min(depth) AS depth FROM (
    SELECT root, root AS id, 0 AS depth, unnest(['dependency', 'dependent', 'association']) AS direction FROM s
    UNION ALL SELECT root, id, 1, 'dependency' FROM p1 UNION ALL SELECT root, id, 2, 'dependency' FROM p2
    UNION ALL SELECT s.root, e.to_id, 1, e.kind FROM s JOIN semantic_edges e ON e.from_id = s.root WHERE e.kind IN ('dependent', 'association')) GROUP BY root, id, direction)"""


@query(_ALL_CONTEXT + " SELECT root, id, direction, depth FROM ctx")
def ctx_intent_all(spark, d):
    return traverse.intent_context(_customers(spark, d), _edges(spark, d))[0]


@query(_ALL_CONTEXT + """,
near AS (SELECT DISTINCT root, id, 'dependency' AS direction FROM ctx WHERE direction <> 'dependent' UNION ALL SELECT root, id, 'dependent' FROM ctx WHERE direction = 'dependent' AND depth >= 1)
SELECT n.root, n.id, n.direction, count(DISTINCT e.relationship_id) AS remaining, list_sort(list(DISTINCT e.relationship_id)) AS relationship_ids
FROM near n JOIN semantic_edges e ON e.from_id = n.id AND CASE WHEN e.kind = 'dependent' THEN 'dependent' ELSE 'dependency' END = n.direction
WHERE NOT EXISTS (SELECT 1 FROM ctx c WHERE c.root = n.root AND c.id = e.to_id) GROUP BY n.root, n.id, n.direction""")
def ctx_boundary_all(spark, d):
    edges = _edges(spark, d)
    return traverse.boundary(traverse.intent_context(_customers(spark, d), edges)[0], edges)


@query(""",
up AS (SELECT DISTINCT from_id AS id, to_id FROM semantic_edges WHERE kind = 'dependency' AND from_id <> to_id),
grown AS (SELECT 'part-' || p_partkey AS root, 'part-' || p_partkey AS id, 0 AS depth FROM part UNION SELECT root, to_id, depth + 1 FROM grown JOIN up USING (id) WHERE depth < 6)
SELECT root, id, min(depth) AS depth FROM grown GROUP BY root, id""")
def upstream_of_parts(spark, d):
    ids = star.table(spark, d, "part").select(F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("id"))
    return traverse.upstream(spark, ids.select(F.col("id").alias("root"), "id"), _edges(spark, d))


@query("SELECT canonical_identity, ord % 7 <> 0 AS found FROM records")
def touched_queryable_all(spark, d):
    r = star.semantic_records(spark, d)
    return retrieval.queryable(r.filter("ord % 7 <> 0"), r)


# Two graphs that share all ids. In the second, links of customers and suppliers
# are associations, orders hang from no customer, and views are other.


def _second(spark, d):
    g = star.graph(spark, d)
    keyed = lambda t: t.withColumn("graph_key", F.lit("second"))
    kind = F.when(F.col("type") == "Assignment", "Association").otherwise(F.col("type"))
    rels = g.relationships.filter("type <> 'Access'").withColumn("type", kind)
    return type(g)(keyed(g.elements.filter("type <> 'Product'")), keyed(rels), keyed(g.views), keyed(g.view_elements.filter("view_id <> 'view-root'")), keyed(g.view_relationships))


def _both(spark, d):
    a, b = star.graph(spark, d), _second(spark, d)
    return type(a)(*(getattr(a, t).unionByName(getattr(b, t)) for t in ("elements", "relationships", "views", "view_elements", "view_relationships")))


_TWO = """,
rels2 AS (
  SELECT 'star' AS graph_key, id, ord, type, source_id, target_id FROM links
  UNION ALL SELECT 'second', id, ord, CASE type WHEN 'Assignment' THEN 'Association' ELSE type END, source_id, target_id FROM links WHERE type <> 'Access'),
elements2 AS (SELECT 'star' AS graph_key, * FROM elements UNION ALL SELECT 'second', * FROM elements WHERE type <> 'Product'),
views2 AS (SELECT unnest(['star', 'second']) AS graph_key, * FROM views),
members2 AS (SELECT 'star' AS graph_key, * FROM view_elements UNION ALL SELECT 'second', * FROM view_elements WHERE view_id <> 'view-root'),
drawn2 AS (SELECT unnest(['star', 'second']) AS graph_key, * FROM view_relationships),
dep2 AS (
  SELECT graph_key, source_id AS from_id, target_id AS to_id, id FROM rels2 WHERE type IN ('Access', 'Assignment', 'Specialization', 'Composition', 'Aggregation')
  UNION ALL SELECT graph_key, target_id, source_id, id FROM rels2 WHERE type IN ('Serving', 'Realization', 'Flow', 'Triggering', 'Influence'))"""


@query(_TWO + """,
r0 AS (SELECT graph_key, id AS root, id, 0 AS depth FROM elements2 WHERE type = 'Business Actor'),
r1 AS (SELECT DISTINCT r.graph_key, r.root, e.to_id AS id, 1 AS depth FROM r0 r JOIN dep2 e ON e.graph_key = r.graph_key AND e.from_id = r.id),
r2 AS (SELECT DISTINCT r.graph_key, r.root, e.to_id AS id, 2 AS depth FROM r1 r JOIN dep2 e ON e.graph_key = r.graph_key AND e.from_id = r.id)
SELECT graph_key, root, id, min(depth) AS depth FROM (SELECT * FROM r0 UNION ALL SELECT * FROM r1 UNION ALL SELECT * FROM r2) GROUP BY graph_key, root, id""")
def two_graphs_context(spark, d):
    g = _both(spark, d)
    starts = g.elements.filter("type = 'Business Actor'").select("graph_key", F.col("id").alias("root"), "id")
    return traverse.traverse(starts, traverse.semantic_edges(g.relationships), 2)


@query(_TWO + """
SELECT v.graph_key, v.view_id, v.view_name, v.parent_element_id, p.type AS parent_type,
  (SELECT count(*) FROM members2 m JOIN elements2 e ON e.graph_key = m.graph_key AND e.id = m.element_id WHERE m.graph_key = v.graph_key AND m.view_id = v.view_id) AS n_elements,
  (SELECT count(*) FROM drawn2 m JOIN rels2 r ON r.graph_key = m.graph_key AND r.id = m.relationship_id WHERE m.graph_key = v.graph_key AND m.view_id = v.view_id) AS n_relationships,
  (SELECT count(*) FROM members2 m JOIN views2 c ON c.graph_key = m.graph_key AND c.parent_element_id = m.element_id WHERE m.graph_key = v.graph_key AND m.view_id = v.view_id) AS n_children
FROM views2 v LEFT JOIN elements2 p ON p.graph_key = v.graph_key AND p.id = v.parent_element_id""")
def two_graphs_views(spark, d):
    return views.view_context(_both(spark, d)).drop("n_missing")


@query(_TWO + """,
pe2 AS (
  SELECT graph_key, source_id AS from_id, target_id AS to_id FROM rels2 WHERE type IN ('Triggering', 'Access', 'Association')
  UNION ALL SELECT graph_key, target_id, source_id FROM rels2 WHERE type IN ('Serving', 'Realization', 'Assignment', 'Association')),
c0 AS (SELECT graph_key, id FROM elements2 WHERE id IN ('customer-1', 'nation-3')),
c1 AS (SELECT DISTINCT c.graph_key, to_id AS id FROM c0 c JOIN pe2 ON pe2.graph_key = c.graph_key AND from_id = c.id),
c2 AS (SELECT DISTINCT c.graph_key, to_id AS id FROM c1 c JOIN pe2 ON pe2.graph_key = c.graph_key AND from_id = c.id)
SELECT graph_key, id, min(depth) AS depth FROM (SELECT *, 0 AS depth FROM c0 UNION ALL SELECT *, 1 FROM c1 UNION ALL SELECT *, 2 FROM c2) GROUP BY graph_key, id""")
def two_graphs_closure(spark, d):
    g = _both(spark, d)
    return closure.policy_closure(g.elements.filter("id in ('customer-1', 'nation-3')").select("graph_key", "id"), g.relationships)[0]


@query(_TWO + """,
hit AS (SELECT graph_key, id FROM rels2 WHERE id LIKE 'ca-%0' AND graph_key = 'second'),
ends AS (SELECT graph_key, id, unnest([source_id, target_id]) AS element_id FROM rels2),
was AS (SELECT DISTINCT m.graph_key, m.view_id, e.element_id FROM drawn2 m JOIN hit ON hit.graph_key = m.graph_key AND hit.id = m.relationship_id JOIN ends e ON e.graph_key = m.graph_key AND e.id = m.relationship_id),
used AS (SELECT DISTINCT m.graph_key, m.view_id, e.element_id FROM drawn2 m JOIN ends e ON e.graph_key = m.graph_key AND e.id = m.relationship_id WHERE NOT EXISTS (SELECT 1 FROM hit WHERE hit.graph_key = m.graph_key AND hit.id = m.relationship_id))
SELECT graph_key, view_id, element_id FROM members2 v WHERE NOT EXISTS (
  SELECT 1 FROM was w WHERE w.graph_key = v.graph_key AND w.view_id = v.view_id AND w.element_id = v.element_id
  AND NOT EXISTS (SELECT 1 FROM used u WHERE u.graph_key = w.graph_key AND u.view_id = w.view_id AND u.element_id = w.element_id))""")
def two_graphs_removal(spark, d):
    g = _both(spark, d)
    ids = g.relationships.filter("id like 'ca-%0' and graph_key = 'second'").select("graph_key", "id")
    return mutate.remove_relationships(g, ids).view_elements.select("graph_key", "view_id", "element_id")


# Drawings, trees and sizes with links in them.


@query("""SELECT m.view_id, m.ord AS place, l.id, l.type, l.source_id, l.target_id FROM view_relationships m JOIN links l ON l.id = m.relationship_id
WHERE EXISTS (SELECT 1 FROM view_elements e WHERE e.view_id = m.view_id AND e.element_id = l.source_id) AND EXISTS (SELECT 1 FROM view_elements e WHERE e.view_id = m.view_id AND e.element_id = l.target_id)""")
def view_graph_edges(spark, d):
    return views.drawn_edges(star.graph(spark, d)).drop("graph_key")


_LINKED = """,
entry AS (SELECT id FROM elements WHERE type IN ('Location', 'Grouping') OR (type = 'Business Actor' AND ord % 3 = 0) OR (type = 'Product' AND ord % 10 = 0) OR (type = 'Business Role' AND ord % 2 = 0)),
edge AS (
  SELECT source_id AS parent, target_id AS child, type AS label FROM links WHERE type IN ('Access', 'Assignment', 'Specialization', 'Composition', 'Aggregation') AND source_id IN (FROM entry) AND target_id IN (FROM entry)
  UNION ALL SELECT target_id, source_id, type FROM links WHERE type IN ('Serving', 'Realization', 'Flow', 'Triggering', 'Influence') AND source_id IN (FROM entry) AND target_id IN (FROM entry)),
tied AS (SELECT parent AS id FROM edge UNION SELECT child FROM edge)
SELECT parent, child, label FROM edge UNION ALL SELECT (SELECT min(id) FROM entry), id, 'impact' FROM entry WHERE id NOT IN (FROM tied) AND id <> (SELECT min(id) FROM entry)"""


@query(_LINKED)
def diff_tree_linked(spark, d):
    e = star.elements(spark, d).filter("type in ('Location', 'Grouping') or (type = 'Business Actor' and ord % 3 = 0) or (type = 'Product' and ord % 10 = 0) or (type = 'Business Role' and ord % 2 = 0)")
    return diff.tree_edges(e.select("id"), star.links(spark, d))


@query("SELECT (1.5 * sum(length(p) - length(replace(p, 'x', ''))) FILTER (true) + 2 * count(*) FILTER (k = 1))::DOUBLE AS total_g FROM (SELECT CASE WHEN p_partkey % 2 = 0 THEN repeat('x', (p_partkey % 4)::INTEGER) ELSE '' END AS p, p_partkey % 2 AS k FROM part)")
def diff_size_points(spark, d):
    """Even parts are processes with as many points as their key modulo four; others are interfaces."""
    n = F.col("p_partkey")
    words = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n % 4, F.lit(1))), lambda k: F.concat(F.lit("FP"), k.cast("string"))), " ")
    kind = F.when(n % 2 == 0, "Business Process").otherwise("Application Interface")
    rows = star.table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), kind.alias("type"), F.lit("n").alias("name"), F.when(n % 4 > 0, words).otherwise("").alias("description"))
    return diff.total_size(rows, star.links(spark, d).limit(0))


# Purposes: suppliers are seeds of audits, customers of repairs; two policies hang
# from the selector, and regions lead to one of them.


def _purpose_links(spark, d):
    made = [("g1", "Triggering", "grag-purpose-closure", "grag-audit-policy"), ("g2", "Triggering", "grag-purpose-closure", "grag-repair-policy"), ("g3", "Triggering", "grag-seed-retrieval", "grag-purpose-closure")]
    more = spark.createDataFrame([(k, *r) for k, r in enumerate(made)], "ord long, id string, type string, source_id string, target_id string")
    base = star.links(spark, d).select("ord", "id", "type", "source_id", "target_id")
    region = star.table(spark, d, "region").select(F.lit(9).cast("long"), F.concat(F.lit("gr-"), F.col("r_regionkey").cast("string")), F.lit("Flow"), F.concat(F.lit("region-"), F.col("r_regionkey").cast("string")), F.lit("grag-audit-policy"))
    return base.unionAll(more.select(base.columns)).unionAll(region)


@query(""",
pl AS (
  SELECT id, type, source_id, target_id FROM links UNION ALL SELECT 'g1', 'Triggering', 'grag-purpose-closure', 'grag-audit-policy'
  UNION ALL SELECT 'g2', 'Triggering', 'grag-purpose-closure', 'grag-repair-policy' UNION ALL SELECT 'g3', 'Triggering', 'grag-seed-retrieval', 'grag-purpose-closure'
  UNION ALL SELECT 'gr-' || r_regionkey, 'Flow', 'region-' || r_regionkey, 'grag-audit-policy' FROM region),
pol AS (SELECT * FROM (VALUES ('intent-decision', 'grag-intent-decision-policy'), ('implementation-design', 'grag-implementation-policy'), ('coding-repair', 'grag-repair-policy'), ('audit', 'grag-audit-policy'), ('graph-tidy', 'grag-graph-tidy-policy')) t(purpose, anchor)),
st AS (
  SELECT purpose, anchor, source_id AS f, target_id AS t FROM pol, pl WHERE type IN ('Triggering', 'Access', 'Association') AND NOT (type = 'Triggering' AND source_id = 'grag-purpose-closure' AND target_id <> anchor)
  UNION ALL SELECT purpose, anchor, target_id, source_id FROM pol, pl WHERE type IN ('Serving', 'Realization', 'Assignment', 'Association') OR (type = 'Triggering' AND source_id = 'grag-seed-retrieval')
  UNION ALL SELECT purpose, anchor, source_id, target_id FROM pol, pl WHERE type IN ('Flow', 'Influence', 'Composition', 'Aggregation', 'Specialization') AND target_id = anchor),
z0 AS (
  SELECT 'audit' AS purpose, 'supplier-' || s_suppkey AS id FROM supplier UNION SELECT 'coding-repair', 'customer-' || c_custkey FROM customer UNION SELECT 'audit', 'region-1'
  UNION SELECT purpose, anchor FROM pol UNION SELECT purpose, 'grag-purpose-closure' FROM pol WHERE anchor IN ('grag-audit-policy', 'grag-repair-policy')),
z1 AS (SELECT DISTINCT z.purpose, t AS id FROM z0 z JOIN st ON st.purpose = z.purpose AND f = z.id),
z2 AS (SELECT DISTINCT z.purpose, t AS id FROM z1 z JOIN st ON st.purpose = z.purpose AND f = z.id)
SELECT purpose, id, min(depth) AS depth FROM (SELECT *, 0 AS depth FROM z0 UNION ALL SELECT *, 1 FROM z1 UNION ALL SELECT *, 2 FROM z2) GROUP BY purpose, id""")
def purpose_scopes(spark, d):
    e = star.elements(spark, d)
    audit = e.filter("type = 'Business Role' or id = 'region-1'").select(F.lit("audit").alias("purpose"), "id")
    repair = e.filter("type = 'Business Actor'").select(F.lit("coding-repair").alias("purpose"), "id")
    return closure.purpose_scope(closure.purpose_policies(spark), audit.unionAll(repair), _purpose_links(spark, d))[0].drop("reason")


@query("SELECT canonical_identity, CASE WHEN n % 2 = 0 THEN 'unknown' ELSE 'version differs' END AS problem FROM (SELECT 'Element:part-' || p_partkey AS canonical_identity, p_partkey % 6 AS n FROM part) WHERE n IN (1, 2)")
def seed_authority(spark, d):
    n = F.col("p_partkey") % 6
    rows = star.table(spark, d, "part").select(F.concat(F.lit("Element:part-"), F.col("p_partkey").cast("string")).alias("canonical_identity"), n.alias("n"))
    return closure.unauthorised(rows.withColumn("content_version", F.when(F.col("n") == 1, "v0").otherwise("v1")).drop("n"), rows.filter("n <> 2").select("canonical_identity", F.lit("v1").alias("content_version")))


# Exports and handoffs: pages of the star schema as packages, tasks and claims.


@query("""SELECT s_nationkey::BIGINT AS package_id, bucket, count(*) AS n, list(id ORDER BY id) AS ids FROM (
  SELECT s_nationkey, CASE WHEN s_suppkey % 3 = 0 THEN 'Class' WHEN s_suppkey % 3 = 1 THEN 'Actor' ELSE 'Unknown' END AS bucket, 'supplier-' || s_suppkey AS id FROM supplier) GROUP BY s_nationkey, bucket""")
def package_buckets(spark, d):
    n = F.col("s_suppkey") % 3
    rows = star.table(spark, d, "supplier").select(F.col("s_nationkey").cast("long").alias("package_id"), F.when(n == 0, "Class").otherwise("").alias("meta_type"), F.when(n == 1, "Actor").when(n == 0, "Other").alias("type"), F.concat(F.lit("supplier-"), F.col("s_suppkey").cast("string")).alias("id"))
    return catalog.buckets(rows, "package_id")


@query("""SELECT id, CASE WHEN min(rank) = 1 THEN 'owned' WHEN min(rank) = 2 THEN 'diagram_reference' ELSE 'connector' END AS scope FROM (
  SELECT 'part-' || l_partkey AS id, CASE WHEN l_quantity > 45 THEN 1 WHEN l_quantity > 10 THEN 2 ELSE 3 END AS rank FROM lineitem) GROUP BY id""")
def package_scopes(spark, d):
    q = F.col("l_quantity")
    rows = star.table(spark, d, "lineitem").select(F.concat(F.lit("part-"), F.col("l_partkey").cast("string")).alias("id"), F.when(q > 45, "owned").when(q > 10, "diagram_reference").otherwise("connector").alias("scope"))
    return catalog.merged_scopes(rows, "id")


@query("""SELECT rule, id, count(*) AS n FROM (
  SELECT 'missing_element' AS rule, 'customer-' || (user_id * 7) AS id FROM events WHERE user_id * 7 NOT IN (SELECT c_custkey FROM customer)
  UNION ALL SELECT 'no_testcase', 'customer-' || (user_id * 7) FROM events WHERE user_id * 7 IN (SELECT c_custkey FROM customer WHERE c_custkey % 4 = 0)) GROUP BY rule, id""")
def handoff_claims(spark, d):
    e = star.table(spark, d, "customer").select(F.concat(F.lit("customer-"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("name"), (F.col("c_custkey") % 4).cast("int").alias("n_testcases"))
    rows = star.table(spark, d, "events").select(F.lit("h").alias("document"), F.col("event_id").alias("place"), F.concat(F.lit("customer-"), (F.col("user_id") * 7).cast("string")).alias("element_id"))
    return handoff.claims(rows, e).groupBy("rule", "id").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT 'order-' || o_custkey AS document, 'missing_task' AS rule, o_orderkey::VARCHAR AS id, 'needs ' || (o_orderkey + 1) || ', which is missing' AS message FROM orders o
WHERE NOT EXISTS (SELECT 1 FROM orders p WHERE p.o_custkey = o.o_custkey AND p.o_orderkey = o.o_orderkey + 1)""")
def handoff_tasks(spark, d):
    o = star.table(spark, d, "orders")
    rows = o.select(F.concat(F.lit("order-"), F.col("o_custkey").cast("string")).alias("document"), F.col("o_orderkey").cast("string").alias("task_id"), F.array((F.col("o_orderkey") + 1).cast("string")).alias("needs"))
    return handoff.tasks(rows)


# A batch of all nine kinds of mutations, over all suppliers and nations.


def _batch(spark, d):
    def rows(df, seq, verb, i, **fields):
        cols = {c.split()[0]: c.split(maxsplit=1)[1] for c in mutate.BATCH.split(", ")}
        given = {"seq": seq, "type": F.lit(verb), "id": i, **fields}
        return df.select(*[given.get(c, F.lit(None)).cast(t).alias(c) for c, t in cols.items()])

    s, n = star.table(spark, d, "supplier"), star.table(spark, d, "nation")
    k, key = F.col("s_suppkey"), F.col("n_nationkey")
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    return (
        rows(n, key + 1000, "addView", name("view-new-", key), name=F.lit("new"), parent_element_id=name("nation-", key))
        .unionAll(rows(s, k + 1_000_000, "addElement", name("added-", k), kind=F.lit("Business Role"), name=name("added ", k), view_ids=F.array(name("view-new-", F.col("s_nationkey")))))
        .unionAll(rows(s, k + 2_000_000, "addRelationship", name("ar-", k), kind=F.lit("Assignment"), source_id=name("added-", k), target_id=name("nation-", F.col("s_nationkey")), view_ids=F.array(name("view-new-", F.col("s_nationkey")))))
        .unionAll(rows(s, k + 3_000_000, "updateElement", name("added-", k), name=name("renamed ", k)))
        .unionAll(rows(s.filter("s_suppkey % 2 = 0"), k + 4_000_000, "updateRelationship", name("ar-", k), source_id=name("supplier-", k)))
        .unionAll(rows(s.filter("s_suppkey % 3 = 0"), k + 5_000_000, "removeRelationship", name("ar-", k)))
        .unionAll(rows(s.filter("s_suppkey % 5 = 0"), k + 6_000_000, "removeElement", name("supplier-", k)))
        .unionAll(rows(n, key + 7_000_000, "updateView", name("view-new-", key), name=name("view of ", key)))
        .unionAll(rows(n.filter("n_nationkey % 5 = 4"), key + 8_000_000, "removeView", name("view-nation-", key)))
    )


@query("""
, s AS (SELECT s_suppkey AS k, s_nationkey AS n, s_suppkey % 2 = 0 AS moved, s_suppkey % 3 = 0 AS cut, s_suppkey % 5 = 0 AS gone FROM supplier),
link AS (SELECT k, n, CASE WHEN moved THEN 'supplier-' || k ELSE 'added-' || k END AS source FROM s WHERE NOT cut AND NOT (moved AND gone))
SELECT 'view-new-' || n AS view_id, 'element' AS kind, source AS id FROM link
UNION SELECT 'view-new-' || n, 'element', 'nation-' || n FROM s WHERE NOT cut
UNION SELECT 'view-new-' || n, 'relationship', 'ar-' || k FROM link
UNION SELECT 'view-new-' || n_nationkey, 'view', 'view of ' || n_nationkey FROM nation""")
def mutation_batch(spark, d):
    g, _, refused = mutate.apply_batch(star.graph(spark, d), _batch(spark, d))
    new = lambda t: t.filter("view_id like 'view-new-%'")
    out = new(g.view_elements).select("view_id", F.lit("element").alias("kind"), F.col("element_id").alias("id"))
    out = out.unionAll(new(g.view_relationships).select("view_id", F.lit("relationship"), "relationship_id")).unionAll(new(g.views).select("view_id", F.lit("view"), "view_name"))
    return out.unionAll(refused.select(F.lit("refused"), F.lit("refused"), "reason"))


@query("""
, s AS (SELECT s_suppkey AS k, s_suppkey % 2 = 0 AS moved, s_suppkey % 3 = 0 AS cut, s_suppkey % 5 = 0 AS gone FROM supplier)
SELECT 'element' AS kind, 'added-' || k AS id, 'created' AS change FROM s
UNION SELECT 'element', 'supplier-' || k, 'removed' FROM s WHERE gone
UNION SELECT 'relationship', 'ar-' || k, 'created' FROM s WHERE NOT cut AND NOT (moved AND gone)
UNION SELECT 'relationship', r.id, 'removed' FROM relationships r JOIN s ON gone AND 'supplier-' || k IN (r.source_id, r.target_id)
UNION SELECT 'view', 'view-new-' || n_nationkey, 'created' FROM nation
UNION SELECT 'view', 'view-nation-' || n_nationkey, 'removed' FROM nation WHERE n_nationkey % 5 = 4""")
def mutation_batch_changes(spark, d):
    batch = _batch(spark, d)
    before = mutate.part(star.graph(spark, d), batch)[0]  # nothing else comes or goes
    return mutate.changes(before, mutate.apply_to_part(before, batch)[0]).drop("graph_key")


from stratagraph import gate_queries, modelling_queries, upkeep_queries  # noqa: E402, F401 -- they register their queries here
