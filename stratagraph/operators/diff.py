"""Difference of two versions of a graph, its size estimate and its tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratagraph.functions.text import functional_points
from stratagraph.model import SOURCE_DEPENDS, TARGET_DEPENDS
from stratagraph.sources.documents import shared_key

# Sizes of changed elements and relationships by type.
DEFAULT_SIZE = 1.5
ELEMENT_SIZE = {
    "Goal": 15, "Requirement": 15, "Constraint": 1.5, "Business Process": 15, "Application Component": 2, "Application Function": 1.5,
    "Application Interface": 2, "Data Object": 1.5, "Assessment": 1.5, "Principle": 1.5,
}
RELATIONSHIP_SIZE = {"Realization": 15, "Influence": 1.5, "Assignment": 3, "Serving": 1.5, "Access": 1.5, "Association": 2, "Composition": 10}


def content_digest(rows: DataFrame, key: str = "id") -> Column:
    """A digest of a row's content, keys of structs in order of the schema."""
    return F.sha2(F.to_json(F.struct(*[c for c in rows.columns if c not in ("graph_key", "ord")])), 256)


def diff(before: DataFrame, after: DataFrame, key: str = "id") -> DataFrame:
    """(id, status, type, name) of added, removed and affected rows."""
    of = shared_key(before, after)
    a = before.select(*of, F.col(key).alias("id"), content_digest(before).alias("old"), F.struct("type", "name").alias("was"))
    b = after.select(*of, F.col(key).alias("id"), content_digest(after).alias("new"), F.struct("type", "name").alias("is"))
    both = a.join(b, [*of, "id"], "full_outer")
    status = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "affected")
    return both.withColumn("status", status).filter("status is not null").withColumn("x", F.coalesce("is", "was")).select(*of, "id", "status", "x.type", "x.name")


def by_id(col: str = "id") -> list[Column]:
    """Numbers first by value, then other ids by text."""
    return [F.expr(f"try_cast({col} as double)").asc_nulls_last(), F.col(col).asc()]


def sized(changes: DataFrame, sizes: dict[str, float]) -> DataFrame:
    """Changes with ``g``, the size of their type."""
    pairs = F.create_map(*[F.lit(x) for k, v in sizes.items() for x in (k, float(v))])
    return changes.withColumn("g", F.coalesce(F.element_at(pairs, F.col("type")), F.lit(DEFAULT_SIZE)))


def total_size(elements: DataFrame, relationships: DataFrame) -> DataFrame:
    """One row, total_g: functional points of processes and interfaces if there
    are any, else the larger sum of the two kinds. ``elements`` may have
    ``description``, in which points are counted."""
    if "description" not in elements.columns:
        elements = elements.withColumn("description", F.lit(""))
    process = F.when(F.col("type") == "Business Process", F.size(functional_points(F.col("description")))).otherwise(0)
    reach = ((F.col("type") == "Application Interface") | ((F.col("type") == "Application Component") & F.col("name").rlike("(?i)W3|IDASS|SSO"))).cast("int")
    e = sized(elements, ELEMENT_SIZE).agg(F.coalesce(F.sum("g"), F.lit(0.0)).alias("eg"), (F.coalesce(F.sum(process), F.lit(0)) * 1.5 + 2 * F.coalesce(F.sum(reach), F.lit(0))).alias("fp"))
    r = sized(relationships, RELATIONSHIP_SIZE).agg(F.coalesce(F.sum("g"), F.lit(0.0)).alias("rg"))
    return e.crossJoin(r).select(F.when(F.col("fp") > 0, F.col("fp")).otherwise(F.greatest("eg", "rg", F.lit(DEFAULT_SIZE))).alias("total_g"))


def context_elements(changed: DataFrame, relationships: DataFrame, current: DataFrame, base: DataFrame) -> DataFrame:
    """Ends of changed relationships that didn't change: (id, name, type)."""
    key = shared_key(changed, relationships, current, base)
    ids = relationships.select(*key, F.explode(F.array("source_id", "target_id")).alias("id")).distinct().join(changed.select(*key, "id"), [*key, "id"], "left_anti")
    now = current.select(*key, "id", F.struct("name", "type").alias("now"))
    was = base.select(*key, "id", F.struct("name", "type").alias("was"))
    out = ids.join(now, [*key, "id"], "left").join(was, [*key, "id"], "left").withColumn("x", F.coalesce("now", "was"))
    return out.select(*key, "id", "x.name", "x.type")


def tree_edges(entries: DataFrame, relationships: DataFrame) -> DataFrame:
    """(parent, child, label): what depends points to what it needs; entries
    without an edge hang from the first one (of their graph) as "impact"."""
    key = shared_key(entries, relationships)
    ids = entries.select(*key, "id")
    both = relationships
    for end in ("source_id", "target_id"):
        both = both.join(ids.withColumnRenamed("id", end), [*key, end], "left_semi")
    down = F.col("type").isin(SOURCE_DEPENDS)
    links = both.filter(F.col("type").isin(SOURCE_DEPENDS + TARGET_DEPENDS)).select(
        *key, F.when(down, F.col("source_id")).otherwise(F.col("target_id")).alias("parent"), F.when(down, F.col("target_id")).otherwise(F.col("source_id")).alias("child"), F.col("type").alias("label")
    )
    tied = links.select(*key, F.explode(F.array("parent", "child")).alias("id")).distinct()
    order = F.struct(F.expr("try_cast(id as double) is null"), F.expr("try_cast(id as double)"), "id")
    first = entries.groupBy(*key).agg(F.min_by("id", order).alias("parent"))
    loose = ids.join(tied, [*key, "id"], "left_anti")
    loose = (loose.join(first, key) if key else loose.crossJoin(F.broadcast(first))).filter("id <> parent")  # one row a graph
    return links.unionAll(loose.select(*key, "parent", F.col("id").alias("child"), F.lit("impact").alias("label")))


def plantuml(entries: DataFrame, relationships: DataFrame, most: int = 1000) -> str:
    """A diagram of the first ``most`` changes and the tree over them."""
    colours = {"added": "#palegreen", "removed": "#pink", "affected": "#lightyellow"}
    rows = entries.orderBy(*by_id()).limit(most).collect()
    alias = {r["id"]: f"n{k}" for k, r in enumerate(rows)}
    said = lambda x: str(x or "").replace("\\", "\\\\").replace('"', "'").replace("\n", " ")
    out = ["@startuml", *[f'rectangle "{said(r["name"])} ({said(r["type"])})" as {alias[r["id"]]} {colours.get(r["status"], "")}'.rstrip() for r in rows]]
    tree = tree_edges(entries.orderBy(*by_id()).limit(most), relationships).orderBy("parent", "child", "label").collect()
    return "\n".join([*out, *[f"{alias[t['parent']]} --> {alias[t['child']]} : {said(t['label'])}" for t in tree], "@enduml"]) + "\n"


def markdown(changes: DataFrame, most: int = 1000) -> str:
    """A table of the first ``most`` changes, for people to read."""
    rows = changes.orderBy(*by_id()).limit(most).collect()
    return "\n".join(["| id | status | type | name |", "| --- | --- | --- | --- |", *[f"| {r['id']} | {r['status']} | {r['type']} | {r['name']} |" for r in rows]]) + "\n"
