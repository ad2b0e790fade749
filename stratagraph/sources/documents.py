"""Graph documents: nested JSON in, normalized tables out, and back."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagraph.model import DOCUMENT


@dataclass(frozen=True)
class Graph:
    """The tables of one or more graphs; ``graph_key`` tells graphs apart."""

    elements: DataFrame
    relationships: DataFrame
    views: DataFrame
    view_elements: DataFrame
    view_relationships: DataFrame


def shared_key(*tables: DataFrame) -> list[str]:
    """``["graph_key"]`` if all tables have it; tables without it are of one graph."""
    return ["graph_key"] if all("graph_key" in t.columns for t in tables) else []


def read_documents(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row for each JSON document, with its path as ``graph_key``."""
    rows = spark.read.option("multiLine", True).schema(DOCUMENT).json(path)
    return rows.withColumn("graph_key", F.regexp_replace(F.input_file_name(), r"\\", "/"))


def _parts(docs: DataFrame, field: str) -> DataFrame:
    return docs.select("graph_key", F.posexplode(field).alias("ord", "x")).select("graph_key", F.col("ord").cast("long").alias("ord"), "x.*")


def explode_documents(docs: DataFrame) -> Graph:
    """Documents as tables; ``ord`` is the place in the document."""
    views = _parts(docs, "views")

    def members(column: str, name: str) -> DataFrame:
        return views.select("graph_key", "view_id", F.posexplode(column).alias("ord", name)).withColumn("ord", F.col("ord").cast("long"))

    return Graph(
        _parts(docs, "elements"),
        _parts(docs, "relationships"),
        views.drop("included_elements", "included_relationships"),
        members("included_elements", "element_id"),
        members("included_relationships", "relationship_id"),
    )


def assemble_documents(docs: DataFrame, graph: Graph) -> DataFrame:
    """The inverse of ``explode_documents``: one nested row for each graph.

    A graph is a document, so one row holds it; graphs are grouped, never the
    whole table.
    """

    def listed(rows: DataFrame, keys: list[str], column: str, value) -> DataFrame:
        return rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", value.alias("v")))), lambda x: x["v"]).alias(column))

    def nested(rows: DataFrame) -> F.Column:
        return F.struct(*[c for c in rows.columns if c not in ("graph_key", "ord")])

    views = graph.views
    for table, name, column in ((graph.view_elements, "element_id", "included_elements"), (graph.view_relationships, "relationship_id", "included_relationships")):
        views = views.join(listed(table, ["graph_key", "view_id"], column, F.col(name)), ["graph_key", "view_id"], "left")
        views = views.withColumn(column, F.coalesce(column, F.array().cast("array<string>")))
    out = docs.select("graph_key", "name", "description", "attributes")
    for rows, column in ((graph.elements, "elements"), (graph.relationships, "relationships"), (views, "views")):
        out = out.join(listed(rows, ["graph_key"], column, nested(rows)), "graph_key", "left")
        out = out.withColumn(column, F.coalesce(column, F.array().cast(out.schema[column].dataType)))
    return out


def write_documents(documents: DataFrame, path: str) -> None:
    """UTF-8 JSON lines, one document a line, empty fields left out."""
    documents.write.mode("overwrite").option("ignoreNullFields", True).json(path)


def discover(spark: SparkSession, root: str, name: str = "SystemArchitecture.json", depth: int = 6) -> DataFrame:
    """(project_id, project, path) of documents in ``design/KG`` folders below a root.

    Hidden and vendored folders are skipped, and projects inside a project.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(root).select("path")
    base = F.regexp_replace(F.lit(root.rstrip("/")), "^[a-z]+:/*", "/")
    inner = F.substring("path_", F.length(base) + 2, F.lit(1 << 20))
    rows = files.withColumn("path_", F.regexp_replace("path", "^[a-z]+:/*", "/")).withColumn("inner", inner)
    rows = rows.filter(F.col("inner").rlike(r"(^|/)design/KG/[^/]+$") & ~F.col("inner").rlike(r"(^|/)(\.[^/]*|node_modules|vendor|dist|build)/"))
    home = F.regexp_replace("path_", "/?design/KG/[^/]+$", "")
    rows = rows.withColumn("home", home).withColumn("levels", F.size(F.split(F.regexp_replace("inner", "/?design/KG/[^/]+$", ""), "/")))
    rows = rows.filter(F.col("levels") <= depth)
    # Each project's own ancestors are few, so they meet other projects by equality.
    steps = F.split("home", "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(steps) - 1, F.lit(1))), lambda k: F.array_join(F.slice(steps, 1, k), "/"))
    inside = rows.select("home", F.explode(above).alias("outer_home")).filter("home <> outer_home").join(rows.select(F.col("home").alias("outer_home")).distinct(), "outer_home", "left_semi")
    rows = rows.join(inside.select("home").distinct(), "home", "left_anti")
    return rows.select(F.substring(F.sha1("path_"), 1, 12).alias("project_id"), F.element_at(F.split("home", "/"), -1).alias("project"), "path").orderBy("project", "path")
