"""Import of graphs into a repository with ids of its own: parents first, an id
table from old ids to new ones, and what could not be imported as rows with reasons.

New ids follow the order in which a reader of the document makes objects: an element
is made when it, or the first element below it, comes in the document, its parents
before it. Ids that the repository has already keep theirs and are not made again.
An element below or on a cycle of parents is rejected. Of rows with one id the last
one's content counts, at the first one's place. Levels are rounds of joins; numbers
are given over ranges of the order, things at one place by their ids.
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratagraph.plans.fixpoint import Rounds, grow
from stratagraph.plans.numbering import numbered
from stratagraph.sources.documents import Graph, shared_key

REJECT = ["kind", "id", "view_id", "reason"]


# The grid on which an import puts a diagram's elements.
COLUMNS, LEFT, TOP, ACROSS, DOWN, WIDTH, HEIGHT = 5, 40, 40, 260, 150, 180, 80


def _box(i: Column) -> list[Column]:
    left, top = LEFT + i % COLUMNS * ACROSS, TOP + F.floor(i / COLUMNS) * DOWN
    return [x.cast("long").alias(n) for n, x in (("left", left), ("top", top), ("right", left + WIDTH), ("bottom", top + HEIGHT))]


def _blank(column: str) -> Column:
    return F.trim(F.coalesce(F.col(column), F.lit(""))) == ""


def _rejected(rows: DataFrame, key: list[str], kind: str, id_: Column, reason: Column | str, view: Column | None = None) -> DataFrame:
    view = F.lit(None).cast("string") if view is None else view
    return rows.select(*key, F.lit(kind).alias("kind"), id_.alias("id"), view.alias("view_id"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))


def _levels(rows: DataFrame, key: list[str], tables: Rounds) -> DataFrame:
    """(id, owner, ord, level): rows (id, parent, ord; parent null: at the top) that
    hang on the top, with the number of parents that are made before them."""
    top = rows.filter("parent is null").select(*key, "id", F.lit(0).alias("level"))
    below = tables.save(rows.filter("parent is not null").select(*key, "parent", "id"))
    down = lambda new: new.select(*key, F.col("id").alias("parent"), "level").join(below, [*key, "parent"]).select(*key, "id", (F.col("level") + 1).alias("level"))
    return tables.save(rows.join(grow(rows.sparkSession, top, down, [*key, "id"]), [*key, "id"]))


def _first_needed(leveled: DataFrame, key: list[str], tables: Rounds) -> DataFrame:
    """``leveled`` with ``needed``: the first place of a row or of any row below it."""
    deepest = leveled.agg(F.max("level").alias("m")).first()["m"]
    out = below = None
    for level in range(deepest if deepest is not None else -1, -1, -1):
        here = leveled.filter(F.col("level") == level).withColumn("needed", F.col("ord"))
        if below is not None:
            least = below.groupBy(*key, F.col("parent").alias("id")).agg(F.min("needed").alias("least"))
            here = here.join(least, [*key, "id"], "left").withColumn("needed", F.least("needed", "least")).drop("least")
        below = tables.save(here)
        out = below if out is None else out.unionByName(below)
    return leveled.withColumn("needed", F.col("ord")) if out is None else out


def _elements(elements: DataFrame, existing: DataFrame, key: list[str], tables: Rounds, first: int) -> tuple[DataFrame, DataFrame]:
    at = [*key, "id"]
    named = elements.filter(~_blank("id"))
    last = F.max_by(F.struct("name", "type", "parent"), "ord")
    rows = named.groupBy(*at).agg(F.min("ord").alias("ord"), last.alias("x")).select(*at, "ord", "x.*")
    there = existing.select(*at, "new_id")
    rows = tables.save(rows.join(there, at, "left"))
    new = rows.filter("new_id is null").drop("new_id")
    # A parent counts if the document or the repository has it; only one that is new has to be made first.
    ids = new.select(*key, F.col("id").alias("parent")).withColumn("makes", F.lit(True))
    new = new.withColumn("parent", F.when(~_blank("parent") & (F.col("parent") != "0"), F.col("parent")))
    hung = new.join(ids, [*key, "parent"], "left").withColumn("told", F.col("parent"))
    hung = hung.withColumn("parent", F.when(F.col("makes"), F.col("parent"))).drop("makes")
    leveled = _first_needed(_levels(hung, key, tables), key, tables)
    made = numbered(leveled, [*[F.col(k) for k in key], F.col("needed"), F.col("level"), F.col("id")], tables, "new_id", first)
    known = made.select(*at, "new_id").unionByName(there)
    owners = known.select(*key, F.col("id").alias("told"), F.col("new_id").alias("owner_id"))
    # Elements that the document does not have are no owners, though the repository may have them.
    owners = owners.join(rows.select(*key, F.col("id").alias("told")), [*key, "told"], "left_semi")
    out = made.join(owners, [*key, "told"], "left").select("new_id", *at, "name", "type", "owner_id", "level", F.lit(True).alias("made"))
    kept = rows.filter("new_id is not null").select("new_id", *at, "name", "type", F.lit(None).cast("long").alias("owner_id"), F.lit(None).cast("int").alias("level"), F.lit(False).alias("made"))
    cyclic = new.select(*at).join(made.select(*at), at, "left_anti")
    rejects = _rejected(elements.filter(_blank("id")), key, "element", F.col("id"), "no id").unionByName(_rejected(cyclic, key, "element", F.col("id"), "cycle of parents"))
    return tables.save(out.unionByName(kept)), rejects


class Imported:
    """What an import makes, each table when it is first asked for; all carry the
    documents' ``graph_key``, if any.

    elements (new_id, id, name, type, owner_id, level, made), relationships (new_id, id,
    name, type, source_id, target_id: new ids), views (new_id, view_id, view_name,
    owner_id), view_elements (diagram_id, element_id, ord, left, top, right, bottom),
    view_relationships (diagram_id, connector_id), rejects (kind, id, view_id, reason).
    """

    def __init__(self, graph: Graph, existing: DataFrame, subdiagrams: DataFrame, key: list[str], first: int):
        self.graph, self.existing, self.subdiagrams, self.key, self.first = graph, existing, subdiagrams, key, first
        self.tables, self.order = Rounds(graph.elements.sparkSession), [F.col(k) for k in key]

    @cached_property
    def _made(self) -> tuple[DataFrame, DataFrame]:
        return _elements(self.graph.elements, self.existing, self.key, self.tables, self.first)

    @property
    def elements(self) -> DataFrame:
        return self._made[0]

    def _new(self, column: str, name: str) -> DataFrame:
        return self.elements.select(*self.key, F.col("id").alias(column), F.col("new_id").alias(name))

    def _told(self, relationships: DataFrame) -> DataFrame:
        """Relationships with the new ids of their ends, null where there are none."""
        told = relationships.filter(~_blank("id")).select(*self.key, "id", "ord", "name", "type", "source_id", "target_id")
        for end in ("source", "target"):
            told = told.join(self._new(f"{end}_id", end), [*self.key, f"{end}_id"], "left")
        return told

    def _numbered(self, *columns: str) -> DataFrame:
        whole = self._told(self.graph.relationships).filter("source is not null and target is not null")
        whole = self.tables.save(whole.select(*self.key, "id", "ord", *columns))  # read for the ranges, then dealt to them
        return numbered(whole, [*self.order, F.col("ord"), F.col("id")], self.tables, "new_id", self.first)

    @cached_property
    def relationships(self) -> DataFrame:
        made = self._numbered("name", "type", "source", "target")
        return made.select("new_id", *self.key, "id", "name", "type", F.col("source").alias("source_id"), F.col("target").alias("target_id"))

    @cached_property
    def views(self) -> DataFrame:
        key = self.key
        views = self.graph.views.filter(~_blank("view_id")).groupBy(*key, "view_id").agg(F.min("ord").alias("ord"), F.min_by(F.struct("view_name", "parent_element_id"), "ord").alias("x"))
        views = views.select(*key, "view_id", "ord", "x.*", F.lit(0).alias("declared"))
        said = self.subdiagrams.join(self._new("id", "n"), [*key, "id"], "left_semi").groupBy(*key, "view_id").agg(F.min_by(F.struct("ord", "view_name", "id"), "ord").alias("f"))
        owner = self.subdiagrams.filter(~_blank("view_id")).groupBy(*key, "view_id").agg(F.max_by("id", "ord").alias("owner"))
        extra = said.join(views, [*key, "view_id"], "left_anti").select(*key, "view_id", "f.ord", "f.view_name", F.col("f.id").alias("parent_element_id"), F.lit(1).alias("declared"))
        views = numbered(views.unionByName(extra), [*self.order, F.col("declared"), F.col("ord"), F.col("view_id")], self.tables, "new_id", self.first)
        views = views.join(owner, [*key, "view_id"], "left").join(self._new("parent_element_id", "a"), [*key, "parent_element_id"], "left").join(self._new("owner", "b"), [*key, "owner"], "left")
        return self.tables.save(views.select("new_id", *key, "view_id", "view_name", F.coalesce("a", "b").alias("owner_id")))

    @cached_property
    def _diagrams(self) -> DataFrame:
        return self.views.select(*self.key, "view_id", F.col("new_id").alias("diagram_id"))

    @cached_property
    def _held(self) -> DataFrame:
        # A view is drawn as a whole: its members are one group.
        place = (F.row_number().over(Window.partitionBy(*self.key, "view_id").orderBy("ord")) - 1).cast("long")
        return self.graph.view_elements.withColumn("i", place).join(self._diagrams, [*self.key, "view_id"]).join(self._new("element_id", "e"), [*self.key, "element_id"], "left")

    @cached_property
    def view_elements(self) -> DataFrame:
        return self._held.filter("e is not null").select(*self.key, "diagram_id", F.col("e").alias("element_id"), F.col("i").alias("ord"), *_box(F.col("i")))

    @property
    def _drawn(self) -> DataFrame:
        return self.graph.view_relationships.join(self._diagrams, [*self.key, "view_id"])

    @cached_property
    def view_relationships(self) -> DataFrame:
        # Only ids and numbers are needed here, of relationships that views show.
        made = self.relationships if "relationships" in self.__dict__ else self._numbered()
        shown = self.graph.view_relationships.select(*self.key, F.col("relationship_id").alias("id"))
        last = made.join(shown, [*self.key, "id"], "left_semi").groupBy(*self.key, F.col("id").alias("relationship_id")).agg(F.max("new_id").alias("connector_id"))
        return self._drawn.join(last, [*self.key, "relationship_id"]).select(*self.key, "diagram_id", "connector_id")

    @cached_property
    def rejects(self) -> DataFrame:
        key, graph = self.key, self.graph
        of = [*key, "relationship_id"]
        ids = lambda rows: rows.select(*key, F.col("id").alias("relationship_id"))
        lost = self.tables.save(self._told(graph.relationships).filter("source is null or target is null").select(*key, "id", "source", "target"))
        missing = F.array_join(F.array_compact(F.array(*[F.when(F.col(e).isNull(), F.lit(e)) for e in ("source", "target")])), " and ")
        # What a view draws is lost if no relationship of its id is whole: those with a lost one are looked at again.
        drawn = self._drawn
        absent = drawn.join(ids(graph.relationships.filter(~_blank("id"))), of, "left_anti")
        broken = drawn.join(ids(lost), of, "left_semi")
        again = graph.relationships.join(broken.select(*key, F.col("relationship_id").alias("id")), [*key, "id"], "left_semi")
        broken = broken.join(ids(self._told(again).filter("source is not null and target is not null")), of, "left_anti")
        reject = lambda rows, kind, id_, reason, view=None: _rejected(rows, key, kind, F.col(id_), reason, None if view is None else F.col(view))
        parts = [
            reject(graph.relationships.filter(_blank("id")), "relationship", "id", "no id"),
            reject(lost, "relationship", "id", F.concat(F.lit("missing "), missing)),
            reject(graph.views.filter(_blank("view_id")), "view", "view_id", "no id"),
            reject(self._held.filter("e is null"), "view element", "element_id", "missing element", "view_id"),
            reject(absent, "view relationship", "relationship_id", "missing relationship", "view_id"),
            reject(broken, "view relationship", "relationship_id", "missing relationship", "view_id"),
        ]
        return reduce(DataFrame.unionByName, parts, self._made[1])


def import_graph(graph: Graph, existing: DataFrame | None = None, subdiagrams: DataFrame | None = None, first: int = 1) -> Imported:
    """Import ``graph``. ``existing`` (id, new_id): elements of the repository;
    ``subdiagrams`` (view_id, view_name, id, ord): views that elements declare, made
    without members if the document lacks them. New ids begin with ``first``."""
    spark = graph.elements.sparkSession
    key = shared_key(graph.elements, graph.relationships, graph.views, graph.view_elements, graph.view_relationships, *[t for t in (existing, subdiagrams) if t is not None])
    graph_type = dict(graph.elements.dtypes).get("graph_key", "string")
    keys = f"graph_key {graph_type}, " if key else ""
    existing = spark.createDataFrame([], f"{keys}id string, new_id long") if existing is None else existing
    subdiagrams = spark.createDataFrame([], f"{keys}view_id string, view_name string, id string, ord long") if subdiagrams is None else subdiagrams
    return Imported(graph, existing, subdiagrams, key, first)
