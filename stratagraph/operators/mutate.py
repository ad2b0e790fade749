"""Changes of a graph: an ordered log of mutations, applied set-wise.

A log row has seq, type, id and the fields that it sets. For elements the last
state of an id follows from its own rows alone, so a log of any length is one
grouped pass. Relationship and view changes are joins on the tables they touch.
Refused mutations come back as rows with a reason and nothing of them is applied.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratagraph.plans.fixpoint import Rounds
from stratagraph.sources.documents import Graph, shared_key


def last_states(log: DataFrame, fields: list[str]) -> DataFrame:
    """(id, alive, fields): the state that each id's own rows leave.

    After the last removal, an add sets all fields and updates set theirs (null:
    unchanged). ``alive`` is null for ids that the log only updates, whose other
    fields come from the table.
    """
    key = shared_key(log)
    w = Window.partitionBy(*key, "id")
    ranked = log.withColumn("cut", F.max(F.when(F.col("type") == "remove", F.col("seq"))).over(w))
    live = (F.col("cut").isNull() | (F.col("seq") > F.col("cut"))) & (F.col("type") != "remove")
    first_add = F.min(F.when(live & (F.col("type") == "add"), F.col("seq")))
    aggs = [F.max_by(F.when(live, F.col(f)), F.when(live & F.col(f).isNotNull(), F.col("seq"))).alias(f) for f in fields]
    out = ranked.groupBy(*key, "id").agg(first_add.alias("added"), F.max("cut").alias("removed"), *aggs)
    alive = F.when(F.col("added").isNotNull(), True).when(F.col("removed").isNotNull(), False)
    return out.select(*key, "id", alive.alias("alive"), *fields)


def apply_log(rows: DataFrame, log: DataFrame, fields: list[str]) -> DataFrame:
    """Rows (id and fields) after an element log. An add of an id that is there
    does not overwrite it; an update of an id that is not there does nothing."""
    key = shared_key(rows, log)
    at = [*key, "id"]
    state = last_states(log, fields)
    old = rows.select(*at, F.lit(True).alias("there"), F.struct(*fields).alias("old"))
    removed = log.filter("type = 'remove'").select(*at).distinct().withColumn("gone", F.lit(True))
    both = state.join(old, at, "full_outer").join(removed, at, "left")
    stays = F.coalesce("there", F.lit(False)) & F.col("gone").isNull()
    keep = both.filter(stays | F.coalesce("alive", F.lit(False)))
    return keep.select(*at, *[F.when(stays, F.coalesce(F.col(f), F.col(f"old.{f}"))).otherwise(F.col(f)).alias(f) for f in fields])


def _key(graph: Graph, *more: DataFrame) -> list[str]:
    return shared_key(graph.elements, graph.relationships, graph.views, graph.view_elements, graph.view_relationships, *more)


def _without(table: DataFrame, rows: DataFrame, on: list[str]) -> DataFrame:
    return table.join(rows.select(*on), on, "left_anti").select(table.columns)


def _ends(graph: Graph, key: list[str]) -> DataFrame:
    """(relationship_id, element_id): both ends of each relationship."""
    return graph.relationships.select(*key, F.col("id").alias("relationship_id"), F.explode(F.array("source_id", "target_id")).alias("element_id"))


def _appended(members: DataFrame, rows: DataFrame, key: list[str], column: str) -> DataFrame:
    """Members with new ones (view_id and ``column``) at the end of their lists, in
    the order of their ``step``, if rows have one, then of ids."""
    at = [*key, "view_id"]
    step = F.col("step") if "step" in rows.columns else F.lit(0)
    new = rows.groupBy(*at, column).agg(F.min(step).alias("step")).join(members.select(*at, column), [*at, column], "left_anti")
    top = members.groupBy(*at).agg(F.max("ord").alias("top"))
    place = F.coalesce("top", F.lit(-1)) + F.row_number().over(Window.partitionBy(*at).orderBy("step", column))
    add = new.join(top, at, "left").select(*at, column, place.cast("long").alias("ord"))
    return members.select(*at, column, "ord").unionByName(add).select([c for c in members.columns if c in (*at, column, "ord")])


def remove_elements(graph: Graph, ids: DataFrame) -> tuple[Graph, DataFrame]:
    """The graph without elements, their relationships and memberships, and the
    refused ones (id, reason): those that child views hang from."""
    key = _key(graph, ids)
    at = [*key, "id"]
    refused = ids.join(graph.views.select(*key, F.col("parent_element_id").alias("id")), at, "left_semi").select(*at, F.lit("child views exist").alias("reason"))
    gone = ids.join(refused.select(*at), at, "left_anti").select(*at)
    end = lambda c: gone.withColumnRenamed("id", c)
    rels = graph.relationships
    for c in ("source_id", "target_id"):
        rels = _without(rels, end(c), [*key, c])
    drawn = graph.view_relationships.join(rels.select(*key, F.col("id").alias("relationship_id")), [*key, "relationship_id"], "left_semi").select(graph.view_relationships.columns)
    held = _without(graph.view_elements, end("element_id"), [*key, "element_id"])
    return replace(graph, elements=_without(graph.elements, gone, at), relationships=rels, view_elements=held, view_relationships=drawn), refused


def remove_from_views(graph: Graph, scope: DataFrame) -> Graph:
    """Take elements out of views (view_id, element_id; a null view takes it out of
    none); an element in no view afterwards goes altogether, with its links' places in every view, and links
    of the elements that are in no view then go too."""
    key = _key(graph, scope)
    at = [*key, "view_id"]
    held = _without(graph.view_elements, scope, [*at, "element_id"])
    touched = scope.select(*key, "element_id").distinct()
    gone = touched.join(held.select(*key, "element_id"), [*key, "element_id"], "left_anti")
    ends = _ends(graph, key)
    drawn = _without(graph.view_relationships, ends.join(scope, [*key, "element_id"]).select(*at, "relationship_id").distinct(), [*at, "relationship_id"])
    drawn = _without(drawn, ends.join(gone, [*key, "element_id"], "left_semi").select(*key, "relationship_id").distinct(), [*key, "relationship_id"])
    related = ends.join(touched, [*key, "element_id"], "left_semi").select(*key, "relationship_id").distinct()
    lost = related.join(drawn.select(*key, "relationship_id"), [*key, "relationship_id"], "left_anti").withColumnRenamed("relationship_id", "id")
    elements = _without(graph.elements, gone.withColumnRenamed("element_id", "id"), [*key, "id"])
    return replace(graph, elements=elements, relationships=_without(graph.relationships, lost, [*key, "id"]), view_elements=held, view_relationships=drawn)


def add_elements(graph: Graph, rows: DataFrame, scope: DataFrame) -> Graph:
    """Add elements (an id that is there keeps its row) to views (view_id, element_id)."""
    key = _key(graph, rows, scope)
    new = rows.join(graph.elements.select(*key, "id"), [*key, "id"], "left_anti").select(graph.elements.columns)
    return replace(graph, elements=graph.elements.unionByName(new), view_elements=_appended(graph.view_elements, scope, key, "element_id"))


def add_relationships(graph: Graph, rows: DataFrame, scope: DataFrame) -> Graph:
    """Add relationships (an id that is there keeps its row) to views (view_id,
    relationship_id), and both ends of each to the same views."""
    key = shared_key(graph.relationships, graph.view_elements, graph.view_relationships, rows, scope)
    if not key and "graph_key" in graph.views.columns:  # a scope of views alone: ids of views name their graphs
        keys = graph.views.select("view_id", "graph_key")
        rows = rows if "graph_key" in rows.columns else rows.join(scope.join(keys, "view_id").select(F.col("relationship_id").alias("id"), "graph_key").distinct(), "id")
        scope = scope.join(keys, "view_id")
        key = ["graph_key"]
    new = rows.join(graph.relationships.select(*key, "id"), [*key, "id"], "left_anti").select(graph.relationships.columns)
    told = rows.select(*key, F.col("id").alias("relationship_id"), F.posexplode(F.array("source_id", "target_id")).alias("place", "element_id"))
    step = F.struct(F.col("step") if "step" in scope.columns else F.lit(0), "place").alias("step")
    ends = scope.join(told, [*key, "relationship_id"]).select(*key, "view_id", "element_id", step)
    return replace(
        graph,
        relationships=graph.relationships.unionByName(new),
        view_elements=_appended(graph.view_elements, ends, key, "element_id"),
        view_relationships=_appended(graph.view_relationships, scope, key, "relationship_id"),
    )


def remove_relationships(graph: Graph, ids: DataFrame) -> Graph:
    """Without relationships; ends that no other link of a view uses leave it."""
    key = _key(graph, ids)
    return take_relationships(graph, graph.view_relationships.join(ids.select(*key, F.col("id").alias("relationship_id")), [*key, "relationship_id"], "left_semi"), ids)


def take_relationships(graph: Graph, scope: DataFrame, ids: DataFrame) -> Graph:
    """Take relationships out of views (view_id, relationship_id). Their ends leave
    a view if no link left in it uses them; of ``ids``, those in no view go."""
    key = _key(graph, scope, ids)
    at = [*key, "view_id"]
    left = _without(graph.view_relationships, scope, [*at, "relationship_id"])
    # All links meet the drawn ones once, before their two ends become rows.
    drawn = scope.select(*at, "relationship_id", F.lit(True).alias("goes")).unionAll(left.select(*at, "relationship_id", F.lit(False)))
    drawn = drawn.join(graph.relationships.select(*key, F.col("id").alias("relationship_id"), "source_id", "target_id"), [*key, "relationship_id"])
    ends = drawn.select(*at, "goes", F.explode(F.array("source_id", "target_id")).alias("element_id"))
    drop = ends.groupBy(*at, "element_id").agg(F.bool_and("goes").alias("goes")).filter("goes").drop("goes")
    gone = ids.select(*key, "id").join(left.select(*key, F.col("relationship_id").alias("id")), [*key, "id"], "left_anti")
    return replace(graph, relationships=_without(graph.relationships, gone, [*key, "id"]), view_elements=_without(graph.view_elements, drop, [*at, "element_id"]), view_relationships=left)


def update_rows(table: DataFrame, patch: DataFrame, on: list[str]) -> DataFrame:
    """A table with a patch's fields where they are not null."""
    fields = [c for c in patch.columns if c in table.columns and c not in on]
    new = patch.select(*on, *[F.col(c).alias(f"patch_{c}") for c in fields])
    return table.join(new, on, "left").select([F.coalesce(f"patch_{c}", c).alias(c) if c in fields else F.col(c) for c in table.columns])


def update_relationships(graph: Graph, patch: DataFrame) -> Graph:
    """Patch relationships (id and fields): new ends join the views of the link,
    old ones leave those where no other link uses them."""
    key = _key(graph, patch)
    at = [*key, "view_id"]
    rels = update_rows(graph.relationships, patch, [*key, "id"])
    mine = patch.select(*key, F.col("id").alias("relationship_id")).distinct()
    seen = graph.view_relationships.join(mine, [*key, "relationship_id"], "left_semi").select(*at, "relationship_id")
    now = _ends(replace(graph, relationships=rels), key)
    old = seen.join(_ends(graph, key), [*key, "relationship_id"]).select(*at, "element_id").distinct()
    used = graph.view_relationships.join(now, [*key, "relationship_id"]).select(*at, "element_id").distinct()
    held = _appended(graph.view_elements, seen.join(now, [*key, "relationship_id"]).select(*at, "element_id"), key, "element_id")
    return replace(graph, relationships=rels, view_elements=_without(held, old.join(used, [*at, "element_id"], "left_anti"), [*at, "element_id"]))


def add_views(graph: Graph, rows: DataFrame) -> tuple[Graph, DataFrame]:
    """New views, and refused ones (id, reason): their ids are taken."""
    at = [*shared_key(graph.views, rows), "view_id"]
    refused = rows.join(graph.views.select(*at), at, "left_semi").select(*at[:-1], F.col("view_id").alias("id"), F.lit("view exists").alias("reason"))
    new = rows.join(graph.views.select(*at), at, "left_anti").select(graph.views.columns)
    return replace(graph, views=graph.views.unionByName(new)), refused


def remove_views(graph: Graph, ids: DataFrame) -> Graph:
    at = [*_key(graph, ids), "view_id"]
    return replace(graph, views=_without(graph.views, ids, at), view_elements=_without(graph.view_elements, ids, at), view_relationships=_without(graph.view_relationships, ids, at))


def rename_views(graph: Graph, names: DataFrame) -> Graph:
    """Give views new ids (view_id, new_id) in all tables."""
    at = [*_key(graph, names), "view_id"]

    def moved(t: DataFrame) -> DataFrame:
        return t.join(names.select(*at, "new_id"), at, "left").withColumn("view_id", F.coalesce("new_id", "view_id")).select(t.columns)

    return replace(graph, views=moved(graph.views), view_elements=moved(graph.view_elements), view_relationships=moved(graph.view_relationships))


# A batch of mutations in order, as one request of a user makes it.

#: A batch's columns besides seq, type, id and view_ids.
FIELDS = ["kind", "name", "description", "parent", "source_id", "target_id", "parent_element_id"]
BATCH = "seq long, type string, id string, kind string, name string, description string, parent string, source_id string, target_id string, parent_element_id string, view_ids array<string>"
_TABLES = ("elements", "relationships", "views", "view_elements", "view_relationships")
TYPES = [f"{verb}{what}" for what in ("Element", "Relationship", "View") for verb in ("add", "update", "remove")]


def _runs(batch: DataFrame, tables: Rounds) -> tuple[DataFrame, list[tuple[int, int, str]]]:
    """The batch with ``stretch`` and ``turn``, and (stretch, turn, type) in order.

    A stretch is all successive steps of one type; a turn of it has each id once.
    Steps of one type and different ids give the same rows in any order, so turns may
    run one after the other. The driver sees one row a stretch and range of steps.
    """
    here = Window.partitionBy("range_no").orderBy("seq")
    dealt = tables.save(batch.repartitionByRange("seq").withColumn("range_no", F.spark_partition_id()))
    opens = F.when(F.col("type").eqNullSafe(F.lag("type").over(here)) & (F.row_number().over(here) > 1), 0).otherwise(1)
    dealt = dealt.withColumn("opens", opens).withColumn("part", F.sum("opens").over(here)).drop("opens")
    parts = dealt.groupBy("range_no", "part").agg(F.min("seq").alias("low"), F.first("type").alias("type")).orderBy("low").collect()
    named, kind, n = [], None, 0
    for p in parts:
        n += not named or p["type"] != kind
        kind = p["type"]
        named.append((p["range_no"], p["part"], n))
    names = batch.sparkSession.createDataFrame(named, "range_no int, part long, stretch long")
    nth = F.row_number().over(Window.partitionBy("stretch", "id").orderBy("seq"))
    # Repeated adds of an element join one turn, as their memberships keep the order of steps.
    turn = F.when(F.col("type") == "addElement", 1).otherwise(nth)
    placed = tables.save(dealt.join(names, ["range_no", "part"]).withColumn("nth", nth).withColumn("turn", turn).drop("range_no", "part"))
    runs = placed.groupBy("stretch", "turn").agg(F.first("type").alias("type")).collect()
    return placed, sorted((r["stretch"], r["turn"], r["type"] or "") for r in runs)


def _shaped(rows: DataFrame, table: DataFrame, names: dict[str, str]) -> DataFrame:
    """A batch's rows as rows of a table; what they lack is null."""
    have = {**{c: c for c in rows.columns}, **names}
    return rows.select(*[F.col(have[c]).cast(t).alias(c) if c in have else F.lit(None).cast(t).alias(c) for c, t in table.dtypes])


def part(graph: Graph, batch: DataFrame) -> tuple[Graph, DataFrame, DataFrame]:
    """The part of a graph that a batch can change, and the other elements and relationships.

    Elements are those that the batch names. Relationships are those that it names, those
    of elements that it removes, and those drawn in the views that it names or in which its
    relationships are drawn. All rows of an id are in one part. Views and members are whole.
    """
    tables = Rounds(batch.sparkSession)
    of = lambda what: batch.filter(F.col("type").endswith(what)).select("id")
    named = tables.save(of("Relationship").distinct())
    drawn = graph.view_relationships.select("view_id", F.col("relationship_id").alias("id"))
    seen = batch.select(F.explode("view_ids").alias("view_id")).unionAll(drawn.join(named, "id", "left_semi").select("view_id")).distinct()
    ids = tables.save(named.unionAll(drawn.join(seen, "view_id", "left_semi").select("id")).distinct())
    gone = tables.save(batch.filter("type = 'removeElement'").select("id").distinct())

    def split(table: DataFrame, marks: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
        rows = table
        for n, (column, rows_of) in enumerate(marks.items()):
            rows = rows.join(rows_of.select(F.col("id").alias(column), F.lit(True).alias(f"mark_{n}")), column, "left")
        hit = F.coalesce(*[F.col(f"mark_{n}") for n in range(len(marks))], F.lit(False))
        return tables.save(rows.filter(hit).select(table.columns)), rows.filter(~hit).select(table.columns)

    elements, other = split(graph.elements, {"id": tables.save(of("Element").distinct())})
    relationships, rest = split(graph.relationships, {"id": ids, "source_id": gone, "target_id": gone})
    return replace(graph, elements=elements, relationships=relationships), other, rest


def apply_batch(graph: Graph, batch: DataFrame, limit: int | None = None) -> tuple[Graph, DataFrame, DataFrame]:
    """The graph after a batch, as ``apply_to_part`` says it, with the rows that the
    batch cannot change: these are neither shuffled nor written."""
    near, elements, relationships = part(graph, batch)
    after, touched, refused = apply_to_part(near, batch, limit)
    if after is near:
        return graph, touched, refused
    whole = replace(after, elements=elements.unionByName(after.elements), relationships=relationships.unionByName(after.relationships))
    return whole, touched, refused


def apply_to_part(graph: Graph, batch: DataFrame, limit: int | None = None) -> tuple[Graph, DataFrame, DataFrame]:
    """The graph after a batch (``BATCH``, of one graph) of the nine types in
    order, (kind, id) of what it touched, and (seq, id, reason) of refusals. With
    one refusal nothing is applied. A view that the batch makes larger is refused
    (seq: null) if it then has more than ``limit`` elements.

    ``kind`` is the type of a new element or relationship; updates may not give
    one. Fields that are null stay as they are. Stretches of one type are applied
    as joins, however many rows they have; the tables that they change are written
    after each. New members of views stand in the order of steps.
    """
    tables, first, key = Rounds(batch.sparkSession), graph, _key(graph)
    placed, runs = _runs(batch, tables)
    one = graph.views.select(*key).distinct() if key else None  # a batch is of one graph
    refusals, touched = [], []
    for stretch, turn, kind in runs:
        rows = placed.filter((F.col("stretch") == stretch) & (F.col("turn") == turn))
        rows = rows.crossJoin(F.broadcast(one)) if key else rows
        scope = rows.select(*key, "seq", "id", F.explode("view_ids").alias("view_id"))
        what = kind[len("update") :] if kind.startswith("update") else kind[len("remove") :] if kind.startswith("remove") else kind[len("add") :]
        owner, column = {"Element": (graph.elements, "id"), "Relationship": (graph.relationships, "id"), "View": (graph.views, "view_id")}.get(what, (graph.views, "view_id"))
        known = owner.select(*key, F.col(column).alias("id")).distinct()
        say = lambda found, reason: refusals.append(found.select("seq", "id", F.lit(reason).alias("reason")))  # noqa: B023, E731
        if kind not in TYPES:
            say(rows, "unsupported type")
            continue
        if kind == "addView":
            say(rows.join(known, [*key, "id"], "left_semi"), "view exists")
        elif not kind.startswith("add"):
            say(rows.join(known, [*key, "id"], "left_anti"), "does not exist")
        if kind in ("updateElement", "updateRelationship"):
            say(rows.filter("kind is not null"), "type cannot be updated")
        if kind in ("addElement", "addRelationship"):
            say(rows.filter("coalesce(size(view_ids), 0) < 1"), "needs a view")
        say(scope.join(graph.views.select(*key, "view_id"), [*key, "view_id"], "left_anti"), "view does not exist")
        touched.append(rows.select(*key, F.lit(what).alias("kind"), "id"))
        before = graph
        places = scope.select(*key, "view_id", F.col("id").alias(f"{what.lower()}_id"), F.col("seq").alias("step"))
        ids = rows.select(*key, "id")
        if kind == "addElement":
            graph = add_elements(graph, _shaped(rows.filter("nth = 1").withColumn("ord", F.lit(1 << 50) + F.col("seq")), graph.elements, {"type": "kind"}), places)
        elif kind == "updateElement":
            graph = replace(graph, elements=update_rows(graph.elements, rows.select(*key, "id", "name", "description", "parent"), [*key, "id"]))
            names = rows.filter("name is not null").select(*key, F.col("id").alias("parent_element_id"), F.col("name").alias("parent_element_name"))
            graph = replace(graph, views=update_rows(graph.views, names, [*key, "parent_element_id"]))
        elif kind == "removeElement":
            say(rows.join(graph.views.select(*key, F.col("parent_element_id").alias("id")), [*key, "id"], "left_semi"), "child views exist")
            rels = _ends(graph, key).join(ids.withColumnRenamed("id", "element_id"), [*key, "element_id"], "left_semi")
            touched.append(rels.select(*key, F.lit("Relationship").alias("kind"), F.col("relationship_id").alias("id")))
            whole = rows.filter("view_ids is null").select(*key, F.col("id").alias("element_id"))
            held = graph.view_elements.join(whole, [*key, "element_id"], "left_semi").select(*key, "view_id", "element_id")
            drawn = graph.view_relationships.join(_ends(graph, key).join(whole, [*key, "element_id"], "left_semi"), [*key, "relationship_id"]).select(*key, "view_id", "element_id")
            alone = whole.select(*key, F.lit(None).cast("string").alias("view_id"), "element_id")
            graph = remove_from_views(graph, places.drop("step").unionByName(held).unionByName(drawn).unionByName(alone).distinct())
        elif kind == "addRelationship":
            graph = add_relationships(graph, _shaped(rows.withColumn("ord", F.lit(1 << 50) + F.col("seq")), graph.relationships, {"type": "kind"}), places)
        elif kind == "updateRelationship":
            graph = update_relationships(graph, rows.select(*key, "id", "name", "description", "source_id", "target_id"))
        elif kind == "removeRelationship":
            shown = graph.view_relationships.select(*key, "view_id", "relationship_id")
            whole = shown.join(rows.filter("view_ids is null").select(*key, F.col("id").alias("relationship_id")), [*key, "relationship_id"], "left_semi")
            graph = take_relationships(graph, places.drop("step").unionByName(whole).select(*key, "view_id", "relationship_id"), ids)
        elif kind == "addView":
            graph, _ = add_views(graph, _shaped(rows.withColumn("ord", F.lit(1 << 50) + F.col("seq")), graph.views, {"view_id": "id", "view_name": "name"}))
        elif kind == "updateView":
            patch = rows.select(*key, F.col("id").alias("view_id"), F.col("name").alias("view_name"), "parent_element_id")
            graph = replace(graph, views=update_rows(graph.views, patch, [*key, "view_id"]))
        else:
            graph = remove_views(graph, ids.withColumnRenamed("id", "view_id"))
        changed = {t: tables.save(getattr(graph, t)) for t in _TABLES if getattr(graph, t) is not getattr(before, t)}
        graph = replace(graph, **changed)
    if limit is not None:
        size = lambda g, n: g.view_elements.groupBy(*key, "view_id").agg(F.count(F.lit(1)).alias(n))
        grown = size(graph, "n").filter(F.col("n") > limit).join(size(first, "was"), [*key, "view_id"], "left").filter("n > coalesce(was, 0)")
        refusals.append(grown.select(F.lit(None).cast("long").alias("seq"), F.col("view_id").alias("id"), F.lit(f"more than {limit} elements").alias("reason")))
    none = batch.select("seq", "id", F.lit("").alias("reason")).limit(0)
    refused = tables.save(reduce(DataFrame.unionAll, refusals, none).distinct())
    stop = not refused.isEmpty()
    seen = tables.save(reduce(DataFrame.unionAll, touched).distinct()) if touched and not stop else None
    if seen is None:
        seen = batch.select(*([F.lit("").alias("graph_key")] if key else []), F.lit("").alias("kind"), "id").limit(0)
    return (first if stop else graph), seen, refused


def changes(before: Graph, after: Graph) -> DataFrame:
    """(kind, id, change) of elements, relationships and views that came or went."""
    key, out = _key(before), []
    for kind, table, column in (("element", "elements", "id"), ("relationship", "relationships", "id"), ("view", "views", "view_id")):
        a, b = (getattr(g, table).select(*key, F.col(column).alias("id")).distinct() for g in (before, after))
        for new, old, change in ((b, a, "created"), (a, b, "removed")):
            out.append(new.join(old, [*key, "id"], "left_anti").select(*key, F.lit(kind).alias("kind"), "id", F.lit(change).alias("change")))
    return reduce(DataFrame.unionAll, out)


def subdiagrams(views: DataFrame) -> DataFrame:
    """(id, subdiagram_views): what elements' lists should be, from views' parents."""
    return views.filter("parent_element_id is not null").groupBy(*shared_key(views), F.col("parent_element_id").alias("id")).agg(F.array_sort(F.collect_set(F.struct("view_id", "view_name"))).alias("subdiagram_views"))


def subdiagram_repairs(elements: DataFrame, views: DataFrame) -> DataFrame:
    """(id, was, wanted) of elements whose lists differ from ``subdiagrams``.
    ``elements`` has id and subdiagram_views."""
    key = shared_key(elements, views)
    at = [*key, "id"]
    none = F.array().cast("array<struct<view_id:string,view_name:string>>")
    was = elements.select(*at, F.array_sort(F.coalesce("subdiagram_views", none)).alias("was"))
    wanted = subdiagrams(views).select(*at, F.col("subdiagram_views").alias("wanted"))
    out = was.join(wanted, at, "left").withColumn("wanted", F.coalesce("wanted", none))
    return out.filter("was <> wanted")


def missing_subdiagrams(elements: DataFrame, views: DataFrame) -> DataFrame:
    """(view_id, view_name, parent_element_id) of declared views that don't exist."""
    key = shared_key(elements, views)
    told = elements.select(*key, F.col("id").alias("parent_element_id"), F.explode("subdiagram_views").alias("v")).select(*key, "v.view_id", "v.view_name", "parent_element_id")
    return told.join(views.select(*key, "view_id"), [*key, "view_id"], "left_anti")


def inverse(before: DataFrame, after: DataFrame, fields: list[str]) -> DataFrame:
    """The log (seq, type, id, fields) that takes ``after`` back to ``before``."""
    at = [*shared_key(before, after), "id"]
    a, b = before.select(*at, F.struct(*fields).alias("a")), after.select(*at, F.struct(*fields).alias("b"))
    both = a.join(b, at, "full_outer").filter("not (a <=> b)")
    kind = F.when(F.col("b").isNull(), "add").when(F.col("a").isNull(), "remove").otherwise("update")
    return both.select(F.lit(0).cast("long").alias("seq"), kind.alias("type"), *at, *[F.col(f"a.{f}").alias(f) for f in fields])
