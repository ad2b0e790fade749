"""Queries of stored state over the star schema: backfills, an index under deltas, snapshots."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagraph.operators import records, resolve
from stratagraph.operators.backfill import Backfill
from stratagraph.plans.fixpoint import Rounds
from stratagraph.queries import query
from stratagraph.sources import index_store, projection, star
from stratagraph.sources.snapshots import Snapshots

# A backfill of all vectors. The provider fails for every seventh record at first (without
# a row for every 35th), and for every 21st again.


def _backfill(spark, d) -> Backfill:
    vectors = star.semantic_records(spark, d)

    def provider(batch: DataFrame) -> DataFrame:
        rows = batch.join(vectors.select("canonical_identity", "vector", "ord"), "canonical_identity").filter("not (attempt = 1 and ord % 35 = 0)")
        fails = F.col("ord") % F.when(F.col("attempt") == 1, 7).otherwise(21) == 0
        return rows.select("canonical_identity", F.when(~fails, F.col("vector")).alias("vector"), F.when(fails, F.when(F.col("attempt") == 1, "RATE_LIMITED").otherwise("TIMEOUT")).alias("category"))

    wanted = vectors.select("canonical_identity", "channel", F.concat(F.lit("content:"), F.col("ord").cast("string")).alias("content_version"))
    fill = Backfill(wanted, f"{Rounds(spark).root}/backfill", "canonical:1", batches=4)
    fill.run(provider)
    return fill


@query("""SELECT canonical_identity, channel, CASE WHEN ord % 21 = 0 THEN 'TIMEOUT' WHEN ord % 35 = 0 THEN 'PROVIDER_RECORD_FAILED' ELSE 'RATE_LIMITED' END AS category,
  CASE WHEN ord % 21 = 0 THEN 2 ELSE 1 END AS attempt FROM records WHERE ord % 7 = 0""")
def backfill_failures(spark, d):
    return _backfill(spark, d).failures().select("canonical_identity", "channel", "category", "attempt")


@query("""SELECT channel, count(*) AS total, count(*) FILTER (ord % 21 <> 0) AS completed, count(*) FILTER (ord % 7 = 0) + count(*) FILTER (ord % 21 = 0) AS retries,
  count(*) FILTER (ord % 21 = 0) AS failed, CASE WHEN bool_or(ord % 21 = 0) THEN 'partial' ELSE 'complete' END AS status FROM records GROUP BY channel""")
def backfill_progress(spark, d):
    return _backfill(spark, d).progress()


# An index of all objects under a delta: every tenth customer is changed, every seventh
# supplier goes, some objects are new. The index misses the change of every hundredth customer.


def _objects(spark, d) -> DataFrame:
    row = lambda t, channel, id_, text: t.select(F.concat(F.lit(f"{channel}:"), F.col(id_)).alias("canonical_identity"), F.lit(channel).alias("channel"), F.col(text).alias("content_version"))
    parts = [row(star.elements(spark, d), "Element", "id", "name"), row(star.links(spark, d), "ArchitectureRelationship", "id", "type"), row(star.views(spark, d), "View", "view_id", "view_name")]
    return reduce(DataFrame.unionAll, parts)


def _delta(spark, d) -> tuple[DataFrame, DataFrame]:
    """Upserts with the number of their customer (null: another object), and tombstones."""
    t = lambda n: star.table(spark, d, n)
    changed = t("customer").filter("c_custkey % 10 = 0").selectExpr("concat('Element:customer-', c_custkey) AS canonical_identity", "'Element' AS channel", "concat('new ', c_name) AS content_version", "c_custkey AS k")
    new = t("part").filter("p_partkey % 50 = 0").selectExpr("concat('View:extra-', p_partkey)", "'View'", "p_name", "cast(NULL as long)")
    gone = t("supplier").filter("s_suppkey % 7 = 0").selectExpr("concat('Element:supplier-', s_suppkey) AS canonical_identity")
    return changed.unionAll(new), gone


def _kept_index(spark, d) -> tuple[DataFrame, index_store.IndexStore]:
    """The expected summary and the index, both after the delta."""
    tables = Rounds(spark)
    store = index_store.IndexStore(spark, f"{tables.root}/index", 16)
    store.create(_objects(spark, d))
    expected = tables.save(store.summary())
    upserts, gone = _delta(spark, d)
    told, here = upserts.drop("k"), upserts.filter("k % 100 <> 0 OR k IS NULL").drop("k")
    old = store.find(told.select("canonical_identity").unionByName(gone))
    expected = tables.save(index_store.moved(expected, old, told, store.parts))
    store.apply(here, gone)
    return expected, store


_AFTER = """,
objects AS (
  SELECT 'Element:' || id AS canonical_identity, 'Element' AS channel, name AS content_version FROM elements
  UNION ALL SELECT 'ArchitectureRelationship:' || id, 'ArchitectureRelationship', type FROM links UNION ALL SELECT 'View:' || view_id, 'View', view_name FROM views),
after AS (
  SELECT canonical_identity, channel, CASE WHEN c_custkey % 10 = 0 THEN 'new ' || c_name ELSE content_version END AS content_version, c_custkey % 100 = 0 AS missed, content_version AS was
  FROM objects LEFT JOIN customer ON canonical_identity = 'Element:customer-' || c_custkey
  WHERE canonical_identity NOT IN (SELECT 'Element:supplier-' || s_suppkey FROM supplier WHERE s_suppkey % 7 = 0)
  UNION ALL SELECT 'View:extra-' || p_partkey, 'View', p_name, false, NULL FROM part WHERE p_partkey % 50 = 0)
"""


@query(_AFTER + "SELECT canonical_identity, channel, CASE WHEN missed THEN was ELSE content_version END AS content_version FROM after")
def index_after_delta(spark, d):
    return _kept_index(spark, d)[1].records().drop("part")


@query(_AFTER + "SELECT channel, count(*) AS n_expected, count(*) AS n_actual, NOT coalesce(bool_or(missed), false) AS coherent FROM after GROUP BY channel")
def index_coherence(spark, d):
    expected, store = _kept_index(spark, d)
    return index_store.coherence(expected, store.summary()).drop("parts_off")


# Snapshots of the graph: the first as it is, the second without every other supplier and
# with customers renamed, the third without views' members; then the second is restored.


def _snapshots(spark, d) -> Snapshots:
    g = star.graph(spark, d)
    k = F.regexp_extract("id", "([0-9]+)$", 1).cast("long")
    second = g.elements.filter(~((F.col("type") == "Business Role") & (k % 2 == 0))).withColumn("name", F.when(F.col("type") == "Business Actor", F.concat("name", F.lit(" (2)"))).otherwise(F.col("name")))
    kept = Snapshots(spark, f"{Rounds(spark).root}/snapshots", keep=3)
    kept.save(g, "2024-01-01 00:00:00")
    stored = kept.as_of()  # what stays is copied from the first version, not made again
    kept.save(replace(stored, elements=second), "2024-02-01 00:00:00")
    kept.save(replace(stored, view_elements=g.view_elements.limit(0)), "2024-03-01 00:00:00")
    return kept


_SECOND = "SELECT id, CASE WHEN type = 'Business Actor' THEN name || ' (2)' ELSE name END AS name, type FROM elements WHERE type <> 'Business Role' OR regexp_extract(id, '([0-9]+)$', 1)::BIGINT % 2 <> 0"


@query(_SECOND)
def snapshot_as_of(spark, d):
    return _snapshots(spark, d).as_of("2024-02-15 00:00:00").elements.select("id", "name", "type")


@query(f"""SELECT 'element' AS kind, id, name AS text FROM ({_SECOND}) UNION ALL SELECT 'member', view_id, element_id FROM view_elements
  UNION ALL SELECT 'version', 'star', v FROM (VALUES ('2'), ('3'), ('4')) t(v)""")
def snapshot_restored(spark, d):
    kept = _snapshots(spark, d)
    kept.restore(kept.versions().filter("version = 2"))
    now = kept.as_of()
    versions = kept.versions().select(F.lit("version").alias("kind"), F.col("graph_key").alias("id"), F.col("version").cast("string").alias("text"))
    return now.elements.select(F.lit("element").alias("kind"), "id", F.col("name").alias("text")).unionByName(now.view_elements.select(F.lit("member").alias("kind"), F.col("view_id").alias("id"), F.col("element_id").alias("text"))).unionByName(versions)


@query("""SELECT 'element' AS kind, id, name AS text FROM elements WHERE type <> 'Business Role'
  UNION ALL SELECT 'view', view_id, view_name FROM views UNION ALL SELECT 'member', view_id, element_id FROM view_elements WHERE element_id NOT LIKE 'supplier-%'""")
def projection_rewritten(spark, d):
    """A graph written again without its suppliers, relationships and drawn relationships."""
    path, g = f"{Rounds(spark).root}/projection", star.graph(spark, d)
    projection.write_projection(g, path)
    less = g.elements.filter("type <> 'Business Role'")
    projection.write_projection(replace(g, elements=less, relationships=g.relationships.limit(0), view_elements=g.view_elements.filter("element_id not like 'supplier-%'"), view_relationships=g.view_relationships.limit(0)), path)
    now = projection.read_projection(spark, path)
    row = lambda t, kind, a, b: t.select(F.lit(kind).alias("kind"), F.col(a).alias("id"), F.col(b).alias("text"))
    members = [row(now.view_elements, "member", "view_id", "element_id"), row(now.relationships, "relationship", "id", "type"), row(now.view_relationships, "drawn", "view_id", "relationship_id")]
    return reduce(DataFrame.unionAll, members, row(now.elements, "element", "id", "name").unionAll(row(now.views, "view", "view_id", "view_name")))


# Records with planted faults, by their number.


def _faulty(spark, d) -> DataFrame:
    r = star.semantic_records(spark, d)
    fault = lambda n, x, other: F.when(F.col("ord") % n == 0, x).otherwise(other)
    return r.select(
        "ord", fault(11, F.lit("  "), F.col("canonical_identity")).alias("canonical_identity"), fault(13, F.lit("Other"), F.col("channel")).alias("channel"), *[F.lit("1").alias(c) for c in ("canonical_version", "content_version", "index_version", "provider")],
        fault(23, F.lit("other"), F.lit("m")).alias("model"), F.lit("1").alias("model_version"), fault(17, F.lit(0), F.size("vector")).alias("dimensions"),
        fault(19, F.concat(F.slice("vector", 1, F.size("vector") - 1), F.array(F.lit(None).cast("double"))), F.col("vector")).alias("vector"), fault(29, F.lit("run"), F.lit(None)).alias("run_id"),
    )


@query("""SELECT ord, array_to_string(list_filter([
  CASE WHEN ord % 11 = 0 THEN 'canonical_identity is blank' END, CASE WHEN ord % 13 = 0 THEN 'unknown channel' END, CASE WHEN ord % 17 = 0 THEN 'bad dimensions' END,
  CASE WHEN ord % 17 = 0 OR ord % 19 = 0 THEN 'bad vector' END, CASE WHEN ord % 17 = 0 OR ord % 23 = 0 THEN 'other profile' END, CASE WHEN ord % 29 = 0 THEN 'run id' END], lambda x: x IS NOT NULL), ', ') AS reasons
  FROM records WHERE ord % 11 = 0 OR ord % 13 = 0 OR ord % 17 = 0 OR ord % 19 = 0 OR ord % 23 = 0 OR ord % 29 = 0""")
def records_quarantined(spark, d):
    rows = _faulty(spark, d)
    size = len(rows.select("vector").first()["vector"])
    profile = {"provider": "1", "model": "m", "model_version": "1", "dimensions": size}
    bad = records.quarantine(records.checked(rows, profile), f"{Rounds(spark).root}/checked")[1]
    return bad.select("ord", F.array_join("reasons", ", ").alias("reasons"))


# Requests for all elements: by id, by an id that is not there, by name, by a name that is
# not there. Customers are named by their market segment, so these names are shared.


@query(""",
e AS (SELECT ord, id, type, CASE WHEN type = 'Business Actor' THEN description ELSE name END AS name FROM elements),
q AS (SELECT id AS request_id, CASE ord % 4 WHEN 0 THEN id WHEN 1 THEN id || '-gone' END AS by_id, CASE ord % 4 WHEN 2 THEN name WHEN 3 THEN name || CASE WHEN ord % 3 = 0 THEN ' gone' ELSE '' END END AS by_name FROM e),
n AS (SELECT name, count(*) AS n, min(id) AS one, list(id ORDER BY ord) AS ids FROM e GROUP BY name),
a AS (SELECT q.*, CASE WHEN by_id IS NOT NULL THEN CASE WHEN i.id IS NULL THEN 0 ELSE 1 END ELSE coalesce(n.n, 0) END AS m, i.id AS hit, one, ids FROM q LEFT JOIN e i ON i.id = q.by_id LEFT JOIN n ON n.name = q.by_name)
SELECT request_id, CASE WHEN m = 1 THEN 'passed' WHEN m > 1 THEN 'ambiguous' ELSE 'failed' END AS status, CASE WHEN m = 1 THEN coalesce(hit, one) END AS element_id, m::BIGINT AS n_matches,
  CASE WHEN m > 1 THEN array_to_string(ids[1:20], ',') ELSE '' END AS candidates FROM a""")
def resolve_elements(spark, d):
    e = star.elements(spark, d).withColumn("name", F.when(F.col("type") == "Business Actor", F.col("description")).otherwise(F.col("name")))
    kind = F.col("ord") % 4
    by_id = F.when(kind == 0, F.col("id")).when(kind == 1, F.concat("id", F.lit("-gone")))
    by_name = F.when(kind == 2, F.col("name")).when(kind == 3, F.concat("name", F.when(F.col("ord") % 3 == 0, " gone").otherwise("")))
    out = resolve.resolve(e.select("graph_key", F.col("id").alias("request_id"), by_id.alias("element_id"), by_name.alias("element_name")), e)
    return out.select("request_id", "status", "element_id", "n_matches", F.array_join(F.transform("candidates", lambda c: c["id"]), ",").alias("candidates"))
