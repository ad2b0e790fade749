"""Stored state: broken-off backfills, an index under random deltas, snapshots of graphs."""

import random

import pytest
from pyspark.sql import functions as F

from stratagraph.operators.backfill import Backfill, merge_failures
from stratagraph.sources import steps
from stratagraph.sources.documents import Graph
from stratagraph.sources.index_store import IndexStore, coherence, coherent, moved, summaries, touched_records
from stratagraph.sources.snapshots import Snapshots, capped

ID = "canonical_identity string, channel string, content_version string"


def wanted(spark, n=12):
    return spark.createDataFrame([(f"Element:{k}", "Element", f"c{k}") for k in range(n)], ID)


def provider(batch):
    """Every third fails at first, 0 and 6 always; nothing is said of 9 at first."""
    k = F.regexp_extract("canonical_identity", "([0-9]+)$", 1).cast("int")
    fails = (k % 6 == 0) | ((k % 3 == 0) & (F.col("attempt") == 1))
    rows = batch.filter(~((k == 9) & (F.col("attempt") == 1)))
    return rows.select("canonical_identity", F.when(~fails, F.array(k.cast("double"))).alias("vector"), F.when(fails, F.concat(F.lit("try "), "attempt")).alias("category"))


def state(fill):
    return (
        sorted(tuple(r) for r in fill.records().select("canonical_identity", "vector", "attempt").collect()),
        sorted(tuple(r) for r in fill.attempts().select("canonical_identity", "category", "attempt").collect()),
    )


EXPECTED = (
    sorted((f"Element:{k}", [float(k)], 2 if k % 3 == 0 else 1) for k in range(12) if k % 6),
    sorted([(f"Element:{k}", "PROVIDER_RECORD_FAILED" if k == 9 else "try 1", 1) for k in (0, 3, 6, 9)] + [(f"Element:{k}", "try 2", 2) for k in (0, 6)]),
)


@pytest.mark.parametrize("at", range(1, 7))
def test_a_run_that_breaks_off_goes_on(spark, tmp_path, monkeypatch, at):
    """Each write of the first three steps fails once, before and after it is done."""
    fill, writes, write = Backfill(wanted(spark), str(tmp_path), "v1", batches=2), [], steps.Steps.write

    def broken(self, table, step, rows):
        writes.append(step)
        if len(writes) == at and at % 2:
            raise OSError("before")
        write(self, table, step, rows)
        if len(writes) == at:
            raise OSError("after")

    monkeypatch.setattr(steps.Steps, "write", broken)
    with pytest.raises(OSError):
        fill.run(provider)
    monkeypatch.setattr(steps.Steps, "write", write)
    Backfill(wanted(spark), str(tmp_path), "v1", batches=2).run(provider, attempts=2)
    got = state(fill)
    # A finished first attempt counts, so the second run may try once more what fails for good.
    assert got[0] == EXPECTED[0]
    assert {x for x in got[1] if x[2] < 3} == set(EXPECTED[1]) and len(got[1]) == len(set(got[1]))


def test_progress_versions_and_edits(spark, tmp_path):
    fill = Backfill(wanted(spark), str(tmp_path), "v1", batches=3)
    assert [(r["completed"], r["status"]) for r in fill.progress().collect()] == [(0, "pending")]
    (r,) = fill.run(provider).collect()
    assert (r["total"], r["completed"], r["retries"], r["failed"], r["status"]) == (12, 10, 6, 2, "partial")
    assert state(fill) == EXPECTED
    assert {r["canonical_identity"]: r["category"] for r in fill.failures().collect()} == {"Element:0": "try 2", "Element:6": "try 2", "Element:3": "try 1", "Element:9": "PROVIDER_RECORD_FAILED"}
    other = Backfill(wanted(spark), str(tmp_path), "v2")
    assert other.records().isEmpty() and other.pending().count() == 12
    edited = wanted(spark).withColumn("content_version", F.when(F.col("canonical_identity") == "Element:1", "new").otherwise(F.col("content_version")))
    assert [r[0] for r in Backfill(edited, str(tmp_path), "v1").pending().filter("canonical_identity not in ('Element:0', 'Element:6')").collect()] == ["Element:1"]
    assert merge_failures(fill.attempts().limit(0)).count() == 0


def test_summaries_follow_random_deltas(spark, tmp_path):
    """After each delta: the kept summary is that of all rows, and equals the index's."""
    rnd, parts = random.Random(5), 8
    row = lambda k, v, g: (g, f"{c}:{k}", c, f"v{v}") if (c := ("Element", "View", "ArchitectureRelationship")[k % 3]) else None
    schema = f"graph_key string, {ID}"
    now = {(g, k): row(k, 0, g) for g in "gh" for k in range(60)}
    frame = lambda rows: spark.createDataFrame(list(rows), schema)
    store = IndexStore(spark, str(tmp_path / "index"), parts)
    store.create(frame(now.values()))
    fixed = lambda df: spark.createDataFrame(df.collect(), df.schema)
    summary = fixed(summaries(frame(now.values()), parts))
    for n in range(1, 4):
        ups = {(g, k): row(k, n, g) for g, k in ((rnd.choice("gh"), rnd.randrange(90)) for _ in range(6))}
        out = {at: now[at] for at in rnd.sample(sorted(set(now) - set(ups)), 3)}
        up, gone = frame(ups.values()), frame(out.values()).select("graph_key", "canonical_identity")
        old = store.find(up.select("graph_key", "canonical_identity").unionByName(gone))
        summary = fixed(moved(summary, old, up, parts))
        touched = store.apply(up, gone)
        now = {at: r for at, r in (now | ups).items() if at not in out}
        full = summaries(frame(now.values()), parts)
        both = lambda df: sorted(tuple(r) for r in df.select(sorted(df.columns)).collect())
        assert both(summary) == both(full) == both(store.summary())
        assert both(store.records().drop("part")) == both(frame(now.values()))
        assert 0 < len(touched) <= parts
    assert [r["coherent"] for r in coherent(coherence(summary, store.summary())).collect()] == [True, True]
    lost = frame([next(iter(now.values()))]).select("graph_key", "canonical_identity")
    store.apply(frame([]), lost)
    assert sorted(r["coherent"] for r in coherent(coherence(summary, store.summary())).collect()) == [False, True]


def test_only_touched_partitions_are_read(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"), 16)
    store.create(wanted(spark, 200))
    one = spark.createDataFrame([("Element:7",)], "canonical_identity string")
    before = set(store.records().inputFiles())
    assert len(store.find(one).inputFiles()) == 1 and store.find(one).count() == 1
    assert len(store.apply(wanted(spark, 0), one)) == 1
    assert len(before & set(store.records().inputFiles())) == len(before) - 1
    found, missing = touched_records(wanted(spark), spark.createDataFrame([("Element:3",), ("Element:99",)], "canonical_identity string"))
    assert found.count() == 1 and [r[0] for r in missing.collect()] == ["Element:99"]


def graph(spark, **names):
    rows = [(g, f"{g}-{k}", n) for g, ns in names.items() for k, n in enumerate(ns)]
    return Graph(
        spark.createDataFrame(rows, "graph_key string, id string, name string"),
        *(spark.createDataFrame([], s) for s in ("graph_key string, id string", "graph_key string, view_id string", "graph_key string, view_id string, element_id string", "graph_key string, view_id string, relationship_id string")),
    )


def test_snapshots_of_graphs_with_versions_of_their_own(spark, tmp_path):
    kept = Snapshots(spark, str(tmp_path), keep=2)
    names = lambda g: {(r["graph_key"], r["name"]) for r in g.elements.collect()}
    kept.save(graph(spark, **{"007": ["a"], "h": ["x", "y"]}), "2024-01-01")
    kept.save(graph(spark, **{"007": ["b"]}), "2024-01-02")
    assert names(kept.as_of()) == {("007", "b"), ("h", "x"), ("h", "y")}
    assert names(kept.as_of("2024-01-01")) == {("007", "a"), ("h", "x"), ("h", "y")}
    assert names(kept.as_of("2023-01-01")) == set()
    kept.save(graph(spark, **{"007": ["c"]}), "2024-01-03")  # 007 has its newest two, h its one
    assert sorted((r["graph_key"], r["version"]) for r in kept.versions().collect()) == [("007", 2), ("007", 3), ("h", 1)]
    assert names(kept.as_of("2024-01-01")) == {("h", "x"), ("h", "y")}
    assert names(kept.restore(spark.createDataFrame([("007", 2)], "graph_key string, version long"))) == {("007", "b")}
    assert names(kept.as_of()) == {("007", "b"), ("h", "x"), ("h", "y")}
    kept.save(graph(spark, h=["z"]), "2024-01-05")
    kept.save(graph(spark, h=["q"]), "2024-01-06")
    kept.clean()
    folders = list((tmp_path / "data").iterdir())
    assert len(folders) == len({r["folder"] for r in kept.versions().collect()}) == 4  # nothing is left of what went


def test_undo_keeps_the_newest(spark):
    log = spark.createDataFrame([(g, k) for g, n in (("g", 7), ("h", 2)) for k in range(n)], "graph_key string, seq long")
    assert sorted(map(tuple, capped(log, 3).collect())) == [("g", 4), ("g", 5), ("g", 6), ("h", 0), ("h", 1)]


def test_a_restored_version_copies_nothing(spark, tmp_path):
    kept = Snapshots(spark, str(tmp_path), keep=2)
    for name in "abc":
        kept.save(graph(spark, g=[name]))
    before = {p.name for p in (tmp_path / "data").iterdir()}
    back = kept.restore(spark.createDataFrame([("g", 2)], "graph_key string, version long"))
    assert [r["name"] for r in back.elements.collect()] == ["b"]
    assert {p.name for p in (tmp_path / "data").iterdir()} <= before
    kept.save(graph(spark, g=["d"]))
    kept.clean()
    again = kept.version(spark.createDataFrame([("g", 4)], "graph_key string, version long"))
    assert [r["name"] for r in again.elements.collect()] == ["b"]  # its folder outlives version 2


def test_a_projection_with_the_same_rows_is_not_compared_by_ids(spark, tmp_path, monkeypatch):
    from stratagraph.sources import projection

    def compared(*_):
        raise AssertionError("compared by ids")

    monkeypatch.setattr(projection, "verify_projection", compared)
    assert projection.write_projection(graph(spark, g=["a", "b"], h=["a"]), str(tmp_path)).isEmpty()
    state = {r["graph_key"]: (r["dirty"], r["elements"], r["relationships"]) for r in projection.sync_state(spark, str(tmp_path)).collect()}
    assert state == {"g": (False, 2, 0), "h": (False, 1, 0)}
