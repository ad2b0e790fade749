import numpy as np
import pytest
from pyspark.sql import functions as F

from stratagraph.llm import lattice

SCHEMA = "vec_id long, embedding array<float>, label string, cls int, id string"


def expected(rows, threshold=0.9):
    good = [(i, np.array(v, np.float64)) for i, v in rows if v and all(x is not None for x in v) and np.isfinite(v).all() and any(v)]
    links, ids = {}, [i for i, _ in rows]
    for n in {len(v) for _, v in good}:
        some = [(i, v / np.linalg.norm(v)) for i, v in good if len(v) == n]
        units = np.stack([v for _, v in some])
        for a, b in np.argwhere(np.triu(units @ units.T >= threshold, 1)):
            i, j = some[a][0], some[b][0]
            links.setdefault(i, set()).add(j), links.setdefault(j, set()).add(i)
    out = []
    for i in ids:
        seen, todo = {i}, [i]
        while todo:
            for j in links.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j), todo.append(j)
        out.append((i, len(links.get(i, ())), min(seen), i == min(seen)))
    return sorted(out)


def run(df):
    return sorted(tuple(r) for r in lattice.similar_vectors(df).select("vec_id", "n_links", "component_id", "kept").collect())


def test_edges(spark):
    v = [1.0, 2.0, 3.0, 4.0]
    rows = [(1, None), (2, []), (3, [0.0] * 4), (4, [None, 1.0, 0.0, 0.0]), (5, [float("nan")] * 4), (6, [float("inf"), 0.0, 0.0, 0.0]), (7, v), (8, v), (9, [2 * x for x in v]), (10, [-x for x in v]), (11, v[:3]), (12, [1.0, 2.0, 3.0, 4.1]), (13, [1e-30] * 4)]
    df = spark.createDataFrame([(i, x, "l", 1, "x") for i, x in rows], SCHEMA)
    assert run(df) == expected(rows)
    assert run(df.limit(0)) == []


def check(df):
    """No false link, and of the true ones at least the share that is promised."""
    want = expected([(r["vec_id"], r["embedding"]) for r in df.collect()])
    got = run(df)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    return sum(g[1] for g in got), sum(w[1] for w in want)


def test_no_false_links_in_the_table(spark, sf):
    check(spark.read.parquet(f"{sf}/embeddings.parquet").withColumn("cls", F.lit(1)))


@pytest.mark.parametrize("n", [600, 3000])
def test_recall_of_planted_pairs(spark, n):
    """Half of the vectors have a partner at a cosine just above the threshold."""
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 64)) + 0.4 * rng.normal(size=64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = np.concatenate([lattice.partners(x[k::4][: n // 8], c, 5 + k) for k, c in enumerate((0.9001, 0.91, 0.93, 0.96))])
    rows = np.concatenate([x, near])
    df = spark.createDataFrame([(i, [float(c) for c in v], "l", 1, "x") for i, v in enumerate(rows)], SCHEMA.replace("float", "double"))
    got, want = check(df)
    assert want >= n and got >= 0.9 * want, (got, want)


def test_cells_shrink_as_rows_grow():
    x = np.random.default_rng(2).normal(size=(400, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    few, many = lattice.fitted(x, 1000), lattice.fitted(x, 10**8)
    assert few[2] < many[2] and few[0] < many[0]


def test_null_and_repeated_ids(spark):
    v, u = [1.0, 2.0, 3.0, 4.0], [4.0, -1.0, 0.5, 0.0]
    rows = [(None, v), (None, v), (None, u), (3, v), (3, u), (3, u), (5, [1.0, 2.0, 3.0, 4.1])]
    df = spark.createDataFrame([(i, x, "l", 1, "x") for i, x in rows], SCHEMA)
    got = sorted((tuple(r) for r in lattice.similar_vectors(df).select("vec_id", "n_links", "component_id").collect()), key=repr)
    assert got == sorted([(None, 3, 3), (None, 3, 3), (3, 3, 3), (5, 3, 3), (None, 2, 3), (3, 2, 3), (3, 2, 3)], key=repr)


def test_a_crowded_cell_is_cut_into_blocks(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=16)
    x = base + rng.normal(size=(lattice.BLOCK + 300, 16)) * 0.02
    df = spark.createDataFrame([(i, [float(c) for c in v], "l", 1, "x") for i, v in enumerate(x)], SCHEMA)
    got = run(df)
    assert {g[1] for g in got} == {len(x) - 1} and {g[2] for g in got} == {0}


def test_nearest_lattice_point():
    x = np.random.default_rng(1).normal(size=(500, 8)) * 2
    near = lattice.nearest_e8(x)
    for step in lattice.shortest():
        assert (((x - near) ** 2).sum(axis=1) <= ((x - near - step) ** 2).sum(axis=1) + 1e-9).all()
    assert len({tuple(v) for v in lattice.shortest()}) == 240
