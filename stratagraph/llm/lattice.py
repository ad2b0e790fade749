"""Operator 3: embedding near-duplicates by E8 lattice hashing.

Each table projects a unit vector to eight random directions and decodes the
point to the nearest E8 lattice point. A vector stands in its own cell and in the
next nearest cells around it. Vectors that share a cell are compared by cosine in
double precision, block against block; a pair that shares several cells counts in
the first of them alone, which its two code lists decide. Blocks give counts and
a spanning forest of links, never pairs.

Cell size, tables and probes follow from the number of vectors: ``fitted`` takes
``SAMPLE`` of them, puts beside each a partner at exactly the threshold, and
measures for each cell size how often the two share a cell and how often two
vectors of the sample do. Of the settings that reach ``RECALL`` for such partners
it takes that with the least work for all rows. Every row is then indexed.

Vectors of equal components are one class. A cell of more than ``BLOCK`` classes
is dealt over blocks by a hash, every two of which meet. Vectors of different
dimensions never meet. Vectors that are null, empty, zero or hold a null or
non-finite component link with nothing. Repeated rows are members of a class.
Null ids keep their rows and never name a component that has another id; rows of
one id each get the result of their own vector. An empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagraph.llm.components import components
from stratagraph.llm.jaccard import forest
from stratagraph.llm.scratch import Scratch
from stratagraph.llm.textcols import mix

THRESHOLD = 0.9
#: Vectors that the cell size is fitted on; the share of partners to be found.
SAMPLE, RECALL = 1024, 0.97
#: What may be chosen: cell sizes (larger numbers give smaller cells), probes, tables.
SCALES, PROBES, TABLES = (0.45, 0.55, 0.65, 0.8, 1.0, 1.2, 1.5), (3, 5, 9, 16), 64
#: Work of placing a vector in one cell, in comparisons of two vectors.
PLACING = 200.0
BLOCK = 2048


def _d8(x: np.ndarray) -> np.ndarray:
    """Nearest points of D8: whole coordinates of an even sum."""
    near = np.rint(x)
    off = x - near
    k = np.abs(off).argmax(axis=1)
    rows = np.flatnonzero(near.sum(axis=1) % 2 != 0)
    near[rows, k[rows]] += np.where(off[rows, k[rows]] >= 0, 1.0, -1.0)
    return near


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8, the union of D8 and D8 moved by one half."""
    a, b = _d8(x), _d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


def shortest() -> np.ndarray:
    """The 240 shortest vectors of E8: the way to each neighbouring point."""
    out = []
    for i, j in combinations(range(8), 2):
        for p, q in product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = p, q
            out.append(v)
    out += [np.array(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


def codes(units: np.ndarray, tables: int, probes: int, scale: float) -> np.ndarray:
    """Hashes of the cells of each unit vector: rows x tables x (1 + probes)."""
    n, dim = units.shape
    around = shortest()
    out = np.zeros((n, tables, 1 + probes), np.uint64)
    for t in range(tables):
        turn = np.random.default_rng([8, dim, t]).normal(size=(dim, 8)) * scale
        x = units @ turn
        own = nearest_e8(x)
        cells = own[:, None, :]
        if probes:
            # |x - own - r|^2 is least where r points along what is left of x.
            gap = ((around**2).sum(axis=1)[None] - 2 * (x - own) @ around.T).round(9)
            best = np.argsort(gap, axis=1, kind="stable")[:, :probes]
            cells = np.concatenate([cells, own[:, None, :] + around[best]], axis=1)
        whole = np.rint(cells * 2).astype(np.int64).astype(np.uint64)
        h = np.full(whole.shape[:2], np.uint64(dim * 4096 + t))
        for k in range(8):
            h = mix(h * np.uint64(31) + whole[:, :, k])
        out[:, t] = h
    return out


def partners(units: np.ndarray, cosine: float, seed: int = 3) -> np.ndarray:
    """Beside each unit vector another at this cosine."""
    r = np.random.default_rng(seed).normal(size=units.shape)
    r -= (r * units).sum(axis=1, keepdims=True) * units
    norm = np.linalg.norm(r, axis=1, keepdims=True)
    return cosine * units + math.sqrt(1 - cosine * cosine) * r / np.where(norm > 0, norm, 1.0)


def _sharing(a: np.ndarray, b: np.ndarray) -> float:
    """The mean share of tables in which rows of two code lists share a cell."""
    return float((a[:, :, :, None] == b[:, :, None, :]).any(axis=(2, 3)).mean())


def fitted(units: np.ndarray, rows: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int, float]:
    """(tables, probes, scale) for this many rows, from a sample of them."""
    if len(units) < 2 or units.shape[1] < 2:
        return 1, PROBES[0], SCALES[0]
    near, trial, best = partners(units, threshold), 4, None
    most = max(PROBES)
    for scale in SCALES:
        one, two = codes(units, trial, most, scale), codes(near, trial, most, scale)
        for probes in PROBES:
            x, y = one[:, :, : 1 + probes], two[:, :, : 1 + probes]
            found = min(_sharing(x, y), 1 - 1e-6)
            if found <= 0:
                continue
            tables = max(1, math.ceil(math.log(1 - recall) / math.log(1 - found)))
            if tables > TABLES:
                continue
            met = sum(int((c * (c - 1) // 2).sum()) for c in (np.unique(x[:, t], return_counts=True)[1] for t in range(trial))) / trial
            pairs = tables * met / (len(units) * (len(units) - 1) / 2) * rows * rows / 2
            work = pairs + PLACING * tables * (1 + probes) * rows
            if best is None or work < best[0]:
                best = (work, tables, probes, scale)
    return best[1:] if best else (TABLES, most, SCALES[0])


def _units(column) -> list[np.ndarray | None]:
    rows = []
    for v in column:
        v = v.as_py()
        ok = v is not None and len(v) > 0 and all(x is not None for x in v)
        x = np.array(v, np.float64) if ok else None
        norm = np.linalg.norm(x) if ok and np.isfinite(x).all() else 0.0
        if ok and not np.isfinite(norm):  # too long for a double: scale first
            x = x / np.abs(x).max()
            norm = np.linalg.norm(x)
        elif ok and norm < 1e-150 and np.isfinite(x).all() and x.any():
            x = x / np.abs(x).max()
            norm = np.linalg.norm(x)
        rows.append(x / norm if norm > 0 else None)
    return rows


def _encode(batches):
    for batch in batches:
        for a in range(0, batch.num_rows, 1024):
            part = batch.slice(a, 1024)
            units = [None if u is None else u.tobytes() for u in _units(part.column(1))]
            cls = [None if u is None else hashlib.blake2b(u, digest_size=16).digest() for u in units]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(cls, pa.binary()), pa.array(units, pa.binary())], names=["id", "cls", "unit"])


def _by_dimension(column) -> list[tuple[list[int], np.ndarray]]:
    """Rows of each dimension and their unit vectors."""
    rows = [np.frombuffer(u.as_py(), np.float64) for u in column]
    dims: dict[int, list[int]] = {}
    for k, u in enumerate(rows):
        dims.setdefault(len(u), []).append(k)
    return [(at, np.stack([rows[k] for k in at])) for at in dims.values()]


def _fit(rows: int, threshold: float):
    def run(batches):
        held = pa.Table.from_batches(list(batches), pa.schema([("unit", pa.binary())])).column("unit")
        if len(held):
            units = max(_by_dimension(held), key=lambda x: len(x[0]))[1]
            tables, probes, scale = fitted(units, rows, threshold)
            yield pa.RecordBatch.from_arrays([pa.array([tables], pa.int32()), pa.array([probes], pa.int32()), pa.array([scale])], names=["tables", "probes", "scale"])

    return run


def _place(tables: int, probes: int, scale: float):
    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                held: list = [None] * part.num_rows
                for at, units in _by_dimension(part.column(2)):
                    for k, c in zip(at, codes(units, tables, probes, scale), strict=True):
                        held[k] = c.tobytes()
                cells = [np.unique(np.frombuffer(c, np.int64)).tolist() for c in held]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(held, pa.binary()), pa.array(cells, pa.list_(pa.int64()))], names=[*part.schema.names, "codes", "cells"])

    return run


def _first_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least cell that the code lists of each pair have in common."""
    out = np.full(len(a), np.iinfo(np.int64).max)
    width = a.shape[1]
    for k in range(width):  # sorted lists: the first hit of a is its least
        open_ = np.flatnonzero(out == np.iinfo(np.int64).max)
        if not len(open_):
            break
        hit = (a[open_, k][:, None] == b[open_]).any(axis=1)
        out[open_[hit]] = a[open_[hit], k]
    return out


def _verify(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        cls = table.column("cls").to_pylist()
        cell = table.column("cell")[0].as_py()
        copies = np.array(table.column("copies").to_pylist(), np.int64)
        side = np.array(table.column("side").to_pylist())
        x = np.stack([np.frombuffer(u, np.float64) for u in table.column("unit").to_pylist()])
        lists = np.sort(np.stack([np.frombuffer(c, np.int64) for c in table.column("codes").to_pylist()]), axis=1)
        one = np.flatnonzero(side <= 0)
        two = np.flatnonzero(side == 1) if (side == 1).any() or (side == 0).any() else one
        links, count = [], np.zeros(len(cls), np.int64)
        for a in range(0, len(one), 256):
            i, j = np.nonzero(x[one[a : a + 256]] @ x[two].T >= threshold)
            i, j = one[i + a], two[j]
            if two is one:
                i, j = i[i < j], j[i < j]
            for b in range(0, len(i), 1 << 16):
                p, q = i[b : b + (1 << 16)], j[b : b + (1 << 16)]
                here = _first_shared(lists[p], lists[q]) == cell
                p, q = p[here], q[here]
                np.add.at(count, p, copies[q])
                np.add.at(count, q, copies[p])
                found = np.stack([p, q], axis=1)
                # Only links that join two trees so far are kept.
                if len(found):
                    links.append(found)
                    joined = forest(len(cls), np.concatenate(links))
                    at = np.flatnonzero(joined != np.arange(len(cls)))
                    links = [np.stack([at, joined[at]], axis=1)]
        root = forest(len(cls), np.concatenate(links)) if links else np.arange(len(cls))
        at = np.flatnonzero(count)
        return pa.table({"cls": pa.array([cls[k] for k in at], pa.binary()), "root": pa.array([cls[root[k]] for k in at], pa.binary()), "links": pa.array(count[at], pa.int64())})

    return run


def similar_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD, index: tuple[int, int, float] | None = None) -> DataFrame:
    """One row for each row: vec_id, n_links, component_id, kept, class_id.

    ``index`` gives (tables, probes, scale) instead of the fitted ones."""
    scratch = Scratch(vectors.sparkSession, "lattice")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    coded = scratch.save(rows.mapInArrow(_encode, "id long, cls binary, unit binary"))
    known = coded.filter("cls is not null")
    classes = scratch.save(known.groupBy("cls").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("unit").alias("unit")))
    if index is None:  # classes are digests: the least of them are a random sample
        some = classes.orderBy("cls").limit(SAMPLE).select("unit").repartition(1)
        got = some.mapInArrow(_fit(classes.count(), threshold), "tables int, probes int, scale double").collect()
        index = tuple(got[0]) if got else (1, PROBES[0], SCALES[0])
    schema = "cls binary, copies long, unit binary, codes binary, cells array<long>"
    reps, classes = classes.select("cls", "rep", "copies"), scratch.save(classes.select("cls", "copies", "unit").mapInArrow(_place(*index), schema))
    spots = classes.select("cls", F.explode("cells").alias("cell"))
    sizes = scratch.save(spots.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("n"), F.count(F.lit(1)).alias("members")).filter("members > 1").drop("members"))
    placed = spots.join(sizes, "cell").withColumn("own", F.pmod(F.xxhash64("cls"), F.col("n")).cast("int"))
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("n") - 1),
        lambda t: F.struct(
            F.when(t == F.col("own"), -1).when(t > F.col("own"), 0).otherwise(1).alias("side"), F.least(t, F.col("own")).alias("low"), F.greatest(t, F.col("own")).alias("high")
        ),
    )
    meet = placed.select("cls", "cell", F.explode(pairs).alias("p")).select("cls", "cell", "p.*")
    full = meet.join(classes.select("cls", "copies", "unit", "codes"), "cls").select("side", "cls", "copies", "cell", "low", "high", "unit", "codes")
    found = scratch.save(full.groupBy("cell", "low", "high").applyInArrow(_verify(threshold), "cls binary, root binary, links long"))
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("cls").alias("a"), F.col("root").alias("b")), scratch)
    least = scratch.save(groups.select(F.col("node").alias("cls"), "root").join(reps.select("cls", "rep"), "cls").groupBy("root").agg(F.min("rep").alias("component")))
    groups = groups.join(least, "root").select(F.col("node").alias("cls"), "component")
    table = scratch.save(reps.join(links, "cls", "left").join(groups, "cls", "left"))
    out = coded.select("id", "cls").join(table, "cls", "left")
    component = F.coalesce("component", "rep", "id")
    return out.select(
        F.col("id").alias("vec_id"),
        (F.coalesce(F.col("copies") - 1, F.lit(0)) + F.coalesce("links", F.lit(0))).alias("n_links"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
        F.coalesce("rep", "id").alias("class_id"),
    )
