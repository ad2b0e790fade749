"""Operator 2: n-gram Jaccard join with a MinHash LSH forest.

Each document is its set of five-word shingles (A-Z lowered, split at white
space). Documents of one set are a class. The forest has ``TREES`` trees; in
each, a class is a string of ``DEPTH`` MinHash values, and the classes that share
a node of the prefix trie are those with an equal prefix. Prefixes begin at
``DEPTH`` values and shorten until the target recall is reached: that of pairs at
the threshold, measured on one document in ``PROBE`` and a copy of it without a
fifth of its shingles, and weighed with the formula's as ``PRIOR`` such pairs.

Classes that meet in a node are verified on the words of their shingles, block
against block. Nodes that overlap form a cluster. A cluster whose nodes are
nearly all of it (a group of near copies) is compared as one, so that each pair
is compared once; one that only chains nodes together is compared node by node,
a pair in the first tree where it meets. Either is cut by set size, since
similar sets have similar sizes, and by a hash, so no block outgrows ``BLOCK``
sets or ``BLOCK_SHINGLES`` shingles by much. Blocks give counts and a spanning
forest of their links, never pairs.

A class is found by a digest of shingle hashes. Where its documents differ in
words, their shingles are compared as words with those of one of them; what
differs is a class of its own.

A document of one to four words has a single shingle, all its words. Null,
empty and blank texts have none and link with nothing. Long texts are read
whole. Repeated rows are members of one class. Null ids keep their rows; a row
is found again by its id and a hash of its text. An empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagraph.llm.components import components
from stratagraph.llm.scratch import Scratch
from stratagraph.llm.textcols import Words, mix, pieces, shingles

WORDS, THRESHOLD = 5, 0.8
TREES, DEPTH, RECALL = 16, 8, 0.9995
#: One document in so many measures the recall; pairs that the formula counts as.
PROBE, PRIOR = 64, 4096
BLOCK, BLOCK_SHINGLES = 256, 1 << 20
#: Rows whose words are hashed together.
ROWS = 512
_BYTES = 4  # of a MinHash value in a prefix


def expected_recall(depth: int, threshold: float, trees: int = TREES) -> float:
    """The share of pairs at the threshold with an equal prefix in some tree."""
    return 1 - (1 - threshold**depth) ** trees


def prefix_length(met: list[int], probes: int, threshold: float, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix whose recall is reached; ``met[d]`` of ``probes`` pairs
    met at prefix ``d``."""
    for d in range(depth, 1, -1):
        if (met[d] + PRIOR * expected_recall(d, threshold, trees)) / (probes + PRIOR) >= recall:
            return d
    return 1


def shingle_sets(column, n: int) -> list[np.ndarray]:
    """Sorted distinct shingles of each row."""
    h, first = shingles(Words(column, lower=True), n)
    return [np.unique(h[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values of each set: sets x trees x depth."""
    if not sets:
        return np.zeros((0, TREES, DEPTH), ">u4")
    h = np.concatenate(sets)
    first = np.cumsum([0, *map(len, sets)])[:-1]
    out = np.zeros((len(sets), TREES * DEPTH), ">u4")
    work = np.empty_like(h)
    for k, seed in enumerate(mix(np.arange(1, TREES * DEPTH + 1, dtype=np.uint64))):
        np.bitwise_xor(h, seed, out=work)
        np.multiply(work, seed | np.uint64(1), out=work)
        out[:, k] = np.minimum.reduceat(work, first) >> np.uint64(32)
    return out.reshape(len(sets), TREES, DEPTH)


def _probe(s: np.ndarray, sig: np.ndarray, threshold: float) -> int:
    """The longest prefix that a set shares in some tree with what is left of it
    at the threshold."""
    left = s[np.sort(np.argsort(mix(s))[: max(1, math.ceil(threshold * len(s)))])]
    same = _signatures([left])[0] == sig
    return int(np.cumprod(same, axis=1).sum(axis=1).max())


def _sign(n: int, threshold: float, class_bytes: int):
    def run(batches):
        for batch in batches:
            for part in pieces(batch, 2, ROWS):
                words = Words(part.column(2), lower=True)
                h, first = shingles(words, n)
                sets = [np.unique(h[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
                own = [hashlib.blake2b(b" ".join((t.as_py() or "").encode().lower().split()), digest_size=16).digest() for t in part.column(2)]
                full = [k for k, s in enumerate(sets) if len(s)]
                trees: list = [None] * len(sets)
                probes: list = [None] * len(sets)
                for b in range(0, len(full), 32):  # sets of about the cache's size
                    some = full[b : b + 32]
                    for k, sig in zip(some, _signatures([sets[k] for k in some]), strict=True):
                        trees[k] = sig.tobytes()
                        if int(sets[k][0]) % PROBE == 0:
                            probes[k] = _probe(sets[k], sig, threshold)
                cls = [_digest(s)[:class_bytes] if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(cls, pa.binary()), pa.array(own, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(trees, pa.binary()), pa.array(probes, pa.int32())],
                    names=["id", "mark", "cls", "own", "size", "trees", "probe"],
                )

    return run


def word_shingles(texts: list[str], n: int) -> list[np.ndarray]:
    """Sorted distinct shingles of each text, as numbers that stand for their words."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.large_string())))
    first = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy())]).astype(np.int64)
    # Blanks at either end give empty words, which are none.
    flat = split.flatten()
    solid = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    first = np.concatenate([[0], np.cumsum(solid)])[first]
    word = flat.filter(pa.array(solid)).dictionary_encode().indices.to_numpy().astype(np.int64) + 1
    # A shingle of fewer words, of texts with no more, ends in zeros.
    count = np.diff(first)
    at = np.arange(len(word)) - np.repeat(first[:-1], count)
    end = np.repeat(count, count)
    name, base = np.zeros(len(word), np.int64), int(word.max(initial=0)) + 1
    for j in range(n):
        step = np.zeros(len(word), np.int64)
        step[: len(word) - j] = word[j:]
        name = pd.factorize(name * base + np.where(at + j < end, step, 0))[0]
    keep = at <= np.maximum(end - n, 0)
    rows = np.repeat(np.arange(len(texts)), count)[keep]
    name = name[keep]
    cut = np.searchsorted(rows, np.arange(len(texts) + 1))
    return [np.unique(name[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]


_PLACED = "pair string, side int, tree int, cls binary, copies long, nodes binary, text string"


def _place(batches):
    """One row for each pair of blocks that a class's text is compared in; once a
    task, however many rows repeat the smallest id of a class."""
    done: set[bytes] = set()
    for batch in batches:
        for r in range(batch.num_rows):
            cls, copies, nodes, pairs, text = (batch.column(k)[r].as_py() for k in range(5))
            if cls in done:
                continue
            done.add(cls)
            for a in range(0, len(pairs), 64):
                some = pairs[a : a + 64]
                same = lambda x, kind: pa.array([x] * len(some), kind)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([p["pair"] for p in some]), pa.array([p["side"] for p in some], pa.int32()), pa.array([p["tree"] for p in some], pa.int32()),
                        same(cls, pa.binary()), same(copies, pa.int64()), pa.array([nodes if p["tree"] >= 0 else None for p in some], pa.binary()), same(text, pa.string()),
                    ],
                    names=["pair", "side", "tree", "cls", "copies", "nodes", "text"],
                )


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of 0/1 matrices over slices."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    values, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    place = np.cumsum(shared) - 1
    keep = shared[inverse]
    owner, inverse = owner[keep], place[inverse[keep]]
    order = np.argsort(inverse, kind="stable")
    owner, inverse = owner[order], inverse[order]
    out = np.zeros((n, n), np.float32)
    total = int(shared.sum())
    for a in range(0, total, 4096):
        lo, hi = np.searchsorted(inverse, [a, a + 4096])
        m = np.zeros((n, min(4096, total - a)), np.float32)
        m[owner[lo:hi], inverse[lo:hi] - a] = 1
        out += m @ m.T
    return out


def forest(n: int, links: np.ndarray) -> np.ndarray:
    """The smallest row that each of ``n`` rows reaches over links (i, j)."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, links[:, 0], root[links[:, 1]])
        np.minimum.at(low, links[:, 1], root[links[:, 0]])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _verify(n: int, threshold: float):
    def run(table: pa.Table) -> pa.Table:
        # Rows that repeat a smallest id may have been read by several tasks.
        first = {key: k for k, key in reversed(list(enumerate(zip(table.column("cls").to_pylist(), table.column("side").to_pylist(), strict=True))))}
        table = table.take(sorted(first.values()))
        cls = table.column("cls").to_pylist()
        copies = np.array(table.column("copies").to_pylist(), np.int64)
        side = np.array(table.column("side").to_pylist())
        sets = word_shingles(table.column("text").to_pylist(), n)
        size = np.array([len(s) for s in sets], np.int64)
        both = _overlaps(sets).astype(np.int64)
        linked = both >= np.ceil((size[:, None] + size[None, :] - both) * threshold - 1e-9)
        np.fill_diagonal(linked, False)
        if (side >= 0).any():  # two blocks: pairs within one are another group's
            linked &= side[:, None] != side[None, :]
        tree = table.column("tree")[0].as_py()
        if tree > 0:  # a pair counts in the first tree where it meets
            nodes = np.stack([np.frombuffer(x, np.int64) for x in table.column("nodes").to_pylist()])
            for t in range(tree):
                linked &= nodes[:, None, t] != nodes[None, :, t]
        root = forest(len(cls), np.argwhere(linked))
        at = np.flatnonzero(linked.any(axis=1))
        return pa.table(
            {"cls": pa.array([cls[k] for k in at], pa.binary()), "root": pa.array([cls[root[k]] for k in at], pa.binary()), "links": pa.array(linked[at] @ copies, pa.int64())}
        )

    return run


def _blocks(members: DataFrame, scratch: Scratch, threshold: float = THRESHOLD) -> DataFrame:
    """(cls, pairs): the pairs of blocks in which each class is compared.

    ``members``: grp, tree, cls, size. Bands of sets hold sizes within the
    threshold's ratio, so that a similar pair is in one band or in two that follow
    each other. A band with more than a block is dealt over blocks by a hash.
    """
    band = F.floor(F.log("size") / -math.log(threshold) + 1e-9)
    banded = scratch.save(members.withColumn("band", band))
    heavy = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int")
    counts = scratch.save(banded.groupBy("grp", "band").agg(heavy.alias("n"), F.count(F.lit(1)).alias("rows"), F.sum("size").alias("weight")))
    whole = counts.groupBy("grp").agg((F.sum("rows") <= BLOCK).alias("few"), (F.sum("weight") <= BLOCK_SHINGLES).alias("light"))
    here = counts.select("grp", "band", "n")
    above = counts.select("grp", (F.col("band") - 1).alias("band"), F.col("n").alias("n_above"))
    below = counts.select("grp", (F.col("band") + 1).alias("band"), F.col("n").alias("n_below"))
    plan = scratch.save(here.join(above, ["grp", "band"], "left").join(below, ["grp", "band"], "left").join(whole, "grp"))
    rows = banded.join(plan, ["grp", "band"]).withColumn("own", F.pmod(F.xxhash64("cls"), F.col("n")).cast("int"))
    name = lambda *parts: F.concat_ws("/", "grp", *[p.cast("string") for p in parts])
    entry = lambda side, pair: F.struct(side.cast("int").alias("side"), pair.alias("pair"), F.col("tree"))
    s, b = F.col("own"), F.col("band")
    row = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    inner = F.transform(
        row(F.col("n")),
        lambda t: entry(F.when(t == s, F.lit(-1)).otherwise(s), F.when(t == s, name(b, s)).otherwise(name(b, F.least(s, t), F.greatest(s, t)))),
    )
    up = F.transform(row(F.coalesce("n_above", F.lit(0))), lambda t: entry(F.lit(0), name(b, s, b + 1, t)))
    down = F.transform(row(F.coalesce("n_below", F.lit(0))), lambda t: entry(F.lit(1), name(b - 1, t, b, s)))
    pairs = F.when(F.col("few") & F.col("light"), F.array(entry(F.lit(-1), F.col("grp")))).otherwise(F.concat(inner, up, down))
    found = rows.select("cls", pairs.alias("pairs"))
    return found.groupBy("cls").agg(F.flatten(F.collect_list("pairs")).alias("pairs"))  # at most one list a tree


def _differing(batches, n: int):
    """Members of a class whose shingles are not those of the one they stand by."""
    for batch in batches:
        cls, own, text, model = (batch.column(k).to_pylist() for k in range(4))
        for c, o, t, m in zip(cls, own, text, model, strict=True):
            a, b = word_shingles([t or "", m or ""], n)
            if not np.array_equal(a, b):
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()), pa.array([o], pa.binary())], names=["d_cls", "d_own"])


def _settled(signed: DataFrame, rows: DataFrame, scratch: Scratch, n: int) -> DataFrame:
    """``signed`` with classes whose members have the same shingles, word by word."""
    kinds = signed.filter("cls is not null").groupBy("cls", "own").agg(F.min(F.struct("id", "mark")).alias("row"))
    mixed = kinds.groupBy("cls").agg(F.min("own").alias("lead"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    found = scratch.save(kinds.join(mixed, "cls").select("cls", "own", "lead", "row.id", "row.mark"))
    if found.isEmpty():
        return signed
    keyed = rows.select(F.col("id").alias("t_id"), F.col("mark").alias("t_mark"), "text")
    same = F.col("id").eqNullSafe(F.col("t_id")) & (F.col("mark") == F.col("t_mark"))
    held = scratch.save(found.join(keyed, same).groupBy("cls", "own", "lead").agg(F.first("text").alias("text")))
    leads = held.filter("own = lead").select("cls", F.col("text").alias("model"))
    others = held.filter("own <> lead").join(leads, "cls").select("cls", "own", "text", "model")
    differ = scratch.save(others.mapInArrow(lambda batches: _differing(batches, n), "d_cls binary, d_own binary"))
    marked = signed.join(differ, (F.col("cls") == F.col("d_cls")) & (F.col("own") == F.col("d_own")), "left")
    apart = F.concat("cls", F.col("d_own"), F.lit(b"/"))  # longer than any digest
    return scratch.save(marked.withColumn("cls", F.coalesce(F.when(F.col("d_own").isNotNull(), apart), "cls")).drop("d_cls", "d_own"))


def _depth(signed: DataFrame, threshold: float) -> int:
    """The prefix length that measured recall allows; a few counts reach the driver."""
    probes = {r["probe"]: r["count"] for r in signed.filter("probe is not null").groupBy("probe").count().collect()}
    return prefix_length([sum(n for p, n in probes.items() if p >= d) for d in range(DEPTH + 1)], sum(probes.values()), threshold)


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: float = THRESHOLD, class_bytes: int = 16) -> DataFrame:
    """One row for each row: doc_id, class_id (smallest id of its set), n_links
    (other rows at the threshold), group_id (smallest id it reaches), kept.

    ``class_bytes`` shortens the digests of classes; tests use it to force collisions.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select("id", F.xxhash64("text").alias("mark"), "text")
    signed = scratch.save(rows.mapInArrow(_sign(words, threshold, class_bytes), "id long, mark long, cls binary, own binary, size long, trees binary, probe int"))
    depth = _depth(signed, threshold)
    signed = _settled(signed, rows, scratch, words)
    known = signed.filter("cls is not null")
    least = F.min(F.struct(F.col("id").isNull(), "id", "mark")).alias("least")
    classes = known.groupBy("cls").agg(least, F.count(F.lit(1)).alias("copies"), F.first("size").alias("size"), F.first("trees").alias("trees"))
    classes = scratch.save(classes.select("cls", F.col("least.id").alias("rep"), F.col("least.mark").alias("rep_mark"), "copies", "size", "trees"))
    prefix = lambda t: F.xxhash64(F.substring("trees", t * DEPTH * _BYTES + 1, depth * _BYTES), F.lit(t))
    nodes = scratch.save(classes.select("cls", "size", F.posexplode(F.array(*map(prefix, range(TREES)))).alias("tree", "prefix")))
    shared = scratch.save(nodes.groupBy("tree", "prefix").agg(F.min("cls").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    met = scratch.save(nodes.join(shared, ["tree", "prefix"]).select(F.col("cls").alias("a"), "b", "tree", "prefix", "size"))
    clusters = components(met.select("a", "b").distinct(), scratch).select(F.col("node").alias("cls"), F.col("root").alias("cluster"))
    # Node by node if that is less than the whole cluster against itself.
    by_node = shared.join(clusters, F.col("b") == F.col("cls")).groupBy("cluster").agg(F.sum(F.col("n") * F.col("n")).alias("node_work"))
    counted = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    chained = scratch.save(counted.join(by_node, "cluster").select("cluster", ((F.col("n") > BLOCK) & (F.col("node_work") < F.col("n") * F.col("n"))).alias("chained")))
    of = clusters.join(chained, "cluster")
    dense = of.filter("not chained").join(classes.select("cls", "size"), "cls").select(F.hex("cluster").alias("grp"), F.lit(-1).alias("tree"), "cls", "size")
    loose = met.join(of.filter("chained").select(F.col("cls").alias("a")), "a").select(F.concat_ws("/", F.lit("node"), "tree", "prefix").alias("grp"), "tree", F.col("a").alias("cls"), "size")
    plan = scratch.save(_blocks(dense.unionAll(loose), scratch, threshold))
    marks = F.concat(*[F.unhex(F.lpad(F.hex(prefix(t)), 16, "0")) for t in range(TREES)])
    placed = plan.join(classes.select("cls", "rep", "rep_mark", "copies", marks.alias("nodes")), "cls")
    same = placed["rep"].eqNullSafe(rows["id"]) & (placed["rep_mark"] == rows["mark"])
    texts = placed.join(rows, same).select("cls", "copies", "nodes", "pairs", "text").mapInArrow(_place, _PLACED)
    found = scratch.save(texts.groupBy("pair").applyInArrow(_verify(words, threshold), "cls binary, root binary, links long"))
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("cls").alias("a"), F.col("root").alias("b")), scratch)
    reps = groups.select(F.col("node").alias("cls"), "root").join(classes.select("cls", "rep"), "cls")
    least = scratch.save(reps.groupBy("root").agg(F.min("rep").alias("group_id")))
    groups = groups.join(least, "root").select(F.col("node").alias("cls"), "group_id")
    table = scratch.save(classes.select("cls", "rep", "copies").join(links, "cls", "left").join(groups, "cls", "left"))
    out = signed.select("id", "cls").join(table, "cls", "left")
    group = F.coalesce("group_id", "rep", "id")
    return out.select(
        F.col("id").alias("doc_id"),
        F.coalesce("rep", "id").alias("class_id"),
        (F.coalesce(F.col("copies") - 1, F.lit(0)) + F.coalesce("links", F.lit(0))).alias("n_links"),
        group.alias("group_id"),
        F.col("id").eqNullSafe(group).alias("kept"),
    )
