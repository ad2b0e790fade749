"""Operator 1: exact deduplication by composable polynomial fingerprints.

A text is cut into chunks. Each chunk has a polynomial hash under two prime
moduli and a shift, the base raised to its length; fingerprints of longer
texts follow from ``hash(a + b) = hash(a) * shift(b) + hash(b)``, so the chunks
of one text can be hashed on different machines. Texts of equal fingerprint and
length are then compared chunk by chunk with the text that stays; a text that
differs moves on to a class of its own, until no difference is left.

A row is found again by its id and a hash of its text, so rows without an id, or
of one id, never meet each other's texts by the id alone.

Equal means identical after lower-casing A-Z. Null counts as the empty text,
all empty texts are equal. Repeated rows with one id are rows of their own.
Rows whose id is null take part; such an id never beats another.
An empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagraph.llm.scratch import Scratch

CHUNK = 1 << 16
#: Texts longer than this are hashed by several tasks.
HUGE = 1 << 22
PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 1220703125)
_FINGERPRINT = "f_len long, f_1 long, f_2 long"
_powers: dict[int, np.ndarray] = {}


def _power_row(k: int) -> np.ndarray:
    """Descending powers of a base: the weights of a chunk's bytes."""
    if k not in _powers:
        row = np.empty(CHUNK + 1, np.int64)
        row[0] = 1
        for i in range(1, CHUNK + 1):
            row[i] = int(row[i - 1]) * BASES[k] % PRIMES[k]
        _powers[k] = row[::-1].copy()
    return _powers[k]


def chunk_hash(chunk: bytes) -> tuple[int, int, int, int]:
    """(hash, shift) of at most CHUNK bytes under each modulus."""
    x = np.frombuffer(chunk, np.uint8).astype(np.int64)
    out = []
    for k in (0, 1):
        w = _power_row(k)
        n = len(x)
        out += [int(np.dot(x + 1, w[CHUNK + 1 - n :]) % PRIMES[k]) if n else 0, int(w[CHUNK - n])]
    return tuple(out)


def combine(parts) -> tuple[int, int]:
    """Fingerprint of consecutive chunks from their (hash, shift) pairs."""
    a = b = 0
    for h1, s1, h2, s2 in parts:
        a = (a * s1 + h1) % PRIMES[0]
        b = (b * s2 + h2) % PRIMES[1]
    return a, b


def _normal(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()


def _hash_whole(batches):
    """Fingerprints of rows (id, text); huge texts pass on for other tasks."""
    for batch in batches:
        ids, n = batch.column(0), batch.num_rows
        length, one, two, sha, text = [], [], [], [], []
        for value in batch.column(1):
            x = _normal(value.as_py())
            length.append(len(x))
            sha.append(hashlib.sha256(x).hexdigest())
            if len(x) > HUGE:
                one.append(None), two.append(None), text.append(x)
                continue
            a, b = combine(chunk_hash(x[i : i + CHUNK]) for i in range(0, len(x), CHUNK))
            one.append(a), two.append(b), text.append(None)
        yield pa.RecordBatch.from_arrays(
            [ids, batch.column(2), pa.array(length, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(sha, pa.string()), pa.array(text, pa.binary())],
            names=["id", "mark", "f_len", "f_1", "f_2", "sha", "huge"],
        )


def _chunks_of(batches):
    """(id, mark, sha, number, chunk) of normalised huge texts."""
    for batch in batches:
        for i, mark, sha, x in zip(*(batch.column(k) for k in range(4)), strict=True):
            x, sha = x.as_py(), sha.as_py()
            for a in range(0, len(x), HUGE):
                cut = [x[b : b + CHUNK] for b in range(a, min(a + HUGE, len(x)), CHUNK)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i.as_py()] * len(cut), pa.int64()), pa.array([mark.as_py()] * len(cut), pa.int64()), pa.array([sha] * len(cut)), pa.array(range(a // CHUNK, a // CHUNK + len(cut)), pa.int64()), pa.array(cut, pa.binary())],
                    names=["id", "mark", "sha", "no", "chunk"],
                )


def _hash_chunks(batches):
    for batch in batches:
        parts = [chunk_hash(x.as_py()) for x in batch.column(4)]
        cols = [pa.array([p[k] for p in parts], pa.int64()) for k in range(4)]
        length = pa.array([len(x.as_py()) for x in batch.column(4)], pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], length, *cols], names=["id", "mark", "sha", "no", "len", "h1", "s1", "h2", "s2"])


def combine_chunks(chunks: DataFrame, *keys: str) -> DataFrame:
    """Fingerprints of texts whose hashed chunks (no, len, h1, s1, h2, s2) are rows."""
    ordered = F.array_sort(F.collect_list(F.struct("no", "len", "h1", "s1", "h2", "s2")))

    def fold(h: str, s: str, prime: int):
        return F.aggregate("p", F.lit(0).cast("long"), lambda acc, x: (acc * x[s] + x[h]) % prime)

    return chunks.groupBy(*keys).agg(ordered.alias("p")).select(
        *keys, F.aggregate("p", F.lit(0).cast("long"), lambda acc, x: acc + x["len"]).alias("f_len"), fold("h1", "s1", PRIMES[0]).alias("f_1"), fold("h2", "s2", PRIMES[1]).alias("f_2")
    )


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("mark"))


def fingerprints(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, mark, f_len, f_1, f_2, sha."""
    rows = _texts(docs, id_col, text_col)
    whole = scratch.save(rows.mapInArrow(_hash_whole, f"id long, mark long, {_FINGERPRINT}, sha string, huge binary"))
    small = whole.filter("huge is null").select("id", "mark", "f_len", "f_1", "f_2", "sha")
    huge = whole.filter("huge is not null")
    if huge.isEmpty():
        return small
    # Spread chunks of one text over tasks; equal rows give equal chunks.
    named = huge.withColumn("sha", F.concat_ws("/", F.col("sha"), F.monotonically_increasing_id()))
    spread = named.select("id", "mark", "sha", "huge").mapInArrow(_chunks_of, "id long, mark long, sha string, no long, chunk binary").repartition("sha", "no")
    hashed = spread.mapInArrow(_hash_chunks, "id long, mark long, sha string, no long, len long, h1 long, s1 long, h2 long, s2 long")
    wide = combine_chunks(hashed, "id", "mark", "sha").withColumn("sha", F.substring_index("sha", "/", 1))
    return small.unionByName(wide.select(small.columns))


def _cut(batches):
    """Chunks of normalised texts, with the class that each text is in."""
    for batch in batches:
        for row in batch.to_pylist():
            x = _normal(row["text"])
            if hashlib.sha256(x).hexdigest() != row["sha"]:
                continue  # another row of a repeated id
            cut = [x[b : b + CHUNK] for b in range(0, len(x), CHUNK)] or [b""]
            n = len(cut)
            same = lambda name, kind: pa.array([row[name]] * n, kind)
            yield pa.RecordBatch.from_arrays(
                [same("id", pa.int64()), same("sha", pa.string()), same("keep_id", pa.int64()), same("keep_sha", pa.string()), pa.array(range(n), pa.int64()), pa.array(cut, pa.binary())],
                names=["id", "sha", "keep_id", "keep_sha", "no", "chunk"],
            )


def _classes(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """One row for each fingerprint: the row that stays and the size."""
    top = F.max(F.struct("id", "sha")).alias("top")
    return scratch.save(
        rows.groupBy("f_len", "f_1", "f_2", "round").agg(top, F.count(F.lit(1)).alias("group_size")).select("f_len", "f_1", "f_2", "round", F.col("top.id").alias("keep_id"), F.col("top.sha").alias("keep_sha"), "group_size")
    )


def _differing(docs: DataFrame, members: DataFrame, scratch: Scratch, id_col: str, text_col: str) -> DataFrame:
    """(id, sha) of members whose chunks are not those of the text that stays.

    Chunks meet on (class, number): a huge text is spread over tasks, and both
    sides of that join are written tables, so a hot class can be split.
    """
    text = _texts(docs, id_col, text_col).withColumnsRenamed({"id": "t_id", "mark": "t_mark"})
    kin = members.select("id", "mark", "sha", "keep_id", "keep_sha").distinct()
    same = F.col("id").eqNullSafe(F.col("t_id")) & (F.col("mark") == F.col("t_mark"))
    cut = scratch.save(
        kin.join(text, same).select("id", "sha", "keep_id", "keep_sha", "text").mapInArrow(_cut, "id long, sha string, keep_id long, keep_sha string, no long, chunk binary")
    )
    keeper = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("sha") == F.col("keep_sha"))
    stays = scratch.save(cut.filter(keeper).groupBy("keep_id", "keep_sha", "no").agg(F.first("chunk").alias("model")).withColumnsRenamed({"keep_id": "k_id", "keep_sha": "k_sha", "no": "k_no"}))
    on = F.col("keep_id").eqNullSafe(F.col("k_id")) & (F.col("keep_sha") == F.col("k_sha")) & (F.col("no") == F.col("k_no"))
    return cut.filter(~keeper).join(stays, on, "left").filter("model is null or model <> chunk").select("id", "sha").distinct()


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int | None = None) -> DataFrame:
    """Rows (doc_id, keep_id, group_size, kept, text_sha256), one for each row.

    ``modulus`` makes fingerprints coarser; tests use it to force collisions.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    rows = fingerprints(docs, scratch, id_col, text_col).withColumn("round", F.lit(0))
    if modulus:
        rows = rows.select("id", "mark", F.lit(0).cast("long").alias("f_len"), (F.col("f_1") % modulus).alias("f_1"), F.lit(0).cast("long").alias("f_2"), "sha", "round")
    done, n = None, 0
    while True:
        classes = _classes(rows, scratch)
        key = ["f_len", "f_1", "f_2", "round"]
        found = rows.join(classes, key)
        differ = scratch.save(_differing(docs, found.filter("group_size > 1"), scratch, id_col, text_col))
        if differ.isEmpty():
            break
        # What differs from its class's text leaves the class for the next round.
        n += 1
        off = differ.select(F.col("id").alias("d_id"), F.col("sha").alias("d_sha"))
        marked = scratch.save(rows.join(off, F.col("id").eqNullSafe(F.col("d_id")) & (F.col("sha") == F.col("d_sha")), "left"))
        settled = marked.filter("d_sha is null").select(rows.columns)
        done = settled if done is None else done.unionByName(settled)
        rows = marked.filter("d_sha is not null").select(rows.columns).withColumn("round", F.lit(n))
    if done is not None:
        rows = done.unionByName(rows)
        found = rows.join(_classes(rows, scratch), key)
    same = F.col("id").eqNullSafe(F.col("keep_id"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", same.alias("kept"), F.col("sha").alias("text_sha256"))


ORACLE = """
WITH n AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM n WINDOW g AS (PARTITION BY text_sha256)
"""
