"""Operator 5: document quality by hashed word n-grams and FTRL.

Features are hashed n-grams of words: each word as it is (A-Z lowered), pairs
of words, endings of words, and runs of one to three word shapes (case, digits,
signs, length, sameness with the word before). A document's vector holds the
parts that they have of its n-grams. A logistic regression is trained with
follow-the-regularised-leader updates on at most ``SAMPLE`` labelled rows, those
of the smallest hashes of their ids. They reach the task that trains in the
order of their hashes, once for each epoch, so it holds a batch at a time.
Scoring is a sparse dot product inside the scan, without a shuffle.

Null and empty texts score by the bias alone. A row's score depends on its text
alone: repeated rows score alike, wherever they stand. With
no labelled row the score is 0.5 everywhere. Other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagraph.llm.textcols import Words, mix, pieces

#: Labelled rows that are trained on, at most.
SAMPLE = 12_000
BITS = 18
SCALE = 24.0
EPOCHS = 2
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.002, 0.5
THRESHOLD = 0.3


def _class_sums(data: np.ndarray) -> list[np.ndarray]:
    upper = (data >= 65) & (data <= 90)
    lower = ((data >= 97) & (data <= 122)) | (data >= 128)
    digit = (data >= 48) & (data <= 57)
    zero = np.zeros(1, np.int32)
    return [np.concatenate([zero, np.cumsum(m, dtype=np.int32)]) for m in (upper, lower, digit)]


def features(column) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all rows, and the first one of each row."""
    words = Words(column, lower=True)
    h, s, e, first = words.hashes, words.starts, words.ends, words.row_start
    total = len(h)
    if not total:
        return np.zeros(0, np.uint32), np.zeros(len(first), np.int64)
    length = e - s
    upper, lower, digit = (c[e] - c[s] for c in _class_sums(words.data))
    signs = length - upper - lower - digit
    head = np.zeros(total, bool)
    head[first[:-1][first[:-1] < total]] = True
    again = np.zeros(total, bool)
    again[1:] = (h[1:] == h[:-1]) & ~head[1:]
    shape = (np.minimum(upper, 2) + 3 * np.minimum(signs, 4) + 15 * np.minimum(digit, 2) + 45 * (lower > 0) + 90 * np.minimum(length // 4, 4) + 450 * again).astype(np.uint64)
    # Position of a word in its row decides which longer n-grams it ends.
    at = np.arange(total) - np.repeat(first[:-1], np.diff(first))
    tail = words.data[e - 1].astype(np.uint64) + (words.data[np.maximum(e - 2, s)].astype(np.uint64) << np.uint64(8)) + (words.data[np.maximum(e - 3, s)].astype(np.uint64) << np.uint64(16))
    pair, two, three = h.copy(), shape.copy(), shape.copy()
    pair[1:] = h[1:] * np.uint64(3) + mix(h[:-1])
    two[1:] = shape[1:] * np.uint64(1021) + shape[:-1]
    three[2:] = two[2:] * np.uint64(1021) + shape[:-2]
    grams = [(h, 1, 0), (pair, 2, 1), (tail, 3, 0), (shape, 4, 0), (two, 5, 1), (three, 6, 2)]
    seeds = mix(np.arange(7, dtype=np.uint64))
    out = np.stack([(mix(v + seeds[k]) >> np.uint64(64 - BITS)).astype(np.uint32) for v, k, _ in grams], axis=1)
    kept = np.stack([at >= least for _, _, least in grams], axis=1)
    counts = np.concatenate([[0], np.cumsum(kept.sum(axis=1))])
    return out[kept], counts[first]


_VECTORS = "epoch int, h long, y int, idx binary, part binary"


def _emit_features(batches):
    """Feature vectors (ids, parts of the row's n-grams), once for each epoch."""
    for batch in batches:
        for some in pieces(batch, 2):
            idx, first = features(some.column(2))
            found = [np.unique(idx[a:b], return_counts=True) for a, b in zip(first[:-1], first[1:], strict=True)]
            u = [x.astype("<u4").tobytes() for x, _ in found]
            v = [(c / max(c.sum(), 1)).astype("<f4").tobytes() for _, c in found]
            for epoch in range(EPOCHS):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([epoch] * len(u), pa.int32()), some.column(0), some.column(1), pa.array(u, pa.binary()), pa.array(v, pa.binary())], names=["epoch", "h", "y", "idx", "part"]
                )


def ftrl(rows) -> np.ndarray:
    """Weights after updates by (features, parts, label) in turn; the last is the bias."""
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weight(zi, ni):
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    for u, part, y in rows:
        u, v = np.append(u.astype(np.int64), size - 1), np.append(part * np.float64(SCALE), 1.0)
        zi, ni = z[u], n[u]
        w = weight(zi, ni)
        g = (1 / (1 + np.exp(-np.clip(np.dot(w, v), -35, 35))) - y) * v
        step = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
        z[u] = zi + g - step * w
        n[u] = ni + g * g
    return weight(z, n)


def _fit(batches):
    rows = ((np.frombuffer(u.as_py(), "<u4"), np.frombuffer(v.as_py(), "<f4"), float(y.as_py())) for b in batches for u, v, y in zip(b.column(3), b.column(4), b.column(2), strict=True))
    yield pa.RecordBatch.from_arrays([pa.array([ftrl(rows).astype("<f8").tobytes()], pa.binary())], names=["w"])


def remainder(id_col) -> F.Column:
    """crc32 of the id as text, modulo 5."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> np.ndarray:
    """Weights learned from labelled rows outside the held-out fifth."""
    lab = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("l_id"), F.col(label_col).cast("int").alias("y"))
    lab = lab.filter(remainder(F.col("l_id")) != 0).withColumn("h", F.xxhash64("l_id"))
    lab = lab.orderBy("h", "l_id", "y").limit(sample)  # bounded by the parameter, so it may be broadcast
    text = docs.select(F.col(id_col).cast("long").alias("d_id"), F.col(text_col).cast("string").alias("text"))
    rows = text.join(F.broadcast(lab), F.col("d_id") == F.col("l_id")).select("h", "y", "text")
    rows = rows.mapInArrow(_emit_features, _VECTORS).repartition(1).sortWithinPartitions("epoch", "h", "y", "idx")
    got = rows.mapInArrow(_fit, "w binary").collect()
    if not got:
        return np.zeros((1 << BITS) + 1)
    return np.frombuffer(got[0]["w"], "<f8")


def score_column(column, weights: np.ndarray) -> np.ndarray:
    idx, first = features(column)
    n = np.diff(first)
    full = np.flatnonzero(n)
    sums = np.zeros(len(n))
    if len(full):
        sums[full] = np.add.reduceat(weights[idx], first[:-1][full])  # over each row's own numbers
    return 1 / (1 + np.exp(-np.clip(sums * SCALE / np.maximum(n, 1) + weights[-1], -35, 35)))


def with_score(docs: DataFrame, weights: np.ndarray, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` and the score of each row; a column of that name is replaced."""
    from pyspark.sql.types import DoubleType, StructType

    keep = [f for f in docs.schema.fields if f.name != score_col]
    names = [f.name for f in keep]
    share = docs.sparkSession.sparkContext.broadcast(weights)  # 2 ** BITS numbers

    def scored(batches):
        w = share.value
        at = names.index(text_col)
        for batch in batches:
            cols = [batch.column(k) for k in range(len(names))]
            s = np.concatenate([np.zeros(0), *(score_column(p.column(at), w) for p in pieces(batch, at, 256))])
            yield pa.RecordBatch.from_arrays([*cols, pa.array(s, pa.float64())], names=[*names, score_col])

    schema = StructType(keep).add(score_col, DoubleType())
    return docs.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(scored, schema)


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    w = train(docs, labels, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    s = with_score(rows, w)
    return s.select("doc_id", (remainder(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def held_out(doc_id) -> bool:
    """Whether a row is never trained on."""
    return zlib.crc32(str(doc_id).encode()) % 5 == 0
