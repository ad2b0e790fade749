"""Spans of characters (kind, start, end) in texts, and their digests."""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def joined(spans, kinds: list[str]) -> str:
    """``kind:start:end`` by start, then by the order of kinds."""
    rank = {k: n for n, k in enumerate(kinds)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], rank[s[0]], s[2])))


def digest(spans, kinds: list[str]) -> str:
    return hashlib.sha256(joined(spans, kinds).encode()).hexdigest()


def words(text: str) -> list[tuple[int, int, str]]:
    """(start, end, word) of a text."""
    return [(m.start(), m.end(), m[0]) for m in _WORD.finditer(text)]


def covering(word_spans, spans) -> list[tuple[int, str] | None]:
    """For each word the first span over it: (its number, its kind)."""
    out: list[tuple[int, str] | None] = []
    ordered = sorted((a, b, k) for k, a, b in spans)
    at = 0
    for a, b, _ in word_spans:
        while at < len(ordered) and ordered[at][1] <= a:
            at += 1
        hit = at < len(ordered) and ordered[at][0] < b
        out.append((at, ordered[at][2]) if hit else None)
    return out


def overlaps(a: int, b: int, spans) -> bool:
    return any(x < b and a < y for _, x, y in spans)


def sampled(docs: DataFrame, most: int, id_col: str, text_col: str) -> DataFrame:
    """(h, text) of at most ``most`` documents with text: those of the smallest
    hashes of id and text, each once however often it is repeated. The hashes are
    few by that bound, so they may be broadcast."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter((F.col("text") != "") & F.col("id").isNotNull())
    rows = rows.select(F.xxhash64("id", "text").alias("h"), "text")
    least = rows.select(F.col("h").alias("s_h")).distinct().orderBy("s_h").limit(most)
    return rows.join(F.broadcast(least), F.col("h") == F.col("s_h")).select("h", "text").dropDuplicates(["h"])


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)
