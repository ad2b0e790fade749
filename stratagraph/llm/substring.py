"""Operator 6: substring deduplication by recompression.

A word becomes a 64-bit name. Rounds then name runs of one name, and pairs of
neighbours of which the first is on the left side and the second on the right
side of a hash of names. Names are hashes of what they stand for, so all tasks
give equal substrings equal symbols, without a dictionary. Every symbol knows
the words that settle it: its own and those of the neighbours that could have
merged with it. A symbol settled by words inside a window is there wherever
that window occurs; the least name of the highest round that has one in the
window is its anchor. Equal windows have equal anchors.

Anchors that occur in two documents mark documents to look into; of their
windows those with such an anchor get a name, a rolling hash, and once a BLAKE2
digest of their very words: a name stands for its windows where they all have one
digest, and digests themselves decide where they have several, so no weak hash can
remove a word. A window repeats when a document of a smaller id has it. Documents of equal
words are settled first: all but the smallest id go whole.

A word is a run of bytes other than space and 0x09-0x0D. Null counts as empty.
Texts shorter than a window keep all words; long ones are read whole. Rows of
one id never remove words of each other; a row is known by its id and a hash of
its text, so however many rows one id has, they spread over tasks and meet no other. Null ids keep all words. An empty table gives an empty table;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagraph.llm.scratch import Scratch
from stratagraph.llm.textcols import Words, mix, pieces

WINDOW = 50
ROUNDS = 7
#: Rows whose words are parsed together.
ROWS = 256
_EMPTY = hashlib.sha256(b"").hexdigest()


class Symbols:
    """A round's symbols of some documents: names, and the words that settle
    each (``low`` to ``high``). A document's border settles nothing (``bad``)."""

    __slots__ = ("name", "low", "high", "bad", "doc")

    def __init__(self, name, low, high, bad, doc):
        self.name, self.low, self.high, self.bad, self.doc = name, low, high, bad, doc

    @classmethod
    def of_words(cls, names: np.ndarray, row_start: np.ndarray) -> Symbols:
        at = np.arange(len(names))
        return cls(names, at, at + 1, np.zeros(len(names), bool), np.repeat(np.arange(len(row_start) - 1), np.diff(row_start)))

    def _beside(self) -> tuple[np.ndarray, np.ndarray]:
        """Whether each symbol has a neighbour before and after it."""
        inner = self.doc[1:] == self.doc[:-1]
        return np.concatenate([[False], inner]), np.concatenate([inner, [False]])

    def runs(self, seed: int) -> Symbols:
        """Runs of one name become one symbol."""
        n = len(self.name)
        head = np.ones(n, bool)
        head[1:] = (self.name[1:] != self.name[:-1]) | (self.doc[1:] != self.doc[:-1])
        first = np.flatnonzero(head)
        last = np.append(first[1:], n) - 1
        size = (last - first + 1).astype(np.uint64)
        name = self.name[first]
        name = np.where(size > 1, mix(name + size * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)), name)
        before, after = self._beside()
        prev, follow = np.maximum(first - 1, 0), np.minimum(last + 1, n - 1)
        has_prev, has_next = before[first], after[last]
        bad = np.logical_or.reduceat(self.bad, first) | ~has_prev | ~has_next | self.bad[prev] | self.bad[follow]
        return Symbols(name, np.where(has_prev, self.low[prev], self.low[first]), np.where(has_next, self.high[follow], self.high[last]), bad, self.doc[first])

    def pairs(self, seed: int) -> Symbols:
        """A left name and a right name after it become one symbol."""
        right = (mix(self.name ^ np.uint64(seed)) >> np.uint64(17)) & np.uint64(1) == 1
        before, after = self._beside()
        n = len(self.name)
        joins = ~right & after & np.append(right[1:], False)
        second = np.concatenate([[False], joins[:-1]])
        prev, follow = np.maximum(np.arange(n) - 1, 0), np.minimum(np.arange(n) + 1, n - 1)
        name = np.where(joins, mix(self.name * np.uint64(31) + mix(self.name[follow] + np.uint64(seed))), self.name)
        alone_left, alone_right = ~right & ~joins, right
        low = np.where(alone_right & before, self.low[prev], self.low)
        high = np.where((joins | alone_left) & after, self.high[follow], self.high)
        bad = self.bad | (joins & self.bad[follow]) | (alone_left & (~after | self.bad[follow])) | (alone_right & (~before | self.bad[prev]))
        keep = ~second
        return Symbols(name[keep], low[keep], high[keep], bad[keep], self.doc[keep])


def _least(keys: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum of keys[a] to keys[b], for each a <= b."""
    level = np.frexp((b - a + 1).astype(np.float64))[1] - 1
    out = np.empty(len(a), keys.dtype)
    table = keys
    for k in range(int(level.max()) + 1 if len(level) else 0):
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(table[a[at]], table[b[at] - (1 << k) + 1])
        step = 1 << k
        table = np.minimum(table[:-step], table[step:]) if len(table) > step else table
    return out


def windows(words: Words, size: int = WINDOW) -> np.ndarray:
    """First words of all windows, over the rows of ``words``."""
    count = np.maximum(np.diff(words.row_start) - size + 1, 0)
    return np.repeat(words.row_start[:-1] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(int(count.sum()))


def anchors(words: Words, starts: np.ndarray, size: int = WINDOW, rounds: int = ROUNDS) -> np.ndarray:
    """The anchor of each window that begins at ``starts``."""
    out = np.zeros(len(starts), np.uint64)
    if not len(starts):
        return out
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    levels = [Symbols.of_words(words.hashes, words.row_start)]
    for k in range(rounds):
        levels.append(levels[-1].runs(2 * k + 1).pairs(2 * k + 2))
    open_ = np.arange(len(starts))
    for level in reversed(levels):
        keys = np.where(level.bad, top, level.name)
        p = starts[open_]
        a = np.searchsorted(level.low, p)
        b = np.searchsorted(level.high, p + size, side="right") - 1
        some = np.flatnonzero(a <= b)
        least = _least(keys, a[some], b[some])
        found = least != top
        out[open_[some[found]]] = least[found]
        rest = np.ones(len(open_), bool)
        rest[some[found]] = False
        open_ = open_[rest]
        if not len(open_):
            break
    return out


def _window_digests(words: Words, starts: np.ndarray, size: int) -> np.ndarray:
    """128 bits of the words of each window: two numbers a row."""
    digest = hashlib.blake2b
    # Words in a row with one space between them, whatever stood there.
    ends = np.cumsum(words.ends - words.starts + 1)
    begins = ends - (words.ends - words.starts + 1)
    joined = np.full(int(ends[-1]) if len(ends) else 0, 0x20, np.uint8)
    solid = np.ones(len(joined), bool)
    solid[ends - 1] = False
    joined[solid] = words.data[~_blank(words)]
    view = memoryview(joined.tobytes())
    out = b"".join([digest(view[a:b], digest_size=16).digest() for a, b in zip(begins[starts].tolist(), (ends[starts + size - 1] - 1).tolist(), strict=True)])
    return np.frombuffer(out, np.int64).reshape(-1, 2)


def _blank(words: Words) -> np.ndarray:
    """Which bytes belong to no word."""
    edge = np.zeros(len(words.data) + 1, np.int8)
    np.add.at(edge, words.starts, 1)
    np.add.at(edge, words.ends, -1)
    return np.cumsum(edge[:-1], dtype=np.int8) == 0


def _parse(size: int, rounds: int):
    def run(batches):
        for batch in batches:
            for part in pieces(batch, 1, ROWS):
                words = Words(part.column(1))
                starts = windows(words, size)
                found = anchors(words, starts, size, rounds)
                cut = np.searchsorted(starts, words.row_start)
                names = [np.unique(found[i:j]).view(np.int64).tolist() for i, j in zip(cut[:-1], cut[1:], strict=True)]
                text = [(t.as_py() or "").encode() for t in part.column(1)]
                sha = [hashlib.sha256(b" ".join(t.split())).hexdigest() for t in text]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(words.row_start), pa.int64()), pa.array(sha), part.column(2), pa.array(names, pa.list_(pa.int64()))],
                    names=["id", "n_words", "sha", "key", "anchors"],
                )

    return run


def _runs(size: int, rounds: int):
    """Marked documents with the windows whose anchor another document has: first and
    number of each run of them, one after the other."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, 2, ROWS):
                words = Words(part.column(2))
                starts = windows(words, size)
                found = anchors(words, starts, size, rounds).view(np.int64)
                cut = np.searchsorted(starts, words.row_start)
                out = []
                for names, row, i, j in zip(part.column(3).to_pylist(), words.row_start, cut[:-1], cut[1:], strict=False):
                    at = starts[i:j][np.isin(found[i:j], np.array(names, np.int64))] - row
                    first = np.flatnonzero(np.diff(at, prepend=-2) != 1)
                    out.append(np.stack([at[first], np.diff(first, append=len(at))], axis=1).ravel().astype(np.int32))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(3)), pa.array(out, pa.list_(pa.int32()))], names=["id", "key", "text", "runs"])

    return run


def _window_names(words: Words, starts: np.ndarray, size: int, bits: int) -> np.ndarray:
    """A number of ``bits`` bits for each window, of its words' hashes: a rolling polynomial."""
    base = 0x9E3779B97F4A7C15
    power = np.full(len(words.hashes) + 1, base, np.uint64)
    power[0] = 1
    power = np.cumprod(power)
    sums = np.zeros(len(words.hashes) + 1, np.uint64)
    np.cumsum(words.hashes * power[:-1], out=sums[1:])
    back = np.full(len(power), pow(base, -1, 1 << 64), np.uint64)
    back[0] = 1
    name = mix((sums[starts + size] - sums[starts]) * np.cumprod(back)[starts])
    return (name >> np.uint64(64 - bits)).view(np.int64)


def _windows(size: int, bits: int, digests: bool):
    """Windows of the runs by name, with the digest of their words if it is asked for."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, 2, ROWS):
                words = Words(part.column(2))
                runs = part.column(3)
                pairs = runs.flatten().to_numpy(zero_copy_only=False).reshape(-1, 2).astype(np.int64)
                many = np.diff(runs.offsets.to_numpy()) // 2
                row = np.repeat(np.repeat(np.arange(len(many)), many), pairs[:, 1])
                ends = np.cumsum(pairs[:, 1])
                at = np.arange(len(row)) + np.repeat(pairs[:, 0] - (ends - pairs[:, 1]), pairs[:, 1])
                starts = at + words.row_start[row]
                ids, keys = (part.column(k).to_numpy(zero_copy_only=False)[row] for k in (0, 1))
                cols = {"id": ids, "key": keys, "at": at.astype(np.int32), "name": _window_names(words, starts, size, bits)}
                if digests:
                    two = _window_digests(words, starts, size)
                    cols |= {"h1": two[:, 0], "h2": two[:, 1]}
                for b in range(0, len(at), 1 << 17):
                    yield pa.RecordBatch.from_arrays([pa.array(c[b : b + (1 << 17)]) for c in cols.values()], names=list(cols))

    return run


def _strip(size: int):
    """What is left of documents without the words of repeated windows."""

    def run(batches):
        for batch in batches:
            out = []
            for i, key, text, at in zip(*(batch.column(k) for k in range(4)), strict=True):
                words = (text.as_py() or "").encode().split()
                edge, at = np.zeros(len(words) + 1, np.int64), np.array(at.as_py(), np.int64)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + size, -1)
                keep = np.cumsum(edge[:-1]) == 0
                left = b" ".join(compress(words, keep))
                out.append((i.as_py(), key.as_py(), int(len(words) - keep.sum()), left.decode(), hashlib.sha256(left).hexdigest()))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["id", "key", "n_removed", "kept_text", "kept_sha256"])

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW, rounds: int = ROUNDS, bits: int = 64) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text) of every row;
    kept_text is null where no word goes. ``bits`` is the size of windows' names: with
    fewer, more windows share a name and are told apart by their digests, at some cost."""
    scratch = Scratch(docs.sparkSession, "substring")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("key", F.xxhash64("text"))  # tells rows of one id apart
    parsed = scratch.save(rows.mapInArrow(_parse(size, rounds), "id long, n_words long, sha string, key long, anchors array<long>"))
    facts = parsed.select("id", "n_words", "sha", "key")
    repeated = not facts.groupBy("id").count().filter("count > 1").isEmpty()
    full = (F.col("n_words") >= size) & F.col("id").isNotNull()
    first = scratch.save(facts.filter(full).groupBy("sha").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("sha", "first_id"))
    copies = scratch.save(facts.filter(full).join(first, "sha").filter("id > first_id").select(F.col("id").alias("c_id"), F.col("key").alias("c_key")).distinct())
    is_copy = (F.col("id") == F.col("c_id")) & (F.col("key") == F.col("c_key"))
    solo = parsed.filter(full).select("id", "key", "anchors").join(copies, is_copy, "left_anti")
    entries = scratch.save(solo.select("id", "key", F.explode("anchors").alias("anchor")))
    shared = scratch.save(entries.groupBy("anchor").agg(F.min("id").alias("a"), F.max("id").alias("b")).filter("a < b").select("anchor"))
    marks = entries.join(shared, "anchor").groupBy("id", "key").agg(F.collect_set("anchor").alias("anchors"))
    marks = scratch.save(marks.select(F.col("id").alias("m_id"), F.col("key").alias("m_key"), "anchors"))
    scratch.drop(entries), scratch.drop(shared)
    held = rows.join(marks, (F.col("id") == F.col("m_id")) & (F.col("key") == F.col("m_key"))).select("id", "key", "text", "anchors")
    held = held.dropDuplicates(["id", "key"]) if repeated else held
    held = scratch.save(held.mapInArrow(_runs(size, rounds), "id long, key long, text string, runs array<int>"))
    scratch.drop(marks)
    named, digested = (held.mapInArrow(_windows(size, bits, d), f"id long, key long, at int, name long{', h1 long, h2 long' if d else ''}") for d in (False, True))
    ends = [F.min("id").alias("first_id"), F.max("id").alias("last_id")]
    of_words = [f(h).alias(f"{n}_{h}") for h in ("h1", "h2") for n, f in (("least", F.min), ("most", F.max))]
    mixed = (F.col("least_h1") != F.col("most_h1")) | (F.col("least_h2") != F.col("most_h2"))
    least = scratch.save(digested.groupBy("name").agg(*ends, *of_words).filter("first_id < last_id").select("name", "first_id", mixed.alias("mixed")))
    again = named.join(least.filter("not mixed"), "name").filter("id > first_id").select("id", "key", "at")
    if not least.filter("mixed").isEmpty():  # one name for windows of other words: their digests decide
        unlike = digested.join(least.filter("mixed").select("name"), "name", "left_semi")
        by_words = scratch.save(unlike.groupBy("h1", "h2").agg(*ends).filter("first_id < last_id").drop("last_id"))
        again = again.unionByName(unlike.join(by_words, ["h1", "h2"]).filter("id > first_id").select("id", "key", "at"))
    # Written on its own: the windows' shuffle is gone before texts are shuffled.
    cut = scratch.save(again.groupBy("id", "key").agg(F.collect_set("at").alias("at")))
    left = held.drop("runs").join(cut, ["id", "key"]).select("id", "key", "text", "at")
    left = left.mapInArrow(_strip(size), "id long, key long, n_removed long, kept_text string, kept_sha256 string")
    left = left.select(F.col("id").alias("l_id"), F.col("key").alias("l_key"), "n_removed", "kept_text", "kept_sha256")
    out = facts.join(copies, is_copy, "left").join(left, (F.col("id") == F.col("l_id")) & (F.col("key") == F.col("l_key")), "left")
    gone = F.col("c_id").isNotNull()
    return out.select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.when(gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(gone, F.lit(_EMPTY)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(gone, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"),
    )
