"""Operator 10: token ids in patched frame-of-reference files.

Documents are ordered by id over all tasks; each task writes shards of whole
documents. A shard is one binary image:

    magic, numbers of documents, tokens and blocks,
    ids, null marks and token counts of documents,
    for each block its start in the packed bytes, base, width and exceptions,
    packed bytes, places of exceptions, values of exceptions.

A block holds 512 ids. Its minimum is subtracted; the rest is packed at the
smallest width that holds ``PERCENT`` of the ids; others are exceptions, patched
in when read. The block starts let a reader decode any range of ids alone.
Images are rows of a Parquet table, so that any store that Spark reaches holds
them; ``image`` alone is the file for readers without Spark.

Null text counts as empty: its document has the end id alone. Long texts are
encoded whole; a shard ends after the document that fills it. Repeated ids keep
all their rows, ordered by a hash of the text. Null ids come first. An empty table gives an
empty table. Other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratagraph.llm.tokenize import encoder

MAGIC = b"PFORTOK1"
BLOCK = 512
PERCENT = 90
SHARD_TOKENS = 1 << 20
#: Blocks that are packed or unpacked at a time.
SOME = 256
_HEAD = np.dtype([("docs", "<u8"), ("tokens", "<u8"), ("blocks", "<u8"), ("packed", "<u8"), ("exceptions", "<u8")])
_INDEX = np.dtype([("start", "<u8"), ("base", "<u4"), ("width", "u1"), ("exceptions", "<u2")])


def _lanes(width: int):
    """Where each of eight numbers of ``width`` bits lies in their ``width`` bytes:
    (its place among the eight, first byte, bits before it there, bytes it touches)."""
    for k in range(8):
        first, shift = divmod(k * width, 8)
        yield k, first, shift, (shift + width + 7) // 8


def _pack(rows: np.ndarray, width: int) -> np.ndarray:
    """Bytes of each row: its numbers at ``width`` bits, lowest first."""
    eights = rows.reshape(-1, 8).astype("<u4" if width <= 25 else "<u8")
    out = np.zeros((len(eights), width), np.uint8)
    for k, first, shift, touched in _lanes(width):
        x = eights[:, k] << eights.dtype.type(shift)
        for byte in range(touched):
            out[:, first + byte] |= (x >> eights.dtype.type(8 * byte)).astype(np.uint8)
    return out.reshape(len(rows), -1)


def _unpack(packed: np.ndarray, width: int) -> np.ndarray:
    eights = packed.reshape(-1, width)
    kind = np.dtype("<u4" if width <= 25 else "<u8")
    out = np.empty((len(eights), 8), np.uint32)
    for k, first, shift, touched in _lanes(width):
        x = np.zeros(len(eights), kind)
        for byte in range(touched):
            x |= eights[:, first + byte].astype(kind) << kind.type(8 * byte)
        out[:, k] = (x >> kind.type(shift)) & kind.type((1 << width) - 1)
    return out.reshape(len(packed), BLOCK)


def encode_image(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """The binary image of a shard."""
    ids = ids.astype(np.uint32)
    n = -(-len(ids) // BLOCK)
    full = np.empty(n * BLOCK, np.uint32)
    full[: len(ids)] = ids
    full[len(ids) :] = ids[-1] if len(ids) else 0
    rows = full.reshape(n, BLOCK)
    base = rows.min(axis=1) if n else np.zeros(0, np.uint32)
    rows = rows - base[:, None]
    # The smallest width that holds PERCENT of a block is that of one number of it.
    need = -(-BLOCK * PERCENT // 100)
    most = np.partition(rows, need - 1, axis=1)[:, need - 1] if n else base
    width = np.frexp(most.astype(np.float64))[1].astype(np.uint8)
    limit = np.left_shift(np.uint64(1), width.astype(np.uint64))
    odd = rows >= limit[:, None]
    index = np.zeros(n, _INDEX)
    index["base"], index["width"], index["exceptions"] = base, width, odd.sum(axis=1)
    size = width.astype(np.int64) * (BLOCK // 8)
    index["start"] = np.concatenate([[0], np.cumsum(size)[:-1]]) if n else 0
    packed = np.zeros(int(size.sum()), np.uint8)
    low = np.where(odd, 0, rows).astype(np.uint32)
    for w in np.unique(width[width > 0]):
        at = np.flatnonzero(width == w)
        for c in range(0, len(at), SOME):
            some = at[c : c + SOME]
            place = index["start"][some].astype(np.int64)[:, None] + np.arange(int(w) * (BLOCK // 8))
            packed[place] = _pack(low[some], int(w))
    block, place = np.nonzero(odd)
    head = np.array([(len(doc_ids), len(ids), n, len(packed), len(block))], _HEAD)
    null = np.array([i is None for i in doc_ids], np.uint8)
    number = np.array([0 if i is None else i for i in doc_ids], "<i8")
    return b"".join([MAGIC, head.tobytes(), number.tobytes(), null.tobytes(), np.array(lengths, "<u8").tobytes(), index.tobytes(), packed.tobytes(), place.astype("<u2").tobytes(), rows[block, place].astype("<u4").tobytes()])


class Image:
    """A shard's image, read lazily."""

    def __init__(self, data: bytes):
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token file")
        at = len(MAGIC)

        def take(kind, n):
            nonlocal at
            out = np.frombuffer(data, kind, int(n), at)
            at += out.nbytes
            return out

        self.head = take(_HEAD, 1)[0]
        n = self.head["docs"]
        ids, null = take("<i8", n), take("u1", n)
        self.doc_ids = [None if m else int(i) for i, m in zip(ids, null, strict=True)]
        self.lengths = take("<u8", n).astype(np.int64)
        self.index = take(_INDEX, self.head["blocks"])
        self.packed = take("u1", self.head["packed"])
        self.places, self.values = take("<u2", self.head["exceptions"]), take("<u4", self.head["exceptions"])

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids from ``start`` to ``stop``; only their blocks are decoded."""
        stop = int(self.head["tokens"]) if stop is None else stop
        a, b = start // BLOCK, -(-stop // BLOCK)
        index = self.index[a:b]
        rows = np.zeros((b - a, BLOCK), np.uint32)
        for w in np.unique(index["width"][index["width"] > 0]):
            at = np.flatnonzero(index["width"] == w)
            for c in range(0, len(at), SOME):
                some = at[c : c + SOME]
                place = index["start"][some].astype(np.int64)[:, None] + np.arange(int(w) * (BLOCK // 8))
                rows[some] = _unpack(self.packed[place], int(w))
        before = int(self.index["exceptions"][:a].sum())
        count = int(index["exceptions"].sum())
        block = np.repeat(np.arange(b - a), index["exceptions"])
        rows[block, self.places[before : before + count]] = self.values[before : before + count]
        rows += index["base"][:, None]
        return rows.reshape(-1)[start - a * BLOCK : stop - a * BLOCK]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, space: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of all documents, each with ``end_id``, in order of their ids."""

    def shards(batches):
        enc, part = encoder(tokenizer, space), TaskContext.get().partitionId()
        end = np.array([end_id], enc.kind).tobytes()
        ids, lengths, held, total, no = [], [], [], 0, 0

        def image():
            data = encode_image(ids, lengths, np.frombuffer(b"".join(held), enc.kind))
            return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([no]), pa.array([total]), pa.array([data], pa.binary())], names=["part", "shard", "n_tokens", "image"])

        for batch in batches:
            for i, x in zip(batch.column(0), enc.encode_all(batch.column(1).to_pylist()), strict=True):
                x += end
                ids.append(i.as_py()), lengths.append(len(x) // enc.kind.itemsize), held.append(x)
                total += lengths[-1]
                if total >= SHARD_TOKENS:
                    yield image()
                    ids, lengths, held, total, no = [], [], [], 0, no + 1
        if ids:
            yield image()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # Rows of one id, or of none, spread by a hash of their texts.
    order = (F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc())
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    ordered.mapInArrow(shards, "part long, shard long, n_tokens long, image binary").write.mode("overwrite").option("compression", "none").parquet(path)


def _documents(batches):
    """Documents of shards: where each starts in its shard, and its ids."""
    for batch in batches:
        for part, shard, data in zip(*(batch.column(k) for k in range(3)), strict=True):
            image = Image(data.as_py())
            stops = np.cumsum(image.lengths)
            starts = stops - image.lengths
            for a in range(0, len(starts), 1024):
                b = min(a + 1024, len(starts))
                ids = image.ids(int(starts[a]), int(stops[b - 1])).astype("<u4")
                rows = [ids[s - starts[a] : e - starts[a]].tobytes() for s, e in zip(starts[a:b], stops[a:b], strict=True)]
                same = lambda x: pa.array([x.as_py()] * len(rows), pa.int64())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [same(part), same(shard), pa.array(image.doc_ids[a:b], pa.int64()), pa.array(starts[a:b], pa.int64()), pa.array(image.lengths[a:b], pa.int64()), pa.array([zlib.crc32(x) for x in rows], pa.int64()), pa.array(rows, pa.binary())],
                    names=["part", "shard", "doc_id", "at", "n_tokens", "ids_crc32", "ids"],
                )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every document in the files.

    ``start`` counts the ids of all documents before. Sums run over parts first
    (as many as writing tasks), then over the shards of each part.
    """
    files = spark.read.schema("part long, shard long, n_tokens long, image binary").parquet(path)
    sizes = files.groupBy("part", "shard").agg(F.sum("n_tokens").alias("n"))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_at"))
    within = sizes.select("part", "shard", (F.sum("n").over(Window.partitionBy("part").orderBy("shard")) - F.col("n")).alias("shard_at"))
    base = within.join(before, "part").select("part", "shard", (F.col("part_at") + F.col("shard_at")).alias("base"))
    rows = files.select("part", "shard", "image").mapInArrow(_documents, "part long, shard long, doc_id long, at long, n_tokens long, ids_crc32 long, ids binary")
    return rows.join(base, ["part", "shard"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "ids")
