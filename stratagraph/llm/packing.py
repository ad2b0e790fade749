"""Operator 8: lexical retrieval packing with sharded BM25 indexes.

Documents become token ids, are dealt by a MinHash of their ids (so that like
documents meet) and cut into shards of bounded size. Each shard has an inverted
index over token ids with BM25 weights; document frequencies and the mean
length are those of the whole corpus. A seed is scored by all its distinct ids;
the end id closes every document and is no term. A seed document fills a window; its best
unused neighbours follow, whole if they fit, until a last one is cut to fit.
What is left of that one seeds the next window. What remains at the end of a
task fills sequences whose lengths are powers of two, so nothing is padded.

Null text counts as empty: its document is the end id alone. A long text is
encoded whole and cut over as many windows as it fills. Repeated rows are
packed one by one (``row_key`` tells them apart). An empty table gives an empty
table. Other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagraph.llm.scratch import Scratch
from stratagraph.llm.textcols import mix
from stratagraph.llm.tokenize import encoder

WINDOW = 4096
SHARD_TOKENS = 1 << 21
K1, B = 1.2, 0.75
#: A term that one in so many documents of a shard has is added as a whole row.
DENSE = 6


def tokenized(docs: DataFrame, tokenizer: str, space: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, near, ids): token ids with the end id; near: their MinHash."""

    def encode(batches):
        enc = encoder(tokenizer, space)
        end = np.array([end_id], enc.kind).tobytes()
        rank = mix(np.arange(1 << 16, dtype=np.uint64) + np.uint64(1))
        for batch in batches:
            rows = [enc.encode(t.as_py()) + end for t in batch.column(1)]
            ids = [np.frombuffer(x, enc.kind) for x in rows]
            near = [int((rank[x & 0xFFFF].min() >> np.uint64(1))) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array(near, pa.int64()), pa.array([x.astype("<u4").tobytes() if enc.kind.itemsize == 4 else x.tobytes() for x in ids], pa.binary())],
                names=["doc_id", "n", "near", "ids"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(encode, "doc_id long, n long, near long, ids binary")


def document_frequencies(tokens: DataFrame, kind: str) -> tuple[np.ndarray, int, float]:
    """Documents with each token id, their number and mean length; as many
    numbers come to the driver as the vocabulary has ids."""

    def count(batches):
        df = np.zeros(0, np.int64)
        for batch in batches:
            for x in batch.column(0):
                u = np.unique(np.frombuffer(x.as_py(), kind))
                if len(u) and u[-1] >= len(df):
                    df = np.concatenate([df, np.zeros(int(u[-1]) + 1 - len(df), np.int64)])
                df[u] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(df[at], pa.int64())], names=["token", "df"])

    rows = tokens.select("ids").mapInArrow(count, "token long, df long").groupBy("token").agg(F.sum("df").alias("df")).collect()
    out = np.zeros(max((r["token"] for r in rows), default=0) + 1, np.int64)
    for r in rows:
        out[r["token"]] = r["df"]
    total = tokens.agg(F.count(F.lit(1)).alias("n"), F.avg("n").alias("mean")).first()
    return out, total["n"], total["mean"] or 1.0


class Shard:
    """BM25 over the token ids of some documents."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        terms, weights = [], []
        for x in docs:
            u, tf = np.unique(x, return_counts=True)
            u = u.astype(np.int64)
            w = idf[u] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(x) / mean))
            terms.append(u), weights.append(w)
        term = np.concatenate(terms).astype(np.int64)
        order = np.argsort(term, kind="stable")
        owner = np.repeat(np.arange(len(docs)), [len(u) for u in terms])
        self.owner, self.weight = owner[order], np.concatenate(weights)[order]
        self.first = np.searchsorted(term[order], np.arange(len(idf) + 1))
        self.n, self.terms = len(docs), terms
        # Terms of many documents: a weight for each document of the shard, which
        # is added as a whole. They are few, since the shard's tokens are bounded.
        self.dense: dict[int, np.ndarray] = {}
        for t in np.flatnonzero(np.diff(self.first) > max(self.n // DENSE, 64)).tolist():
            row = self.dense[t] = np.zeros(self.n, np.float32)
            row[self.owner[self.first[t] : self.first[t + 1]]] = self.weight[self.first[t] : self.first[t + 1]]

    def scores(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """What each unused document scores for all terms of the seed."""
        terms = self.terms[seed].tolist()
        spans = [slice(self.first[t], self.first[t + 1]) for t in terms if t not in self.dense]
        score = np.zeros(self.n, np.float32)
        if spans:
            score += np.bincount(np.concatenate([self.owner[s] for s in spans]), np.concatenate([self.weight[s] for s in spans]), self.n)
        for t in terms:
            row = self.dense.get(t)
            if row is not None:
                score += row
        score[~unused] = 0
        return score

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused documents that share a term with the seed, best first."""
        score = self.scores(seed, unused)
        found = np.flatnonzero(score)
        return found[np.lexsort((found, -score[found]))]


class Packer:
    """Fills windows; keeps what doesn't fill one for the next shard."""

    def __init__(self, part: int, idf: np.ndarray, mean: float):
        self.base, self.idf, self.mean, self.count, self.rest = part << 32, idf, mean, 0, []
        #: Pieces by how they came into their window.
        self.came = {"seed": 0, "retrieved": 0, "by length": 0, "last": 0}

    def fill(self, docs: list[tuple], last: bool):
        """Pieces (row, start, length, sequence, offset) of docs (row, at, ids)."""
        docs = self.rest + docs
        self.rest = []
        if not docs:
            return
        index = Shard([d[2][:-1] for d in docs], self.idf, self.mean)
        left = np.array([len(d[2]) - d[1] for d in docs])
        at = np.array([d[1] for d in docs])
        unused = left > 0
        order = iter(np.argsort(-left, kind="stable"))
        total, carry = int(left.sum()), -1

        def piece(k, room, offset):
            n = int(min(left[k], room))
            out = (docs[k][0], int(at[k]), n, self.base + self.count, offset, docs[k][2])
            at[k] += n
            left[k] -= n
            unused[k] = left[k] > 0
            return n, out

        while total >= WINDOW:
            seed = carry if carry >= 0 and unused[carry] else next(k for k in order if unused[k])
            carry, used = -1, 0
            n, out = piece(seed, WINDOW, 0)
            self.came["seed"] += 1
            used += n
            yield out
            if used < WINDOW:
                score = index.scores(seed, unused)
                spare = None
                while used < WINDOW:
                    k = int(score.argmax())
                    if spare is None and score[k] and left[k] > WINDOW - used:
                        spare = k
                    if spare is not None:
                        # The best that fits; what doesn't fit now never will.
                        score[left > WINDOW - used] = 0
                        k = int(score.argmax())
                    if not score[k]:
                        break
                    score[k] = 0
                    n, out = piece(k, WINDOW, used)
                    self.came["retrieved"] += 1
                    used += n
                    yield out
                while used < WINDOW:
                    k = spare if spare is not None else next(j for j in order if unused[j])
                    self.came["retrieved" if spare is not None else "by length"] += 1
                    spare = None
                    n, out = piece(k, WINDOW - used, used)
                    used += n
                    yield out
                    if unused[k]:
                        carry = k
            elif unused[seed]:
                carry = seed
            total -= WINDOW
            self.count += 1
        self.rest = [(docs[k][0], int(at[k]), docs[k][2]) for k in np.flatnonzero(unused)]
        if last and self.rest:
            yield from self._powers()

    def _powers(self):
        """The last documents, cut into sequences of power-of-two lengths."""
        total = sum(len(ids) - at for _, at, ids in self.rest)
        rest = iter(self.rest)
        row, at, ids = next(rest)
        for k in reversed(range(total.bit_length())):
            if not total >> k & 1:
                continue
            room, offset = 1 << k, 0
            while room:
                if at == len(ids):
                    row, at, ids = next(rest)
                n = min(room, len(ids) - at)
                self.came["last"] += 1
                yield row, at, n, self.base + self.count, offset, ids
                at, room, offset = at + n, room - n, offset + n
            self.count += 1
        self.rest = []


_PIECES = "doc_id long, row_key long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def pack(docs: DataFrame, tokenizer: str, space: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece of a document, with its ids as 32-bit integers."""
    from stratagraph.llm.tokenize import Encoder

    scratch = Scratch(docs.sparkSession, "packing")
    kind = str(Encoder(tokenizer, space).kind)
    tokens = scratch.save(tokenized(docs, tokenizer, space, end_id, id_col, text_col))
    df, n, mean = document_frequencies(tokens, kind)
    share = docs.sparkSession.sparkContext.broadcast(np.log1p((n - df + 0.5) / (df + 0.5)))  # as long as the vocabulary

    def pieces(batches):
        part = TaskContext.get().partitionId()
        packer, held, size, row = Packer(part, share.value, mean), [], 0, 0
        whole: dict[int, tuple] = {}

        def rows(last):
            out = list(packer.fill(held, last))
            for a in range(0, len(out), 2048):
                cut = out[a : a + 2048]
                ids = [x[5][x[1] : x[1] + x[2]].astype("<u4").tobytes() for x in cut]
                num = lambda values: pa.array(list(values), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [num(whole[x[0]][0] for x in cut), num((part << 32) + x[0] for x in cut), num(x[1] for x in cut), num(x[2] for x in cut), num(zlib.crc32(i) for i in ids), num(whole[x[0]][1] for x in cut), num(x[3] for x in cut), num(x[4] for x in cut), pa.array(ids, pa.binary())],
                    names=[c.split()[0] for c in _PIECES.split(", ")],
                )
            kept = {d[0] for d in packer.rest}
            for r in [r for r in whole if r not in kept]:
                del whole[r]

        for batch in batches:
            for i, x in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.frombuffer(x.as_py(), kind)
                whole[row] = (i.as_py(), len(ids))
                held.append((row, 0, ids))
                row, size = row + 1, size + len(ids)
                if size >= SHARD_TOKENS:
                    yield from rows(False)
                    held, size = [], 0
        yield from rows(True)

    dealt = tokens.repartitionByRange("near", "doc_id").sortWithinPartitions("near", "doc_id", "ids")
    return dealt.select("doc_id", "ids").mapInArrow(pieces, _PIECES)
