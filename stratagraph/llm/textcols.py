"""Vectorised work on Arrow string columns: words, word hashes, shingles.

All functions read whole texts. A word is a maximal run of bytes other than
space and 0x09-0x0D. Long texts are hashed slice by slice, so memory follows
the slice and not the text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes that are hashed at once; a longer word is hashed piece by piece.
SLICE = 1 << 16
#: A word's hash joins its polynomials modulo two primes, under these bases.
PRIMES = (2147483647, 2147483629)
BASES = (1220703125, 1103515245)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = []


def _power_tables() -> list[np.ndarray]:
    """For each prime the powers of its base and of the base's inverse."""
    if not _powers:
        for p, b in zip(PRIMES, BASES, strict=True):
            for base in (b, pow(b, -1, p)):
                row = np.ones(1, np.uint64)
                while len(row) <= SLICE:
                    row = np.concatenate([row, row * np.uint64(pow(base, len(row), p)) % np.uint64(p)])
                _powers.append(row[: SLICE + 1].astype(np.uint32))
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def pieces(batch: pa.RecordBatch, text: int, rows: int = 512, size: int = 1 << 22):
    """Slices of a batch with at most ``rows`` rows and about ``size`` bytes of text."""
    column = batch.column(text).cast(pa.large_string())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, min(a + rows, int(np.searchsorted(ends, ends[a] + size, side="right")) - 1))
        yield batch.slice(a, b - a)
        a = b


def _slices(data: np.ndarray):
    """Cuts of at most SLICE bytes, after a white space if there is one near."""
    a, n = 0, len(data)
    while a < n:
        b = min(a + SLICE, n)
        if b < n:
            hit = np.flatnonzero(_SPACE[data[max(b - 4096, a) : b]])
            if len(hit):
                b = max(b - 4096, a) + int(hit[-1]) + 1
        yield a, b
        a = b


def _parts(x: np.ndarray, s: np.ndarray, e: np.ndarray) -> list[np.ndarray]:
    """Polynomials modulo each prime of the bytes from ``s`` to ``e``."""
    out, tables = [], _power_tables()
    sums = np.empty(len(x) + 1, np.uint64)
    sums[0] = 0
    for k, p in enumerate(PRIMES):
        np.cumsum((x.astype(np.uint64) + np.uint64(1)) * tables[2 * k][: len(x)], out=sums[1:])
        out.append((sums[e] - sums[s]) % np.uint64(p) * tables[2 * k + 1][s] % np.uint64(p))
    return out


class Words:
    """Words of a column: hashes (if wanted), byte spans; each row's first word and byte."""

    __slots__ = ("data", "hashes", "offsets", "row_start", "starts", "ends")

    def __init__(self, column, lower: bool = False, hashed: bool = True):
        self.data, offs = self.data, self.offsets = buffers(column)
        one, two, starts, ends, open_ = [], [], [], [], False
        for a, b in _slices(self.data):
            x = _LOWER[self.data[a:b]] if lower else self.data[a:b]
            solid = ~_SPACE[x]
            first = solid.copy()
            first[1:] &= ~solid[:-1]
            last = solid.copy()
            last[:-1] &= ~solid[1:]
            lo, hi = np.searchsorted(offs, [a, b])
            cut = offs[lo:hi] - a
            inner = cut[cut > 0]
            first[cut] = solid[cut]
            last[inner - 1] = solid[inner - 1]
            s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
            h = _parts(x, s, e) if hashed else [np.zeros(len(s), np.uint64)] * 2
            if open_ and len(s) and s[0] == 0 and not (len(cut) and cut[0] == 0):
                # The word began before: its next bytes weigh as much more.
                for held, part, base, p in zip((one, two), h, BASES, PRIMES, strict=True):
                    held[-1][-1] = (int(held[-1][-1]) + int(part[0]) * pow(base, int(ends[-1][-1] - starts[-1][-1]), p)) % p
                ends[-1][-1] = e[0] + a
                s, e, h = s[1:], e[1:], [h[0][1:], h[1][1:]]
            if len(s):
                for held, part in zip((one, two, starts, ends), (*h, s + a, e + a), strict=True):
                    held.append(part)
            open_ = bool(solid[-1])
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        self.starts, self.ends = join(starts, np.int64), join(ends, np.int64)
        length = (self.ends - self.starts).astype(np.uint64)
        self.hashes = mix(mix((join(one, np.uint64) << np.uint64(31)) + join(two, np.uint64)) + length)
        self.row_start = np.searchsorted(self.starts, offs)

    def __len__(self) -> int:
        return len(self.row_start) - 1


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``n`` words of a row, and each row's first one.

    A row of fewer than ``n`` words, but one at least, has a single shingle:
    all its words. A row without words has none.
    """
    h, starts = words.hashes, words.row_start
    total = len(h)
    acc = np.zeros(total, np.uint64)
    seeds = mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)
    for j in range(min(n, total)):
        acc[: total - j] += h[j:] * seeds[j]
    count = np.diff(starts)
    whole = np.maximum(count - n + 1, 0)
    short = np.flatnonzero((count > 0) & (count < n))
    for r in short:
        part = h[starts[r] : starts[r + 1]]
        acc[starts[r]] = (part * seeds[: len(part)]).sum(dtype=np.uint64) + np.uint64(len(part))
    whole[short] = 1
    first = np.concatenate([[0], np.cumsum(whole)])
    keep = np.repeat(starts[:-1] - first[:-1], whole) + np.arange(first[-1])
    return mix(acc[keep]), first
