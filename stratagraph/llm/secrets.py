"""Operator 9: secrets with a linear-chain conditional random field.

Patterns find the base spans. Then all words of a document are tagged begin,
inside or outside of a secret by a linear chain, decoded by Viterbi. Its
features are the shape of a word's core (what follows a sign of assignment in
it, without quotes), the shapes of the words beside it, what the words before it
and its own stem say, and how many words of the document carry digits or such
signs. Tagged cores from ``LEAST`` characters on, beside no base span, are added.

The weights maximise the likelihood of short windows of words from at most
``SAMPLE`` documents: windows around base spans as they are; the same words with
made-up secrets under other names, signs and alphabets, or under no name; and
windows with what only looks like one (dates, numbers, names, addresses, a
keyword before plain words). So a name that no base pattern has, or none at all,
is part of what is learned, and no window teaches that what a pattern missed is
none. Windows are of bounded size, whatever the documents are.

Null counts as empty. Long texts are read whole; the patterns take linear time.
Repeated rows get equal results. With an empty table the result is empty. Other
columns are ignored.
"""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagraph.llm.spans import digest, joined, log_sum, overlaps, sampled
from stratagraph.llm.textcols import Words, mix, pieces

KINDS = ["assign", "access", "hex"]
ADDED = "tagged"
SAMPLE = 2000
SHRINK, RATE, EPOCHS, BATCH = 1e-5, 0.03, 4, 128
#: The least length of an added core; a window's words on each side.
LEAST, SIDE = 8, 8
#: Words whose features are computed at once; steps of a Viterbi block.
CHUNK, STRIDE = 1 << 16, 64
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_HEX_BYTES = bytes(int(chr(b) in "0123456789abcdef") for b in range(256))

# Names, signs and alphabets of made-up secrets.
NAMES = "password passwd pass pwd passphrase passcode secret client_secret token auth_token access_token api_key apikey key access_key private_key credential credentials bearer authorization auth login db_password signing_key".split()
SIGNS = [" = ", "=", ": ", ":", " is ", " was ", " -> ", " ", '="', ' = "', ": '", " := "]
ALPHABETS = [
    "0123456789abcdef",
    "0123456789ABCDEF",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "abcdefghijklmnopqrstuvwxyz0123456789-_",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz23456789!#$%&*@",
]


def _long_hex(text: str) -> bool:
    """Whether 32 such characters in a row are possible: every fourth byte tells."""
    return b"\x01" * 8 in text.encode("utf-8", "surrogatepass")[::4].translate(_HEX_BYTES)


def _found(text: str | None) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, start of the value) of the base matches."""
    if not text:
        return []
    out = []
    if "=" in text or ":" in text:
        out += [("assign", m.start(), m.end(), m.start(2)) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), m.start()) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    if _long_hex(text):
        out += [("hex", m.start(), m.end(), m.start()) for m in _HEX.finditer(text)]
    return out


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each kind that are long enough."""
    return [s[:3] for s in _found(text)]


# Features: each word has one number in each of these columns' ranges.

_LENGTHS = np.array([1, 3, 5, 8, 12, 16, 24, 40])
_CHANGES = np.array([1, 2, 3, 5, 8])
_HASHED = 1 << 12
_COLUMNS = {"length": 10, "classes": 4 * 3 * 3 * 3, "changes": 6 * 9, "hex": 2 * 9, "before": _HASHED + 1, "two before": _HASHED + 1, "sign": 7 * 6, "stem": _HASHED + 1, "shape before": 109, "shape after": 109, "marks": 18, "file": 12}
_OFFSETS = np.cumsum([0, *_COLUMNS.values()])
N_FEATURES = int(_OFFSETS[-1])
_UPPER, _LOWERS, _DIGIT = (np.array([lo <= b <= hi for b in range(256)]) for lo, hi in ((65, 90), (97, 122), (48, 57)))
_LOWERS[128:] = True
_LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 for b in range(256)])
_ALNUM = _UPPER | _LOWERS | _DIGIT
_SIGN = np.zeros(256, bool)
_SIGN[[ord(":"), ord("=")]] = True
_HEXES = _DIGIT | np.array([97 <= (b | 32) <= 102 for b in range(256)])
_KIND = (_UPPER + 2 * _LOWERS + 3 * _DIGIT).astype(np.int8)
#: Kinds of last characters of a word before: letter or digit, =, :, >, quote, other.
_LAST = np.full(256, 5, np.int64)
_LAST[_ALNUM] = 0
for _k, _c in enumerate("=:>\"", 1):
    _LAST[ord(_c)] = _k
_LAST[ord("'")] = 4


def _counts(mask: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.int32), np.cumsum(mask, dtype=np.int32)])


def _name_of(x: np.ndarray, s: np.ndarray, e: np.ndarray, last: np.ndarray, gap: np.ndarray) -> np.ndarray:
    """A bucket for the last run of letters in each piece (its length, first and
    last four letters), or the last bucket."""
    end = last[np.maximum(e - 1, 0)]
    some = (end >= s) & (e > s)
    end = np.where(some, end, 0)
    begin = np.where(some, np.maximum(gap[end] + 1, s), 0)
    low = (x | 32).astype(np.uint64)
    h = np.zeros(len(s), np.uint64)
    for k in range(4):
        h = (h << np.uint64(16)) | (low[np.minimum(begin + k, end)] << np.uint64(8)) | low[np.maximum(end - k, begin)]
    h = mix(h ^ ((end - begin).astype(np.uint64) << np.uint64(40)))
    return np.where(some, (h >> np.uint64(52)).astype(np.int64), _HASHED)


def cores(x: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word's core, and the sign before it (or the end)."""
    at, n = np.arange(len(x), dtype=np.int32), np.int32(len(x))
    sign = np.minimum.accumulate(np.where(_SIGN[x], at, n)[::-1])[::-1]
    first = np.minimum.accumulate(np.where(_ALNUM[x], at, n)[::-1])[::-1]
    final = np.maximum.accumulate(np.where(_ALNUM[x], at, np.int32(-1)))
    mark = np.minimum(sign[s], e)
    inner = mark < e - 1
    cs = first[np.where(inner, mark + 1, s)]
    ce = final[e - 1] + 1
    empty = (cs >= e) | (ce <= cs)
    whole = empty & inner  # nothing but signs after it: the core is before
    cs, inner = np.where(whole, first[s], cs), inner & ~whole
    gone = (cs >= e) | (ce <= cs)
    return np.where(gone, s, cs), np.where(gone, s, ce), np.where(inner, mark, e)


def _columns(words: Words, lo: int, hi: int) -> tuple[np.ndarray, ...]:
    """What words ``lo`` to ``hi`` say by themselves."""
    base = int(words.starts[lo])
    x = words.data[base : int(words.ends[hi - 1])]
    s, e = words.starts[lo:hi] - base, words.ends[lo:hi] - base
    cs, ce, mark = cores(x, s, e)
    upper, lower, digit, hexes = (_counts(m[x]) for m in (_UPPER, _LOWERS, _DIGIT, _HEXES))
    kind = _KIND[x]
    change = np.concatenate([np.zeros(2, np.int32), np.cumsum(kind[1:] != kind[:-1], dtype=np.int32)])
    n = ce - cs
    u, w, d, hx = (c[ce] - c[cs] for c in (upper, lower, digit, hexes))
    turns = np.where(n > 1, change[np.maximum(ce, 1)] - change[np.minimum(cs + 1, ce)], 0)
    length = np.searchsorted(_LENGTHS, n, side="right")
    sort = ((np.searchsorted([1, 3, 6], d, side="right") * 3 + np.minimum(u, 2)) * 3 + np.minimum(w, 2)) * 3 + np.minimum(n - u - w - d, 2)
    at = np.arange(len(x), dtype=np.int32)
    last = np.maximum.accumulate(np.where(_LETTER[x], at, np.int32(-1)))
    gap = np.maximum.accumulate(np.where(_LETTER[x], np.int32(-1), at))
    name = _name_of(x, s, e, last, gap)
    stem, led = np.full(len(s), _HASHED), np.flatnonzero(mark < e)
    stem[led] = _name_of(x, s[led], np.maximum(mark, s)[led], last, gap)
    mixed = (d > 0) & (u + w > 0)
    coarse = 3 * (n >= LEAST) + np.where(mixed, 2, np.where(d > 0, 1, 0))
    turned = np.searchsorted(_CHANGES, turns, side="right")
    ats, dots, strokes = (c[ce] - c[cs] for c in (_counts(x == ord(m)) for m in "@./"))
    marks = (np.minimum(ats, 1) * 3 + np.minimum(dots, 2)) * 3 + np.minimum(strokes, 2)
    return length, sort, turned * 9 + length, (hx == n) * 9 + length, name, _LAST[x[e - 1]], coarse, stem, marks


def file_codes(words: Words) -> np.ndarray:
    """A number for each row: how many words are cued, and its braces."""
    cued = np.zeros(len(words.starts), bool)
    for a in range(0, len(cued), CHUNK):
        b = min(a + CHUNK, len(cued))
        base = int(words.starts[a])
        x = words.data[base : int(words.ends[b - 1])]
        marks = _counts(_DIGIT[x] | _SIGN[x])
        cued[a:b] = marks[words.ends[a:b] - base] > marks[words.starts[a:b] - base]
    n = np.maximum(np.diff(words.row_start), 1)
    share = np.diff(_counts(cued)[words.row_start]) / n
    marks = np.flatnonzero((words.data == ord(";")) | (words.data == ord("{")))
    braces = np.diff(np.searchsorted(marks, words.offsets)) > 0
    return np.searchsorted([0.001, 0.01, 0.05, 0.15, 0.4], share, side="right") * 2 + braces


def features(words: Words, files: np.ndarray | None = None):
    """(first word, columns of feature numbers) of all words, ``CHUNK`` at a time."""
    n = len(words.starts)
    files = file_codes(words) if files is None else files
    heads = np.zeros(n + 1, bool)
    heads[words.row_start] = True
    row = np.searchsorted(words.row_start, np.arange(n), side="right") - 1
    for a in range(0, n, CHUNK):
        b = min(a + CHUNK, n)
        lo, hi = max(a - 2, 0), min(b + 1, n)
        length, sort, turned, hexed, name, last, coarse, stem, marks = _columns(words, lo, hi)
        me, at = np.arange(a - lo, b - lo), np.arange(a, b)
        has1 = ~heads[at]
        has2 = has1 & ~heads[np.maximum(at - 1, 0)]
        after = ~heads[at + 1]
        one, two, nxt = np.maximum(me - 1, 0), np.maximum(me - 2, 0), np.minimum(me + 1, hi - lo - 1)
        cols = [
            length[me], sort[me], turned[me], hexed[me],
            np.where(has1, name[one], _HASHED), np.where(has2, name[two], _HASHED),
            np.where(has1, last[one], 6) * 6 + coarse[me], stem[me],
            np.where(has1, sort[one], 108), np.where(after, sort[nxt], 108), marks[me], files[row[at]],
        ]
        yield a, [c + o for c, o in zip(cols, _OFFSETS, strict=False)]


def _ways(v: np.ndarray, trans: np.ndarray, heads: np.ndarray) -> list[np.ndarray]:
    """Scores (..., label, row) of coming from each label; ``heads`` come from none."""
    out = [v[..., k, :][..., None, :] + trans[k][:, None] for k in range(3)]
    if len(heads):
        for k in range(3):
            out[k][..., heads] = v[..., k, :][..., None, heads] + np.array([[0.0], [0.0], [-1e4]])
    return out


def viterbi(score: np.ndarray, heads: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """The best path over words in a row; ``heads`` marks the first of each
    document, which follows nothing and cannot be inside.

    Blocks of ``STRIDE`` steps run side by side: first what a block makes of each
    label before it, then labels from block to block, then those within.
    """
    n, stride = len(score), STRIDE
    if not n:
        return np.zeros(0, np.int64)
    rows = -(-n // stride)
    s = np.zeros((rows * stride, 3))
    s[:n] = score
    h = np.ones(rows * stride, bool)
    h[:n] = heads
    s = np.ascontiguousarray(s.reshape(rows, stride, 3).transpose(1, 2, 0))  # step, label, block
    first = [np.flatnonzero(x) for x in h.reshape(rows, stride).T]
    whole = np.where(np.eye(3, dtype=bool)[:, :, None], 0.0, -1e9) + np.zeros(rows)
    for c in range(stride):
        x, y, z = _ways(whole, trans, first[c])
        whole = np.maximum(np.maximum(x, y), z) + s[c]
    entry, v = np.zeros((3, rows)), np.zeros(3)
    for r, block in enumerate(whole.transpose(2, 0, 1)):
        entry[:, r] = v
        v = (v[:, None] + block).max(axis=0)
        v = v - v.max()
    back = np.zeros((stride, 3, rows), np.int8)
    for c in range(stride):
        x, y, z = _ways(entry, trans, first[c])
        top = np.maximum(x, y)
        back[c] = np.where(z > top, 2, y > x)
        entry = np.maximum(top, z) + s[c]
    at, leads = np.arange(rows), np.repeat(np.arange(3, dtype=np.int8)[:, None], rows, axis=1)
    for c in reversed(range(stride)):
        leads = back[c][leads, at]
    label, ends = int(entry[:, -1].argmax()), np.zeros(rows, np.int8)
    for r in reversed(range(rows)):
        ends[r] = label
        label = int(leads[label, r])
    path = np.zeros((stride, rows), np.int8)
    for c in reversed(range(stride)):
        path[c] = ends
        ends = back[c][ends, at]
    return path.T.reshape(-1)[:n].astype(np.int64)


def _floor() -> np.ndarray:
    """No inside after outside."""
    out = np.zeros((3, 3))
    out[0, 2] = -1e4
    return out


# Training windows: (text, labels of its words).


def made_up(rng: random.Random, length: int | None = None) -> str:
    """A made-up secret with a letter and a digit or a change of case."""
    while True:
        letters = rng.choice(ALPHABETS)
        out = "".join(rng.choice(letters) for _ in range(length or rng.choice([8, 9, 10, 12, 14, 16, 20, 24, 32, 40, 48])))
        if out[0].isalnum() and out[-1].isalnum() and any(c.isdigit() for c in out) and any(c.isalpha() for c in out):
            return out


def lookalike(rng: random.Random) -> str:
    """What only looks like a secret: numbers, dates, names, addresses."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    w = lambda: "".join(rng.choice("abcdefghijklmnoprstuvwy") for _ in range(rng.randrange(3, 9)))
    return rng.choice(
        [
            lambda: d(rng.randrange(1, 9)), lambda: d(16), lambda: f"20{d(2)}-0{d(1)}-1{d(1)}", lambda: f"20{d(2)}-0{d(1)}-1{d(1)}T1{d(1)}:3{d(1)}:0{d(1)}Z", lambda: f"1{d(1)}:{d(2)}", lambda: f"v{d(1)}.{d(2)}.{d(1)}", lambda: f"{d(2)}.{d(3)}.{d(2)}.{d(1)}",
            lambda: f"https://www.{w()}.com/{w()}/{w()}?id={d(4)}", lambda: f"{w()}.{d(2)}@{w()}.example.com", lambda: f"{w()}{d(2)}@{w()}{d(1)}.{w()}.org", lambda: f"{w()}.{w()}@{w()}.net", lambda: f"{w().title()}{w().title()}{w().title()}", lambda: f"{w()}_{w()}_{d(2)}.{rng.choice(['txt', 'py', 'pdf', 'jpeg'])}",
            lambda: f"{w().upper()}-20{d(2)}-{d(5)}", lambda: f"+1-{d(3)}-{d(3)}-{d(4)}", lambda: f"{w()}-{w()}-{w()}", lambda: f"${d(3)},{d(3)}.00", lambda: f"{w()}/{w()}/{w()}", lambda: f"{w().upper()}{d(2)}", lambda: f"{d(3)}{rng.choice(['km', 'px', 'kg', 'MHz', 'th'])}", lambda: f"ISBN{d(13)}",
        ]
    )()


def _planted(words: list[str], rng: random.Random) -> tuple[str, list[int]]:
    """The words with a made-up secret among them, under a name or none."""
    k = rng.randrange(len(words) + 1)
    value = made_up(rng)
    name, sign = rng.choice(NAMES), rng.choice(SIGNS)
    name = rng.choice([str.lower, str.upper, str.title, lambda x: x.replace("_", "-")])(name)
    if rng.random() < 0.25:  # no name: the value must speak for itself
        name, sign = "", ""
        value = made_up(rng, rng.choice([20, 24, 32, 40, 48]))
    if rng.random() < 0.15:
        name = "x" + "".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randrange(3, 9))) if name and "=" in sign else name
    parts = [value[a : a + 24] for a in range(0, len(value), 24)] if len(value) > 24 and rng.random() < 0.3 else [value]
    close = rng.choice(["", "", ".", ",", ";"]) if not sign.endswith(("'", '"')) else sign[-1]
    inserted = f"{name}{sign}{parts[0]}".split() + parts[1:]
    inserted[-1] += close
    labels = [0] * (len(inserted) - len(parts)) + [1] + [2] * (len(parts) - 1)
    return " ".join([*words[:k], *inserted, *words[k:]]), [0] * k + labels + [0] * (len(words) - k)


def _harmless(words: list[str], rng: random.Random) -> tuple[str, list[int]]:
    """The words with a lookalike among them, or a keyword before plain words."""
    k = rng.randrange(len(words) + 1)
    if rng.random() < 0.5:
        inserted = [lookalike(rng) + rng.choice(["", "", ".", ","])]
        if rng.random() < 0.3:
            inserted = [rng.choice(["id", "date", "number", "ref", "at", "on"]) + rng.choice(["", ":", " ="]), *inserted]
    else:
        plain = [w for w in words if w.isalpha()] or ["required"]
        inserted = f"{rng.choice(NAMES)}{rng.choice(SIGNS[:8])}{rng.choice([*plain, 'required', 'none', 'true', 'here'])}".split()
    text = " ".join([*words[:k], *inserted, *words[k:]])
    return text, [0] * len(text.split(" "))


def training_windows(text: str, seed: int, most: int = 4) -> list[tuple[str, list[int]]]:
    """Windows of a document, of bounded size."""
    rng, found = random.Random(seed), _found(text)
    ends = sorted({(v, e) for _, _, e, v in found})
    out: list[tuple[str, list[int]]] = []
    spots = [m.span() for m in _WORD.finditer(text)]
    starts = [a for a, _ in spots]
    labels = [0] * len(spots)
    for v, e in ends:
        k = int(np.searchsorted(starts, v, side="right")) - 1
        at = k
        while 0 <= at < len(spots) and spots[at][0] < e:
            labels[at] = labels[at] or (1 if at == k else 2)
            at += 1
    centres = [k for k, y in enumerate(labels) if y == 1][:most]
    cued = [k for k, (a, b) in enumerate(spots) if not labels[k] and any(c in "=:0123456789" for c in text[a : min(b, a + 64)])]
    centres += rng.sample(cued, min(2, len(cued))) + [rng.randrange(len(spots)) for _ in range(2) if spots]
    for k in centres:
        a, b = max(0, k - SIDE), min(len(spots), k + SIDE + 1)
        if spots[b - 1][1] - spots[a][0] <= 4096:
            out.append((" ".join(text[i:j] for i, j in spots[a:b]), labels[a:b]))
    # Words without a base secret in them take made-up ones in.
    plain = [w for w, y in out if not any(y)][-2:]
    for w in plain:
        some = [x for x in w.split(" ") if x]
        out += [_planted(some, rng), _planted(some, rng), _harmless(some, rng)]
    return out


def _emit_windows(batches):
    for batch in batches:
        rows, files, labels = [], [], []
        for h, text in zip(batch.column(0), batch.column(1), strict=True):
            t = text.as_py()
            code = int(file_codes(Words(pa.array([t]), hashed=False))[0])
            got = training_windows(t, h.as_py() & 0xFFFFFFFF)
            rows += [w for w, _ in got]
            labels += [np.array(y, np.int8).tobytes() for _, y in got]
            files += [code] * len(got)
        words = Words(pa.array(rows, pa.string()), hashed=False)
        idx = [np.stack(x, axis=1) for _, x in features(words, np.array(files, np.int64))]
        idx = np.concatenate(idx).astype("<i4") if idx else np.zeros((0, len(_COLUMNS)), "<i4")
        cut = [idx[a:b].tobytes() for a, b in zip(words.row_start[:-1], words.row_start[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(cut, pa.binary()), pa.array(labels, pa.binary())], names=["idx", "y"])


def _marginals(score: np.ndarray, trans: np.ndarray, size: np.ndarray):
    """Node and link marginals of padded chains."""
    n, t, k = score.shape
    alpha, beta = np.zeros((n, t, k)), np.zeros((n, t, k))
    alpha[:, 0] = score[:, 0] + [0.0, 0.0, -1e4]
    for i in range(1, t):
        step = score[:, i] + log_sum(alpha[:, i - 1, :, None] + trans, 1)
        alpha[:, i] = np.where((i < size)[:, None], step, alpha[:, i - 1])
    for i in range(t - 2, -1, -1):
        step = log_sum(trans + (score[:, i + 1] + beta[:, i + 1])[:, None, :], 2)
        beta[:, i] = np.where((i + 1 < size)[:, None], step, 0.0)
    whole = log_sum(alpha[:, -1], 1)
    live = np.arange(t)[None] < size[:, None]
    node = np.exp(alpha + beta - whole[:, None, None]) * live[:, :, None]
    link = np.exp(alpha[:, :-1, :, None] + trans + (score + beta)[:, 1:, None, :] - whole[:, None, None, None]) * live[:, 1:, None, None]
    return node, link.sum(axis=(0, 1))


def fit(runs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Feature weights and, as the last three rows, transitions."""
    w = np.zeros((N_FEATURES + 3, 3))
    m, v, step = np.zeros_like(w), np.zeros_like(w), 0
    order, width = np.random.default_rng(9), len(_COLUMNS)
    for _ in range(EPOCHS):
        deal = order.permutation(len(runs))
        for a in range(0, len(runs), BATCH):
            some = [runs[k] for k in deal[a : a + BATCH]]
            size = np.array([len(y) for _, y in some])
            live = np.arange(size.max())[None] < size[:, None]
            rows = np.concatenate([x for x, _ in some])
            target = np.zeros((*live.shape, 3))
            target[live] = np.eye(3)[np.concatenate([y for _, y in some])]
            score = np.zeros(target.shape)
            score[live] = w[rows].sum(axis=1)
            node, link = _marginals(score, w[-3:] + _floor(), size)
            off = (node - target)[live] / len(some)
            g = SHRINK * w
            flat = rows.ravel()
            g[:-3] += np.stack([np.bincount(flat, np.repeat(off[:, c], width), N_FEATURES) for c in range(3)], axis=1)
            g[-3:] += (link - np.einsum("nti,ntj->ij", target[:, :-1], target[:, 1:])) / len(some)
            step += 1
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w = w - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w


def labels_of(words: Words, w: np.ndarray) -> np.ndarray:
    """The best labels of all words of all rows."""
    score = np.zeros((len(words.starts), 3))
    for a, cols in features(words):
        for c in cols:
            score[a : a + len(c)] += w[c]
    heads = np.zeros(len(score) + 1, bool)
    heads[words.row_start] = True
    return viterbi(score, heads[:-1], w[-3:] + _floor())


def tag(texts: list[str | None], w: np.ndarray) -> list[tuple[list, list]]:
    """(base spans, added spans) of each text."""
    out: list[tuple[list, list]] = [(base_spans(t), []) for t in texts]
    if not w.any():
        return out
    words = Words(pa.array(texts, pa.large_string()), hashed=False)
    path = labels_of(words, w)
    hits = np.flatnonzero(path)
    row = np.searchsorted(words.row_start, hits, side="right") - 1
    for r in np.unique(row):
        text, (base, added) = texts[r], out[r]
        raw, first = text.encode(), int(words.offsets[r])
        x, last = np.frombuffer(raw, np.uint8), -2
        for k in hits[row == r]:
            s, e = int(words.starts[k]) - first, int(words.ends[k]) - first
            cs, ce, _ = cores(x[s:e], np.array([0]), np.array([e - s]))
            a, b = s + int(cs[0]), s + int(ce[0])
            a, b = len(raw[:a].decode()), len(raw[:b].decode())
            if path[k] == 2 and last == k - 1:
                added[-1] = (ADDED, added[-1][1], b)
            else:
                added.append((ADDED, a, b))
            last = k
        added[:] = [x for x in added if x[2] - x[1] >= LEAST and not overlaps(x[1], x[2], base)]
    return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> np.ndarray:
    def learn(batches):
        rows = sorted((r["idx"], r["y"]) for b in batches for r in b.to_pylist())
        runs = [(np.frombuffer(x, "<i4").reshape(-1, len(_COLUMNS)), np.frombuffer(y, np.int8)) for x, y in rows if len(y)]
        yield pa.RecordBatch.from_arrays([pa.array([fit(runs).astype("<f8").tobytes()], pa.binary())], names=["w"])

    windows = sampled(docs, sample, id_col, text_col).mapInArrow(_emit_windows, "idx binary, y binary")
    got = windows.repartition(1).mapInArrow(learn, "w binary").collect()
    if not got:
        return np.zeros((N_FEATURES + 3, 3))
    return np.frombuffer(got[0]["w"], "<f8").reshape(-1, 3)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row: doc_id, n_assign, n_access, n_hex (of base spans),
    base_sha256, spans, n_added."""
    w = train(docs, id_col, text_col)
    kinds = [*KINDS, ADDED]

    def run(batches):
        for batch in batches:
            for part in pieces(batch, 1, 512, 1 << 21):
                rows = tag(part.column(1).to_pylist(), w)
                count = [pa.array([sum(s[0] == k for s in b) for b, _ in rows], pa.int64()) for k in KINDS]
                sha = pa.array([digest(b, kinds) for b, _ in rows], pa.string())
                text = pa.array([joined(b + x, kinds) for b, x in rows], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), *count, sha, text, pa.array([len(x) for _, x in rows], pa.int64())], names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long")
