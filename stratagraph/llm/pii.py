"""Operator 4: personal data with a skip-chain conditional random field.

Patterns find the base spans. Then the words of a document that could be part
of such data (with a digit or an at sign) are the nodes of a field over the
kinds and "none": words side by side share a chain potential, and words alike
however far apart (the same letters and digits, the same local part of an
address, the same last digits) share a skip potential. Words in base spans are
evidence. Loopy belief propagation spreads it, so that a later mention that no
pattern fits gets the label of the first. Words that reach ``SURE``, by their
own shape, by their neighbours or along a skip, become spans of their own, in
documents without a base span too; base spans stay.

The weights, those of the skip potential too, maximise the pseudo-likelihood of
short windows from at most ``SAMPLE`` documents, labelled by the patterns, into
which made-up data are planted: some as the patterns know them, with a later
mention in another form; some in another form alone; and what only looks like
such data (numbers that fail the card test, dates, versions, prices). So what the
patterns miss is not taught to be none. Windows are of bounded size.

Null counts as empty and has no spans. Long texts are read whole; the patterns
take linear time. Repeated rows get equal results. With an empty table or no
cue the result has no spans. Other columns are ignored.
"""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagraph.llm.spans import covering, digest, joined, overlaps, sampled, softmax, words
from stratagraph.llm.textcols import pieces

KINDS = ["email", "ip", "card", "phone"]
SAMPLE = 1000
SURE = 0.6
ROUNDS = 10
SHRINK, STEPS = 1e-4, 150
#: Words of a training window, and its characters at most.
WORDS, CHARS = 36, 2048
_CUE = re.compile(r"[0-9@]|[(\[]at[)\]]")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# A run of digits is taken whole or not at all, so no search restarts in it.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_KEEP = re.compile(r"[^a-z0-9]+")
_BEFORE = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str):
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _BEFORE:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield "email", start, found.end()
        # Nothing before an at sign can belong to a later address.
        free = found.end() if found else at + 1
        at = text.find("@", free)


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each kind that pass its test."""
    if not text or not _CUE.search(text):
        return []
    out = list(_emails(text))
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


_CONTEXT = 64
N_FEATURES = 1 + 7 + 4 + 13 + _CONTEXT + 1


def _features(word: str, before: str) -> list[float]:
    """The shape of a word and, as a bucket, the letters at the end of the one before."""
    number = "".join(c for c in word if "0" <= c <= "9")
    core = word.strip(".,;:!?$#*\"'|")
    digits, rest = len(number), len(core) - len(number)
    lead = re.search(r"[a-z]+(?=[^a-z]*$)", before.lower())
    bucket = zlib.crc32(lead[0].encode()) % _CONTEXT if lead else _CONTEXT
    context = [0.0] * (_CONTEXT + 1)
    context[bucket] = 1.0
    shape = [float(digits >= n) for n in (1, 2, 4, 7, 10, 14, 20)] + [float(rest >= n) for n in (1, 2, 4, 8)]
    letters = any(c.isalpha() for c in core)
    split = len(re.findall(r"[0-9]+", core))
    kinds = [
        "@" in core, bool(re.search(r"[(\[]at[)\]]", core.lower())), core.count(".") == 1, core.count(".") == 2, core.count(".") == 3, core[:1] == "+", "(" in core, "-" in core, letters,
        14 <= digits <= 19 and luhn(number), 10 <= digits <= 12 and split > 1 and not letters, split == 4, digits == len(core) and digits > 0,
    ]
    return [1.0, *shape, *map(float, kinds), *context]


def _keys(word: str) -> set[str]:
    """What makes words alike."""
    low = word.lower()
    out = {_KEEP.sub("", low)}
    local = re.split(r"@|[(\[]at[)\]]", low)
    if len(local) > 1:
        out.add(_KEEP.sub("", local[0]))
    digits = "".join(c for c in word if "0" <= c <= "9")
    if len(digits) >= 7:
        out |= {digits, digits[-7:]}
    return {k for k in out if len(k) >= 6}


class Graph:
    """The nodes and links of some documents' fields."""

    def __init__(self):
        self.doc, self.span, self.x, self.label, self.links = [], [], [], [], []

    def add(self, doc: int, text: str, spans) -> None:
        found = words(text)
        cover = covering(found, spans)
        alike: dict[str, int] = {}
        keys = [_keys(w) if cover[k] is not None or _CUE.search(w) else set() for k, (_, _, w) in enumerate(found)]
        ordered = sorted((a, b, kind) for kind, a, b in spans)
        for k, c in enumerate(cover):
            if c is not None and (k == 0 or cover[k - 1] is None or cover[k - 1][0] != c[0]):
                a, b, _ = ordered[c[0]]
                keys[k] |= _keys(text[a:b])  # what a span of several words says as a whole
        known = set().union(*keys) if keys else set()
        last = None
        for k, (a, b, w) in enumerate(found):
            # Words without a cue join in if they repeat one that has it.
            own = keys[k] or ({_KEEP.sub("", w.lower())} & known if len(w) >= 6 else set())
            if not own and cover[k] is None and not _CUE.search(w):
                continue
            n = len(self.doc)
            self.doc.append(doc)
            self.span.append((a, b))
            self.x.append(_features(w, found[k - 1][2] if k else ""))
            self.label.append(0 if cover[k] is None else 1 + KINDS.index(cover[k][1]))
            if last == k - 1:
                self.links.append((n - 1, n, 0))
            for key in sorted(own):
                if key in alike:
                    self.links.append((alike[key], n, 1))
                alike[key] = n
            last = k

    def arrays(self):
        links = np.array(sorted(set(self.links)), np.int64).reshape(-1, 3)
        return np.array(self.x).reshape(-1, N_FEATURES), np.array(self.label, np.int64), links


def fit(graph: Graph) -> np.ndarray:
    """Weights of features and of neighbours' labels (before, after, skip)."""
    x, y, links = graph.arrays()
    k = 1 + len(KINDS)
    if not len(y):
        return np.zeros((N_FEATURES + 3 * k, k))
    near = np.zeros((len(y), 3, k))
    for way, (i, j) in enumerate(((1, 0), (0, 1))):
        chain = links[links[:, 2] == 0]
        np.add.at(near, (chain[:, i], way, y[chain[:, j]]), 1)
        skip = links[links[:, 2] == 1]
        np.add.at(near, (skip[:, i], 2, y[skip[:, j]]), 1)
    z = np.concatenate([x, near.reshape(len(y), -1)], axis=1)
    w, target = np.zeros((z.shape[1], k)), np.eye(k)[y]
    m = v = np.zeros_like(w)
    for step in range(1, STEPS + 1):
        g = z.T @ (softmax(z @ w) - target) / max(len(y), 1) + SHRINK * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w


# Made-up data for training windows.


def _number(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def _name(rng: random.Random) -> str:
    return "".join(rng.choice("abcdefghiklmnoprstuvw") for _ in range(rng.randrange(3, 8)))


def card(rng: random.Random, good: bool = True) -> str:
    """Sixteen digits that pass the card test, or don't."""
    while True:
        out = str(rng.choice([2, 3, 4, 5, 6])) + _number(rng, 15)
        if luhn(out) == good:
            return out


def mention(kind: str, rng: random.Random) -> tuple[str, list[str], list[str]]:
    """Made-up data as a pattern knows it; other forms that speak for themselves;
    other forms that only the first makes clear."""
    if kind == "email":
        local, host, top = f"{_name(rng)}{rng.choice(['.', '_', ''])}{_name(rng)}{rng.choice(['', _number(rng, 2)])}", _name(rng), rng.choice(["com", "org", "net", "example.com"])
        return f"{local}@{host}.{top}", [f"{local}(at){host}.{top}", f"{local}[at]{host}.{top}"], [f"{local}@{host}", f"@{local}", local]
    if kind == "phone":
        a, b, c, d = str(rng.randrange(1, 98)), _number(rng, 3), _number(rng, 3), _number(rng, 4)
        return rng.choice([f"+{a} ({b}) {c}-{d}", f"+{a} {b} {c} {d}", f"+{a}-{b}-{c}-{d}"]), [f"({b}) {c}-{d}", f"{b}-{c}-{d}", f"{b}.{c}.{d}", f"00{a} {b} {c} {d}"], [f"{c}-{d}", f"{c}{d}", f"{b}{c}{d}", f"{a}{b}{c}{d}"]
    if kind == "ip":
        parts = [str(rng.randrange(1, 256)) for _ in range(4)]
        return ".".join(parts), ["-".join(["ip", *parts])], ["-".join(parts), "_".join(parts)]
    x = card(rng)
    cut = [x[k : k + 4] for k in range(0, 16, 4)]
    return rng.choice([x, " ".join(cut), "-".join(cut)]), [".".join(cut), "/".join(cut)], ["_".join(cut), ":".join(cut)]


def lookalike(rng: random.Random) -> str:
    """What only looks like personal data."""
    n = lambda k: _number(rng, k)
    return rng.choice(
        [
            lambda: card(rng, good=False), lambda: card(rng, good=False), lambda: n(rng.randrange(1, 14)), lambda: f"20{n(2)}-0{n(1)}-1{n(1)}", lambda: f"{n(1)}.{n(1)}.", lambda: f"v{n(1)}.{n(2)}.{n(1)}", lambda: f"${n(3)},{n(3)}.00", lambda: f"1{n(1)}:{n(2)}", lambda: f"{_name(rng).upper()}-20{n(2)}-{n(5)}",
            lambda: f"{n(3)}-{n(2)}", lambda: f"{n(7)}", lambda: f"pp. {n(3)}-{n(3)}", lambda: f"@ {n(2)}", lambda: f"{n(2)}/{n(2)}/20{n(2)}", lambda: f"{n(4)}.{n(4)}.{n(3)}.{n(1)}", lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40)), lambda: f"ISBN {n(3)}-{n(10)}", lambda: f"{n(3)}.{n(3)}.{n(3)}",
        ]
    )()


#: What may stand before data, or before what only looks like it.
LEADS = {"email": "mail email contact at write to".split(), "phone": "call phone tel fax mobile at".split(), "ip": "host server from ip address at".split(), "card": "card visa charged account number".split()}
PLAIN_LEADS = "page number id ref version on about section order invoice no".split()


def training_window(text: str, seed: int) -> tuple[str, list[tuple[str, int, int]]]:
    """A bounded window of a text with planted data, and the spans of those that
    no pattern has to find."""
    rng = random.Random(seed)
    found = words(text)
    base = base_spans(text)
    at = 0
    if found:
        at = int(np.searchsorted([a for a, _, _ in found], rng.choice(base)[1])) if base and rng.random() < 0.5 else rng.randrange(len(found))
    own = [w for _, _, w in found[max(0, at - WORDS // 2) : at + WORDS // 2]]
    while sum(map(len, own)) > CHARS:
        own.pop()
    # Planted parts and the places of their words, kept in order.
    parts: list[tuple[str, str | None]] = []
    for kind in KINDS:
        whole, clear, hidden = mention(kind, rng)
        led = lambda x, k=kind: f"{rng.choice(LEADS[k])} {x}" if rng.random() < 0.6 else x
        if rng.random() < 0.5:
            parts.append((led(whole), None))
            for _ in range(rng.randrange(1, 3)):
                parts.append((rng.choice(clear + hidden * 2), kind))
        if rng.random() < 0.5:
            parts.append((led(rng.choice(mention(kind, rng)[1])), kind))
    for _ in range(rng.randrange(2, 6)):
        x = lookalike(rng)
        x = f"{rng.choice(PLAIN_LEADS)} {x}" if rng.random() < 0.5 else x
        parts.append((x, None))
        if rng.random() < 0.3:
            parts.append((x, None))  # what is no data stays none when it is repeated
    places = sorted(rng.randrange(len(own) + 1) for _ in parts)
    order = list(range(len(parts)))
    if rng.random() < 0.5:  # the known form need not come first
        rng.shuffle(order)
    out, spans, done = "", [], 0
    for place, k in zip(places, order, strict=True):
        out += "".join(w + " " for w in own[done:place])
        done = place
        x, kind = parts[k]
        lead = next((f"{w} " for w in LEADS.get(kind, []) if x.startswith(f"{w} ")), "")
        if kind:
            spans.append((kind, len(out) + len(lead), len(out) + len(x)))
        out += x + rng.choice([" ", " ", ". ", ", "]) + ("and " if kind is None else "")
    return out + " ".join(own[done:]), spans


def beliefs(x: np.ndarray, known: np.ndarray, links: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Marginals of all nodes after rounds of loopy belief propagation."""
    k = 1 + len(KINDS)
    own = x @ w[:N_FEATURES]
    own[known > 0] = -50.0
    own[known > 0, known[known > 0]] = 0.0
    if not len(links):
        return softmax(own)
    before, after, skip = w[N_FEATURES:].reshape(3, k, k)
    # Half of what each end has learned about the other.
    pots = np.stack([(after + before.T) / 2, (skip + skip.T) / 2])
    a, b, kind = links.T
    source, sink = np.concatenate([a, b]), np.concatenate([b, a])
    pot = np.concatenate([pots[kind], pots[kind].transpose(0, 2, 1)])
    n, e = len(x), len(links)
    back = np.concatenate([np.arange(e, 2 * e), np.arange(e)])
    msg = np.zeros((2 * e, k))
    for _ in range(ROUNDS):
        total = own.copy()
        np.add.at(total, sink, msg)
        out = total[source] - msg[back]
        new = out[:, :, None] + pot
        top = new.max(axis=1, keepdims=True)
        new = (top + np.log(np.exp(new - top).sum(axis=1, keepdims=True)))[:, 0]
        msg = 0.5 * msg + 0.5 * (new - new.max(axis=1, keepdims=True))
    total = own.copy()
    np.add.at(total, sink, msg)
    assert total.shape == (n, k)
    return softmax(total)


def tag(texts: list[str | None], w: np.ndarray) -> list[tuple[list, list]]:
    """(base spans, added spans) of each text."""
    base = [base_spans(t) for t in texts]
    graph = Graph()
    for d, (t, spans) in enumerate(zip(texts, base, strict=True)):
        if t and _CUE.search(t):
            graph.add(d, t, spans)
    added: list[list] = [[] for _ in texts]
    if graph.doc:
        x, known, links = graph.arrays()
        p = beliefs(x, known, links, w)
        best = p.argmax(axis=1)
        last = None
        for n in np.flatnonzero((known == 0) & (best > 0) & (p.max(axis=1) >= SURE)):
            d, (a, b), kind = graph.doc[n], graph.span[n], KINDS[best[n] - 1]
            while b > a and not texts[d][b - 1].isalnum():
                b -= 1
            while a < b and not (texts[d][a].isalnum() or texts[d][a] in "+(@"):
                a += 1
            if a == b or overlaps(a, b, base[d]):
                continue
            if last == (n - 1, d, kind) and added[d] and not any(c.isalnum() for c in texts[d][added[d][-1][2] : a]):
                added[d][-1] = (kind, added[d][-1][1], b)
            else:
                added[d].append((kind, a, b))
            last = (n, d, kind)
    return list(zip(base, added, strict=True))


def _emit_windows(batches):
    for batch in batches:
        rows = [(h, *training_window(t.as_py(), (h << 1) + k & 0xFFFFFFFF)) for h, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([pa.array([h for h, _, _ in rows], pa.int64()), pa.array([t for _, t, _ in rows], pa.string()), pa.array([joined(x, KINDS) for _, _, x in rows], pa.string())], names=["h", "text", "spans"])


def _learn(batches):
    rows = sorted((r["h"], r["text"], r["spans"]) for b in batches for r in b.to_pylist())
    graph = Graph()
    for d, (_, text, spans) in enumerate(rows):
        planted = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in spans.split(",") if x)]
        base = base_spans(text)
        graph.add(d, text, base + [x for x in planted if not overlaps(x[1], x[2], base)])
    yield pa.RecordBatch.from_arrays([pa.array([fit(graph).astype("<f8").tobytes()], pa.binary())], names=["w"])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> np.ndarray:
    k = 1 + len(KINDS)
    windows = sampled(docs, sample, id_col, text_col).mapInArrow(_emit_windows, "h long, text string, spans string")
    got = windows.repartition(1).mapInArrow(_learn, "w binary").collect()
    if not got:
        return np.zeros((N_FEATURES + 3 * k, k))
    return np.frombuffer(got[0]["w"], "<f8").reshape(-1, k)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row: doc_id, n_email, n_ip, n_card, n_phone (of base
    spans), base_sha256, spans, n_added."""
    w = train(docs, id_col, text_col)

    def run(batches):
        for batch in batches:
            for part in pieces(batch, 1):
                rows = tag(part.column(1).to_pylist(), w)
                count = [pa.array([sum(s[0] == k for s in b) for b, _ in rows], pa.int64()) for k in KINDS]
                sha = pa.array([digest(b, KINDS) for b, _ in rows], pa.string())
                text = pa.array([joined(b + x, KINDS) for b, x in rows], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), *count, sha, text, pa.array([len(x) for _, x in rows], pa.int64())], names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
