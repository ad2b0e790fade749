import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stratagraph.llm import licenses
from stratagraph.llm.queries import op12_licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(text, phrases=licenses.PHRASES, notices=licenses.NOTICES, threshold=0.8):
    ws, places, found, base = WORD.findall(lowered(text)), [], [], set()
    for k, (t, label) in enumerate([*phrases, *notices]):
        run = t.split()
        own, length = set(run), licenses.block_length(len(run))
        if k < len(phrases):
            at = [i for i in range(len(ws)) if ws[i : i + len(run)] == run]
            places += at
            base |= {label} if at else set()
        for b in range(2 * len(ws) // length + 1):
            shared = own & set(ws[b * length // 2 : b * length // 2 + length])
            if len(shared) >= math.ceil(threshold * len(own) - 1e-9):
                found.append((length, b * length // 2, shared, len(shared) / len(own), label))
    worse = lambda p, o: o[1] <= p[1] + p[0] and p[1] <= o[1] + o[0] and p[2] <= o[2] and p[3] < o[3]
    labels = {p[4] for p in found if not any(worse(p, o) for o in found)}
    score = max((p[3] for p in found), default=0.0)
    return (len(ws), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score)


COLS = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def rows(df):
    return Counter((r["doc_id"], *[r[c] for c in COLS]) for r in df.collect())


def test_same_as_sql(spark, sf, same_rows):
    same_rows(op12_licenses(spark, sf), licenses.ORACLE)


def mixed(seed, n):
    """Texts of pieces of notices, their words shuffled or dropped, between other words."""
    rnd, out = random.Random(seed), []
    templates = [t for t, _ in [*licenses.PHRASES, *licenses.NOTICES]]
    for _ in range(n):
        words = []
        for _ in range(rnd.randrange(1, 9)):
            run = rnd.choice(templates).split()
            run = [w for w in run if rnd.random() < 0.9]
            if rnd.random() < 0.3:
                rnd.shuffle(run)
            words += run + [rnd.choice(["zz", "The", "of", "Ünder", "MIT"]) for _ in range(rnd.randrange(0, 25))]
        out.append(rnd.choice([" ", "\n", ", "]).join(words))
    return out


@pytest.mark.parametrize("threshold", [0.8, 0.5])
def test_same_as_brute_force(make, edges, threshold, monkeypatch):
    monkeypatch.setattr(licenses, "SEGMENT", 64)  # many texts span segments
    docs = edges + [(100 + i, t) for i, t in enumerate(mixed(1, 60))] + [(5, "Under  the MIT-License! under the mit license")] * 4 + [(None, "cc BY nc, " * 300)] * 2
    df = make(docs).withColumn("words", F.lit(0)).withColumn("seg", F.lit(1)).withColumn("labels", F.lit("x"))
    assert rows(licenses.find_licenses(df, threshold=threshold)) == Counter((i, *brute(t, threshold=threshold)) for i, t in docs)


def test_templates_beyond_the_broadcast_bound_give_the_same(make, monkeypatch):
    docs = list(enumerate(mixed(2, 20)))
    monkeypatch.setattr(licenses, "BROADCAST", 0)
    assert rows(licenses.find_licenses(make(docs))) == Counter((i, *brute(t)) for i, t in docs)


def test_wording_other_than_the_phrases(make):
    docs = [
        (1, "This work is licensed under the GNU General Public License, version 3."),
        (2, "Released under the terms of the MIT License"),
        (3, "the license of the club; under a mitten"),
        (4, "Permission to use, copy, modify, and/or distribute this software for any purpose, with or without any fee, is hereby granted"),
        (5, "We read about an open license and a general public that is under age."),
    ]
    found = {r["doc_id"]: (r["labels"], r["n_base"]) for r in licenses.find_licenses(make(docs)).collect()}
    assert found == {1: ("gpl-3", 0), 2: ("mit", 0), 3: ("", 0), 4: ("isc", 0), 5: ("", 0)}


def test_empty(make):
    assert licenses.find_licenses(make([]).limit(0)).count() == 0
