import hashlib
from collections import defaultdict

import pytest

from stratagraph.llm import exact_dedup


def normal(text):
    return (text or "").encode().lower()


def expected(texts):
    groups = defaultdict(list)
    for i, t in texts:
        groups[normal(t)].append(i)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(t).hexdigest()) for i in ids]
    return sorted(out, key=repr)


def run(df, **kw):
    return sorted((tuple(r) for r in exact_dedup.exact_dedup(df, **kw).collect()), key=repr)


def test_edges(make, edges):
    assert run(make(edges)) == expected(edges)


def test_empty(make):
    assert run(make([])) == []


@pytest.mark.parametrize("modulus", [1, 3])
def test_colliding_fingerprints_are_told_apart(make, edges, modulus):
    some = [e for e in edges if e[0] not in (10, 11)] + [(20 + k, "t" * (k % 4)) for k in range(9)]
    assert run(make(some), modulus=modulus) == expected(some)


def test_huge_texts_are_hashed_in_parts(make):
    long_ = "x" * (exact_dedup.HUGE + 70_000)
    some = [(1, long_), (2, long_.upper()), (3, long_ + "y"), (4, "x")]
    assert run(make(some)) == expected(some)


def test_fingerprints_combine():
    text = bytes(range(256)) * 700
    cut = [text[a : a + 5000] for a in range(0, len(text), 5000)]
    other = [text[a : a + 65536] for a in range(0, len(text), 65536)]
    assert exact_dedup.combine(map(exact_dedup.chunk_hash, cut)) == exact_dedup.combine(map(exact_dedup.chunk_hash, other))


def test_same_as_sql(spark, sf, same_rows):
    from stratagraph.llm.queries import op1_exact_dedup

    same_rows(op1_exact_dedup(spark, sf), exact_dedup.ORACLE)
