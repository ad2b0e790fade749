import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stratagraph.llm import trie
from stratagraph.llm.queries import op11_prefix_trie


def brute(turns):
    """Nodes of the rebuilt conversations of (conv_id, turn, role, text)."""
    convs = {}
    for c, turn, role, text in turns:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}\x1f{role}\x1f{text}".encode()).hexdigest()
            convs.setdefault(c, []).append((turn is not None, turn or 0, digest, role, text))
    convs = {c: [x[3:] for x in sorted(v)] for c, v in convs.items()}
    made = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = tuple(convs.get(c - c % 100, [])[:h] + own[h:])
    members = {}
    for c, ts in made.items():
        for d in range(len(ts) + 1):
            members.setdefault(ts[:d], []).append(c)
    leaves, saved, kids = Counter(), Counter(), Counter(n[:-1] for n in members if n)
    for node, cs in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not kids[node]
            saved[node[:d]] += (len(cs) - 1) * len(node[-1][1]) if node else 0
    out = Counter()
    for node, cs in members.items():
        ends = ",".join(map(str, sorted(c for c in cs if made[c] == node)))
        up = min(members[node[:-1]]) if node else None
        out[(min(cs), len(node), up, len(cs), kids[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest())] += 1
    return out


SCHEMA = "conv_id long, turn long, role string, text string, c int, place string, node long, n string"


def check(spark, turns):
    df = spark.createDataFrame([(*t, 1, "x", 2, "y") for t in turns], SCHEMA).repartition(3)
    got = Counter(tuple(r) for r in trie.conversation_trie(df).collect())
    assert got == brute(turns)


def test_same_as_sql(spark, sf, same_rows):
    same_rows(op11_prefix_trie(spark, sf), trie.ORACLE)


def test_branches(spark):
    turns = [(c, k, "user", f"t{(c * 7 + k * c) % (k + 2)}") for c in range(400) for k in range(c % 11)]
    check(spark, turns)


@pytest.mark.parametrize("chunk", [2, 1024])
def test_edges(spark, monkeypatch, chunk):
    monkeypatch.setattr(trie, "CHUNK", chunk)
    monkeypatch.setattr(trie, "IDS", 3)
    turns = [(c, k, "a", "same") for c in (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10) for k in range(3)]  # copies
    turns += [(200, None, None, None), (200, 5, "", ""), (201, 1, "r", None), (205, 1, "x", "é" * 3000)]  # nulls, no more turns than shared
    turns += [(317, 1, "u", "v")] * 4 + [(317, 1, "w", "v")]  # ties and repeated rows, no base
    turns += [(450, k, "long", str(k % 5)) for k in range(200)] + [(451, k, "long", str(k % 5)) for k in range(190)]  # one holds most rows
    turns += [(None, 1, "a", "b"), (500, 0, "a", "long " * 100_000)]
    check(spark, turns)


def test_only_conversations_that_lose_all_turns(spark):
    gone = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 1)
    check(spark, [(gone, 1, "a", "b")])


def test_empty(spark):
    assert trie.conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_rounds_and_hot_nodes(spark, monkeypatch):
    """Every node counts as hot for some bounds, none for others."""
    turns = [(c, k, "u", f"{k}-{c % (k + 1)}") for c in range(60) for k in range(4)]
    for hot in (10**9, 0):
        monkeypatch.setattr("stratagraph.llm.ordered.HOT", hot)
        check(spark, turns)


def test_sizes_of_paths_stay_whole_numbers(spark):
    df = spark.createDataFrame([(2**k + d,) for k in range(1, 40) for d in (-1, 0)], "size long")
    got = {r["size"]: r["c"] for r in df.withColumn("c", F.length(F.conv(F.col("size").cast("string"), 10, 2)) - 1).collect()}
    assert all(got[n] == n.bit_length() - 1 for n in got)
