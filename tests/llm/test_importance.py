import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stratagraph.llm import importance
from stratagraph.llm.ordered import first_ranks, lookup, places
from stratagraph.llm.queries import op13_importance
from stratagraph.llm.scratch import Scratch

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(docs, target, runs=1, buckets=10_000):
    def found(text):
        ws = WORD.findall(lowered(text))
        return len(ws), [zlib.crc32(" ".join(ws[i : i + n]).encode()) % buckets for n in range(1, runs + 1) for i in range(len(ws) - n + 1)]

    s, t = Counter(b for _, x in docs for b in found(x)[1]), Counter(b for x in target for b in found(x)[1])
    sa, ta = float(sum(s.values()) + buckets), float(sum(t.values()) + buckets)
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * sa / ((s[b] + 1) * ta)))
    rows = []
    for i, x in docs:
        n, bs = found(x)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(map(gain, bs))
        rows.append((i, n, len(bs), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    order = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0]))
    most = 10 * len(order) // 100
    out = Counter((r[0], *r[2:], k + 1 if k < most else None) for k, r in enumerate(order))
    return out + Counter((r[0], *r[2:], None) for r in rows if r[1] < 20)


def rows(df):
    return Counter(tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect())


def test_same_as_sql(spark, sf, same_rows):
    same_rows(op13_importance(spark, sf), importance.ORACLE)


@pytest.mark.parametrize("runs", [1, 2])
def test_same_as_brute_force(spark, make, edges, texts, runs):
    docs = edges + [(100 + i, t) for i, t in texts[:60]] + [(7, "Aa bb cc " * 9)] * 11 + [(None, "x y z " * 8)] * 3
    target = ["one two THREE four", None, "", "aa bb"]
    df = make(docs).withColumn("words", F.lit(1)).withColumn("rank", F.lit("mine"))
    out = importance.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), runs=runs)
    assert rows(out) == brute(docs, target, runs)


def test_empty(spark, make):
    none = make([]).limit(0)
    assert importance.resample(none, none).count() == 0
    some = importance.resample(make([(1, "a b")]), none)
    assert [(r["doc_id"], r["n_features"], r["rank"]) for r in some.collect()] == [(1, 2, None)]


def test_places_and_ranks_of_a_hot_group(spark):
    df = spark.range(3000).select((F.col("id") % 7 * (F.col("id") % 3)).alias("g"), (F.col("id") * 7919 % 3001).alias("v")).repartition(6)
    scratch = Scratch(spark, "test")
    got = Counter((r["g"], r["v"], r["place"]) for r in places(df, "g", [F.col("v")], scratch).collect())
    by = {}
    for r in df.collect():
        by.setdefault(r["g"], []).append(r["v"])
    assert got == Counter((g, v, k) for g, vs in by.items() for k, v in enumerate(sorted(vs)))
    top = {r["v"]: r["rank"] for r in first_ranks(df, [F.desc("v")], lambda n: n // 2, scratch).collect()}
    assert top == {v: (k + 1 if k < 1500 else None) for k, v in enumerate(sorted((v for vs in by.values() for v in vs), reverse=True))}
    same = spark.range(500).select(F.lit(1).alias("v"))
    assert sorted(r["rank"] for r in first_ranks(same, [F.col("v")], lambda n: n, scratch).collect()) == list(range(1, 501))


def test_lookup_of_hot_and_cold_keys(spark):
    left = spark.range(30_000).select(F.when(F.col("id") < 15_000, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    table = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("most"))
    out = lookup(left, table, "k", "n", 30_000)
    assert out.count() == 30_000 and out.filter("k = 0 and most <> 14999").isEmpty()
