import numpy as np

from stratagraph.llm import quality
from stratagraph.llm.queries import op5_quality


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = op5_quality(spark, sf).collect()
    assert all(r["held_out"] == quality.held_out(r["doc_id"]) and r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in rows)
    some = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and labels.get(r["doc_id"]) is not None]
    assert np.mean([p == y for p, y in some]) >= 0.9, (len(some), np.mean([p == y for p, y in some]))


def test_edges(spark, make, edges):
    labels = spark.createDataFrame([(4, 1, 0), (8, 0, 0), (10, 1, 0), (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    rows = quality.quality(make(edges), labels).collect()
    assert len(rows) == len(edges) and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (1, 2, 3)}) == 1
    assert {r["score"] for r in quality.quality(make(edges), labels.limit(0)).collect()} == {0.5}
    assert quality.quality(make([]), labels).collect() == []


def test_labels_of_held_out_rows_change_nothing(spark, make):
    some = [(i, f"good words number {i} here" if i % 2 else f"BAD!!! {i} $$$") for i in range(40)]
    lab = [(i, i % 2, 0) for i in range(40)]
    turned = [(i, 1 - y if quality.held_out(i) else y, t) for i, y, t in lab]
    kind = "doc_id long, quality int, toxic int"
    a, b = (sorted(quality.quality(make(some), spark.createDataFrame(x, kind)).collect()) for x in (lab, turned))
    assert a == b


def test_equal_texts_score_alike_wherever_they_stand():
    import pyarrow as pa

    w = np.random.default_rng(1).normal(size=(1 << quality.BITS) + 1)
    texts = ["some words here", "", "a text of other words, longer than the first", None, "some words here", "x " * 500, "some words here"]
    s = quality.score_column(pa.array(texts), w)
    assert s[0] == s[4] == s[6] and s[1] == s[3]
    assert s[2] == quality.score_column(pa.array(texts[2:3]), w)[0]


def test_training_against_a_plain_version(spark, make):
    import math
    from collections import Counter

    import pyarrow as pa

    rng = np.random.default_rng(7)
    some = [(i, " ".join(rng.choice(["good", "fine", "words", "BAD", "$$$", "3x"], 12))) for i in range(60)]
    lab = [(i, int("good" in t), 0) for i, t in some]
    w = quality.train(make(some), spark.createDataFrame(lab, "doc_id long, quality int, toxic int"))
    order = {r["doc_id"]: r["h"] for r in make(some).selectExpr("doc_id", "xxhash64(doc_id) as h").collect()}
    z, n, bias = Counter(), Counter(), 1 << quality.BITS

    def weight(k):
        if abs(z[k]) <= quality.L1:
            return 0.0
        return -(z[k] - math.copysign(quality.L1, z[k])) / ((quality.BETA + math.sqrt(n[k])) / quality.ALPHA + quality.L2)

    kept = sorted((order[i], t, lab[i][1]) for i, t in some if not quality.held_out(i))
    for _ in range(quality.EPOCHS):
        for _, t, y in kept:
            grams = Counter(quality.features(pa.array([t]))[0].tolist())
            x = {k: float(np.float32(c / grams.total())) * quality.SCALE for k, c in grams.items()} | {bias: 1.0}
            p = 1 / (1 + math.exp(-sum(weight(k) * v for k, v in x.items())))
            now = {k: weight(k) for k in x}
            for k, v in x.items():
                g = (p - y) * v
                step = (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / quality.ALPHA
                z[k] += g - step * now[k]
                n[k] += g * g
    assert np.allclose(w, [weight(k) for k in range(bias + 1)], atol=1e-6) and np.count_nonzero(w) > 20
