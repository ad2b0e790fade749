from collections import Counter

from pyspark.sql import functions as F

from stratagraph.llm import mixing
from stratagraph.llm.queries import op7_poisson_mix


def test_same_as_sql(spark, sf, same_rows):
    same_rows(op7_poisson_mix(spark, sf), mixing.ORACLE)


def test_edges(spark, make, edges):
    df = make(edges).withColumn("source", F.when(F.col("doc_id") > 5, F.lit("a"))).withColumn("copy_no", F.lit("mine"))
    out = mixing.poisson_mix(df, mixing.tempered(df))
    assert set(out.columns) == set(df.columns) | {"shuffle_key"}
    assert mixing.poisson_mix(df.limit(0), mixing.tempered(df.limit(0))).count() == 0
    again = sorted(map(repr, mixing.poisson_mix(df.repartition(5), mixing.tempered(df)).collect()))
    assert again == sorted(map(repr, out.collect()))


def test_copies_follow_the_target_weights(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"), F.when(F.col("id") % 10 == 0, "rare").otherwise("hot").alias("source"))
    weights = spark.createDataFrame([("rare", 0.75), ("hot", 0.25)], "source string, weight double")
    out = mixing.poisson_mix(df, weights)
    n = Counter(r["source"] for r in out.select("source").collect())
    assert abs(n["rare"] - 15_000) < 600 and abs(n["hot"] - 5_000) < 300
    copies = Counter(r["n"] for r in out.filter("source = 'rare'").groupBy("doc_id").agg(F.count("*").alias("n")).collect())
    assert max(copies) > 12  # a Poisson tail, not a fixed count


def test_large_rates_are_sums_of_draws(spark):
    df = spark.createDataFrame([(1, "a", "s")], "doc_id long, text string, source string")
    weights = spark.createDataFrame([("s", 1.0)], "source string, weight double")
    assert abs(mixing.poisson_mix(df, weights, rows=3000.0).count() - 3000) < 300


def test_more_sources_than_are_broadcast_give_the_same(spark, documents):
    weights = mixing.tempered(documents)
    one = mixing.poisson_mix(documents, weights).drop("text")
    two = mixing.poisson_mix(documents, weights, broadcast_sources=0).drop("text")
    assert sorted(map(repr, one.collect())) == sorted(map(repr, two.collect()))
