"""Connected components of links, by contraction in Spark rounds.

In each round every node points to the smallest of its neighbours and itself,
in the order of a hash; links are then drawn between the nodes pointed at, and
those within one node go. The number of nodes falls by a constant factor a
round, so rounds grow with the logarithm of the longest path. All joins are
between written tables: adaptive execution can split the links of a hub.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagraph.llm.scratch import Scratch


def _ranked(col: str):
    return F.struct(F.xxhash64(col).alias("h"), F.col(col).alias("v"))


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for each node of the links (a, b); one root a component."""
    both = edges.filter("a <> b").select("a", "b")
    links = scratch.save(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    steps = []
    while not links.isEmpty():
        low = links.groupBy("a").agg(F.min(_ranked("b")).alias("m"))
        to = scratch.save(low.select(F.col("a").alias("node"), F.least(F.col("m"), _ranked("a"))["v"].alias("to")))
        steps.append(to)
        one = links.join(to.select(F.col("node").alias("a"), F.col("to").alias("x")), "a")
        two = one.join(to.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        rest = scratch.save(two.filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
        scratch.drop(links)
        links = rest
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    roots = steps[0].select("node", F.col("to").alias("root"))
    for k, to in enumerate(steps[1:]):
        step = to.select(F.col("node").alias("root"), "to")
        roots = roots.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        if k % 3 == 2:
            roots = scratch.save(roots)
    return scratch.save(roots)
