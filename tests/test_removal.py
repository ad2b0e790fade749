"""Removal of relationships from the views of a large graph."""

from stratagraph.operators import mutate
from stratagraph.sources.documents import Graph


def test_removal_reads_links_once(spark, tmp_path):
    spark.createDataFrame([("r1", 1, "t", "a", "b"), ("r2", 2, "t", "b", "c"), ("r3", 3, "t", "c", "c")], "id string, ord long, type string, source_id string, target_id string").write.parquet(f"{tmp_path}/links")
    held = spark.createDataFrame([("v", e, k) for k, e in enumerate("abcd")], "view_id string, element_id string, ord long")
    drawn = spark.createDataFrame([("v", "r1", 0), ("v", "r2", 1), ("v", "r3", 2)], "view_id string, relationship_id string, ord long")
    none = spark.createDataFrame([], "id string, view_id string")
    g = Graph(none.drop("view_id"), spark.read.parquet(f"{tmp_path}/links"), none.drop("id"), held, drawn)
    out = mutate.remove_relationships(g, spark.createDataFrame([("r1",)], "id string"))
    assert sorted(r["element_id"] for r in out.view_elements.collect()) == ["b", "c", "d"]
    assert out.view_elements._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    both = mutate.remove_relationships(g, spark.createDataFrame([("r1",), ("r2",)], "id string"))
    assert sorted(r["element_id"] for r in both.view_elements.collect()) == ["c", "d"]
