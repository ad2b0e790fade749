"""The pipeline's stages against brute force on the smallest tables."""

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from stratagraph.llm import mixing, quality

from .test_exact_dedup import normal
from .test_jaccard import expected as near_groups


def test_stages(spark, sf, documents, duck):
    docs, seen = documents, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf).cache()
        seen[name] = docs
    assert all(seen[n].columns == documents.columns for n in ("quality", "exact_dedup", "near_dedup", "mix"))
    ids = lambda n: sorted(r["doc_id"] for r in seen[n].select("doc_id").collect())
    rows = lambda n: [(r["doc_id"], r["text"]) for r in seen[n].select("doc_id", "text").collect()]

    scores = quality.quality(documents, spark.read.parquet(f"{sf}/labels.parquet"))
    assert ids("quality") == sorted(r["doc_id"] for r in scores.filter("predicted = 1").collect())
    stays = {}
    for i, t in rows("quality"):
        stays[normal(t)] = max(i, stays.get(normal(t), i))
    assert ids("exact_dedup") == sorted(stays.values())
    assert ids("near_dedup") == sorted(g[0] for g in near_groups(rows("exact_dedup")) if g[3])
    mixed = seen["near_dedup"].toPandas()
    duck.register("kept_documents", mixed)
    want = duck.sql("SELECT doc_id FROM (" + mixing.ORACLE.replace("FROM documents", "FROM kept_documents") + ") ORDER BY 1").fetchall()
    assert ids("mix") == [r[0] for r in want]
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    total = sum(len(lib.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows("mix"))
    assert sum(r["length"] for r in seen["pack"].collect()) == total


def test_stages_take_edges_and_clashing_columns(spark, sf, make, edges):
    """Nulls, blanks, repeated rows and ids, extra columns, and no rows at all."""
    from pyspark.sql import functions as F

    extra = lambda df: df.withColumn("_quality", F.lit(7)).withColumn("copy_no", F.lit("mine")).withColumn("shuffle_key", F.lit(1.5))
    for rows in (edges, []):
        docs = extra(make(rows))
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.schema == docs.schema, name
            got = out.select("doc_id", "text", "_quality", "copy_no", "shuffle_key").collect()
            assert all((r["doc_id"], r["text"]) in rows and tuple(r)[2:] == (7, "mine", 1.5) for r in got), name
        pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
        assert len({(r["doc_id"]) for r in pieces}) == len({i for i, _ in rows})
    kept = corpus_pipeline.drop_exact_copies(spark, extra(make(edges)), sf)
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 0, 2, 3, 5, 6, 7, 9, 9, 11]
