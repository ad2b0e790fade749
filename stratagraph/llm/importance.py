"""Operator 13: importance resampling towards a target distribution.

Features of a text are its runs of 1 to ``runs`` words, hashed to buckets. A bucket
gains the logarithm of how much likelier it is in the target than in the corpus.
Counts of buckets are summed before they are shuffled, so only totals move: at most
``buckets`` rows a task. Their gains, a list bounded by ``buckets``, become a literal
array. Scoring explodes nothing: higher-order functions turn a text into its array of
buckets and add up the gains. Gumbel noise from a hash of the id makes the draw
of the highest scores a draw without replacement.

Nulls and blank texts have no features and weight 0; a null id counts as empty text
in the noise and comes last among ties. Repeated rows are drawn each for itself.
Long texts are one array of words in one row. Extra columns are not looked at.
An empty table gives an empty result; without target texts every bucket counts as
one feature there.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratagraph.llm.crc import CRC_TABLE, crc32_sql
from stratagraph.llm.ordered import first_ranks
from stratagraph.llm.scratch import Scratch

BUCKETS, RUNS, SEED = 10_000, 1, "2024"
LEAST_WORDS, PER_CENT = 20, 10
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of a text with A-Z in lower case; null has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER), F.lit(WORD), F.lit(0))


def features(found: Column, runs: int = RUNS) -> Column:
    """All runs of 1 to ``runs`` words, joined by a space."""
    out = found
    for n in range(2, runs + 1):
        run = [lambda i, k=k: F.get(found, i + k) for k in range(n)]
        longer = F.transform(F.sequence(F.lit(0), F.size(found) - n), lambda i: F.concat_ws(" ", *[at(i) for at in run]))  # noqa: B023
        out = F.when(F.size(found) >= n, F.concat(out, longer)).otherwise(out)
    return out


def bucket_array(found: Column, runs: int = RUNS, buckets: int = BUCKETS) -> Column:
    return F.transform(features(found, runs), lambda w: (F.crc32(w) % buckets).cast("int"))


def totals(texts: DataFrame, text_col: str = "text", runs: int = RUNS, buckets: int = BUCKETS) -> dict[int, int]:
    """Features of all texts in each bucket that has some."""
    # Words are a column first: an expression inside a lambda is evaluated for each item.
    found = texts.select(words(F.col(text_col)).alias("words")).select(F.explode(bucket_array(F.col("words"), runs, buckets)).alias("bucket"))
    return dict(found.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect())


def gains(corpus: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """Thousandths of the logarithm of each bucket's ratio, each count raised by one."""
    s_all, t_all = float(sum(corpus.values()) + buckets), float(sum(target.values()) + buckets)
    return [math.floor(1000 * math.log((target.get(b, 0) + 1) * s_all / ((corpus.get(b, 0) + 1) * t_all))) for b in range(buckets)]


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: str = SEED,
    runs: int = RUNS,
    buckets: int = BUCKETS,
    least_words: int = LEAST_WORDS,
    per_cent: int = PER_CENT,
) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; rank is null if not drawn."""
    gain = gains(totals(docs, text_col, runs, buckets), totals(target, text_col, runs, buckets), buckets)
    table = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")  # folded to one literal
    found = docs.select(F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("words"))
    found = found.select("doc_id", F.size("words").alias("n_words"), bucket_array(F.col("words"), runs, buckets).alias("found"))
    weight = F.aggregate("found", F.lit(0).cast("long"), lambda a, b: a + F.element_at(table, b + 1))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(float(2**32))
    noise = F.floor(-1000 * F.log(-F.log(u)))
    rows = found.select("doc_id", "n_words", F.size("found").cast("long").alias("n_features"), weight.alias("weight"), noise.alias("noise"))
    rows = rows.select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + F.col("noise")).alias("score"))
    scratch = Scratch(docs.sparkSession, "importance")
    scored = scratch.save(rows)
    able = scored.filter(F.col("n_words") >= least_words)
    ranked = first_ranks(able, [F.desc("score"), F.asc_nulls_last("doc_id")], lambda n: per_cent * n // 100, scratch)
    others = scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(others).drop("n_words")


ORACLE = f"""
WITH {CRC_TABLE},
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{WORD}') AS ws FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{WORD}')) AS f FROM benchmark),
f AS (SELECT doc_id, unnest(ws) AS f FROM w),
known AS (SELECT f, {crc32_sql("f")} % {BUCKETS} AS bucket FROM (SELECT f FROM f UNION SELECT f FROM b), crc_table),
s AS (SELECT bucket, count(*) AS n FROM f JOIN known USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM b JOIN known USING (f) GROUP BY bucket),
g AS (
  SELECT r.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + {BUCKETS})::DOUBLE
    / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + {BUCKETS})::DOUBLE)))::BIGINT AS gain
  FROM range({BUCKETS}) r(bucket) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
weights AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM f JOIN known USING (f) JOIN g USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
    + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::BIGINT::DOUBLE + 0.5) / 4294967296)))::BIGINT AS score
  FROM w LEFT JOIN weights USING (doc_id)),
able AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN r <= {PER_CENT} * n // 100 THEN r END AS rank FROM scored LEFT JOIN able USING (doc_id)
"""
