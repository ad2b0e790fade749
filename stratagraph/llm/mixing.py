"""Operator 7: mix sources to target weights by Poisson replication.

The mean repetition of a document is ``weight x rows / rows of its source``.
A hash of the seed, the id and the text gives a uniform number; the inverse of
the Poisson distribution at it is the number of copies. Copies are exploded and
dealt out anew over all tasks by a hash, sorted by it within each.

Only built-in functions run: nothing here depends on task order, so a lost
executor recomputes the same copies. Rows whose source is null form a source of
their own. Null, empty and long texts are treated alike; equal rows get equal
numbers of copies. A source without a weight is left out. Extra columns stay,
whatever their names; copy_no and shuffle_key take the place of columns of those
names, unless ``keys`` is false. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most so many sources are broadcast; more of them are joined by a shuffle.
BROADCAST_SOURCES = 10_000
SALTS = 64


def uniform(seed: str, *cols: Column) -> Column:
    """A number in [0, 1) from 52 bits of the MD5 of the seed and the columns."""
    text = F.concat_ws("\x1f", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def tempered(docs: DataFrame, source_col: str = "source", power: float = 0.5) -> DataFrame:
    """Target weights of all sources: rows to the ``power``, as parts of one."""
    n = docs.groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    w = F.pow(F.col("n").cast("double"), F.lit(power))
    total = n.agg(F.sum(w).alias("w_all"))
    return n.crossJoin(F.broadcast(total)).select("source", (w / F.col("w_all")).alias("weight"))


def repetition_rates(docs: DataFrame, weights: DataFrame, source_col: str = "source", rows: float | None = None) -> DataFrame:
    """Mean copies of a document of each source: (source, rate)."""
    n = docs.groupBy(F.col(source_col).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("n_all"))
    out = F.col("n_all") if rows is None else F.lit(float(rows))
    return weights.join(n, F.col("source").eqNullSafe(F.col("s"))).crossJoin(F.broadcast(total)).select("source", (F.col("weight") * out / F.col("n")).alias("rate"))


def _distribution(rate: Column) -> Column:
    """P(copies <= k) for k = 0, 1, ... until it is 1 in double precision.

    A rate over 500 is halved until it is not: the copies are then a sum of
    as many draws, so no term of the distribution underflows.
    """
    most = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("c"))
    step = lambda a, k: F.struct((a["p"] * rate / k).alias("p"), F.concat(a["c"], F.array(F.element_at(a["c"], -1) + a["p"] * rate / k)).alias("c"))
    return F.aggregate(F.sequence(F.lit(1), most), start, step)["c"]


def poisson_mix(
    docs: DataFrame,
    weights: DataFrame,
    seed: str = "mix-1",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    rows: float | None = None,
    keys: bool = True,
    broadcast_sources: int = BROADCAST_SOURCES,
) -> DataFrame:
    """Columns of ``docs``, then copy_no (from 0) and shuffle_key (in its order)."""
    rates = repetition_rates(docs, weights, source_col, rows)
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / 500)).cast("int")
    table = rates.select(F.col("source").alias("w_source"), parts.alias("parts"), _distribution(F.col("rate") / parts).alias("cdf"))
    # Rows stand in one column, so none of their names can clash.
    digest = F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    salt = F.pmod(F.xxhash64(F.col(id_col)), F.lit(SALTS)).alias("salt")
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(id_col).cast("string").alias("id"), digest.alias("digest"), F.col(source_col).alias("source"), salt)
    same = F.col("source").eqNullSafe(F.col("w_source"))
    if weights.limit(broadcast_sources + 1).count() <= broadcast_sources:
        joined = base.join(F.broadcast(table), same)
    else:
        table = table.withColumn("w_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = base.join(table, same & (F.col("salt") == F.col("w_salt")))
    # Numbers are drawn into an array first: one digest a draw, not one a term.
    draws = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda part: uniform(f"{seed}/draw", F.col("id"), F.col("digest"), part))
    copies = F.aggregate(draws, F.lit(0), lambda n, u: n + F.size(F.filter("cdf", lambda c: c <= u)))
    counted = joined.select("doc", "id", copies.alias("n")).filter("n > 0")
    out = counted.select("doc", "id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("nth"))
    key = F.md5(F.concat_ws("\x1f", F.lit(f"{seed}/shuffle"), F.col("id"), F.col("nth").cast("string")))
    out = out.select("doc", "nth", key.alias("key")).repartition(F.col("key")).sortWithinPartitions("key")
    if not keys:
        return out.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])
    own = [F.col("doc").getField(c).alias(c) for c in docs.columns if c not in ("copy_no", "shuffle_key")]
    return out.select(*own, F.col("nth").alias("copy_no"), F.col("key").alias("shuffle_key"))


ORACLE = f"""
WITH RECURSIVE n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
r AS (SELECT source, (power(n::DOUBLE, 0.5) / (SELECT sum(power(n::DOUBLE, 0.5)) FROM n)) * (SELECT sum(n) FROM n) / n AS rate FROM n),
d(source, rate, k, p, c) AS (
  SELECT source, rate, 0, exp(-rate), exp(-rate) FROM r
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM d WHERE k < ceil(rate + 12 * sqrt(rate) + 30)),
cdf AS (SELECT source, list(c ORDER BY k) AS c FROM d GROUP BY source),
u AS (
  SELECT doc_id, text, lang, source, n_chars,
    ('0x' || substr(md5('mix-1/draw' || chr(31) || doc_id || chr(31) || md5(coalesce(text, '')) || chr(31) || '0'), 1, 13))::BIGINT::DOUBLE / {2**52} AS u
  FROM documents),
k AS (SELECT u.*, len(list_filter(cdf.c, lambda x: x <= u.u)) AS copies FROM u JOIN cdf ON u.source IS NOT DISTINCT FROM cdf.source),
e AS (SELECT doc_id, text, lang, source, n_chars, unnest(range(copies))::INTEGER AS copy_no FROM k)
SELECT doc_id, text, lang, source, n_chars, copy_no,
  md5('mix-1/shuffle' || chr(31) || doc_id || chr(31) || copy_no) AS shuffle_key
FROM e
"""
