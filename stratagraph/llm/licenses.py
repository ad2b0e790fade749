"""Operator 12: license texts in documents by an exact set-similarity join.

Templates and blocks of documents are sets of words. A block holds a template if
at least ``need`` of the template's different words stand in it. Blocks have a
length of their own for templates of up to a length (a power of two, twice as
many words at least) and begin every half of it, so any run of as many words as
the template lies in a block as a whole.

One pass over the texts keeps the words that some template has, with their places,
by segments of bounded length. Then, as in a prefix-filtered similarity join:

1. words are counted over the whole corpus and ordered from rare to frequent;
2. of a template's n words a block with ``need`` of them has one of the first
   n - need + 1 (prefix), so only blocks around such words are made;
3. a block with fewer than ``need`` template words goes (length), and so does a
   pair whose first shared word leaves too few words behind it on either side
   (position); a pair is taken at its first shared word only, so it comes once;
4. what is left is verified by the intersection of both sets.

Of the pairs found, one gives no label if its common words are among those of another
template in a block that meets its own with a larger share (version 3, not 2).

Phrases are templates that must stand word for word: their blocks come through
the same join, and places are then found inside the blocks. Built-in functions
alone run. Counts of template words are as few as the templates have words; so are
the rows of the prefix index, which is broadcast while it has at most ``BROADCAST``
rows and joined by a shuffle beyond. Texts aren't shuffled, only results of
documents, under a key of id and text: equal rows share it and each gets the result.

Nulls and blank texts have no words: counts of 0, no label, score 0, null places.
Long texts are cut into segments that overlap by a block. Extra columns are not
looked at. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratagraph.llm.importance import _LOWER, _UPPER, WORD, words
from stratagraph.llm.scratch import Scratch

#: Share of a template's words that a block must have.
CONTAINMENT = 0.8
#: Words of a segment; a longer block makes longer segments.
SEGMENT = 1024
BROADCAST = 100_000

# Phrases with their labels, as the contract has them.
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

# Openings and notices of common licenses, with their labels.
NOTICES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-2"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("under the gnu general public license version 2", "gpl-2"),
    ("under the gnu general public license version 3", "gpl-3"),
    ("under the gnu lesser general public license version 3", "lgpl-3"),
    ("under the gnu affero general public license version 3", "agpl-3"),
    ("it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("licensed under the creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("licensed under the creative commons attribution 4 0 international license", "cc-by"),
    ("licensed under the creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
]


def block_length(n_words: int) -> int:
    """The smallest power of two from twice the words on, 8 at least."""
    return max(8, 1 << math.ceil(math.log2(2 * n_words)))


def _vocabulary(templates: list[tuple[str, str]]) -> list[str]:
    return sorted({w for text, _ in templates for w in text.split()})


def segments(docs: DataFrame, vocabulary: list[str], overlap: int, id_col: str, text_col: str) -> DataFrame:
    """One row for each document's start and for each further stretch of ``SEGMENT``
    words that has words of the vocabulary: (key, doc_id, n_words, seg, size, hits)."""
    size = max(SEGMENT, overlap)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.lit(":"), text))
    rows = docs.select(key.alias("key"), F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("words"))
    stretch = lambda s: F.sequence(s * size, F.greatest(s * size, F.least(F.size("words"), s * size + size + overlap) - 1))
    number = lambda s: F.transform(stretch(s), lambda i: F.struct(i.alias("pos"), F.get("words", i).alias("word")))
    kept = lambda s: F.filter(number(s), lambda h: h["word"].isin(vocabulary))
    last = F.floor(F.greatest(F.size("words") - 1, F.lit(0)) / size).cast("int")
    parts = F.transform(F.sequence(F.lit(0), last), lambda s: F.struct(s.alias("seg"), kept(s).alias("hits")))
    out = rows.select("key", "doc_id", F.size("words").cast("long").alias("n_words"), F.explode(parts).alias("s"))
    return out.select("key", "doc_id", "n_words", "s.seg", F.lit(size).alias("size"), "s.hits").filter((F.col("seg") == 0) | (F.size("hits") > 0))


def word_order(found: DataFrame, vocabulary: list[str]) -> list[str]:
    """The vocabulary from rare to frequent in the corpus, ties by the word."""
    own = F.filter("hits", lambda h: h["pos"] < (F.col("seg") + 1) * F.col("size"))
    n = found.select(F.explode(own).alias("h")).groupBy("h.word").agg(F.count(F.lit(1)).alias("n")).collect()
    count = {r["word"]: r["n"] for r in n}  # one row a word of the templates
    return sorted(vocabulary, key=lambda w: (count.get(w, 0), w))


def _index(docs: DataFrame, templates: list[tuple[str, str]], phrases: int, order: list[str], threshold: float) -> DataFrame:
    """The prefix index: a row for each template and word of its prefix."""
    place, rows = {w: i + 1 for i, w in enumerate(order)}, []
    for t, (text, label) in enumerate(templates):
        tokens = sorted({place[w] for w in text.split()})
        need = math.ceil(threshold * len(tokens) - 1e-9)
        run = [place[w] for w in text.split()]
        rows += [(t, label, t < phrases, block_length(len(run)), run, tokens, need, at, tokens[at - 1]) for at in range(1, len(tokens) - need + 2)]
    return docs.sparkSession.createDataFrame(rows, "template int, label string, phrase boolean, length int, run array<int>, tokens array<int>, need int, at int, token int")


def blocks(found: DataFrame, order: list[str], prefixes: dict[int, list[str]]) -> DataFrame:
    """Blocks around prefix words: (key, length, block, hits, tokens), tokens sorted."""
    # A word's place in the order; it is looked up for the hits of a block alone.
    place = lambda w: F.array_position(F.lit(order), w).cast("int")

    def of_length(length: int) -> Column:
        step = length // 2
        lead = F.filter("hits", lambda h: h["word"].isin(prefixes[length]))
        starts = F.array_distinct(F.flatten(F.transform(lead, lambda h: F.array(F.floor(h["pos"] / step).cast("int"), F.floor(h["pos"] / step).cast("int") - 1))))
        # A block belongs to the segment in which it begins.
        own = F.filter(starts, lambda b: (b >= 0) & (F.floor(b * step / F.col("size")) == F.col("seg")))
        return F.transform(own, lambda b: F.struct(F.lit(length).alias("length"), b.alias("block"), F.filter("hits", lambda h: (h["pos"] >= b * step) & (h["pos"] < b * step + length)).alias("hits")))

    lead = sorted({w for ws in prefixes.values() for w in ws})
    some = found.filter(F.exists("hits", lambda h: h["word"].isin(lead)))
    rows = some.select("key", F.explode(F.concat(*[of_length(n) for n in sorted(prefixes)])).alias("b")).select("key", "b.length", "b.block", "b.hits")
    return rows.select("key", "length", "block", F.transform("hits", lambda h: F.struct(h["pos"].alias("pos"), place(h["word"]).alias("token"))).alias("hits")).withColumn(
        "tokens", F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["token"])))
    )


def similar_blocks(made: DataFrame, index: DataFrame, broadcast: bool) -> DataFrame:
    """Pairs of a block and a template with containment from the threshold on."""
    index = index.withColumnRenamed("tokens", "own")
    pairs = made.withColumn("token", F.explode("tokens")).join(F.broadcast(index) if broadcast else index, ["length", "token"])
    n, there = F.size("own"), F.array_position("tokens", F.col("token"))
    pairs = pairs.filter(F.size("tokens") >= F.col("need"))
    pairs = pairs.filter(1 + F.least(n - F.col("at"), F.size("tokens") - there) >= F.col("need"))
    pairs = pairs.filter(~F.arrays_overlap("tokens", F.slice("own", F.lit(1), F.col("at") - 1)))
    pairs = pairs.withColumn("common", F.array_intersect("tokens", "own"))
    return pairs.filter(F.size("common") >= F.col("need")).withColumn("containment", F.size("common") / n)


def best(pairs: DataFrame, longest: int) -> DataFrame:
    """Without pairs whose common words another template has as well, in a block that
    meets theirs, with a larger share: such a one is the better reading."""
    start = F.col("block") * (F.col("length") / 2).cast("int")
    spans = pairs.withColumn("start", start).withColumn("end", F.col("start") + F.col("length"))
    areas = F.sequence(F.floor(F.col("start") / longest) - 2, F.floor(F.col("end") / longest))  # of all that begin near
    better = spans.select("key", F.explode(areas).alias("area"), F.col("start").alias("o_start"), F.col("end").alias("o_end"), F.col("common").alias("more"), F.col("containment").alias("larger"))
    meet = (F.col("o_start") <= F.col("end")) & (F.col("start") <= F.col("o_end"))
    also = meet & (F.col("larger") > F.col("containment")) & (F.size(F.array_except("common", "more")) == 0)
    spans = spans.withColumn("area", F.floor(F.col("start") / longest))
    return spans.alias("p").join(better.alias("b"), [F.col("p.key") == F.col("b.key"), F.col("p.area") == F.col("b.area"), also], "left_anti")


def _places() -> Column:
    """Places of a phrase that begin in the first half of a block (the next block has
    the others): all words of the run stand one after the other."""
    follows = lambda h: F.forall(F.transform("run", lambda w, i: F.struct((h["pos"] + i).alias("pos"), w.alias("token"))), lambda x: F.array_contains("hits", x))
    own = F.filter("hits", lambda h: (h["token"] == F.element_at("run", 1)) & (h["pos"] < (F.col("block") + 1) * F.col("length") / 2) & follows(h))
    return F.transform(own, lambda h: h["pos"])


def find_licenses(
    docs: DataFrame,
    phrases: list[tuple[str, str]] = PHRASES,
    notices: list[tuple[str, str]] = NOTICES,
    threshold: float = CONTAINMENT,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of
    every document. Score: the largest containment found, 0 if none."""
    templates = [*phrases, *notices]
    scratch = Scratch(docs.sparkSession, "licenses")
    vocabulary = _vocabulary(templates)
    longest = max(block_length(len(t.split())) for t, _ in templates)
    found = scratch.save(segments(docs, vocabulary, longest, id_col, text_col))
    order = word_order(found, vocabulary)
    index = _index(docs, templates, len(phrases), order, threshold)
    rows, prefixes = index.select("length", "token").collect(), {}
    for r in rows:
        prefixes.setdefault(r["length"], []).append(order[r["token"] - 1])
    # Columns that one expression makes and several use are written once.
    made = scratch.save(blocks(found, order, {n: sorted(set(ws)) for n, ws in prefixes.items()}))
    pairs = similar_blocks(made, index, len(rows) <= BROADCAST)
    pairs = pairs.select("key", "template", "length", "block", "label", "phrase", "common", "containment", F.when(F.col("phrase"), _places()).alias("places"))
    pairs = best(scratch.save(pairs.dropDuplicates(["key", "template", "block"])), longest)  # equal rows find the same
    base = F.col("phrase") & (F.size("places") > 0)
    of_doc = pairs.groupBy("key").agg(
        F.sum(F.when(F.col("phrase"), F.size("places")).otherwise(0)).alias("n_base"),
        F.min(F.when(base, F.array_min("places"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.array_max("places"))).cast("long").alias("last_word"),
        F.collect_set(F.when(base, F.col("label"))).alias("base"),
        F.collect_set("label").alias("all"),
        F.max("containment").alias("score"),
    )
    joined = lambda c: F.coalesce(F.array_join(F.array_sort(c), ","), F.lit(""))
    whole = found.filter("seg = 0").select("key", "doc_id", "n_words")
    return whole.join(of_doc, "key", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        joined("base").alias("base_labels"), joined("all").alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def _oracle() -> str:
    templates = [*PHRASES, *NOTICES]
    rows = ", ".join(f"({t}, '{text}', '{label}', {t < len(PHRASES)}, {block_length(len(text.split()))})" for t, (text, label) in enumerate(templates))
    return f"""
WITH t AS (SELECT t, string_split(text, ' ') AS run, label, phrase, length FROM (VALUES {rows}) v(t, text, label, phrase, length)),
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{WORD}') AS ws FROM documents),
v AS (SELECT list(DISTINCT x) AS words FROM (SELECT unnest(run) AS x FROM t)),
p AS (SELECT doc_id, generate_subscripts(ws, 1) - 1 AS pos, unnest(ws) AS word FROM w),
h AS (SELECT doc_id, pos, word FROM p, v WHERE list_contains(words, word)),
lengths AS (SELECT DISTINCT length FROM t),
b AS (
  SELECT doc_id, length, pos // (length // 2) - k AS block, list(DISTINCT word) AS words FROM h, lengths, (VALUES (0), (1)) o(k)
  WHERE pos // (length // 2) - k >= 0 GROUP BY ALL),
n AS (
  SELECT doc_id, length, block, label, list_intersect(words, run) AS common, len(list_intersect(words, run)) / len(list_distinct(run)) AS containment FROM b JOIN t USING (length)
  WHERE len(list_intersect(words, run)) >= ceil({CONTAINMENT} * len(list_distinct(run)) - 1e-9)),
m AS (
  SELECT * FROM n WHERE NOT EXISTS (
    SELECT 1 FROM n o WHERE o.doc_id = n.doc_id AND o.block * (o.length // 2) <= n.block * (n.length // 2) + n.length AND n.block * (n.length // 2) <= o.block * (o.length // 2) + o.length
      AND o.containment > n.containment AND len(list_intersect(n.common, o.common)) = len(n.common))),
f AS (
  SELECT w.doc_id, t.label, unnest(list_filter(range(len(ws)), lambda i: list_slice(ws, i + 1, i + len(run)) = run)) AS pos FROM w, t WHERE phrase),
ma AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(containment) AS score FROM m GROUP BY doc_id),
fa AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM f GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM w LEFT JOIN fa USING (doc_id) LEFT JOIN ma USING (doc_id)
"""


ORACLE = _oracle()
