"""Operator 11: prefix trie of conversations by heavy-path decomposition.

A node is a distinct sequence of first turns. Its fingerprint is the sum of hashes
(SHA-256, four sums modulo 2^32) of its turns with their places, so the prefixes of
a conversation are running sums. Running sums, like everything along a conversation
or a path, are taken in chunks of ``CHUNK`` places and joined by the chunks' totals:
no conversation or path is ever in one group.

Every node's heavy child is the one with the most members. The path of a leaf goes
up while nodes are heavy; each node lies on one path. A light child has at most half
of its parent's members, so paths fall into classes by the binary logarithm of the
members of their heads, and light paths hang on paths of higher classes. One round a
class, at most log2(conversations) + 1 of them, takes suffix sums along the paths of
the class and hands the sums of their heads to the nodes where these hang.

Joins on nodes many rows may share go through ``ordered.lookup``: the few hot
nodes are broadcast, their number has a bound.

Rows without a conversation id are left out. Null roles and texts count as empty.
Turns are ordered by turn, null first; ties by the hash of role and text; repeated
rows are turns of their own. Extra columns are not looked at. An empty table gives
no node. A long text is hashed once; only its hash and length go further.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratagraph.llm.crc import CRC_TABLE, crc32_sql
from stratagraph.llm.ordered import lookup, places
from stratagraph.llm.scratch import Scratch

#: Places of a conversation or a path in one group.
CHUNK = 1024
#: Ids that are joined in one row of an intermediate text.
IDS = 1_024
ROOT = "root"
_SUMS = [f"s{k}" for k in range(4)]


def _text(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def turns(conversations: DataFrame, scratch: Scratch, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(c, place, digest, chars) of every turn, places from 0."""
    digest = F.sha2(F.concat_ws("\x1f", F.length(_text(role_col)).cast("string"), _text(role_col), _text(text_col)), 256)
    rows = conversations.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("c"), F.col(turn_col).cast("long").alias("turn"), digest.alias("digest"), F.length(_text(text_col)).cast("long").alias("chars")
    )
    return places(rows, "c", [F.asc_nulls_first("turn"), F.col("digest")], scratch).select("c", "place", "digest", "chars")


def rebuilt(found: DataFrame, scratch: Scratch, group: int = 100, shared: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with the first h turns of the first one of their
    ``group`` of ids, h = crc32 of the id modulo ``shared``: their sizes (c, n) and
    turns (c, place, digest, chars, n)."""
    h = (F.crc32(F.col("c").cast("string")) % shared).cast("long")
    own = found.groupBy("c").agg(F.count(F.lit(1)).alias("own"))
    total = found.count()
    bases = own.select(F.col("c").alias("base"), F.col("own").alias("there"))
    convs = own.withColumn("h", h).withColumn("base", F.col("c") - F.col("c") % group).join(bases, "base", "left")
    taken = F.least("h", F.coalesce("there", F.lit(0)))
    convs = convs.withColumn("m", taken).withColumn("n", taken + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    convs = scratch.save(convs.select("c", "base", "h", "m", "own", "n"))
    # At most ``group`` conversations times ``shared`` turns for each base.
    heads = found.filter(F.col("place") < shared - 1).select(F.col("c").alias("base"), "place", "digest", "chars")
    first = heads.join(convs.select("base", "c", "h", "n"), "base").filter("place < h").select("c", "place", "digest", "chars", "n")
    # A conversation may have any number of turns of its own.
    rest = lookup(found.filter(F.col("place") >= h), convs.filter("own > h").select("c", "h", "m", "n", "own"), "c", "own", total)
    rest = rest.select("c", (F.col("place") - F.col("h") + F.col("m")).alias("place"), "digest", "chars", "n")
    return convs.select("c", "n"), first.unionByName(rest)


def prefixes(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(c, depth, node, up, chars, ends): the node of each prefix and the one above."""
    term = F.sha2(F.concat_ws(":", F.col("place").cast("string"), "digest"), 256)
    rows = rows.select("c", "place", "chars", "n", F.floor(F.col("place") / CHUNK).alias("chunk"), term.alias("term"))
    rows = rows.select("*", *[F.conv(F.substring("term", 8 * k + 1, 8), 16, 10).cast("long").alias(f"t{k}") for k in range(4)]).drop("term")
    rows = scratch.save(rows)
    totals = rows.groupBy("c", "chunk").agg(*[F.sum(f"t{k}").alias(f"a{k}") for k in range(4)])
    ahead = Window.partitionBy("c").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("c", "chunk", *[F.sum(f"a{k}").over(ahead).alias(f"b{k}") for k in range(4)]).filter("chunk > 0")
    here = Window.partitionBy("c", "chunk").orderBy("place")
    sums = rows.select("*", *[F.sum(f"t{k}").over(here).alias(f"s{k}") for k in range(4)]).join(before, ["c", "chunk"], "left")
    name = lambda parts: F.concat_ws(":", *[F.hex(F.pmod(p, F.lit(1 << 32))) for p in parts])
    at = [F.col(f"s{k}") + F.coalesce(f"b{k}", F.lit(0)) for k in range(4)]
    above = F.when(F.col("place") == 0, F.lit(ROOT)).otherwise(name([a - F.col(f"t{k}") for k, a in enumerate(at)]))
    return scratch.save(sums.select("c", (F.col("place") + 1).alias("depth"), name(at).alias("node"), above.alias("up"), "chars", (F.col("place") + 1 == F.col("n")).alias("ends")))


def _nodes(walks: DataFrame, convs: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, up, depth, conv_id, n_convs, chars, n_children, heavy), the root too."""
    made = walks.groupBy("node").agg(F.max("up").alias("up"), F.max("depth").alias("depth"), F.min("c").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("chars").alias("chars"))
    root = convs.agg(F.min("c").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0")
    root = root.select(F.lit(ROOT).alias("node"), F.lit(None).cast("string").alias("up"), F.lit(0).cast("long").alias("depth"), "conv_id", "n_convs", F.lit(0).cast("long").alias("chars"))
    made = scratch.save(made.unionByName(root))
    below = made.filter("up is not null").groupBy("up").agg(F.count(F.lit(1)).alias("n_children"), F.max(F.struct("n_convs", -F.col("conv_id"), "node")).alias("child"))
    heavy = below.select(F.col("child")["node"].alias("node"), F.lit(True).alias("heavy"))
    out = made.join(below.select(F.col("up").alias("node"), "n_children"), "node", "left").join(heavy, "node", "left")
    return scratch.save(out.withColumn("n_children", F.coalesce("n_children", F.lit(0))).withColumn("heavy", F.coalesce("heavy", F.lit(False))))


def _paths(walks: DataFrame, nodes: DataFrame, total: int, scratch: Scratch) -> DataFrame:
    """Nodes with their path (the smallest conversation that ends at its leaf), the
    class of the path, and, on heads, the place where the path hangs."""
    leaves = nodes.filter("n_children = 0 and depth > 0").select(F.col("conv_id").alias("c"), F.col("depth").alias("long_"))
    down = scratch.save(lookup(walks.select("c", "depth", "node"), leaves, "c", "long_", total))
    light = nodes.filter("not heavy and depth > 0").select("node", "up", "n_convs", F.col("n_convs").alias("members"))
    tops = lookup(down, light, "node", "members", total).groupBy("c").agg(F.max(F.struct("depth", "n_convs", "up")).alias("top"))
    n_all = nodes.filter("depth = 0").select(F.col("n_convs").alias("n_all"))
    heads = leaves.join(tops, "c", "left").crossJoin(F.broadcast(n_all))  # the root's one row
    size = F.coalesce(F.col("top")["n_convs"], F.col("n_all"))
    heads = heads.select("c", "long_", F.coalesce(F.col("top")["depth"], F.lit(0)).alias("head"), size.alias("size"), F.col("top")["up"].alias("at"))
    # Whole numbers: the class is the number of halvings until one is left.
    heads = scratch.save(heads.withColumn("class", F.length(F.conv(F.col("size").cast("string"), 10, 2)) - 1))
    # The path that reaches the root; if no turn exists, the root is all there is.
    on = lookup(down, heads.select("c", "head", "class", "long_"), "c", "long_", total).filter("depth >= head")
    top = nodes.filter("depth = 0").select("node").crossJoin(F.broadcast(heads.filter("head = 0").select("c", "class").limit(1)))
    on = on.select("node", "c", "depth", "head", "class").unionByName(top.select("node", "c", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("head"), "class"))
    on = scratch.save(on)
    hangs = nodes.select(F.col("node").alias("at"), F.col("n_convs").alias("members")).join(on.select(F.col("node").alias("at"), F.col("c").alias("to"), F.col("depth").alias("to_depth"), F.col("class").alias("to_class")), "at")
    hung = lookup(heads.filter("at is not null").select("c", "head", "at"), hangs, "at", "members", total).select("c", F.col("head").alias("depth"), "to", "to_depth", "to_class")
    return scratch.save(on.join(hung, ["c", "depth"], "left"))


def _suffix_sums(rows: DataFrame, long_paths: bool) -> DataFrame:
    """Sums of ``leaves`` and ``saved`` over all deeper nodes of each path."""
    at = rows.groupBy("c", "chunk", "depth").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), *[F.max(x).alias(x) for x in ("to", "to_depth", "to_class")])
    deeper = Window.partitionBy("c", "chunk").orderBy(F.desc("depth"))
    out = at.withColumn("leaves", F.sum("leaves").over(deeper)).withColumn("saved", F.sum("saved").over(deeper))
    if not long_paths:
        return out
    whole = at.groupBy("c", "chunk").agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
    later = Window.partitionBy("c").orderBy(F.desc("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    more = whole.select("c", "chunk", F.sum("l").over(later).alias("l"), F.sum("s").over(later).alias("s")).filter("l is not null")
    out = out.join(more, ["c", "chunk"], "left")
    return out.withColumn("leaves", F.col("leaves") + F.coalesce("l", F.lit(0))).withColumn("saved", F.col("saved") + F.coalesce("s", F.lit(0))).drop("l", "s")


def _subtrees(nodes: DataFrame, paths: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, n_leaves, saved_tokens): sums over each node's subtree."""
    own = nodes.select("node", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    own = scratch.save(paths.join(own, "node").withColumn("chunk", F.floor(F.col("depth") / CHUNK)))
    long_paths = (own.agg(F.max("chunk").alias("m")).first()["m"] or 0) > 0
    classes = sorted(r["class"] for r in own.select("class").distinct().collect())  # at most 63
    cols, done = ["c", "chunk", "depth", "leaves", "saved", "to", "to_depth", "to_class"], []
    for k in classes:
        rows = own.filter(F.col("class") == k).select(cols)
        for below in done:
            hung = below.filter(F.col("to_class") == k).select(
                F.col("to").alias("c"), F.floor(F.col("to_depth") / CHUNK).alias("chunk"), F.col("to_depth").alias("depth"), "leaves", "saved",
                F.lit(None).cast("long").alias("to"), F.lit(None).cast("long").alias("to_depth"), F.lit(None).cast("int").alias("to_class"),
            )
            rows = rows.unionByName(hung)
        done.append(scratch.save(_suffix_sums(rows, long_paths)))
    sums = done[0]
    for more in done[1:]:
        sums = sums.unionByName(more)
    sums = sums.select("c", "depth", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    return own.select("node", "c", "depth").join(sums, ["c", "depth"]).drop("c", "depth")


def _joined(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Ids of one node that follow each other, as texts of at most IDS ids."""
    node, first, ids = None, 0, []
    for frame in frames:
        out = []
        for n, c in zip(frame["node"], frame["c"], strict=True):
            if n != node or len(ids) == IDS:
                if ids:
                    out.append((node, first, ",".join(ids)))
                node, first, ids = n, c, []
            ids.append(str(c))
        yield pd.DataFrame(out, columns=["node", "first", "ids"])
    if ids:
        yield pd.DataFrame([(node, first, ",".join(ids))], columns=["node", "first", "ids"])


def _digests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of each node's texts, taken in one after the other."""
    node, state = None, None
    for frame in frames:
        out = []
        for n, ids in zip(frame["node"], frame["ids"], strict=True):
            if n != node:
                if state is not None:
                    out.append((node, state.hexdigest()))
                node, state = n, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        yield pd.DataFrame(out, columns=["node", "sha"])
    if state is not None:
        yield pd.DataFrame([(node, state.hexdigest())], columns=["node", "sha"])


def end_digests(ends: DataFrame) -> DataFrame:
    """(node, sha) of the ids (node, c) that end there, in ascending order. However
    many end at one node, ids meet in texts of a bounded size, and a task holds one."""
    texts = ends.repartitionByRange("node", "c").sortWithinPartitions("node", "c").mapInPandas(_joined, "node string, first long, ids string")
    return texts.repartition("node").sortWithinPartitions("node", "first").mapInPandas(_digests, "node string, sha string")


def prefix_trie(convs: DataFrame, rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Nodes of the conversations (c, n) with turns (c, place, digest, chars, n):
    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    walks = prefixes(rows, scratch)
    total = max(walks.count(), 1)
    nodes = _nodes(walks, convs, scratch)
    ends = walks.filter("ends").select("node", "c").unionByName(convs.filter("n = 0").select(F.lit(ROOT).alias("node"), "c"))
    nothing = hashlib.sha256(b"").hexdigest()
    if nodes.filter("depth > 0").isEmpty():
        sums = nodes.select("node", F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"))
    else:
        sums = _subtrees(nodes, _paths(walks, nodes, total, scratch), scratch)
    above = nodes.select(F.col("node").alias("up"), F.col("conv_id").alias("parent_conv_id"), F.when(F.col("depth") == 0, total).otherwise(F.col("n_convs")).alias("members"))
    root = nodes.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    first = nodes.filter("depth = 1").crossJoin(F.broadcast(above.filter(F.col("up") == ROOT).select("parent_conv_id")))  # the root's one row
    deeper = lookup(nodes.filter("depth > 1"), above.filter(F.col("up") != ROOT), "up", "members", total)
    out = root.unionByName(first).unionByName(deeper).join(sums, "node").join(end_digests(ends), "node", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha", F.lit(nothing)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations of a table."""
    scratch = Scratch(conversations.sparkSession, "trie")
    found = scratch.save(turns(conversations, scratch))
    convs, rows = rebuilt(found, scratch)
    return prefix_trie(convs, rows, scratch)


ORACLE = f"""
WITH {CRC_TABLE},
o AS (
  SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS ts FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, ts, {crc32_sql("conv_id::VARCHAR")} % 6 AS h FROM o, crc_table),
r AS (
  SELECT h.conv_id, coalesce(list_slice(b.ts, 1, h), []) || list_slice(h.ts, h + 1, len(h.ts)) AS ts
  FROM h LEFT JOIN o b ON b.conv_id = h.conv_id - h.conv_id % 100),
p AS (SELECT conv_id, len(ts) AS n, unnest(range(len(ts) + 1)) AS depth, ts FROM r),
w AS (SELECT conv_id, n, depth, list_slice(ts, 1, depth) AS node FROM p),
nodes AS (
  SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CASE WHEN n = depth THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '') AS ends
  FROM w GROUP BY node, depth),
tops AS (SELECT node, depth, conv_id, n_convs, ends, list_slice(node, 1, depth - 1) AS up, CASE WHEN depth = 0 THEN 0 ELSE length(node[depth].t) END AS chars FROM nodes),
kids AS (SELECT up AS node, count(*) AS n FROM tops WHERE depth > 0 GROUP BY up),
subs AS (
  SELECT w.node, sum(CASE WHEN k.n IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((t.n_convs - 1) * t.chars) AS saved
  FROM tops t LEFT JOIN kids k ON k.node = t.node JOIN w ON w.conv_id = t.conv_id AND w.depth <= t.depth GROUP BY w.node)
SELECT t.conv_id, t.depth, u.conv_id AS parent_conv_id, t.n_convs, coalesce(k.n, 0) AS n_children, s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(t.ends) AS ends_sha256
FROM tops t LEFT JOIN tops u ON u.node = t.up AND t.depth > 0 LEFT JOIN kids k ON k.node = t.node JOIN subs s ON s.node = t.node
"""
