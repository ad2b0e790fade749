"""Checks of what one stage hands to the next, as rule tables (rule, id, message).

A handoff is rows: claims (document, place, element_id), tasks (document, task_id,
needs), criteria of testcases. Each rule is an anti-join, a grouped count or a
pattern, over any number of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What an anchor proposal may say.
ANCHOR_KINDS = ["stable-directory", "contract-file", "explicit-test-entry", "critical-guardrail", "runtime-component", "schema-contract", "mcp-tool", "command"]
IMPLEMENTS = ["direct", "indirect"]
TRACE = {"proposalType": "implementation-to-intent-trace", "sourceAgent": "ImplementationDesign", "targetAgent": "IntentionDesign", "lifecycle": "temporary-trace-proposal"}


def _rule(rows: DataFrame, rule: str, key: str, message: Column) -> DataFrame:
    return rows.select("document", F.lit(rule).alias("rule"), F.col(key).alias("id"), message.alias("message"))


def claims(rows: DataFrame, elements: DataFrame) -> DataFrame:
    """Claimed elements that don't exist, or have no testcase of their own.

    ``elements`` has id, name and n_testcases."""
    at = F.concat(F.lit("intentElementIds["), F.col("place").cast("string"), F.lit("] "))
    both = rows.join(elements.select(F.col("id").alias("element_id"), "name", "n_testcases"), "element_id", "left")
    lost = _rule(both.filter("n_testcases is null"), "missing_element", "element_id", F.concat(at, F.lit("names a missing element")))
    bare = _rule(both.filter("n_testcases = 0"), "no_testcase", "element_id", F.concat(at, F.coalesce("name", F.lit("<unnamed>")), F.lit(" has no mounted testcases")))
    return lost.unionAll(bare)


def tasks(rows: DataFrame) -> DataFrame:
    """Tasks with one id, and needs that no task of the document has."""
    twice = rows.groupBy("document", "task_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    need = rows.select("document", "task_id", F.explode("needs").alias("need")).distinct()
    lost = need.join(rows.select("document", F.col("task_id").alias("need")), ["document", "need"], "left_anti")
    own = need.filter("need = task_id")
    out = _rule(twice, "duplicate_task", "task_id", F.concat(F.col("n").cast("string"), F.lit(" tasks have this id")))
    return out.unionAll(_rule(lost, "missing_task", "task_id", F.concat(F.lit("needs "), "need", F.lit(", which is missing")))).unionAll(_rule(own, "task_needs_itself", "task_id", F.lit("needs itself")))


def testcases(elements: DataFrame) -> DataFrame:
    """(element_id, ord, testcase, criteria): the testcases of all elements."""
    rows = elements.select(F.col("id").alias("element_id"), F.posexplode("testcases").alias("ord", "t"))
    return rows.select("element_id", "ord", F.col("t.name").alias("testcase"), F.col("t.acceptanceCriteria").alias("criteria"))


def criteria_by_testcase(rows: DataFrame) -> DataFrame:
    """(testcase, criteria): the last criteria of each name."""
    return rows.filter("testcase is not null").groupBy("testcase").agg(F.max_by("criteria", F.struct("element_id", "ord")).alias("criteria"))


def criteria(rows: DataFrame) -> DataFrame:
    """Acceptance criteria that are no plain command: shells, quotes, operators."""
    text = F.trim(F.coalesce("criteria", F.lit("")))
    problem = (
        F.when(text == "", "is empty")
        .when(text.rlike(r"(?i)^(cmd|powershell|pwsh|bash|sh|zsh)(\.exe)?(\s|$)"), "runs a shell")
        .when(text.rlike("[\"'`]"), "has quotes")
        .when(text.rlike(r"[|&;<>]"), "has operators")
    )
    found = rows.withColumn("problem", problem).filter("problem is not null")
    return _rule(found.withColumn("document", F.col("element_id")), "acceptance_criteria", "testcase", F.col("problem"))


def anchors(rows: DataFrame, paths: DataFrame) -> DataFrame:
    """Anchor proposals (document, place, kind, implements, contract_paths) with
    values that aren't allowed, or paths that don't exist (``paths`` has path)."""
    spot = rows.withColumn("spot", F.concat(F.lit("anchorProposals["), F.col("place").cast("string"), F.lit("]")))
    kind = _rule(spot.filter(~F.coalesce(F.col("kind").isin(ANCHOR_KINDS), F.lit(False))), "anchor_kind", "spot", F.concat(F.lit("unsupported kind: "), F.coalesce("kind", F.lit("none"))))
    how = _rule(spot.filter(~F.coalesce(F.col("implements").isin(IMPLEMENTS), F.lit(False))), "anchor_implements", "spot", F.concat(F.lit("must be direct or indirect: "), F.coalesce("implements", F.lit("none"))))
    told = spot.select("document", "spot", F.explode_outer("contract_paths").alias("path"))
    none = _rule(told.filter("path is null"), "anchor_paths", "spot", F.lit("needs a contract path"))
    lost = _rule(told.filter("path is not null").join(paths.select("path"), "path", "left_anti"), "anchor_path", "spot", F.concat(F.lit("missing path: "), "path"))
    return kind.unionAll(how).unionAll(none).unionAll(lost)


def trace(rows: DataFrame) -> DataFrame:
    """Proposals (document and the fields of ``TRACE``) with other than fixed values."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("field"), F.col(k).alias("value"), F.lit(v).alias("want")) for k, v in TRACE.items()]))
    off = rows.select("document", pairs.alias("x")).select("document", "x.*").filter("not (value <=> want)")
    return _rule(off, "trace_field", "field", F.concat(F.lit("must be "), "want"))
