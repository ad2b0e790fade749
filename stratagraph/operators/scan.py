"""Sensitive values in keyed texts: one row for each family that matches.

A document's fields are (path, key, value) rows; ``json_fields`` makes them from
JSON of any shape. Families are finer than a report's types: credential keys and
values, commit keys and hashes, paths, e-mail addresses and phone numbers each have
a name of their own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratagraph.functions.text import mask
from stratagraph.plans.fixpoint import MERGE, Rounds

# Patterns of keys and values. Look-arounds stand for word boundaries,
# which know letters outside ASCII in Java.
CREDENTIAL_KEY = r"(?i)token|password|passwd|secret|api[-_]?key|apikey|credential|pwd|private[-_]?key|access[-_]?key|(?<![A-Za-z0-9_])connection|(?<![A-Za-z0-9_])(auth|bearer|jwt)(?![A-Za-z0-9_])"
COMMIT_KEY = r"(?i)commit"
CREDENTIAL_VALUE = r"(?<![A-Za-z0-9_])(sk|pk|AKIA|ASIA|ghp|gho|ghu|ghs|ghr|xox[baprs]|eyJ)[-_A-Za-z0-9]{8,}"
WINDOWS_DRIVE_PATH = r"[A-Za-z]:[\\/]"
UNC_PATH = r"\\\\[A-Za-z0-9._-]+\\"
UNIX_ABSOLUTE_PATH = r"(^|[^A-Za-z0-9_])/(?:home|usr|opt|etc|var|root|tmp|srv|mnt|media|proc|sys|data|apps|projects)/"
ENV_VAR_PATH = r"\$[A-Z_][A-Z0-9_]*|%[A-Z_][A-Z0-9_]*%"
TILDE_PATH = r"~[/\\]"
GIT_BASH_PATH = r"(^|[^A-Za-z0-9_])/c/"
GIT_HASH = r"(?<![A-Za-z0-9_])[0-9a-f]{40}(?![A-Za-z0-9_])"
# A name counts from its first sign on, so that no part of a long run of signs is read again.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"(?<![A-Za-z0-9_])[0-9]{11}(?![A-Za-z0-9_])"

#: Families of values: any of the patterns.
VALUES = {
    "credential_value": [CREDENTIAL_VALUE],
    "path": [WINDOWS_DRIVE_PATH, UNC_PATH, UNIX_ABSOLUTE_PATH, ENV_VAR_PATH, TILDE_PATH, GIT_BASH_PATH],
    "git_hash": [GIT_HASH],
    "email": [EMAIL],
    "phone": [PHONE],
}

#: What every match of a pattern holds; texts without it need no search.
HOLDS = {WINDOWS_DRIVE_PATH: ":", UNC_PATH: "\\\\", UNIX_ABSOLUTE_PATH: "/", TILDE_PATH: "~", GIT_BASH_PATH: "/c/", EMAIL: "@"}


def _any(column: str, patterns: list[str]) -> Column:
    search = lambda p: F.col(column).contains(HOLDS[p]) & F.col(column).rlike(p) if p in HOLDS else F.col(column).rlike(p)
    return reduce(Column.__or__, map(search, patterns))


def sensitive(fields: DataFrame) -> DataFrame:
    """(type, path, value, masked) of fields (path, key, value)."""
    named = F.when(F.lower("key") == "name", F.col("value"))
    checks = [
        F.when(F.col("key").rlike(CREDENTIAL_KEY) | F.coalesce(named.rlike(CREDENTIAL_KEY), F.lit(False)), F.lit("credential_key")),
        F.when(F.col("key").rlike(COMMIT_KEY) | F.coalesce(named.rlike(COMMIT_KEY), F.lit(False)), F.lit("commit_key")),
        *[F.when(_any("value", ps), F.lit(k)) for k, ps in VALUES.items()],
    ]
    # A filter inside the explode would be run twice, once to find texts without a hit.
    hits = fields.withColumn("type", F.explode(F.array(*checks))).filter("type is not null")
    return hits.select("type", "path", "value", mask(F.col("value")).alias("masked"))


def json_fields(documents: DataFrame, column: str = "json") -> DataFrame:
    """(path, key, value) of the texts that stand under a key in JSON documents, and the
    other columns of these; texts in lists have no key. Lists and objects are opened
    level by level, one round a level; values are variants until a text is found."""
    spark = documents.sparkSession
    tables, others = Rounds(spark), [c for c in documents.columns if c != column]
    doc = F.struct(*others) if others else F.lit(0)
    nodes = documents.select(doc.alias("doc"), F.lit("").alias("at"), F.parse_json(column).alias("node")).filter("node is not null")
    found, rounds = spark.createDataFrame([], "path string, key string, value string").select(F.lit(None).cast(nodes.schema["doc"].dataType).alias("doc"), "path", "key", "value"), 0
    while not nodes.isEmpty():
        inner = nodes.lateralJoin(spark.tvf.variant_explode_outer(F.col("node").outer()).toDF("place", "name", "inner")).filter("place is not null")
        step = F.when(F.col("name").isNull(), F.concat(F.lit("["), "place", F.lit("]"))).when(F.col("at") == "", F.col("name")).otherwise(F.concat(F.lit("."), "name"))
        opened = inner.select("doc", F.concat("at", step).alias("at"), "name", F.col("inner").alias("node"), F.schema_of_variant("inner").alias("kind"))
        opened = tables.save(opened)
        texts = opened.filter("kind = 'STRING' and name is not null")
        found = found.unionByName(texts.select("doc", F.col("at").alias("path"), F.col("name").alias("key"), F.variant_get("node", "$", "string").alias("value")))
        nodes, rounds = opened.filter("kind LIKE 'OBJECT%' OR kind LIKE 'ARRAY%'").select("doc", "at", "node"), rounds + 1
        if rounds % MERGE == 0:
            found = tables.save(found)
    return found.select(*[F.col("doc").getField(c).alias(c) for c in others], "path", "key", "value")
