"""Column functions on texts, ids and versions. None leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as browsers see it, which Java's \\s is not.
SPACE = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
_FP = r"(?<![A-Za-z0-9_])FP(?:-[A-Za-z0-9_]+)?-[0-9]+|(?<![A-Za-z0-9_])FP[0-9]+(?![A-Za-z0-9_])"


def score_text(field: Column, query: str) -> Column:
    """100 if equal, 50 if it begins with the query, 20 if it contains it, else 0."""
    q, low = query.strip().lower(), F.lower(F.coalesce(field, F.lit("")))
    if not q:
        return F.lit(0)
    return F.when(low == q, 100).when(low.startswith(q), 50).when(F.instr(low, F.lit(q)) > 0, 20).otherwise(0)


def summarize(text: Column, most: int = 180) -> Column:
    """Blanks collapsed and trimmed; longer texts end in three dots."""
    flat = F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "))
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.substring(flat, 1, most - 3), F.lit("...")))


def functional_points(text: Column) -> Column:
    """Distinct marks such as FP12 or FP-ORD-3 in a text."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_FP), F.lit(0)))


def mask(value: Column) -> Column:
    """The first four characters; short values go whole."""
    return F.when(F.length(value) <= 4, "****").otherwise(F.concat(F.substring(value, 1, 4), F.lit("****")))


def format_size(g: Column) -> Column:
    """One decimal, or none if it is zero."""
    return F.regexp_replace(F.format_string("%.1f", g), r"\.0$", "")


def slug(name: Column, prefix: str = "db-", most: int = 63) -> Column:
    """A database name: lower case, other signs as hyphens."""
    s = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9.-]+", "-"), "-{2,}", "-")
    s = F.regexp_replace(s, "^[-.]+|[-.]+$", "")
    return F.substring(F.when(s.rlike("^[a-z]"), s).otherwise(F.concat(F.lit(prefix), s)), 1, most)


def layer_of(kind: Column) -> Column:
    """The drawing layer of an element type; the first prefix that fits counts."""
    return (
        F.when(kind.rlike("^(Business|Product|Contract|Representation|Goal|Requirement|Driver|Stakeholder)"), "Business")
        .when(kind.rlike("^(Application|Data)"), "Application")
        .when(kind.rlike("^(Technology|Node|Device|System|Artifact|Path|Communication)"), "Technology")
        .when(kind.rlike("^(Work Package|Deliverable|Implementation|Plateau|Gap)"), "Implementation")
        .otherwise("Other")
    )


def canonical_type(name: Column, known: list[str], other: str) -> Column:
    """The known type that a tool's name stands for, whatever its prefix and blanks."""
    squash = lambda s: "".join(c for c in s if c.isalnum()).lower()
    table = F.create_map(*[F.lit(x) for t in known for x in (squash(t), t)])
    key = F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), "^ArchiMate_", ""), "[^A-Za-z0-9]", ""))
    return F.coalesce(F.try_element_at(table, key), F.lit(other))


def next_version(version: Column) -> Column:
    """The trailing number one higher, or a suffix if there is none."""
    n = F.regexp_extract(version, "([0-9]+)$", 1)
    return F.when(n != "", F.concat(F.regexp_replace(version, "[0-9]+$", ""), (F.expr("1") + n.cast("long")).cast("string"))).otherwise(F.concat(version, F.lit("-indexed")))


def content_version(*cols: str) -> Column:
    return F.concat(F.lit("content:"), F.sha2(F.to_json(F.struct(*cols)), 256))


def attribute(attributes: Column, name: str) -> Column:
    """The value of the last attribute of a name."""
    return F.element_at(F.transform(F.filter(attributes, lambda a: a["name"] == name), lambda a: a["value"]), -1)


def safe_integer(x: Column) -> Column:
    """JSON text of an integer: quoted if a double can't hold it."""
    return F.when(F.abs(x) > 9007199254740991, F.concat(F.lit('"'), x.cast("string"), F.lit('"'))).otherwise(x.cast("string"))


def sequence_token(text: Column) -> Column:
    """A leading mark such as 1.2.3."""
    return F.regexp_extract(F.coalesce(text, F.lit("")), r"^\s*([0-9]+(?:\.[0-9]+)*)", 1)


def style_map(text: Column) -> Column:
    """``key=value;`` pairs as a map."""
    return F.str_to_map(F.regexp_replace(text, ";+$", ""), F.lit(";"), F.lit("="))


def rtf_empty(text: Column) -> Column:
    """Whether rich text has nothing to read."""
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\\[a-z]+-?[0-9]* ?|\\['*][0-9a-f]{0,2}", ""), r"[{}\s;]", "")
    return F.length(plain) == 0


def escape_plantuml(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), '"', "'"), r"[\r\n]+", " ")


def alias_of(identifier: Column) -> Column:
    """Letters, digits and underscores only, not beginning with a digit."""
    s = F.regexp_replace(identifier, "[^A-Za-z0-9_]", "_")
    return F.when(s.rlike("^[0-9]"), F.concat(F.lit("n"), s)).otherwise(s)
