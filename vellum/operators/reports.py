"""Findings as a report: grades, what is shown, lists of what was not examined, settled readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import lexical as L

#: How loud a specification's word is.
SEVERITY = {
    "MUST": "error", "MUST NOT": "error", "REQUIRED": "error", "SHALL": "error", "RECOMMENDED": "warning", "SHOULD": "warning",
    "MAY": "info", "OPTIONAL": "info",
}
#: Readings that require, and all readings, the least demanding first.
REQUIRED = ("required", "required-by-batteries-regulation")
PERMISSIVE = ("not-to-be-filled", "not-applicable", "not-stated", "voluntary", "certain-cases", "required-by-other-instrument", *REQUIRED)
#: So many names are listed before the rest is counted; keys of a finding in a report.
NAMED = 5
FIELDS = ("rule", "kind", "severity", "priority", "message", "subject", "detail", "fix", "title", "spec", "fixability", "fixabilityWhy", "path", "line", "part")


def severity(priority: Column) -> Column:
    """A finding's grade from the word of its rule; null for other words."""
    return F.coalesce(*[F.when(priority == word, grade) for word, grade in SEVERITY.items()])


def shown(findings: DataFrame, *, meta_kind: str, show_meta: bool = False) -> DataFrame:
    """Findings that a report shows: all, but those of the relayed kind only where they are errors or asked for. A null kind or
    grade counts as another one."""
    if show_meta:
        return findings
    return findings.where(~F.col("kind").eqNullSafe(meta_kind) | F.col("severity").eqNullSafe("error"))


def as_json(findings: DataFrame) -> Column:
    """A finding as one JSON object with all keys of a report, null where the table has no such column."""
    value = {c: F.col(f"`{c}`") for c in findings.columns}
    fields = [value.get(c, F.lit(None).cast("string")).alias(c) for c in FIELDS]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def settled(readings: DataFrame, key: list[str], reading: str) -> DataFrame:
    """One reading a key: required only where all stated ones require; else the least demanding of the known ones; else the
    first in order; null where none is stated. Null and empty readings state nothing."""
    r = F.when(F.col(reading) != "", F.col(reading))
    every = F.array(*map(F.lit, PERMISSIVE))
    rank = F.nullif(F.array_position(every, r), F.lit(0))
    seen = readings.groupBy(*key).agg(F.min(rank).alias("rank"), F.min(r).alias("least"), F.bool_and(r.isin(*REQUIRED)).alias("required"))
    known = F.get(every, (F.col("rank") - 1).cast("int"))
    return seen.select(*key, F.when(F.col("required"), F.col("least")).otherwise(F.coalesce(known, "least")).alias(reading))


def first_named(rows: DataFrame, key: list[str], name: str, order: list[Column], most: int = NAMED) -> DataFrame:
    """The first distinct names of a key in order, and how many there are: key, names, n. Ranks above `most` leave before they
    are gathered, so lists stay short however many names a key has."""
    each = rows.where(F.col(name).isNotNull()).select(*key, name).distinct()
    w = Window.partitionBy(*key).orderBy(*order)
    top = each.withColumn("__nth", F.row_number().over(w)).where(F.col("__nth") <= most)
    top = top.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("__nth", F.col(name).alias("name")))), lambda x: x["name"]).alias("names"))
    return top.join(each.groupBy(*key).agg(F.count("*").alias("n")), key)


def not_examined(records: DataFrame, strangers: DataFrame) -> DataFrame:
    """One row a place and rule: where, rule, because, unclaimed (names, the first in natural order), unclaimed_count.

    records: where, rule, because, count. strangers: where, rule, name. A record that names an unclaimed element says more than
    others, so its reason stays; the count is the largest stated, and no less than the distinct names."""
    said = F.lit("unclaimed-element-present")
    best = records.groupBy("where", "rule").agg(
        F.coalesce(F.max(F.when(F.col("because") == said, F.col("because"))), F.max("because")).alias("because"), F.max("count").alias("most")
    )
    names = first_named(strangers, ["where", "rule"], "name", [L.natural_key(F.col("name")), F.col("name")])
    none = F.array().cast("array<string>")
    return best.join(names, ["where", "rule"], "left").select("where", "rule", "because", F.coalesce("names", none).alias("unclaimed"), F.greatest(F.coalesce("most", F.lit(0)), F.coalesce("n", F.lit(0))).alias("unclaimed_count"))


def said_once(misses: DataFrame) -> DataFrame:
    """Near misses of one row and spelling in a scope speak once, for their first subject: scope, row, seen, subject, expected,
    n. misses: scope, row, seen, nth, subject, expected."""
    first = F.min(F.struct("nth", "subject", "expected")).alias("x")
    return misses.groupBy("scope", "row", "seen").agg(first, F.count("*").alias("n")).select("scope", "row", "seen", "x.subject", "x.expected", "n")


def beneath(matched: DataFrame, violations: DataFrame, doc: str = "doc") -> DataFrame:
    """Violations at a matched subject or below it: doc, matched, subject. matched: doc, matched. violations: doc, subject.
    A subject meets the matched ones by its ancestors, so nothing is compared by prefix."""
    steps = F.split("subject", "/")
    up = F.transform(steps, lambda _, i: F.array_join(F.slice(steps, 1, i + 1), "/"))
    rows = violations.select(doc, "subject", F.explode(up).alias("matched"))
    return rows.join(matched.select(doc, "matched").distinct(), [doc, "matched"]).select(doc, "matched", "subject")


def held(elements: DataFrame, key: str) -> DataFrame:
    """What each scope holds, in a sentence: the first elements with name and identifier, and how many more.
    elements: key, nth, id_short (or null), semantic_id (or null)."""
    name = F.coalesce(L.shown_text(F.col("id_short")), F.concat(F.lit("["), F.col("nth").cast("string"), F.lit("]")))
    one = F.concat(name, F.lit(" ("), F.coalesce("semantic_id", F.lit("no semanticId")), F.lit(")"))
    w = Window.partitionBy(key).orderBy("nth", "id_short", "semantic_id")
    top = elements.select(key, one.alias("one"), F.row_number().over(w).alias("rank")).where(F.col("rank") <= NAMED)
    top = top.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "one"))), lambda x: x["one"]), ", ").alias("listed"))
    counts = elements.groupBy(key).agg(F.count("*").alias("n"))
    more = F.when(F.col("n") > NAMED, F.concat(F.lit(" and "), (F.col("n") - NAMED).cast("string"), F.lit(" more"))).otherwise("")
    many = F.when(F.col("n") == 1, "").otherwise("s")
    return counts.join(top, key).select(key, F.concat(F.lit("this scope holds "), F.col("n").cast("string"), F.lit(" element"), many, F.lit(": "), "listed", more).alias("held"))
