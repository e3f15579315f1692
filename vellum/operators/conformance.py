"""Conformance operators over any tables: cardinality, exclusive matching, near misses, references, coverage, diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import lexical as L
from vellum.operators.scans import scan
from vellum.sources.shared import written


def cardinality(parents: DataFrame, children: DataFrame, key: str, child_key: str, low: int, high: int | None) -> DataFrame:
    """Parents whose number of children is outside low ... high (None: no upper bound): key, found.

    Children are counted before the join, so only one row a parent meets the parents.
    """
    counts = children.groupBy(F.col(child_key).alias(key)).agg(F.count("*").alias("found"))
    found = F.coalesce(F.col("found"), F.lit(0)).cast("long")
    out = parents.select(key).join(counts, key, "left").select(key, found.alias("found"))
    return out.where((F.col("found") < low) | (F.col("found") > high if high is not None else F.lit(False)))


def claims(elements: DataFrame, element_key: str, rules: list[tuple[str, Column]]) -> DataFrame:
    """Each element belongs to the first rule (name, condition) that fits, at most: element_key, rule, nth."""
    rule, nth = F.lit(None).cast("string"), F.lit(None).cast("int")
    for i, (name, condition) in reversed(list(enumerate(rules, 1))):
        rule, nth = F.when(condition, name).otherwise(rule), F.when(condition, i).otherwise(nth)
    return elements.select(element_key, rule.alias("rule"), nth.alias("nth")).where("rule is not null")


def near_misses(values: DataFrame, value: str, vocabulary: DataFrame, word: str, *, least: int = 3, share: int = 4) -> DataFrame:
    """Distinct values that are no word but within max(least, the word's length / share) edits of one: value, word, distance;
    the nearest word, of equals the first in order.

    The vocabulary is one array that every task reads, so it must fit in memory; a value meets all words of a length within
    reach, in its own row.
    """
    distinct = values.select(F.col(value).alias("value")).where("value is not null").distinct()
    words = vocabulary.select(F.col(word).alias("word")).distinct()
    unknown = distinct.join(words.select(F.col("word").alias("value")), "value", "left_anti")
    reach = lambda w: F.greatest(F.lit(least), F.floor(F.length(w) / share).cast("int"))
    rows = unknown.select("value").crossJoin(F.broadcast(words.agg(F.collect_set("word").alias("words"))))
    near = F.filter("words", lambda w: F.levenshtein(F.col("value"), w) <= reach(w))
    best = F.array_min(F.transform(near, lambda w: F.struct(F.levenshtein(F.col("value"), w).alias("distance"), w.alias("word"))))
    # Not a filter: moved into the join as its condition, it could not be bound there.
    return rows.select("value", F.explode(F.array_compact(F.array(best))).alias("x")).select("value", "x.word", "x.distance")


def dangling(rows: DataFrame, key: str, targets: DataFrame, target_key: str) -> DataFrame:
    """Rows whose key is set but names no target."""
    return rows.where(F.col(key).isNotNull()).join(targets.select(F.col(target_key).alias(key)).distinct(), key, "left_anti")


def not_examined(expected: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Expected key combinations that were never seen."""
    return expected.select(*keys).distinct().join(seen.select(*keys).distinct(), keys, "left_anti")


def verdict_diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Rows that differ between two results: key, old, new, change (gone, new, moved)."""
    a, b = (df.select(key, F.col(value).alias(n)) for df, n in ((old, "old"), (new, "new")))
    both = a.withColumn("in_old", F.lit(True)).join(b.withColumn("in_new", F.lit(True)), key, "full_outer")
    change = F.when(F.col("in_new").isNull(), "gone").when(F.col("in_old").isNull(), "new").when(~F.col("old").eqNullSafe(F.col("new")), "moved")
    return both.select(key, "old", "new", change.alias("change")).where("change is not null")


def runs(rows: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """Runs of equal consecutive values: group, run (from 1), value, length."""
    some = rows.select(*dict.fromkeys([group, value, *order]))
    marked = scan(some, group, order, previous={"before": F.col(value)})
    begins = (F.col("nth_is_first") | ~F.col(value).eqNullSafe(F.col("before"))).cast("int")
    numbered = scan(marked.select(*some.columns, begins.alias("begins")), group, order, sums={"run": F.col("begins")})
    return numbered.groupBy(group, "run").agg(F.first(value).alias("value"), F.count("*").alias("length")).select(group, F.col("run").cast("long").alias("run"), "value", "length")


def carry_forward(rows: DataFrame, group: str, order: list[str], value: Column, name: str) -> DataFrame:
    """rows with the last set value so far, in order, within a group."""
    return scan(rows, group, order, lasts={name: value}).drop("nth_is_first")


def gaps(rows: DataFrame, group: str, number: str) -> DataFrame:
    """Missing numbers between neighbours of a group: group, after, before."""
    step = scan(rows.select(group, number).distinct(), group, [number], previous={"after": F.col(number)})
    return step.where(F.col(number) - F.col("after") > 1).select(group, "after", F.col(number).alias("before"))


def clusters(rows: DataFrame, group: str, number: str, gap: float, *, mean: bool = False) -> DataFrame:
    """Numbers of a group split where neighbours lie more than gap apart: group, cluster (from 1), low, high, n, and their mean if
    asked for. Equal numbers count once each, but are scanned as one."""
    each = rows.groupBy(group, number).agg(F.count("*").alias("n"))
    marked = scan(each, group, [number], previous={"before": F.col(number)})
    begins = F.coalesce((F.col(number) - F.col("before") > gap).cast("int"), F.lit(1))
    numbered = scan(marked.select(group, number, "n", begins.alias("begins")), group, [number], sums={"cluster": F.col("begins")})
    out = numbered.groupBy(group, "cluster").agg(F.min(number).alias("low"), F.max(number).alias("high"), F.sum("n").alias("n"), (F.sum(F.col(number) * F.col("n")) / F.sum("n")).alias("mean"))
    return out.select(group, F.col("cluster").cast("long").alias("cluster"), "low", "high", "n", *["mean"] * mean)


def disagreements(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with more than one distinct value: key, n_values, low, high."""
    return rows.groupBy(key).agg(F.count_distinct(value).alias("n_values"), F.min(value).alias("low"), F.max(value).alias("high")).where("n_values > 1")


def nearest_rows(seen: DataFrame, rows: DataFrame) -> DataFrame:
    """The nearest template row of each element that no row claimed: scope, element, row, distance, seen, expected.

    seen: scope, element, values (array). rows: scope, row, row_ord, claimed (boolean), match (array). Pairs meet by what near
    misses agree in (lexical.near_keys), so none is lost and nothing is crossed. The nearest wins, then one that nothing has
    claimed, then the first row, then spellings in order."""
    keyed = lambda df, column, name: df.withColumn(name, F.explode(column)).withColumn("key", F.explode(L.near_keys(F.col(name))))
    a = keyed(seen.select("scope", "element", "values"), "values", "seen").drop("values")
    b = keyed(rows.select("scope", "row", "row_ord", "claimed", "match"), "match", "expected").drop("match")
    met = a.join(b, ["scope", "key"]).withColumn("distance", L.near_distance(F.col("seen"), F.col("expected"))).where("distance is not null")
    best = F.min(F.struct("distance", "claimed", "row_ord", "seen", "expected", "row"))
    return met.groupBy("scope", "element").agg(best.alias("x")).select("scope", "element", "x.row", "x.distance", "x.seen", "x.expected")


def path_prefixes(path: Column) -> Column:
    """All prefixes of a slash-separated path, shortest first: /a, /a/b, ..."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.transform(parts, lambda _, i: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, i + 1), "/")))


def tree_depths(edges: DataFrame, node: str, parent: str, is_top: Column) -> DataFrame:
    """Nodes reachable from those where is_top holds, with their depth (from 1): one join a level, over that level's rows.
    Nodes in cycles, and below missing parents, are not reached. The lineage is cut at each level."""
    rows = edges.select(node, parent)
    level, out, depth = edges.where(is_top).select(node), None, 1
    while not level.isEmpty():
        here = level.withColumn("depth", F.lit(depth))
        out = here if out is None else out.union(here)
        level = rows.join(level.select(F.col(node).alias(parent)), parent, "left_semi").select(node)
        level = written(level)
        depth += 1
    return out if out is not None else level.withColumn("depth", F.lit(0))


def rollup(findings: DataFrame, group: str, severity: str) -> DataFrame:
    """Counts of errors, warnings and notes of a group, whether it passes, and its exit code: see exit_code."""
    of = lambda s: F.count_if(F.col(severity) == s)
    out = findings.groupBy(group).agg(of("error").alias("errors"), of("warning").alias("warnings"), of("info").alias("notes"))
    return out.select("*", (F.col("errors") == 0).alias("ok"), exit_code(F.lit(True), F.col("errors"), F.col("warnings")).alias("exit_code"))


def exit_code(judged: Column, errors: Column, warnings: Column, *, warnings_as_errors: bool = False, all_judged: Column | None = None) -> Column:
    """2 where nothing was judged, whatever else is asked; 1 for errors, for warnings if asked, and where all_judged, if given,
    is false; else 0."""
    failed = errors > 0
    if warnings_as_errors:
        failed = failed | (warnings > 0)
    if all_judged is not None:
        failed = failed | ~all_judged
    return F.when(~judged, 2).when(failed, 1).otherwise(0)


#: Readings of an obligation, the strongest first.
STRONGEST = ("yes", "conditional", "no", "unclear")


def strongest(readings: DataFrame, key: str, reading: str) -> DataFrame:
    """The strongest reading of each key: key, reading."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, STRONGEST)), F.col(reading)), F.lit(0))
    return readings.groupBy(key).agg(F.min(F.when(rank > 0, rank)).alias("rank")).select(key, F.coalesce(F.get(F.array(*map(F.lit, STRONGEST)), (F.col("rank") - 1).cast("int")), F.lit("unclear")).alias(reading))


def lone_value(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The one value that a key states, folded; null where it states none or several: key, value."""
    folded = F.lower(L.stripped(F.col(value)))
    seen = rows.groupBy(key).agg(F.count_distinct(folded).alias("n"), F.min(folded).alias("least"))
    return seen.select(key, F.when(F.col("n") == 1, F.col("least")).alias(value))


def shared_identifiers(rows: DataFrame, identifier: str, owner: str) -> DataFrame:
    """Identifiers that several owners claim: identifier, owners (sorted; as many as there are templates at most)."""
    several = rows.groupBy(identifier).agg(F.array_sort(F.collect_set(owner)).alias("owners"))
    return several.where(F.size("owners") > 1)
