"""Template documents as the rows that `operators.walk` takes, built as joins and rounds over all templates at once.

A template is a JSON document whose first submodel says what it identifies and which elements it requires. Each element is a
row, numbered in pre-order, unless the place is open (its own identifier is a marker): then it and what it holds are no rows.

A row answers to every identifier that the template gives it, markers aside. It asks for 0 or more elements where no qualifier
says otherwise. An element that repeats its parent's identifier and kind and holds nothing is a copy: its rows are its
parent's, at any depth; it can't be mandatory, or no document would end. A row that nothing identifies can be mandatory inside
a list only, where its kind is matched.

A label that several rows share is told apart by the shortest run of ancestors that differs for all of them: rounds lengthen
the run for the labels that are still shared, so a label of many rows costs its rows once a round and nothing is compared by
pairs.

Documents that are no template, hold more than `most` rows, or whose rows share a label even with all ancestors, are refused:
they give no rows, but one refusal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.lexical import normal_identifier
from vellum.sources.environment import _items, _string
from vellum.sources.shared import written

#: Identifiers of places that a supplier fills; qualifiers that say how many, the first present one counts, and
#: what their words mean; kinds that may hold copies of themselves.
MARKERS = ("https://admin-shell.io/smt-dropin/smt-dropin-use/1/0",)
COUNT_TYPES = ("SMT/Cardinality", "Multiplicity", "Cardinality")
COUNTS = {"One": (1, 1), "ZeroToOne": (0, 1), "OneToMany": (1, None), "ZeroToMany": (0, None)}
NESTING = ("Entity", "SubmodelElementCollection")
#: Rows of one template.
MOST_ROWS = 10_000
COLUMNS = ["template", "row_id", "row_ord", "parent_id", "scope_id", "label", "kind", "sid", "match", "low", "high", "value_type", "list_type"]


def _keys(v: str | Column, path: str) -> Column:
    return F.transform(F.coalesce(_items(v, path), F.array().cast("array<variant>")), lambda k: F.coalesce(_string(k, "$.value"), F.lit("")))


def _joined(keys: Column, each=lambda k: k) -> Column:
    return F.array_join(F.transform(keys, each), "/")


def _spellings(keys: Column) -> Column:
    """Each key, the join of several, and both without ~N."""
    each = F.transform(keys, normal_identifier)
    whole = F.when(F.size(keys) > 1, F.concat(each, F.array(_joined(keys, normal_identifier)))).otherwise(each)
    return F.array_union(whole, F.transform(whole, lambda v: F.regexp_replace(v, r"~\d+", "")))


def _qualifier(name: str) -> Column:
    """A qualifier's value, '' where it is there without one, null where it isn't there; the last of several."""
    of = F.filter(F.coalesce(_items("element", "$.qualifiers"), F.array().cast("array<variant>")), lambda q: _string(q, "$.type") == name)
    return F.when(F.size(of) > 0, F.coalesce(_string(F.element_at(of, -1), "$.value"), F.lit("")))


def escaped(text: Column) -> Column:
    """A regular expression that matches a text only."""
    return F.regexp_replace(text, r"([^\p{L}\p{N}_])", r"\\$1")


def name_pattern(raw: Column, own: Column) -> Column:
    """The regular expression of the names that a qualifier allows: `Part[\\d{2,3}]` is Part, with two or three digits or without,
    anything else the name that it spells; the template's own name passes beside. Null where it can't be read."""
    bracket = r"(?s)^(.*)\[\\d\{(\d)(?:,(\d))?\}\]$"
    part = lambda i: F.regexp_extract(raw, bracket, i)
    times = F.when(part(3) == "", F.concat(F.lit("{"), part(2), F.lit("}"))).otherwise(F.concat(F.lit("{"), part(2), F.lit(","), part(3), F.lit("}")))
    numbered = F.regexp_like(raw, F.lit(bracket))
    inner = F.when(numbered, F.concat(escaped(part(1)), F.lit(r"(?:\d"), times, F.lit(")?"))).otherwise(escaped(raw))
    readable = (raw != "") & ~(numbered & (part(3) != "") & (part(3) < part(2)))
    other = own.isNotNull() & (own != "") & ~F.regexp_like(own, F.concat(F.lit("^(?:"), inner, F.lit(")$")))
    return F.when(readable, F.concat(F.lit("^(?:"), inner, F.when(other, F.concat(F.lit("|"), escaped(own))).otherwise(""), F.lit(")$")))


def _elements(docs: DataFrame, markers: tuple[str, ...], item_names: dict[str, str]) -> DataFrame:
    """All elements that are rows: doc_id, template, path, parent, label, above (labels of the rows above, the nearest first), copies
    and the row's columns."""
    marked = F.array(*map(F.lit, markers)).cast("array<string>")
    names = F.create_map(*[F.lit(x) for pair in item_names.items() for x in pair]) if item_names else None
    holds = lambda field: F.coalesce(_items("element", f"$.{field}"), F.array().cast("array<variant>"))
    inside = F.filter(F.concat(holds("value"), holds("statements")), lambda x: _string(x, "$.modelType").isNotNull())
    first = docs.select("doc_id", F.try_variant_get("body", "$.submodels[0]", "variant").alias("submodel"))
    none = F.lit(None).cast("string")
    level = first.select(
        "doc_id", _joined(_keys("submodel", "$.semanticId.keys"), normal_identifier).alias("template"), F.array().cast("array<int>").alias("parent"), none.alias("parent_kind"), none.alias("parent_sid"),
        F.array().cast("array<string>").alias("above"), F.posexplode(_items("submodel", "$.submodelElements")).alias("at", "element"),
    )
    out = None
    while True:
        keys = _keys("element", "$.semanticId.keys")
        kind, raw = _string("element", "$.modelType"), _joined(keys)
        level = level.where(~F.array_contains(marked, _joined(keys, normal_identifier)) & kind.isNotNull())
        supplemental = F.flatten(F.transform(F.coalesce(_items("element", "$.supplementalSemanticIds"), F.array().cast("array<variant>")), lambda r: _spellings(_keys(r, "$.keys"))))
        short, above = _string("element", "$.idShort"), F.coalesce(F.get("above", F.lit(0)), F.lit(""))
        item = F.concat(above, F.lit("Item"))
        label = F.coalesce(F.when(short != "", short), F.coalesce(F.try_element_at(names, above), item) if names is not None else item)
        counted = [_qualifier(name) for name in COUNT_TYPES]
        level = written(level.select(
            "doc_id", "template", "parent", "above", "element", F.concat("parent", F.array("at")).alias("path"), kind.alias("kind"), raw.alias("raw"), label.alias("label"), short.alias("id_short"),
            F.nullif(_joined(keys, normal_identifier), F.lit("")).alias("sid"), F.array_sort(F.array_except(F.array_union(_spellings(keys), supplemental), marked)).alias("match"),
            ((raw != "") & raw.eqNullSafe(F.col("parent_sid")) & kind.eqNullSafe(F.col("parent_kind")) & kind.isin(*NESTING) & (F.size(inside) == 0)).alias("copies"),
            (F.col("parent_kind") == "SubmodelElementList").eqNullSafe(True).alias("in_list"), F.coalesce(*counted).alias("count"), F.coalesce(*[F.when(q.isNotNull(), F.lit(n)) for q, n in zip(counted, COUNT_TYPES)]).alias("count_type"),
            _string("element", "$.valueType").alias("value_type"), _string("element", "$.typeValueListElement").alias("list_type"), _string("element", "$.semanticId.type").alias("sid_type"),
            _qualifier("AllowedIdShort").alias("allowed"),
        ))
        out = level.drop("element") if out is None else out.union(level.drop("element"))
        level = level.select("doc_id", "template", F.col("path").alias("parent"), F.col("kind").alias("parent_kind"), F.col("raw").alias("parent_sid"), F.concat(F.array("label"), "above").alias("above"), F.posexplode(inside).alias("at", "element"))
        if level.isEmpty():
            return out


def told_apart(rows: DataFrame) -> DataFrame:
    """rows (doc_id, label, above and others) with `shown`: the label, and behind it, where rows share it, as many of the nearest
    ancestors as tell all of them apart (all ancestors where none do)."""
    shared = rows.groupBy("doc_id", "label").agg(F.count("*").alias("n"), F.max(F.size("above")).alias("deepest"))
    alone = rows.join(shared.where("n = 1"), ["doc_id", "label"]).withColumn("shown", F.col("label"))
    still, out, k = written(rows.join(shared.where("n > 1"), ["doc_id", "label"])), alone, 1
    while not still.isEmpty():
        suffix = F.array_join(F.reverse(F.slice("above", F.lit(1), F.lit(k))), "/")
        groups = still.groupBy("doc_id", "label").agg((F.count_distinct(suffix) == F.first("n")).alias("apart"))
        judged = written(still.join(groups, ["doc_id", "label"]).withColumn("settled", F.col("apart") | (F.col("deepest") <= k)))
        shown = F.when(suffix == "", F.col("label")).otherwise(F.concat("label", F.lit(" ("), suffix, F.lit(")")))
        out = out.unionByName(judged.where("settled").drop("apart", "settled").withColumn("shown", shown))
        still, k = judged.where("not settled").drop("apart", "settled"), k + 1
    return out.drop("n", "deepest")


def build(docs: DataFrame, *, prefix: str = "TPL-E", markers: tuple[str, ...] = MARKERS, item_names: dict[str, str] | None = None, most: int = MOST_ROWS) -> tuple[DataFrame, DataFrame]:
    """(rows, refusals) of template documents (doc_id, body as a variant). rows: doc_id, what a walk takes (COLUMNS), allowed (the
    pattern of names), unreadable (is there one that can't be read?), sid_type, count_type (the qualifier that said how many),
    unidentified, endless (the number that a copy asked for in vain). refusals: doc_id, message. `item_names` names unnamed items
    by the label of what holds them, which is otherwise followed by Item."""
    elements = written(_elements(docs, markers, item_names or {}))
    size = elements.groupBy("doc_id").agg(F.count("*").alias("n_rows"))
    submodel = F.try_variant_get("body", "$.submodels[0]", "variant")
    judged = docs.join(size, "doc_id", "left").withColumn("submodel", submodel)
    empty = F.coalesce(F.size(_items("submodel", "$.submodelElements")), F.lit(0)) <= 0
    message = F.when(F.col("submodel").isNull(), "no submodels, so there is no template in it").when((F.size(_keys("submodel", "$.semanticId.keys")) == 0) | empty, "the first submodel declares no semanticId or no elements").when(F.col("n_rows") > most, F.concat(F.lit("more than "), F.lit(f"{most} rows")))
    refused = judged.select("doc_id", message.alias("message")).where("message is not null")
    named = written(told_apart(elements.join(refused.select("doc_id"), "doc_id", "left_anti")))
    twice = named.groupBy("doc_id", "shown").agg(F.count("*").alias("n")).where("n > 1")
    repeated = twice.groupBy("doc_id").agg(F.min("shown").alias("first"), F.count("*").alias("n"))
    repeated = repeated.select("doc_id", F.concat(F.lit("two rows share a label ("), "first", F.when(F.col("n") > 1, F.concat(F.lit(" and "), (F.col("n") - 1).cast("string"), F.lit(" more"))).otherwise(""), F.lit(")")).alias("message"))
    refused = written(refused.union(repeated))
    named = named.join(repeated.select("doc_id"), "doc_id", "left_anti")
    # A template has `most` rows at most, so one document's order is a bounded window.
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("path"))
    row_id = F.concat(F.lit(prefix), F.lpad(number.cast("string"), 2, "0"))
    numbered = named.withColumn("row_id", F.when(number > 99, F.concat(F.lit(prefix), number.cast("string"))).otherwise(row_id))
    numbered = written(numbered)
    parents = numbered.select("doc_id", F.col("path").alias("parent"), F.col("row_id").alias("parent_id"))
    rows = numbered.join(parents, ["doc_id", "parent"], "left")
    bound = lambda i: F.coalesce(*[F.when(F.col("count") == word, F.lit(n[i]).cast("int")) for word, n in COUNTS.items()], F.lit((0, None)[i]).cast("int"))
    unidentified = (F.size("match") == 0) & ~F.col("in_list")
    endless = F.when(F.col("copies") & (bound(0) > 0), bound(0))
    low = F.when(unidentified | endless.isNotNull(), 0).otherwise(bound(0))
    high = F.when(~unidentified, bound(1))
    allowed = F.when(F.col("allowed").isNotNull(), name_pattern(F.col("allowed"), F.col("id_short")))
    rows = rows.select(
        "doc_id", "template", "row_id", F.element_at("path", -1).alias("row_ord"), "parent_id", F.when(F.col("copies"), F.col("parent_id")).alias("scope_id"), F.col("shown").alias("label"), "kind", "sid", "match",
        low.alias("low"), high.alias("high"), "value_type", "list_type", allowed.alias("allowed"), (F.col("allowed").isNotNull() & allowed.isNull()).alias("unreadable"), "sid_type", "count_type", unidentified.alias("unidentified"), endless.alias("endless"),
    )
    return rows, refused
