"""Template walk: elements of documents against the rows of templates, as joins over all documents at once.

Template rows: template (the anchor: the identifier of the submodels that it judges), row_id, row_ord (order in its scope),
parent_id (null: top level), scope_id (whose children this row's elements hold; null: its own; a row that holds copies of an
element above names that one), label, kind, sid (its own identifier, or null), match (identifiers that it takes), low, high
(null: no bound), value_type, list_type (null: any).

Elements and submodels: as `sources.environment` gives them. A submodel is judged by every template whose anchor is among its
main identifiers. A row's scopes are the elements of the right kind that the rows it hangs from claimed. Levels are walked
one after another: each is one equi-join of the level's elements with the rows of their scopes.

An element belongs to one row of its scope at most: the one whose own identifier is among the element's main ones, else the
first in order that shares any identifier with it, or, inside a list, that asks for its kind if it has no main identifier.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.sources.environment import cut

#: Templates of more rows in all are joined by shuffle.
BROADCAST_ROWS = 10_000
KEY = ["doc_id", "sm_ord", "template"]


def _small(template: DataFrame) -> DataFrame:
    return F.broadcast(template) if template.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else template


def judged(submodels: DataFrame, template: DataFrame) -> DataFrame:
    """Submodels (instances) with each template that they declare: doc_id, sm_ord, template."""
    anchors = template.select("template").distinct()
    named = submodels.where("upper(model_kind) <> 'TEMPLATE'").select("doc_id", "sm_ord", F.explode("main_values").alias("template"))
    return named.join(anchors, "template").select(*KEY).distinct()


def claims(elements: DataFrame, submodels: DataFrame, template: DataFrame) -> DataFrame:
    """Each claimed element: doc_id, sm_ord, template, path, parent, row_id, fits (is its kind the row's?)."""
    rows = template.select("template", "row_id", "row_ord", F.col("parent_id").alias("scope_row"), "kind", "sid", "match", F.coalesce("scope_id", "row_id").alias("inner"))
    by_id = _small(rows.withColumn("value", F.explode("match")))
    by_kind = _small(rows)
    scopes = judged(submodels, template).select(*KEY, F.array().cast("array<int>").alias("parent"), F.lit(None).cast(dict(template.dtypes)["row_id"]).alias("scope_row"))
    out, depth = None, 1
    deepest = elements.agg(F.max("depth")).first()[0] or 0
    columns = [*KEY, "path", "parent", "element_kind", "main_values", "scope_row"]
    while depth <= deepest and (depth == 1 or not scopes.isEmpty()):
        here = elements.where(F.col("depth") == depth).join(scopes, ["doc_id", "sm_ord", "parent"]).withColumnRenamed("kind", "element_kind")
        same = lambda r: (F.col("e.template") == F.col(f"{r}.template")) & F.col("e.scope_row").eqNullSafe(F.col(f"{r}.scope_row"))
        of = lambda r: [*[F.col(f"e.{c}") for c in columns], *[F.col(f"{r}.{c}") for c in ("row_id", "row_ord", "kind", "sid", "match", "inner")]]
        valued = here.withColumn("value", F.explode("all_values")).alias("e")
        met = valued.join(by_id.alias("r"), same("r") & (F.col("e.value") == F.col("r.value"))).select(*of("r"))
        bare = here.where(F.col("in_list") & (F.size("main_values") == 0)).alias("e")
        met = met.union(bare.join(by_kind.alias("r"), same("r") & (F.col("e.element_kind") == F.col("r.kind"))).select(*of("r")))
        owned = F.coalesce(F.array_contains("main_values", F.col("sid")) & F.array_contains("match", F.col("sid")), F.lit(False))
        best = met.groupBy(*KEY, "path", "parent").agg(F.min(F.struct((~owned).alias("foreign"), "row_ord", "row_id", (F.col("element_kind") == F.col("kind")).alias("fits"), "inner")).alias("x"))
        claimed = cut(best.select(*KEY, "path", "parent", "x.row_id", "x.fits", "x.inner"))
        out = claimed if out is None else out.union(claimed)
        scopes = claimed.where("fits").select(*KEY, F.col("path").alias("parent"), F.col("inner").alias("scope_row"))
        depth += 1
    empty = scopes.select(*KEY, F.col("parent").alias("path"), "parent", F.col("scope_row").alias("row_id"), F.lit(True).alias("fits"), F.col("scope_row").alias("inner")).limit(0)
    return out if out is not None else empty


def _bounds() -> F.Column:
    low, high = F.coalesce("low", F.lit(0)), F.col("high")
    return F.when((low == 1) & (high == 1), "exactly one").when((low == 0) & (high == 1), "at most one").when((low == 1) & high.isNull(), "one or more").otherwise(F.concat(low.cast("string"), F.lit(" to "), F.coalesce(high.cast("string"), F.lit("any"))))


def findings(elements: DataFrame, submodels: DataFrame, template: DataFrame, claimed: DataFrame | None = None) -> DataFrame:
    """doc_id, sm_ord, template, path (of the scope for counts, else of the element), row_id, check (count, kind, list type,
    value type or value), message. A wrong count doesn't silence the rest; a wrong kind is judged no further."""
    claimed = cut(claims(elements, submodels, template)) if claimed is None else claimed
    rows = _small(template.select("template", F.col("row_id"), F.col("parent_id").alias("scope_row"), "label", F.col("kind").alias("wanted"), "low", "high", F.col("value_type").alias("wanted_type"), "list_type"))
    top = judged(submodels, template).select(*KEY, F.array().cast("array<int>").alias("scope"))
    top = top.join(rows.where("scope_row is null").drop("scope_row"), "template")
    inner = claimed.where("fits").select(*KEY, F.col("path").alias("scope"), F.col("inner").alias("scope_row")).join(rows.where("scope_row is not null"), ["template", "scope_row"]).drop("scope_row")
    counts = claimed.groupBy(*KEY, F.col("parent").alias("scope"), "row_id").agg(F.count("*").alias("n"))
    asked = top.unionByName(inner).join(counts, [*KEY, "scope", "row_id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    wrong = asked.where((F.col("n") < F.coalesce("low", F.lit(0))) | (F.col("n") > F.col("high")))
    message = F.concat(F.lit("the template expects "), _bounds(), F.lit(" '"), F.col("label"), F.lit("' here; found "), F.col("n").cast("string"))
    count = wrong.select(*KEY, F.col("scope").alias("path"), "row_id", F.lit("count").alias("check"), message.alias("message"))

    about = elements.select("doc_id", "sm_ord", "path", F.col("kind").alias("element_kind"), "value", "value_type", F.col("list_type").alias("declared"))
    each = claimed.select(*KEY, "path", "row_id", "fits").join(about, ["doc_id", "sm_ord", "path"]).join(rows.drop("scope_row"), ["template", "row_id"])
    label, is_list = F.concat(F.lit("'"), F.col("label"), F.lit("'")), F.col("list_type").isNotNull() & ~F.col("list_type").eqNullSafe(F.col("declared"))
    checks = F.array_compact(F.array(
        F.when(~F.col("fits"), F.struct(F.lit("kind").alias("check"), F.concat(label, F.lit(" must be a "), "wanted").alias("message"))),
        F.when(F.col("fits") & is_list, F.struct(F.lit("list type").alias("check"), F.concat(label, F.lit(" is declared to hold "), F.coalesce("declared", F.lit("nothing")), F.lit("; the template holds "), "list_type").alias("message"))),
        F.when(F.col("fits") & F.col("wanted_type").isNotNull() & ~F.col("wanted_type").eqNullSafe(F.col("value_type")), F.struct(F.lit("value type").alias("check"), F.concat(label, F.lit(" must carry valueType "), "wanted_type").alias("message"))),
        F.when(F.col("fits") & (F.col("low") >= 1) & (F.col("wanted") == "Property") & F.col("value").isNull(), F.struct(F.lit("value").alias("check"), F.concat(label, F.lit(" is required here and carries no value")).alias("message"))),
    ))
    other = each.select(*KEY, "path", "row_id", F.explode(checks).alias("x")).select(*KEY, "path", "row_id", "x.check", "x.message")
    return count.unionByName(other)


def not_examined(elements: DataFrame, submodels: DataFrame, template: DataFrame) -> DataFrame:
    """Rows that were asked in no scope of a judged submodel: doc_id, sm_ord, template, row_id."""
    claimed = claims(elements, submodels, template)
    every = judged(submodels, template).join(_small(template.select("template", "row_id", "parent_id")), "template")
    asked = claimed.where("fits").select(*KEY, F.col("inner").alias("parent_id")).distinct()
    return every.where("parent_id is not null").join(asked, [*KEY, "parent_id"], "left_anti").select(*KEY, "row_id")


def in_order(found: DataFrame) -> DataFrame:
    """findings with nth, their reading order within a document: submodel, place, row, check, message."""
    return found.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id").orderBy("sm_ord", "path", "row_id", "check", "message")))


def name_drift(elements: DataFrame, claimed: DataFrame, template: DataFrame) -> DataFrame:
    """Claimed elements of the right kind whose name their row's pattern (template column `allowed`) doesn't match: KEY, path,
    id_short, allowed, in_list (inside a list a name is to be removed, elsewhere changed). Elements without a name drift from none."""
    rows = _small(template.where("allowed is not null").select("template", "row_id", "allowed"))
    named = elements.where("id_short <> ''").select("doc_id", "sm_ord", "path", "id_short", "in_list")
    met = claimed.where("fits").join(rows, ["template", "row_id"]).join(named, ["doc_id", "sm_ord", "path"])
    return met.where(~F.regexp_like("id_short", F.col("allowed"))).select(*KEY, "path", "id_short", "allowed", "in_list")


def resolved(references: DataFrame, elements: DataFrame) -> DataFrame:
    """Where references lead: doc_id, sm_ord, ref_id, path (null: nowhere). references: doc_id, sm_ord, ref_id, keys (an array of
    strings, below the submodel).

    All open references advance one key a round: to the first child of that name, or, in a list, at that position, whatever name
    the child has. Collections and lists are entered only; a reference without keys leads nowhere."""
    key = ["doc_id", "sm_ord", "ref_id"]
    level = cut(references.select(*key, "keys", F.lit(1).alias("k"), F.array().cast("array<int>").alias("at")).where(F.size("keys") > 0))
    by_name = elements.where("id_short is not null").select("doc_id", "sm_ord", F.col("parent").alias("at"), F.col("id_short").alias("step"), "path", "kind")
    by_place = elements.where("in_list").select("doc_id", "sm_ord", F.col("parent").alias("at"), F.element_at("path", -1).cast("string").alias("step"), "path", "kind")
    steps = by_name.union(by_place).groupBy("doc_id", "sm_ord", "at", "step").agg(F.min(F.struct("path", "kind")).alias("x"))
    steps, out = cut(steps), None
    while not level.isEmpty():
        met = level.withColumn("step", F.element_at("keys", F.col("k"))).join(steps, ["doc_id", "sm_ord", "at", "step"])
        met = cut(met.select(*key, "keys", F.col("k"), F.col("x.path").alias("path"), F.col("x.kind").alias("kind")))
        found = met.where(F.col("k") == F.size("keys")).select(*key, "path")
        out = found if out is None else out.union(found)
        more = (F.col("k") < F.size("keys")) & F.col("kind").isin("SubmodelElementCollection", "SubmodelElementList")
        level = met.where(more).select(*key, "keys", (F.col("k") + 1).alias("k"), F.col("path").alias("at"))
    rest = references.select(*key)
    return rest.join(out, key, "left") if out is not None else rest.withColumn("path", F.lit(None).cast("array<int>"))
