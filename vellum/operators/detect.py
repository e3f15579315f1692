"""Which tables judge a submodel, and why none does.

tables: name, nth (their order), anchor, origin: `supplied` (a caller's), `pack` (with a template) or `law` (judges without one);
hint (the name that such submodels go by, lower case). Submodels are those of `sources.environment`; templates among them are
never judged. A supplied table takes its anchor over: packs and law tables stand down, a pack where its own anchor is taken, a
law table for submodels that declare a taken one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions import lexical as L
from vellum.operators.walk import _small


def instances(submodels: DataFrame) -> DataFrame:
    return submodels.where("upper(model_kind) <> 'TEMPLATE'")


def answers(submodels: DataFrame, tables: DataFrame) -> DataFrame:
    """doc_id, sm_ord, name, origin: the tables that judge each submodel."""
    taken = _small(tables.where("origin = 'supplied'").select("anchor").distinct().withColumn("taken", F.lit(True)))
    known = _small(tables.select("name", "anchor", "origin"))
    declared = instances(submodels).select("doc_id", "sm_ord", F.explode("main_values").alias("anchor")).distinct()
    # One row a submodel that declares a taken anchor, whichever of its identifiers it is.
    standing = declared.join(taken, "anchor").select("doc_id", "sm_ord", F.lit(True).alias("replaced")).distinct()
    met = declared.join(known, "anchor").join(taken, "anchor", "left").join(standing, ["doc_id", "sm_ord"], "left")
    judges = (F.col("origin") == "supplied") | ((F.col("origin") == "pack") & F.col("taken").isNull()) | ((F.col("origin") == "law") & F.col("replaced").isNull())
    return met.where(judges).select("doc_id", "sm_ord", "name", "origin")


def counts(submodels: DataFrame, tables: DataFrame) -> DataFrame:
    """doc_id, n_submodels, n_templates, n_judged, of every document that has a submodel."""
    judged = answers(submodels, tables).select("doc_id", "sm_ord", F.lit(True).alias("judged")).distinct()
    all_ = submodels.select("doc_id", "sm_ord", (F.upper("model_kind") == "TEMPLATE").alias("template")).join(judged, ["doc_id", "sm_ord"], "left")
    return all_.groupBy("doc_id").agg(F.count("*").alias("n_submodels"), F.count_if("template").alias("n_templates"), F.count_if("judged").alias("n_judged"))


#: What a document that nothing judges looks like, and how far it is from being judged.
REASONS = {"version": 2, "samm version": 2, "name": 2, "other": None, "no identifier": 4}


def diagnosis(submodels: DataFrame, tables: DataFrame) -> DataFrame:
    """Of documents of which nothing is judged: doc_id, reason, grade, seen, table. The first submodel that is near a pack
    decides, by its first such identifier (another version of the pack's, before another SAMM version, before its name); else all
    identifiers are named, the first three in order."""
    found = instances(submodels)
    lost = found.select("doc_id").distinct().join(answers(submodels, tables).select("doc_id").distinct(), "doc_id", "left_anti")
    each = found.join(lost, "doc_id", "left_semi").select("doc_id", "sm_ord", "id_short", F.posexplode_outer(F.when(F.size("main_values") > 0, F.col("main_values"))).alias("at", "seen"))
    packs = _small(tables.where("origin <> 'law'").select("name", "nth", "anchor", "hint"))
    keyed = packs.withColumn("key", F.explode(F.array_compact(F.array(F.concat(F.lit("irdi "), L.version_stem(F.col("anchor"))), F.concat(F.lit("samm "), L.samm_stem(F.col("anchor")))))))
    keys = F.explode(F.array_compact(F.array(F.concat(F.lit("irdi "), L.version_stem(F.col("seen"))), F.concat(F.lit("samm "), L.samm_stem(F.col("seen"))))))
    near = each.withColumn("key", keys).join(keyed, "key").where("seen <> anchor")
    near = near.select("doc_id", "sm_ord", "at", "nth", F.when(F.col("key").startswith("irdi"), "version").otherwise("samm version").alias("reason"), "seen", F.col("name").alias("table"))
    alike = each.groupBy("doc_id", "sm_ord").agg(F.first("id_short").alias("id_short")).withColumn("hint", F.lower("id_short")).join(packs.where("hint is not null"), "hint")
    alike = alike.select("doc_id", "sm_ord", F.lit(1 << 30).alias("at"), "nth", F.lit("name").alias("reason"), F.col("id_short").alias("seen"), F.col("name").alias("table"))
    best = near.union(alike).groupBy("doc_id").agg(F.min(F.struct("sm_ord", "at", "nth", "reason", "seen", "table")).alias("x"))
    # Three identifiers of a document at most leave each task.
    rest = each.where("seen is not null").select("doc_id", "seen").distinct()
    three = rest.groupBy("doc_id").agg(F.slice(F.array_sort(F.collect_set("seen")), 1, 3).alias("three"))
    out = lost.join(best, "doc_id", "left").join(three, "doc_id", "left")
    reason = F.coalesce(F.col("x.reason"), F.when(F.col("three").isNotNull(), "other").otherwise("no identifier"))
    grade = F.coalesce(*[F.when(reason == r, F.lit(g).cast("int")) for r, g in REASONS.items()])
    return out.select("doc_id", reason.alias("reason"), grade.alias("grade"), F.coalesce("x.seen", F.array_join("three", ", ")).alias("seen"), F.col("x.table").alias("table"))
