"""Rows that a published reading of the law expects though a template leaves them optional, and documents that lack them.

Four tables meet: elements of templates, how sources read them, what those sources say of each category, and the provisions
that they cite. A category's verdict is settled from all sources that state one (see reports.settled). What a submodel carries
counts at any depth, by any of an element's identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.operators import detect, reports
from vellum.operators.walk import _small

#: Fixed value: how an annex's numbered provision is cited.
PROVISION = r"(?i)Annex\s+(IV|VII)\s+Part\s+([AB])\s*\(\s*(\d+)\s*\)"


def expected_rows(elements: DataFrame, readings: DataFrame, verdicts: DataFrame, citations: DataFrame, provisions: DataFrame) -> DataFrame:
    """elements: element, anchor, identifier, id_short, cardinality. readings: element, source, reading. verdicts: source, category,
    verdict. citations: source, nth, reference. provisions: key, section, condition, reading. As element, anchor, identifier,
    id_short, categories (map of category to verdict), unconditional (is every verdict that is stated a requirement?), mandatory
    (sources that read it as required, sorted), citations (sorted), conditions (sections with their conditions, sorted).

    Elements that the template leaves optional only (ZeroToOne), and of them those that a source other than a template reads as
    required or conditional."""
    optional = elements.where("cardinality = 'ZeroToOne'").select("element", "anchor", "identifier", "id_short")
    spoken = readings.where("reading in ('yes', 'conditional') and source not like 'template(%'").join(optional.select("element"), "element", "left_semi")
    stated = spoken.join(verdicts, "source").select("element", "category", "verdict")
    settled = reports.settled(stated, ["element", "category"], "verdict").where("verdict is not null")
    by_category = settled.groupBy("element").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "verdict")))).alias("categories"), F.bool_and(F.col("verdict").isin(*reports.REQUIRED)).alias("unconditional"))
    said = spoken.groupBy("element").agg(F.array_sort(F.collect_set(F.when(F.col("reading") == "yes", F.col("source")))).alias("mandatory"))
    cited = spoken.join(citations, "source").select("element", F.regexp_replace("reference", r"^BR\s+", "").alias("reference")).distinct()
    found = F.transform(F.regexp_extract_all("reference", F.lit(PROVISION), F.lit(0)), lambda x: F.lower(F.concat(F.lit("annex-"), F.regexp_extract(x, PROVISION, 1), F.lit("-"), F.regexp_extract(x, PROVISION, 2), F.lit(":"), F.regexp_extract(x, PROVISION, 3))))
    conditional = _small(provisions.where("reading = 'conditional'").select("key", F.struct("section", "condition").alias("condition")))
    conditions = cited.select("element", F.explode(found).alias("key")).join(conditional, "key").groupBy("element").agg(F.array_sort(F.collect_set("condition")).alias("conditions"))
    listed = cited.groupBy("element").agg(F.array_sort(F.collect_set("reference")).alias("citations"))
    out = optional.join(said, "element").join(by_category, "element", "left").join(listed, "element", "left").join(conditions, "element", "left")
    return out.withColumn("unconditional", F.coalesce("unconditional", F.lit(False)))


def absent(rows: DataFrame, submodels: DataFrame, elements: DataFrame, categories: DataFrame) -> DataFrame:
    """doc_id, sm_ord, element, id_short, category: expected rows whose identifier no element of a submodel with their anchor carries,
    at any depth. A row is asked of a document if all categories require it, or the document's does (categories: doc_id, category)."""
    law = _small(rows.select("element", "anchor", "identifier", "id_short", "categories", "unconditional"))
    declared = detect.instances(submodels).select("doc_id", "sm_ord", F.explode("main_values").alias("anchor")).distinct()
    asked = declared.join(law, "anchor").join(categories, "doc_id", "left")
    required = F.coalesce(F.try_element_at("categories", F.col("category")).isin(*reports.REQUIRED), F.lit(False))
    asked = asked.where(F.col("unconditional") | required).select("doc_id", "sm_ord", "element", "identifier", "id_short", "category")
    # Only identifiers of the law leave the elements.
    wanted = _small(rows.select("identifier").distinct())
    carried = elements.select("doc_id", "sm_ord", F.explode("all_values").alias("identifier")).join(wanted, "identifier", "left_semi").distinct()
    return asked.join(carried, ["doc_id", "sm_ord", "identifier"], "left_anti").drop("identifier")
