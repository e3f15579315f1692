"""Registered queries on template documents: their rows, and names that a built template's patterns refuse."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.operators import walk as K
from vellum.plans.registry import query, t
from vellum.sources import environment as E
from vellum.sources import templates as T


def brand_templates(spark, d) -> DataFrame:
    """Each brand as a template document: its types hold colours, which hold things; some things are open places."""
    lit, c = F.lit, F.col
    word = lambda i: F.split_part("p_name", lit(" "), lit(i))
    things = t(spark, d, "part").groupBy("p_brand", "p_type", word(1).alias("colour"), word(2).alias("thing")).agg((F.min("p_size") % 4).alias("s"))
    ref = lambda v: F.concat(lit('"semanticId":{"type":"ExternalReference","keys":[{"type":"GlobalReference","value":"'), v, lit('"}]}'))
    sid = F.when((c("p_type") == "PROMO") & (c("s") == 1), T.MARKERS[0]).otherwise(F.concat(lit("urn:irdi:0173-1%2302-"), c("thing"), lit("%23001~2")))
    count = F.when(c("s") == 0, '[{"type":"SMT/Cardinality","value":"One"}]').when(c("s") == 2, '[{"type":"Cardinality","value":"ZeroToMany"},{"type":"Multiplicity","value":"ZeroToOne"}]').otherwise("[]")
    leaf = F.concat(lit('{"modelType":"Property","valueType":"xs:string","idShort":"'), c("thing"), lit('",'), ref(sid), lit(',"qualifiers":'), count, lit("}"))
    held = lambda df, keys, order, text: df.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(c(order).alias("o"), text.alias("x")))), lambda x: x["x"]), ",").alias("held"))
    box = lambda name: F.concat(lit('{"modelType":"SubmodelElementCollection","idShort":"'), c(name), lit('",'), ref(F.concat(lit("urn:x:"), c(name))), lit(',"value":['), c("held"), lit("]}"))
    colours = held(things, ["p_brand", "p_type", "colour"], "thing", leaf)
    types = held(colours, ["p_brand", "p_type"], "colour", box("colour"))
    text = F.concat(lit('{"submodels":[{"modelType":"Submodel",'), ref(F.concat(lit("urn:brand:"), c("p_brand"))), lit(',"submodelElements":['), c("held"), lit("]}]}"))
    return E.parse(held(types, ["p_brand"], "p_type", box("p_type")).select(c("p_brand").alias("doc_id"), text.alias("text")), "text")


@query("""WITH p AS (SELECT p_brand AS b, p_type AS ty, split_part(p_name, ' ', 1) AS co, split_part(p_name, ' ', 2) AS th, min(p_size) % 4 AS s FROM part GROUP BY ALL),
a AS (SELECT b, ty, NULL AS co, NULL AS th, NULL AS s, ty AS label, dense_rank() OVER (PARTITION BY b ORDER BY ty) - 1 AS row_ord FROM (SELECT DISTINCT b, ty FROM p)
  UNION ALL SELECT b, ty, co, NULL, NULL, co, dense_rank() OVER (PARTITION BY b, ty ORDER BY co) - 1 FROM (SELECT DISTINCT b, ty, co FROM p)
  UNION ALL SELECT b, ty, co, th, s, th, dense_rank() OVER (PARTITION BY b, ty, co ORDER BY th) - 1 FROM p),
k AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY ty, co NULLS FIRST, th NULLS FIRST) AS n FROM a WHERE th IS NULL OR NOT (ty = 'PROMO' AND s = 1)),
g AS (SELECT b, label, count(*) AS shared, count(DISTINCT co) AS colours FROM k GROUP BY b, label),
i AS (SELECT *, 'TPL-E' || CASE WHEN n < 10 THEN '0' ELSE '' END || n AS row_id FROM k JOIN g USING (b, label))
SELECT x.b AS doc_id, 'urn:brand:' || x.b AS template, x.row_id, x.row_ord::INTEGER AS row_ord, u.row_id AS parent_id,
x.label || CASE WHEN x.shared = 1 OR x.co IS NULL THEN '' WHEN x.th IS NULL THEN ' (' || x.ty || ')' WHEN x.colours = x.shared THEN ' (' || x.co || ')' ELSE ' (' || x.ty || '/' || x.co || ')' END AS label,
CASE WHEN x.th IS NULL THEN 'SubmodelElementCollection' ELSE 'Property' END AS kind,
CASE WHEN x.th IS NULL THEN 'urn:x:' || x.label ELSE '0173-1#02-' || x.th || '#001,0173-1#02-' || x.th || '#001~2' END AS match,
CASE WHEN x.s = 0 THEN 1 ELSE 0 END AS low, CASE WHEN x.s IN (0, 2) THEN 1 END AS high, CASE x.s WHEN 0 THEN 'SMT/Cardinality' WHEN 2 THEN 'Multiplicity' END AS count_type
FROM i x LEFT JOIN i u ON u.b = x.b AND u.ty = x.ty AND u.th IS NULL AND x.co IS NOT NULL AND CASE WHEN x.th IS NULL THEN u.co IS NULL ELSE u.co = x.co END""")
def template_rows(spark, d):
    rows, _ = T.build(brand_templates(spark, d))
    return rows.select("doc_id", "template", "row_id", "row_ord", "parent_id", "label", "kind", F.array_join("match", ",").alias("match"), "low", "high", "count_type")


def _reference(value: str) -> dict:
    return {"keys": [{"type": "GlobalReference", "value": value}]}


#: A template whose lines may be numbered.
NAMED = {"submodels": [{"modelType": "Submodel", "semanticId": _reference("urn:named"), "submodelElements": [
    {"modelType": "Property", "idShort": "Line", "semanticId": _reference("urn:line"), "qualifiers": [{"type": "AllowedIdShort", "value": r"Line[\d{2,3}]"}]},
    {"modelType": "Property", "idShort": "Other", "semanticId": _reference("urn:other"), "qualifiers": [{"type": "AllowedIdShort", "value": "O.K"}]},
]}]}


@query("""WITH l AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS pos,
CASE l_partkey % 6 WHEN 0 THEN 'Line' WHEN 1 THEN 'Line' || (10 + l_linenumber) WHEN 2 THEN 'Line' || l_linenumber WHEN 3 THEN 'Row' WHEN 4 THEN 'O.K' ELSE 'Other' END AS name, l_suppkey % 2 AS other FROM lineitem)
SELECT doc_id, pos::INTEGER AS pos, name AS id_short FROM l WHERE CASE other WHEN 0 THEN NOT regexp_full_match(name, 'Line([0-9]{2,3})?') ELSE name NOT IN ('O.K', 'Other') END""")
def name_drift(spark, d):
    k = F.col("l_partkey") % 6
    name = F.when(k == 0, "Line").when(k == 1, F.concat(F.lit("Line"), F.col("l_linenumber") + 10)).when(k == 2, F.concat(F.lit("Line"), "l_linenumber")).when(k == 3, "Row").when(k == 4, "O.K").otherwise("Other")
    sid = F.when(F.col("l_suppkey") % 2 == 0, "urn:line").otherwise("urn:other")
    line = F.struct(F.lit("Property").alias("modelType"), name.alias("idShort"), F.struct(F.array(F.struct(sid.alias("value"))).alias("keys")).alias("semanticId"))
    lines = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", line.alias("line")))), lambda x: x["line"]).alias("submodelElements"))
    sm = F.struct(F.lit("Submodel").alias("modelType"), F.struct(F.array(F.struct(F.lit("urn:named").alias("value"))).alias("keys")).alias("semanticId"), "submodelElements")
    found = E.submodels(E.parse(lines.select("doc_id", F.to_json(sm).alias("text")), "text"))
    rows, _ = T.build(E.parse(spark.createDataFrame([(0, json.dumps(NAMED))], "doc_id int, text string"), "text"))
    elements = E.elements(found)
    drift = K.name_drift(elements, K.claims(elements, found, rows.select(*T.COLUMNS)), rows)
    return drift.select("doc_id", F.element_at("path", -1).alias("pos"), "id_short")
