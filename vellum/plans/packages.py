"""Registered queries on relationships of packages and on the tables that judge submodels."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.operators import detect as D
from vellum.operators import packages as P
from vellum.plans.registry import query, t


def order_packages(spark, d):
    """(relationships, entries) of each order as a package: its lines are spec parts, or what those hold beside."""
    lit, c = F.lit, F.col
    new, old = (lit(x) for x in P.TYPES)
    lines = t(spark, d, "lineitem").select(c("l_orderkey").alias("doc"), c("l_linenumber").alias("n"), "l_partkey", "l_suppkey").distinct()
    part = (c("l_partkey") % 5).cast("string")
    row = lambda source, nth, kind, target, external: F.struct(source.alias("source"), nth.cast("long").alias("nth"), kind.alias("type"), target.alias("target"), external.alias("external"))
    line = c("n") * 1000000 + c("l_partkey") * 10
    spec = row(lit("aasx/aasx-origin"), line, F.concat(F.when(c("n") % 2 == 0, new).otherwise(old), lit("aas-spec")), F.concat(F.when(c("n") % 3 == 0, "/aasx/spec/p").when(c("n") % 3 == 1, "spec/../spec/p").otherwise(" ./spec/P"), part, lit(".json")), lit(False))
    target = F.when(c("l_suppkey") % 4 == 0, F.concat(lit("https://x.org/"), part)).when(c("l_suppkey") % 4 == 1, F.concat(lit("../files/f%20"), part, lit(".pdf"))).when(c("l_suppkey") % 4 == 2, "../../../out.pdf").otherwise("/aasx/files/none.pdf")
    suppl = row(F.concat(lit("aasx/spec/p"), part, lit(".json")), line + 1, F.concat(new, lit("aas-suppl")), target, (c("l_suppkey") % 8 == 1))
    rels = lines.where(c("l_partkey") % 7 > 0).select("doc", F.explode(F.array(spec, suppl)).alias("x")).select("doc", "x.*")
    o = t(spark, d, "orders").select(c("o_orderkey").alias("doc"))
    k = c("doc") % 10
    kind = F.when(k < 7, F.concat(new, lit("aasx-origin"))).when(k == 7, F.concat(old, lit("aasx-origin"))).when(k == 8, "http://other.org/aasx-origin").otherwise("http://other.org/thumbnail")
    root = o.select("doc", F.explode(F.array(row(lit(""), lit(2), kind, lit("/aasx/aasx-origin"), lit(False)), row(lit(""), lit(1), lit("x"), lit("a.png"), lit(False)))).alias("x")).select("doc", "x.*")
    names = F.explode(F.array(*[F.concat(lit("aasx/spec/p"), lit(str(i)), lit(".json")) for i in range(4)], *[lit(f"aasx/files/f {i}.pdf") for i in range(3)], lit("aasx/aasx-origin")))
    return root.unionByName(rels), o.select("doc", names.alias("name")).withColumn("nth", F.xxhash64("name"))


PACKAGE_SQL = """WITH l AS (SELECT DISTINCT l_orderkey AS doc, l_linenumber AS n, l_partkey AS p, l_suppkey AS s FROM lineitem WHERE l_partkey % 7 > 0),
own AS (SELECT o_orderkey AS doc FROM orders WHERE o_orderkey % 10 < 8),
spec AS (SELECT doc, min(n * 1000000 + p * 10) AS nth, CASE WHEN n % 3 = 2 AND p % 5 > 3 THEN 'aasx/ ./spec/P' ELSE 'aasx/spec/p' END || (p % 5) || '.json' AS part, min(p % 5) < 4 AS held FROM l JOIN own USING (doc) GROUP BY doc, part),
sup AS (SELECT l.doc, n * 1000000 + p * 10 + 1 AS nth, 'aasx/spec/p' || (p % 5) || '.json' AS source, CASE s % 4 WHEN 0 THEN 'https://x.org/' || (p % 5) WHEN 1 THEN CASE WHEN s % 8 = 1 THEN '../files/f%20' || (p % 5) || '.pdf' ELSE 'aasx/files/f ' || (p % 5) || '.pdf' END
  WHEN 2 THEN '../../../out.pdf' ELSE 'aasx/files/none.pdf' END AS part, s % 4 <> 0 AND s % 8 <> 1 AS inside, s % 8 = 5 AND p % 5 < 3 AS held FROM l)
"""


@query(PACKAGE_SQL + """SELECT doc, 'origin' AS step, 2::BIGINT AS nth, '' AS source, 'aasx/aasx-origin' AS part, true AS inside, true AS held FROM own
UNION ALL SELECT doc, 'spec', nth, 'aasx/aasx-origin', part, true, held FROM spec
UNION ALL SELECT doc, 'suppl', nth, source, part, inside, held FROM sup WHERE EXISTS (SELECT 1 FROM spec WHERE spec.doc = sup.doc AND spec.part = sup.source)""")
def package_chain(spark, d):
    steps, _ = P.chain(*order_packages(spark, d))
    return steps.withColumnRenamed("to", "part")


@query(PACKAGE_SQL + """SELECT o_orderkey AS doc, CASE o_orderkey % 10 WHEN 8 THEN 'foreign origin' ELSE 'no origin' END AS why FROM orders WHERE o_orderkey % 10 > 7
UNION ALL SELECT doc, 'no spec' FROM own WHERE doc NOT IN (SELECT doc FROM spec)""")
def packages_refused(spark, d):
    return P.chain(*order_packages(spark, d))[1]


#: Tables that judge: packs, one of them taken over, a supplied one, and one that judges by law only.
TABLES = [("alpha", 1, "0173-1#01-AAA001#002", "pack", "alpha"), ("beta", 2, "urn:samm:io.x:1.0.0#Beta", "pack", "beta"), ("gamma", 3, "urn:gamma", "pack", "gamma"), ("mine", 4, "urn:gamma", "supplied", None), ("rule", 5, "urn:law", "law", None)]


def part_submodels(spark, d):
    """Parts as submodels of brands and sizes."""
    k, c = F.col("p_partkey") % 11, F.col
    ids = F.when(k == 0, F.array(F.lit("0173-1#01-AAA001#002"))).when(k == 1, F.array(F.lit("0173-1#01-AAA001#001"))).when(k == 2, F.array(F.lit("urn:samm:io.x:2.0.0#Beta"))).when(k == 3, F.array(F.lit("urn:gamma"), F.lit("urn:law")))
    ids = ids.when(k == 4, F.array(F.lit("urn:law"))).when(k.isin(5, 6), F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("urn:"), "p_type"), F.concat(F.lit("urn:"), "p_name")))
    name = F.when(k == 5, "Gamma").otherwise(c("p_name"))
    return t(spark, d, "part").select(F.floor(c("p_partkey") / 2).alias("doc_id"), (c("p_partkey") % 2).cast("int").alias("sm_ord"), name.alias("id_short"), F.when(c("p_size") > 40, "Template").otherwise("Instance").alias("model_kind"), ids.alias("main_values"))


DETECT_SQL = """WITH s AS (SELECT p_partkey // 2 AS doc_id, p_partkey % 2 AS sm_ord, p_partkey % 11 AS k, p_size > 40 AS template, p_type, p_name FROM part),
a AS (SELECT doc_id, sm_ord, name, origin FROM s JOIN (VALUES (0, 'alpha', 'pack'), (3, 'mine', 'supplied'), (4, 'rule', 'law')) v(k, name, origin) USING (k) WHERE NOT template)
"""


@query(DETECT_SQL + "SELECT doc_id, sm_ord::INTEGER AS sm_ord, name, origin FROM a")
def tables_that_answer(spark, d):
    return D.answers(part_submodels(spark, d), spark.createDataFrame(TABLES, "name string, nth int, anchor string, origin string, hint string"))


@query(DETECT_SQL + "SELECT doc_id, count(*) AS n_submodels, count(*) FILTER (template) AS n_templates, count(*) FILTER (NOT template AND k IN (0, 3, 4)) AS n_judged FROM s GROUP BY doc_id")
def judged_counts(spark, d):
    return D.counts(part_submodels(spark, d), spark.createDataFrame(TABLES, "name string, nth int, anchor string, origin string, hint string"))


@query(DETECT_SQL + """, l AS (SELECT * FROM s WHERE NOT template AND doc_id NOT IN (SELECT doc_id FROM a)),
b AS (SELECT doc_id, k FROM l WHERE k IN (1, 2, 5) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY sm_ord) = 1),
i AS (SELECT doc_id, array_to_string(list_sort(list(DISTINCT v))[:3], ', ') AS three FROM (SELECT doc_id, unnest(['urn:' || p_type, 'urn:' || p_name]) AS v FROM l WHERE k > 6) GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN b.k = 1 THEN 'version' WHEN b.k = 2 THEN 'samm version' WHEN b.k = 5 THEN 'name' WHEN three IS NOT NULL THEN 'other' ELSE 'no identifier' END AS reason,
CASE WHEN b.k IS NOT NULL THEN 2 WHEN three IS NULL THEN 4 END AS grade, CASE b.k WHEN 1 THEN '0173-1#01-AAA001#001' WHEN 2 THEN 'urn:samm:io.x:2.0.0#Beta' WHEN 5 THEN 'Gamma' ELSE three END AS seen,
CASE b.k WHEN 1 THEN 'alpha' WHEN 2 THEN 'beta' WHEN 5 THEN 'gamma' END AS "table" FROM (SELECT DISTINCT doc_id FROM l) d LEFT JOIN b USING (doc_id) LEFT JOIN i USING (doc_id)""")
def nothing_judged(spark, d):
    return D.diagnosis(part_submodels(spark, d), spark.createDataFrame(TABLES, "name string, nth int, anchor string, origin string, hint string"))
