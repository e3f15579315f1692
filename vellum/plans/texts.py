"""Registered queries on names, tags, references and lists of values."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import lexical as L
from vellum.operators import conformance as C
from vellum.plans.registry import query, t


@query("""SELECT p_partkey, split_part(label, ' (', 1) AS id_short FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_type WHEN 1 THEN p_type || ' (' || p_brand || ')' ELSE p_type || '(x) (' || p_brand || ' (y))' END AS label FROM part)""")
def id_shorts(spark, d):
    k = F.col("p_partkey") % 3
    label = F.when(k == 0, F.col("p_type")).when(k == 1, F.concat("p_type", F.lit(" ("), "p_brand", F.lit(")"))).otherwise(F.concat("p_type", F.lit("(x) ("), "p_brand", F.lit(" (y))")))
    return t(spark, d, "part").select("p_partkey", L.id_short_of(label).alias("id_short"))


@query(r"""SELECT page_id, array_to_string(list_sort(list_distinct(list_filter(string_split(v, ''), lambda x: ascii(x) < 128 AND NOT regexp_matches(x, '[A-Za-z0-9._~!$&''()*+,;=:@%/-]')))), '') AS illegal
FROM (SELECT page_id, url || CASE page_id % 3 WHEN 0 THEN ' a<b>é' WHEN 1 THEN '"\^' || chr(9) ELSE '' END AS v FROM pages)""")
def illegal_characters(spark, d):
    k = F.col("page_id") % 3
    v = F.concat("url", F.when(k == 0, " a<b>é").when(k == 1, '"\\^\t').otherwise(""))
    return t(spark, d, "pages").select("page_id", F.array_join(L.illegal_in_a_segment(v), "").alias("illegal"))


@query("""SELECT p_partkey, w[1] || array_to_string(list_transform(w[2:], lambda p: upper(p[1]) || p[2:]), '') AS camel FROM (SELECT p_partkey, string_split(lower(p_type) || '_' || replace(p_name, ' ', '_') || '__x', '_') AS w FROM part)""")
def camel_names(spark, d):
    name = F.concat(F.lower("p_type"), F.lit("_"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("__x"))
    return t(spark, d, "part").select("p_partkey", L.spelt(name).alias("camel"))


@query("""SELECT doc_id, coalesce(tag, '-') AS tag, coalesce(lower(tag) = 'en' OR lower(tag) LIKE 'en-%', false) AS english FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN lang WHEN 1 THEN upper(lang) || '-US' WHEN 2 THEN lang || 'x' WHEN 3 THEN lang || '-' END AS tag FROM documents)""")
def english_tags(spark, d):
    k = F.col("doc_id") % 5
    tag = F.when(k == 0, F.col("lang")).when(k == 1, F.concat(F.upper("lang"), F.lit("-US"))).when(k == 2, F.concat("lang", F.lit("x"))).when(k == 3, F.concat("lang", F.lit("-")))
    return t(spark, d, "documents").select("doc_id", F.coalesce(tag, F.lit("-")).alias("tag"), L.is_english(tag).alias("english"))


@query("""SELECT p_partkey, array_to_string(list_filter(list_transform(string_split_regex(p_name || ';  ' || p_type || chr(10) || ' ;;' || p_brand || ' ', '[\\n;]+'), lambda x: trim(x)), lambda x: x <> ''), '|') AS refs FROM part""")
def split_references(spark, d):
    text = F.concat("p_name", F.lit(";  "), "p_type", F.lit("\n ;;"), "p_brand", F.lit(" "))
    return t(spark, d, "part").select("p_partkey", F.array_join(L.split_references(text), "|").alias("refs"))


@query(r"""SELECT page_id, array_to_string(p[greatest(len(p) - 2, 1):], '/') AS last_three FROM (SELECT page_id, list_filter(string_split_regex(url || '\x//y', '[/\\]'), lambda x: x <> '') AS p FROM pages)""")
def path_tails(spark, d):
    return t(spark, d, "pages").select("page_id", L.last_components(F.concat("url", F.lit("\\x//y")), 3).alias("last_three"))


@query(r"""SELECT page_id, regexp_matches(v, '^[A-Za-z][A-Za-z0-9+.-]*:') AS absolute FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN 'c:' || url WHEN 2 THEN '//' || url WHEN 3 THEN '1' || url ELSE split_part(url, '://', 2) END AS v FROM pages)""")
def absolute_uris(spark, d):
    k = F.col("page_id") % 5
    v = F.when(k == 0, F.col("url")).when(k == 1, F.concat(F.lit("c:"), "url")).when(k == 2, F.concat(F.lit("//"), "url")).when(k == 3, F.concat(F.lit("1"), "url")).otherwise(F.split_part("url", F.lit("://"), F.lit(2)))
    return t(spark, d, "pages").select("page_id", L.is_absolute(v).alias("absolute"))


@query("""WITH g AS (SELECT o_orderkey, list('''' || l_returnflag || l_linenumber || '''' ORDER BY l_linenumber, l_returnflag) FILTER (l_orderkey IS NOT NULL) AS v FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
SELECT o_orderkey, CASE WHEN v IS NULL THEN 'absent' ELSE array_to_string(v[:5], ', ') || CASE WHEN len(v) > 5 THEN ' and ' || (len(v) - 5) || ' more' ELSE '' END END AS shown FROM g""")
def listed_values(spark, d):
    lines = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag"))), lambda x: F.concat(x["l_returnflag"], x["l_linenumber"].cast("string"))).alias("v"))
    both = t(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return both.select("o_orderkey", L.shown_values(F.col("v")).alias("shown"))


@query("""SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ') || [p_brand]) AS word FROM part) GROUP BY word""")
def tally_lists(spark, d):
    words = F.explode(F.concat(F.split("p_name", " "), F.array("p_brand")))
    return t(spark, d, "part").select(words.alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query("""WITH x AS (SELECT DISTINCT l_suppkey, l_quantity * 10 AS q FROM lineitem), m AS (SELECT *, coalesce(q - lag(q) OVER (PARTITION BY l_suppkey ORDER BY q) > 15, true) AS b FROM x),
c AS (SELECT l_suppkey, q, sum(b::INTEGER) OVER (PARTITION BY l_suppkey ORDER BY q) AS cluster FROM m)
SELECT c.l_suppkey, cluster::BIGINT AS cluster, count(*) AS n, round(avg(c.q), 6) AS mean FROM c JOIN lineitem l ON l.l_suppkey = c.l_suppkey AND l.l_quantity * 10 = c.q GROUP BY 1, 2""")
def cluster_means(spark, d):
    rows = t(spark, d, "lineitem").select("l_suppkey", (F.col("l_quantity") * 10).alias("q"))
    return C.clusters(rows, "l_suppkey", "q", 15.0, mean=True).select("l_suppkey", "cluster", "n", F.round("mean", 6).alias("mean"))
