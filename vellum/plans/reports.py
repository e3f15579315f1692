"""Registered queries over packages, findings and readings, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import lexical as L
from vellum.operators import packages as P
from vellum.operators import reports as R
from vellum.plans.registry import query, t


def chosen(number, *forms):
    """One of several columns by a number's remainder."""
    out = forms[-1]
    for i in reversed(range(len(forms) - 1)):
        out = F.when(number % len(forms) == i, forms[i]).otherwise(out)
    return out


def package_entries(spark, d):
    """Packages of parts: entries whose names are spelt in several ways."""
    key, size = F.col("p_partkey"), F.col("p_size").cast("string")
    spelt = lambda before, after=".pdf": F.concat(F.lit(before), size, F.lit(after))
    name = chosen(key, spelt("aasx/f"), spelt("aasx/./F"), spelt("aasx\\f"), spelt("aasx/f%20"), spelt(" aasx/f"))
    return t(spark, d, "part").select((key % 40).alias("doc"), key.alias("nth"), name.alias("name"), F.col("p_size").alias("size"), (key % 2).alias("crc"))


def package_values(spark, d):
    key, size = F.col("p_partkey"), (F.col("p_size") + 1).cast("string")
    spelt = lambda before, after=".pdf": F.concat(F.lit(before), size, F.lit(after))
    value = chosen(key, spelt("/aasx/f"), spelt("AASX/f"), spelt("aasx/f "), spelt(" aasx/f"), spelt("/aasx//f"), spelt("aasx/f%20"), F.lit(None).cast("string"), spelt("other/F"), spelt("aasx/", "/"))
    return t(spark, d, "part").select((key % 40).alias("doc"), value.alias("value"))


PACKAGES = r"""e AS (SELECT p_partkey % 40 AS doc, p_partkey AS nth, p_size AS size, p_partkey % 2 AS crc, CASE p_partkey % 5 WHEN 0 THEN 'aasx/f' || p_size WHEN 1 THEN 'aasx/./F' || p_size
WHEN 2 THEN 'aasx\f' || p_size WHEN 3 THEN 'aasx/f%20' || p_size ELSE ' aasx/f' || p_size END || '.pdf' AS name FROM part),
v AS (SELECT DISTINCT p_partkey % 40 AS doc, CASE p_partkey % 9 WHEN 0 THEN '/aasx/f' || (p_size + 1) || '.pdf' WHEN 1 THEN 'AASX/f' || (p_size + 1) || '.pdf' WHEN 2 THEN 'aasx/f ' || (p_size + 1) || '.pdf'
WHEN 3 THEN ' aasx/f' || (p_size + 1) || '.pdf' WHEN 4 THEN '/aasx//f' || (p_size + 1) || '.pdf' WHEN 5 THEN 'aasx/f%20' || (p_size + 1) || '.pdf' WHEN 6 THEN NULL
WHEN 7 THEN 'other/F' || (p_size + 1) || '.pdf' ELSE 'aasx/' || (p_size + 1) || '/' END AS value FROM part)"""


def sql_part(x: str) -> str:
    """A part's resolved name in SQL, for the spellings above (no steps up)."""
    return f"CASE WHEN NOT ends_with({x}, '/') THEN array_to_string(list_filter(string_split(replace(replace({x}, '\\', '/'), '%20', ' '), '/'), lambda s: s <> '' AND s <> '.'), '/') END"


@query(f"""WITH {PACKAGES},
ek AS (SELECT doc, nth, name, 'name' AS kind, name AS key FROM e UNION ALL SELECT doc, nth, name, 'part', {sql_part('name')} FROM e UNION ALL SELECT doc, nth, name, 'folded', lower({sql_part('name')}) FROM e),
vk AS (SELECT doc, value, 0 AS p, 'name' AS kind, value AS key FROM v UNION ALL SELECT doc, value, 1, 'name', ltrim(value, '/') FROM v UNION ALL SELECT doc, value, 2, 'name', trim(value) FROM v
UNION ALL SELECT doc, value, 3, 'name', ltrim(trim(value), '/') FROM v UNION ALL SELECT doc, value, 4, 'name', {sql_part('trim(value)')} FROM v UNION ALL SELECT doc, value, 5, 'part', {sql_part('trim(value)')} FROM v
UNION ALL SELECT doc, value, 6, 'folded', lower({sql_part('trim(value)')}) FROM v),
m AS (SELECT vk.doc, vk.value, ek.name AS entry, row_number() OVER (PARTITION BY vk.doc, vk.value ORDER BY p, nth) AS n FROM vk JOIN ek ON ek.doc = vk.doc AND ek.kind = vk.kind AND ek.key = vk.key)
SELECT v.doc, v.value, m.entry FROM v LEFT JOIN m ON m.doc = v.doc AND m.value = v.value AND m.n = 1""")
def part_join(spark, d):
    return P.resolved(package_values(spark, d), package_entries(spark, d))


@query(f"""WITH {PACKAGES}, f AS (SELECT doc, lower(regexp_extract(replace(trim(name), '%20', ' '), '([^/\\\\]*)$', 1)) AS file, * EXCLUDE (doc) FROM e),
g AS (SELECT doc, file, count(*) AS n, count(DISTINCT size || ' ' || crc) = 1 AS alike, arg_min(name, nth) AS first FROM f GROUP BY 1, 2)
SELECT v.doc, v.value, g.n, g.alike, g.first FROM v JOIN g ON g.doc = v.doc AND g.file = lower(regexp_extract(replace(trim(value), '%20', ' '), '([^/\\\\]*)$', 1))""")
def part_carrying(spark, d):
    return P.carrying(package_values(spark, d), package_entries(spark, d))


SEVERITIES = " ".join(f"WHEN '{word}' THEN '{grade}'" for word, grade in R.SEVERITY.items())
FINDINGS = f"""f AS (SELECT event_id, user_id, 'R' || (event_id % 7) AS rule, CASE event_id % 3 WHEN 0 THEN 'meta' WHEN 1 THEN 'smt' END AS kind,
CASE event_id % 5 WHEN 0 THEN 'MUST' WHEN 1 THEN 'SHOULD' WHEN 2 THEN 'MAY' WHEN 3 THEN 'SHALL' ELSE 'CAN' END AS priority, event_type AS message, CASE WHEN event_id % 4 <> 0 THEN 'a/"' || user_id END AS subject FROM events),
g AS (SELECT *, CASE priority {SEVERITIES} END AS severity FROM f)"""


def findings(spark, d):
    n = F.col("event_id")
    rows = t(spark, d, "events").select(
        "event_id", "user_id", F.concat(F.lit("R"), (n % 7).cast("string")).alias("rule"), F.when(n % 3 == 0, "meta").when(n % 3 == 1, "smt").alias("kind"),
        chosen(n, *map(F.lit, ("MUST", "SHOULD", "MAY", "SHALL", "CAN"))).alias("priority"), F.col("event_type").alias("message"), F.when(n % 4 != 0, F.concat(F.lit('a/"'), "user_id")).alias("subject"),
    )
    return rows.withColumn("severity", R.severity(F.col("priority")))


@query(f"""WITH {FINDINGS} SELECT event_id, to_json({{'rule': rule, 'kind': kind, 'severity': severity, 'priority': priority, 'message': message, 'subject': subject, 'detail': NULL, 'fix': NULL, 'title': NULL,
'spec': NULL, 'fixability': NULL, 'fixabilityWhy': NULL, 'path': NULL, 'line': NULL, 'part': NULL}})::VARCHAR AS finding FROM g""")
def finding_json(spark, d):
    rows = findings(spark, d)
    return rows.select("event_id", R.as_json(rows).alias("finding"))


@query(f"""WITH {FINDINGS} SELECT user_id, severity, count(*) AS n FROM g WHERE kind IS DISTINCT FROM 'meta' OR severity = 'error' GROUP BY 1, 2""")
def shown_findings(spark, d):
    return R.shown(findings(spark, d), meta_kind="meta").groupBy("user_id", "severity").agg(F.count("*").alias("n"))


READINGS = """s AS (SELECT l_suppkey, l_linenumber, CASE WHEN l_linenumber <= 2 AND l_quantity < 48 THEN 'required' WHEN l_linenumber <= 2 THEN 'required-by-batteries-regulation'
WHEN l_quantity > 40 THEN 'voluntary' WHEN l_quantity > 30 THEN 'certain-cases' WHEN l_quantity > 20 THEN 'other' WHEN l_quantity > 10 THEN '' END AS reading FROM lineitem)"""


@query(f"""WITH {READINGS}, k AS (SELECT l_suppkey, l_linenumber, list_sort(list(DISTINCT reading) FILTER (reading <> '')) AS stated FROM s GROUP BY 1, 2)
SELECT l_suppkey, l_linenumber, CASE WHEN stated IS NULL THEN NULL WHEN len(list_filter(stated, lambda x: x NOT IN ('required', 'required-by-batteries-regulation'))) = 0 THEN stated[1]
WHEN list_contains(stated, 'voluntary') THEN 'voluntary' WHEN list_contains(stated, 'certain-cases') THEN 'certain-cases' WHEN list_contains(stated, 'required') THEN 'required'
WHEN list_contains(stated, 'required-by-batteries-regulation') THEN 'required-by-batteries-regulation' ELSE stated[1] END AS reading FROM k""")
def settled_readings(spark, d):
    q, low = F.col("l_quantity"), F.col("l_linenumber") <= 2
    r = F.when(low & (q < 48), "required").when(low, "required-by-batteries-regulation").when(q > 40, "voluntary").when(q > 30, "certain-cases").when(q > 20, "other").when(q > 10, "")
    return R.settled(t(spark, d, "lineitem").select("l_suppkey", "l_linenumber", r.alias("reading")), ["l_suppkey", "l_linenumber"], "reading")


@query("""WITH r AS (SELECT p_brand AS "where", 'R' || (p_size % 3) AS rule, CASE WHEN p_size = 50 THEN 'unclaimed-element-present' ELSE 'absent' END AS because, p_size // 10 AS n FROM part),
k AS (SELECT "where", rule, max(because) AS because, max(n) AS most FROM r GROUP BY 1, 2),
s AS (SELECT DISTINCT p_brand AS "where", 'R' || (p_size % 4) AS rule, 'e' || (p_partkey % 300) AS name, p_partkey % 300 AS number FROM part WHERE p_retailprice > 950),
o AS (SELECT *, row_number() OVER (PARTITION BY "where", rule ORDER BY number) AS nth FROM s),
u AS (SELECT "where", rule, count(*) AS n, string_agg(name, ',' ORDER BY number) FILTER (nth <= 5) AS names FROM o GROUP BY 1, 2)
SELECT k."where", k.rule, because, coalesce(names, '') AS unclaimed, greatest(most, coalesce(n, 0))::BIGINT AS unclaimed_count FROM k LEFT JOIN u ON u."where" = k."where" AND u.rule = k.rule""")
def merged_not_examined(spark, d):
    part = t(spark, d, "part")
    rule = lambda k: F.concat(F.lit("R"), (F.col("p_size") % k).cast("string")).alias("rule")
    because = F.when(F.col("p_size") == 50, "unclaimed-element-present").otherwise("absent")
    records = part.select(F.col("p_brand").alias("where"), rule(3), because.alias("because"), F.expr("p_size div 10").alias("count"))
    strangers = part.where("p_retailprice > 950").select(F.col("p_brand").alias("where"), rule(4), F.concat(F.lit("e"), (F.col("p_partkey") % 300).cast("string")).alias("name"))
    return R.not_examined(records, strangers).withColumn("unclaimed", F.array_join("unclaimed", ",")).withColumn("unclaimed_count", F.col("unclaimed_count").cast("long"))


@query("""SELECT l_suppkey AS scope, l_linenumber AS "row", l_linestatus AS seen, arg_min(subject, nth) AS subject, arg_min(expected, nth) AS expected, count(*) AS n
FROM (SELECT *, l_orderkey || '/' || l_linenumber AS subject, l_returnflag AS expected, row_number() OVER (PARTITION BY l_suppkey, l_linenumber, l_linestatus ORDER BY l_orderkey, l_orderkey || '/' || l_linenumber, l_returnflag) AS nth FROM lineitem) GROUP BY 1, 2, 3""")
def said_once(spark, d):
    rows = t(spark, d, "lineitem").select(F.col("l_suppkey").alias("scope"), F.col("l_linenumber").alias("row"), F.col("l_linestatus").alias("seen"), F.col("l_orderkey").alias("nth"), F.concat_ws("/", "l_orderkey", "l_linenumber").alias("subject"), F.col("l_returnflag").alias("expected"))
    return R.said_once(rows)


@query("""WITH p AS (SELECT page_id % 10 AS doc, regexp_extract(url, '^[a-z]+://[^/?#]*/([^?#]*)', 1) AS path, page_id FROM pages),
m AS (SELECT DISTINCT doc, array_to_string(string_split(path, '/')[1:1 + page_id % 2], '/') AS matched FROM p WHERE page_id % 3 = 0)
SELECT p.doc, matched, path AS subject FROM p JOIN m ON m.doc = p.doc AND (path = matched OR starts_with(path, matched || '/'))""")
def violations_beneath(spark, d):
    path = F.regexp_extract("url", "^[a-z]+://[^/?#]*/([^?#]*)", 1)
    rows = t(spark, d, "pages").select((F.col("page_id") % 10).alias("doc"), path.alias("subject"), "page_id")
    steps = F.split("subject", "/")
    matched = rows.where("page_id % 3 = 0").select("doc", F.array_join(F.slice(steps, F.lit(1), F.lit(1) + (F.col("page_id") % 2).cast("int")), "/").alias("matched"))
    return R.beneath(matched, rows.drop("page_id"))


@query(r"""WITH w AS (SELECT p_partkey, CASE p_partkey % 11 WHEN 0 THEN 'Mandatory for ' WHEN 1 THEN 'optional, ' WHEN 2 THEN 'mandatoryish ' WHEN 3 THEN 'Applicable3 if ' WHEN 4 THEN 'There is no need to FILL ' WHEN 5 THEN 'N/A'
WHEN 6 THEN '(only for ' WHEN 7 THEN 'Where possible, ' WHEN 8 THEN '–' WHEN 9 THEN NULL ELSE 'Publicly accessible to notified bodies: ' END AS head, p_name FROM part),
x AS (SELECT p_partkey, CASE WHEN head IN ('N/A', '–') THEN head WHEN starts_with(head, '(') THEN head || p_name || '); rest' ELSE head || p_name END AS text FROM w)
SELECT p_partkey, CASE p_partkey % 11 WHEN 6 THEN 'conditional' WHEN 7 THEN 'conditional' ELSE 'yes' END AS obligation,
CASE p_partkey % 11 WHEN 6 THEN 'only for ' || (SELECT p_name FROM w WHERE w.p_partkey = x.p_partkey) WHEN 7 THEN 'Where possible' ELSE '' END AS condition,
CASE p_partkey % 11 WHEN 10 THEN 'public' ELSE 'n/a' END AS access,
CASE p_partkey % 11 WHEN 0 THEN 'yes required' WHEN 1 THEN 'no optional' WHEN 3 THEN 'conditional certain-cases' WHEN 4 THEN 'no not-to-be-filled' WHEN 5 THEN 'unclear not-stated' WHEN 8 THEN 'unclear not-stated' ELSE 'unclear unrecognised' END AS applies FROM x""")
def prose_readings(spark, d):
    heads = ("Mandatory for ", "optional, ", "mandatoryish ", "Applicable3 if ", "There is no need to FILL ", "N/A", "(only for ", "Where possible, ", "–", None, "Publicly accessible to notified bodies: ")
    whole = [F.lit(h).cast("string") if h is None or len(h) < 4 else F.concat(F.lit(h), "p_name", F.lit("); rest" if h[0] == "(" else "")) for h in heads]
    rows = t(spark, d, "part").select("p_partkey", chosen(F.col("p_partkey"), *whole).alias("text"))
    rows = rows.select("p_partkey", L.obligation(F.col("text")).alias("o"), L.access_class(F.col("text")).alias("access"), L.applicability(F.col("text")).alias("a"))
    return rows.select("p_partkey", F.col("o.reading").alias("obligation"), "o.condition", "access", F.concat_ws(" ", "a.reading", "a.label").alias("applies"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '1.' || p_size || '.0' WHEN 1 THEN p_size || '.2' ELSE '' END AS version,
CASE WHEN p_size = 1 THEN 'exactly one' WHEN p_size = 2 THEN 'at most one' WHEN p_size = 3 THEN 'one or more' ELSE 'any number of' END AS words,
CASE WHEN regexp_matches(p_type, '^[AEIOU]') THEN 'an ' ELSE 'a ' END || p_type AS noun,
CASE p_partkey % 3 WHEN 0 THEN '"it''s ' || p_name || '"' WHEN 1 THEN '''' || p_name || ' "\\''\\n''' END AS shown FROM part""")
def report_words(spark, d):
    key, size = F.col("p_partkey"), F.col("p_size").cast("string")
    sid = chosen(key, F.concat(F.lit("urn:samm:io.x:1."), size, F.lit(".0#e")), F.concat(F.lit("https://x.org/a/"), size, F.lit("/2/b")), F.lit("https://x.org/a/1"), F.lit(None).cast("string"))
    low = F.when(F.col("p_size").isin(1, 3), 1).otherwise(0)
    high = F.when(F.col("p_size") <= 2, 1)
    text = chosen(key, F.concat(F.lit("it's "), "p_name"), F.concat("p_name", F.lit(" \"'\n")), F.lit(None).cast("string"))
    return t(spark, d, "part").select("p_partkey", L.namespace_version(sid).alias("version"), L.cardinality_words(low, high).alias("words"), L.with_article(F.col("p_type")).alias("noun"), L.shown_text(text).alias("shown"))


@query("""WITH e AS (SELECT o_custkey, o_orderkey AS nth, CASE WHEN o_orderkey % 3 <> 0 THEN '''' || o_orderstatus || '''' ELSE '[' || o_orderkey || ']' END || ' (' || CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE 'no semanticId' END || ')' AS one FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY nth, one) AS rank, count(*) OVER (PARTITION BY o_custkey) AS n FROM e)
SELECT o_custkey, 'this scope holds ' || any_value(n) || ' element' || CASE WHEN any_value(n) = 1 THEN '' ELSE 's' END || ': ' || string_agg(one, ', ' ORDER BY rank) || CASE WHEN any_value(n) > 5 THEN ' and ' || (any_value(n) - 5) || ' more' ELSE '' END AS held
FROM r WHERE rank <= 5 GROUP BY o_custkey""")
def held_elements(spark, d):
    key = F.col("o_orderkey")
    rows = t(spark, d, "orders").select("o_custkey", key.alias("nth"), F.when(key % 3 != 0, F.col("o_orderstatus")).alias("id_short"), F.when(key % 2 == 0, F.col("o_orderpriority")).alias("semantic_id"))
    return R.held(rows, "o_custkey")


@query("SELECT o_custkey, o_orderpriority AS name, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_names(spark, d):
    return t(spark, d, "orders").groupBy("o_custkey", F.col("o_orderpriority").alias("name")).agg(F.count("*").alias("n")).where("n > 1")
