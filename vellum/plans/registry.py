"""Registered queries: the operators bound to the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import lexical as L
from vellum.operators import conformance as C
from vellum.streaming import windows as W

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("""SELECT o_orderkey, count(l_orderkey) AS found FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey
GROUP BY o_orderkey HAVING count(l_orderkey) NOT BETWEEN 1 AND 4""")
def card_check(spark, d):
    return C.cardinality(t(spark, d, "orders"), t(spark, d, "lineitem"), "o_orderkey", "l_orderkey", 1, 4)


@query("SELECT o_orderkey, 0::BIGINT AS found FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def card_zero(spark, d):
    return C.cardinality(t(spark, d, "orders"), t(spark, d, "lineitem"), "o_orderkey", "l_orderkey", 1, None)


@query("""SELECT doc_id FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN ' ' || chr(10) || chr(9) ELSE text END AS text FROM documents)
WHERE text IS NULL OR regexp_matches(text, '^\\s*$')""")
def required_value(spark, d):
    text = F.when(F.col("doc_id") % 5 == 1, " \n\t").when(F.col("doc_id") % 5 != 0, F.col("text"))
    return t(spark, d, "documents").select("doc_id", text.alias("text")).where(F.col("text").isNull() | F.regexp_like("text", F.lit(r"^\s*$"))).select("doc_id")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus NOT IN ('O', 'F')")
def vocab_check(spark, d):
    return t(spark, d, "orders").where(~F.col("o_orderstatus").isin("O", "F")).select("o_orderkey", "o_orderstatus")


@query("SELECT event_id, CASE event_id % 4 WHEN 1 THEN 'STRING' WHEN 2 THEN NULL ELSE 'OBJECT<b: BIGINT>' END AS found FROM events WHERE event_id % 4 <> 0")
def kind_check(spark, d):
    props = F.when(F.col("event_id") % 4 == 0, F.col("props")).when(F.col("event_id") % 4 == 1, '{"k": "x"}').when(F.col("event_id") % 4 == 2, "{").otherwise('{"k": {"b": 1}}')
    kind = F.expr("schema_of_variant(try_variant_get(try_parse_json(props), '$.k', 'variant'))")
    return t(spark, d, "events").select("event_id", props.alias("props")).select("event_id", kind.alias("found")).where("found is null or found <> 'BIGINT'")


@query("""SELECT doc_id, first_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY lang, md5(text)) AS first_id FROM documents)
WHERE doc_id <> first_id""")
def unique_pair_first(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "lang", F.md5("text").alias("digest"))
    firsts = docs.groupBy("lang", "digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    return docs.join(firsts, ["lang", "digest"]).where("doc_id <> first_id").select("doc_id", "first_id")


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def dangling_ref(spark, d):
    return C.dangling(t(spark, d, "documents").select("doc_id", "source"), "doc_id", t(spark, d, "labels"), "doc_id")


@query("""SELECT p_partkey, rule, nth FROM (SELECT p_partkey, CASE WHEN p_size > 40 THEN 'large' WHEN p_retailprice < 1000 THEN 'cheap'
WHEN p_brand LIKE 'Brand#1%' THEN 'first brands' END AS rule, CASE WHEN p_size > 40 THEN 1 WHEN p_retailprice < 1000 THEN 2
WHEN p_brand LIKE 'Brand#1%' THEN 3 END AS nth FROM part) WHERE rule IS NOT NULL""")
def claim_window(spark, d):
    rules = [("large", F.col("p_size") > 40), ("cheap", F.col("p_retailprice") < 1000), ("first brands", F.col("p_brand").like("Brand#1%"))]
    return C.claims(t(spark, d, "part"), "p_partkey", rules)


VOCABULARY = ("AUTOMOBIL", "BILDING", "FURNITURES", "MACHINRY", "HOUSEHOLDS")


@query("""WITH w(word) AS (VALUES ('AUTOMOBIL'), ('BILDING'), ('FURNITURES'), ('MACHINRY'), ('HOUSEHOLDS')),
v AS (SELECT DISTINCT c_mktsegment AS value FROM customer WHERE c_mktsegment IS NOT NULL),
p AS (SELECT value, word, levenshtein(value, word) AS distance FROM v, w WHERE value NOT IN (SELECT word FROM w)
  AND levenshtein(value, word) <= greatest(3, length(word) // 4)),
r AS (SELECT *, row_number() OVER (PARTITION BY value ORDER BY distance, word) AS n FROM p)
SELECT value, word, distance FROM r WHERE n = 1""")
def near_miss(spark, d):
    words = spark.createDataFrame([(w,) for w in VOCABULARY], "word string")
    return C.near_misses(t(spark, d, "customer"), "c_mktsegment", words, "word")


@query("""SELECT lang, source FROM (SELECT DISTINCT lang, source FROM documents) EXCEPT
SELECT lang, source FROM documents JOIN labels USING (doc_id) WHERE quality = 0""")
def not_examined(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "lang", "source")
    return C.not_examined(docs, docs.join(t(spark, d, "labels").where("quality = 0"), "doc_id"), ["lang", "source"])


BAG = """list_sort(list_distinct(list_filter(string_split_regex(lower(regexp_replace(x, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+'),
lambda w: w <> '' AND w NOT IN ('the','a','an','of','for','to','in','on','and','or','by','is','with','as','at','from','its','their','this','that',
'information','data','value','values','battery','batteries'))))"""


@query(f"""WITH t AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Information on the ' || p_type || ' pursuant to Article 7: ' || p_name
WHEN 1 THEN 'Where applicable, ' || p_name ELSE replace(p_name, ' ', 'Of') || ' batteryValue' END AS full_text,
CASE p_partkey % 3 WHEN 2 THEN replace(p_name, ' ', 'Of') || ' batteryValue' ELSE p_name END AS x FROM part)
SELECT array_to_string({BAG}, ' ') AS bag, min(p_partkey) AS first_key, count(*) AS n FROM t GROUP BY 1 HAVING count(*) > 1""")
def bag_join(spark, d):
    kind, name = F.col("p_partkey") % 3, F.col("p_name")
    text = F.when(kind == 0, F.concat(F.lit("Information on the "), "p_type", F.lit(" pursuant to Article 7: "), name)).when(kind == 1, F.concat(F.lit("Where applicable, "), name)).otherwise(F.concat(F.replace(name, F.lit(" "), F.lit("Of")), F.lit(" batteryValue")))
    bags = t(spark, d, "part").select("p_partkey", F.array_join(L.words_of(text), " ").alias("bag"))
    return bags.groupBy("bag").agg(F.min("p_partkey").alias("first_key"), F.count("*").alias("n")).where("n > 1")


@query("""WITH p AS (SELECT page_id, list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS parts FROM pages)
SELECT prefix, count(*) AS n FROM (SELECT '/' || array_to_string(parts[1:i], '/') AS prefix FROM p, unnest(range(1, len(parts) + 1)) AS u(i)) GROUP BY prefix""")
def prefix_join(spark, d):
    path = F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^?#]*)", 1)
    return t(spark, d, "pages").select(F.explode(C.path_prefixes(path)).alias("prefix")).groupBy("prefix").agg(F.count("*").alias("n"))


@query("""SELECT user_id, count(DISTINCT event_type) AS n_values, min(event_type) AS low, max(event_type) AS high FROM events
GROUP BY user_id HAVING count(DISTINCT event_type) > 1""")
def disagreement(spark, d):
    return C.disagreements(t(spark, d, "events"), "user_id", "event_type")


@query("SELECT user_id, arg_min(event_type, event_id) AS first_type, arg_max(event_type, event_id) AS last_type FROM events GROUP BY user_id")
def settle_reading(spark, d):
    return t(spark, d, "events").groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("first_type"), F.max_by("event_type", "event_id").alias("last_type"))


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source")
def tally(spark, d):
    return t(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))


@query("""SELECT event_type, count(*) FILTER (hour(ts) < 8) AS night, count(*) FILTER (hour(ts) BETWEEN 8 AND 15) AS day,
count(*) FILTER (hour(ts) > 15) AS evening FROM events GROUP BY event_type""")
def pivot_where(spark, d):
    h = F.hour("ts")
    return t(spark, d, "events").groupBy("event_type").agg(F.count_if(h < 8).alias("night"), F.count_if(h.between(8, 15)).alias("day"), F.count_if(h > 15).alias("evening"))


@query("""WITH a AS (SELECT user_id, event_type, ts, event_id, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS b
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), r AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM a)
SELECT user_id, run::BIGINT AS run, any_value(event_type) AS value, count(*) AS length FROM r GROUP BY user_id, run""")
def adjacent_runs(spark, d):
    return C.runs(t(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type")


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id
ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_purchase FROM events""")
def carry_forward(spark, d):
    value = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    return C.carry_forward(t(spark, d, "events").select("event_id", "user_id", "ts", "event_type"), "user_id", ["ts", "event_id"], value, "last_purchase").select("event_id", "last_purchase")


@query("""SELECT conv_id, turn, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS next_role FROM conversations""")
def lead_pair(spark, d):
    from pyspark.sql import Window

    return t(spark, d, "conversations").select("conv_id", "turn", "role", F.lead("role").over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).alias("next_role"))


@query("""SELECT user_id, after, before FROM (SELECT user_id, event_id AS before, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS after
FROM (SELECT DISTINCT user_id, event_id FROM events)) WHERE before - after > 1""")
def gap_detect(spark, d):
    return C.gaps(t(spark, d, "events"), "user_id", "event_id")


@query("""WITH a AS (SELECT l_suppkey, l_extendedprice AS x, CASE WHEN x - lag(x) OVER w > 500 THEN 1 WHEN lag(x) OVER w IS NULL THEN 1 ELSE 0 END AS b
FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_extendedprice)), c AS (SELECT *, sum(b) OVER (PARTITION BY l_suppkey ORDER BY x) AS cluster FROM a)
SELECT l_suppkey, cluster::BIGINT AS cluster, min(x) AS low, max(x) AS high, count(*) AS n FROM c GROUP BY l_suppkey, cluster""")
def cluster_1d(spark, d):
    return C.clusters(t(spark, d, "lineitem"), "l_suppkey", "l_extendedprice", 500)


@query("""SELECT lang, list_aggregate(ids[1:5], 'string_agg', ',') AS first_ids, len(ids)::BIGINT AS n FROM
(SELECT lang, list(doc_id ORDER BY doc_id) AS ids FROM documents GROUP BY lang)""")
def topk_named(spark, d):
    from pyspark.sql import Window

    docs = t(spark, d, "documents").select("lang", "doc_id")
    first = docs.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("doc_id"))).where("n <= 5")
    first = first.groupBy("lang").agg(F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), ",").alias("first_ids"))
    return first.join(docs.groupBy("lang").agg(F.count("*").alias("n")), "lang")


PART_NAMES = ("files/a b.pdf", "./files//x.PDF", "..\\out.txt", "a/b/../../..", "C:\\d\\E%20F.TXT", "dir/", "", "a/./b/../c.xml", "x%2Fy.bin", "/", "É/Ü.Doc", "%zz+1.txt")


@query("""WITH v(i, raw, name, problem, file) AS (VALUES (0, 'files/a b.pdf', 'files/a b.pdf', NULL, 'a b.pdf'), (1, './files//x.PDF', 'files/x.PDF', NULL, 'x.pdf'),
(2, '..\\out.txt', NULL, 'it climbs out of the package', 'out.txt'), (3, 'a/b/../../..', NULL, 'it climbs out of the package', '..'),
(4, 'C:\\d\\E%20F.TXT', 'C:/d/E F.TXT', NULL, 'e f.txt'), (5, 'dir/', NULL, 'it ends in a separator, so it names a directory and not a part', ''),
(6, '', NULL, 'it is empty', ''), (7, 'a/./b/../c.xml', 'a/c.xml', NULL, 'c.xml'), (8, 'x%2Fy.bin', 'x/y.bin', NULL, 'x/y.bin'),
(9, '/', NULL, 'it ends in a separator, so it names a directory and not a part', ''), (10, 'É/Ü.Doc', 'É/Ü.Doc', NULL, 'Ü.doc'), (11, '%zz+1.txt', '%zz+1.txt', NULL, '%zz+1.txt'))
SELECT page_id, nullif(lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]+):', 1)), '') AS scheme, name, problem, file AS file_name FROM pages JOIN v ON page_id % 12 = i""".replace("\\\\", "\\"))
def part_name(spark, d):
    raw = F.get(F.array(*map(F.lit, PART_NAMES)), (F.col("page_id") % len(PART_NAMES)).cast("int"))
    return t(spark, d, "pages").select("page_id", "url", raw.alias("raw")).select("page_id", L.scheme(F.col("url")).alias("scheme"), L.part_name(F.col("raw")).alias("p"), L.file_name(F.col("raw")).alias("file_name")).select("page_id", "scheme", "p.name", "p.problem", "file_name")


@query("""WITH y AS (SELECT p_partkey, (p_partkey * 7919) % 12000 - 6000 AS y, p_partkey % 31 + 1 AS day FROM part),
a AS (SELECT *, CASE WHEN y < 0 THEN -y - 1 ELSE y END AS astro FROM y)
SELECT p_partkey, y <> 0 AND day <= CASE WHEN astro % 4 = 0 AND (astro % 100 <> 0 OR astro % 400 = 0) THEN 29 ELSE 28 END AS february,
y <> 0 AND p_partkey % 16 * 60 + p_partkey % 70 <= 840 AND p_partkey % 70 < 60 AS with_offset FROM a""")
def xs_date(spark, d):
    y = F.col("p_partkey") * 7919 % 12000 - 6000
    year = F.concat(F.when(y < 0, "-").otherwise(""), F.lpad(F.abs(y).cast("string"), 4, "0"))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    february = F.concat(F.lit(" \n"), year, F.lit("-02-"), two(F.col("p_partkey") % 31 + 1), F.lit("\t"))
    offset = F.concat(year, F.lit("-01-31+"), two(F.col("p_partkey") % 16), F.lit(":"), two(F.col("p_partkey") % 70))
    return t(spark, d, "part").select("p_partkey", L.is_xs_date(february).alias("february"), L.is_xs_date(offset).alias("with_offset"))


@query("""WITH n AS (SELECT p_partkey, lpad((p_partkey % 1000)::VARCHAR, 3, '0') AS k, p_partkey % 6 AS form FROM part)
SELECT p_partkey, CASE WHEN form IN (0, 1, 2) THEN '0173-1#02-ABC' || k || '#002' WHEN form = 3 THEN 'urn:irdi:https://x/' || k || '%23a'
WHEN form = 4 THEN 'urn:samm:io.x:1.0.' || k || '#energy' ELSE 'https://example.org/' || k || '/' END AS norm_id,
CASE WHEN form IN (0, 1, 2) THEN '0173-1#02-ABC' || k WHEN form = 4 THEN 'urn:samm:io.x#energy' END AS stem FROM n""")
def norm_id(spark, d):
    k, form = F.lpad((F.col("p_partkey") % 1000).cast("string"), 3, "0"), F.col("p_partkey") % 6
    forms = [("\t0173-1#02-ABC", "#002 "), ("urn:irdi:0173-1%2302-ABC", "%23002"), ("HTTPS://api.eclass-cdp.com/0173-1-02-ABC", "-002/"), ("urn:irdi:https://x/", "%23a"), ("urn:samm:io.x:1.0.", "#energy"), (" https://example.org/", "/")]
    raw = F.lit(None).cast("string")
    for i, (a, b) in enumerate(forms):
        raw = F.when(form == i, F.concat(F.lit(a), k, F.lit(b))).otherwise(raw)
    named = t(spark, d, "part").select("p_partkey", L.normal_identifier(raw).alias("norm_id"))
    return named.select("p_partkey", "norm_id", F.coalesce(L.version_stem(F.col("norm_id")), L.samm_stem(F.col("norm_id"))).alias("stem"))


@query("""SELECT doc_id, CASE WHEN length(text) > 3000 THEN left(text, 3000 - length('... (' || (length(text) - 3000) || ' more characters, not shown)'))
|| '... (' || (length(text) - 3000) || ' more characters, not shown)' ELSE text END AS text FROM documents""")
def bounded_text(spark, d):
    return t(spark, d, "documents").select("doc_id", L.bounded(F.col("text")).alias("text"))


@query(r"""SELECT doc_id, md5(replace(replace(replace(replace(left(text, 40), chr(10), '\x0a'), chr(13), '\x0d') || chr(9) || '\x1b[0m\x7f\x9b' || right(text, 40),
chr(10), '\x0a'), chr(13), '\x0d')) AS digest FROM documents""")
def ctrl_escape(spark, d):
    text = F.concat(F.substring("text", 1, 40), F.lit("\t\x1b[0m\x7f\x9b"), F.substring(F.col("text"), F.greatest(F.length("text") - 39, F.lit(1)), F.lit(40)))
    return t(spark, d, "documents").select("doc_id", F.md5(L.visible(text)).alias("digest"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def sha_digest(spark, d):
    return t(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def dup_digest(spark, d):
    return t(spark, d, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query("""SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.quality AS old, b.quality AS new,
CASE WHEN b.doc_id IS NULL THEN 'gone' WHEN a.doc_id IS NULL THEN 'new' ELSE 'moved' END AS change
FROM (SELECT doc_id, quality FROM labels WHERE doc_id % 7 <> 0) a FULL OUTER JOIN
(SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 1 - quality ELSE quality END AS quality FROM labels WHERE doc_id % 11 <> 0) b ON a.doc_id = b.doc_id
WHERE a.doc_id IS NULL OR b.doc_id IS NULL OR a.quality <> b.quality""")
def verdict_diff(spark, d):
    labels = t(spark, d, "labels").select("doc_id", "quality")
    new = labels.where("doc_id % 11 <> 0").withColumn("quality", F.expr("case when doc_id % 5 = 0 then 1 - quality else quality end"))
    return C.verdict_diff(labels.where("doc_id % 7 <> 0"), new, "doc_id", "quality")


@query("""SELECT source, count(*) FILTER (s = 'error') AS errors, count(*) FILTER (s = 'warning') AS warnings, count(*) FILTER (s = 'info') AS notes,
count(*) FILTER (s = 'error') = 0 AS ok, CASE WHEN count(*) FILTER (s = 'error') > 0 THEN 1 ELSE 0 END AS exit_code
FROM (SELECT source, CASE WHEN toxic = 1 AND quality = 0 THEN 'error' WHEN quality = 0 THEN 'warning' ELSE 'info' END AS s FROM documents JOIN labels USING (doc_id)) GROUP BY source""")
def severity_rollup(spark, d):
    s = F.when((F.col("toxic") == 1) & (F.col("quality") == 0), "error").when(F.col("quality") == 0, "warning").otherwise("info")
    found = t(spark, d, "documents").select("doc_id", "source").join(t(spark, d, "labels"), "doc_id").select("source", s.alias("severity"))
    return C.rollup(found, "source", "severity")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_path(spark, d):
    return t(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("""SELECT r_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM region JOIN nation ON n_regionkey = r_regionkey
JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY r_name""")
def chain_walk(spark, d):
    # Orders are summed by customer, and customers by nation, before each join.
    by_customer = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("s"))
    by_nation = t(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")).join(by_customer, "c_custkey").groupBy("n_nationkey").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    named = by_nation.join(t(spark, d, "nation"), "n_nationkey").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return named.groupBy("r_name").agg(F.sum("n").alias("n"), F.round(F.sum("s"), 2).alias("total"))


@query("""SELECT 'lineitem.part' AS link, count(*) AS n FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part) UNION ALL
SELECT 'orders.customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL
SELECT 'labels.document', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def referential_gate(spark, d):
    links = [("lineitem.part", "lineitem", "l_partkey", "part", "p_partkey"), ("orders.customer", "orders", "o_custkey", "customer", "c_custkey"), ("labels.document", "labels", "doc_id", "documents", "doc_id")]
    out = [C.dangling(t(spark, d, a).select(k), k, t(spark, d, b), j).agg(F.count("*").alias("n")).select(F.lit(name).alias("link"), "n") for name, a, k, b, j in links]
    return out[0].union(out[1]).union(out[2])


@query("""SELECT CASE WHEN l.doc_id IS NULL THEN 'unjudged' WHEN toxic = 1 THEN 'toxic' WHEN quality = 0 THEN 'poor' ELSE 'good' END AS bucket, count(*) AS n
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1""")
def coverage_partition(spark, d):
    bucket = F.when(F.col("quality").isNull(), "unjudged").when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").otherwise("good")
    return t(spark, d, "documents").select("doc_id").join(t(spark, d, "labels"), "doc_id", "left").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) AS nth FROM orders""")
def reading_order(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderpriority", F.desc("o_totalprice"), "o_orderkey")
    return t(spark, d, "orders").select("o_orderkey", F.row_number().over(w).alias("nth"))


@query("""SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY regexp_extract(c_name, '^([^0-9]*)', 1),
try_cast(regexp_extract(c_name, '([0-9]+)', 1) AS BIGINT), c_custkey) AS nth FROM customer""")
def natural_order(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("c_nationkey").orderBy(F.regexp_extract("c_name", "^([^0-9]*)", 1), L.natural_key(F.col("c_name")), "c_custkey")
    return t(spark, d, "customer").select("c_custkey", F.row_number().over(w).alias("nth"))


@query(r"""SELECT page_id, list_count(list_filter(string_split(regexp_replace(regexp_replace(html, '</?(?:p|div|br|li|tr|h[1-6]|title|body)(?:[ /][^>]*)?>', chr(10), 'gi'),
'<[^>]*>', '', 'g'), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))::BIGINT AS n_lines,
md5(array_to_string(list_filter(string_split(regexp_replace(regexp_replace(html, '</?(?:p|div|br|li|tr|h[1-6]|title|body)(?:[ /][^>]*)?>', chr(10), 'gi'),
'<[^>]*>', '', 'g'), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')), chr(10))) AS digest FROM pages""")
def html_lines(spark, d):
    lines = L.html_lines(F.col("html"))
    return t(spark, d, "pages").select("page_id", lines.alias("lines")).select("page_id", F.size("lines").cast("long").alias("n_lines"), F.md5(F.array_join("lines", "\n")).alias("digest"))


@query("""SELECT p_partkey, array_to_string(list_sort(list_distinct(['annex-xiii:' || (p_partkey % 9) || '.' || chr((97 + p_partkey % 26)::INTEGER), 'article:' || p_size || '.2', 'annex-vi-a:' || (p_partkey % 12)]
|| CASE WHEN p_partkey % 2 = 0 THEN ['annex-xiii:4'] ELSE [] END)), ' ') AS keys FROM part""")
def citations(spark, d):
    n = lambda k: (F.col("p_partkey") % k).cast("string")
    text = F.concat(F.lit("see ANNEX XIII, ("), n(9), F.lit(") ("), F.char(97 + F.col("p_partkey") % 26), F.lit("), Art. "), "p_size", F.lit(" ( 2 ) and Annex VI Part A ("), n(12), F.lit("); "), F.when(F.col("p_partkey") % 2 == 0, "annex xiii 4").otherwise("annex xii 4"))
    return t(spark, d, "part").select("p_partkey", F.array_join(L.citations(text), " ").alias("keys"))


@query("""SELECT p_type, p_brand, CASE WHEN bool_and(p_size <= 25) THEN 'small' ELSE 'large' END AS side FROM part
GROUP BY p_type, p_brand HAVING bool_and(p_size <= 25) OR bool_and(p_size > 25)""")
def profile_diff(spark, d):
    small = F.col("p_size") <= 25
    sides = t(spark, d, "part").groupBy("p_type", "p_brand").agg(F.bool_and(small).alias("a"), F.bool_and(~small).alias("b")).where("a or b")
    return sides.select("p_type", "p_brand", F.when(F.col("a"), "small").otherwise("large").alias("side"))


@query("""WITH RECURSIVE e AS (SELECT p_partkey AS node, p_partkey // 10 AS parent FROM part WHERE p_partkey > 0),
w AS (SELECT node, 1 AS depth FROM e WHERE parent = 0 UNION ALL SELECT e.node, w.depth + 1 FROM e JOIN w ON e.parent = w.node) SELECT node, depth FROM w""")
def tree_depth(spark, d):
    edges = t(spark, d, "part").where("p_partkey > 0").select(F.col("p_partkey").alias("node"), F.expr("p_partkey div 10").alias("parent"))
    return C.tree_depths(edges, "node", "parent", F.col("parent") == 0)


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS since, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(spark, d):
    counted = W.run_available(W.window_counts(W.stream(spark, d, "events"), "ts", "event_type", "1 day", "1 hour"))
    return counted.select(F.col("since").cast("timestamp_ntz").alias("since"), "event_type", "n")


def queries() -> dict:
    from vellum.plans import coverage, law, packages, reports, templates, texts, walks  # noqa: F401  add their queries

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
