"""Queries and SQL of the numbered operators, added by __spark_entry__.py where this subpackage is present."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import decontaminate, jaccard_join, license_scan, packing, prefix_trie, quality_rules, simhash_dedup, suffix_dedup, token_counts, token_output, tokenizer_alignment, url_filters, warc
from vellum.llm.common import table


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link(table(spark, sf_dir, "documents"), k=3, percent=90)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    files, order, folder = token_counts.write_flat(docs, word_vocabulary())
    found = token_counts.count_tokens(files, folder)
    # Both sides grow with the corpus, so neither is broadcast.
    return order.hint("merge").join(found, ["file_id", "nth"]).select("doc_id", "n_tokens", "ended")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


#: Fixed values of the contract: pattern and verdict of each rule.
URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filters.judge(pages, URL_RULES).drop("url")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), word_vocabulary(), end_id=1, capacity=2048)


def warc_records(pages: DataFrame) -> DataFrame:
    """Two records a page: its full response, and a revisit 1000 pages later that names the page's own entity tag."""
    tag = F.md5(F.coalesce("html", F.lit("")))
    row = lambda kind, record, time, headers: F.struct(record.alias("record_id"), time.alias("time"), F.lit(kind).alias("type"), headers.alias("headers"))
    full = F.create_map(F.lit("etag"), tag, F.lit("content-length"), F.octet_length("html").cast("string"))
    again = F.create_map(F.lit("etag"), F.concat(F.lit("W/"), tag), F.lit("date"), F.col("page_id").cast("string"), F.lit("set-cookie"), F.lit("x"))
    both = F.explode(F.array(row("response", F.col("page_id") * 2, F.col("page_id") * 2, full), row("revisit", F.col("page_id") * 2 + 1, (F.col("page_id") + 1000) * 2 + 1, again)))
    return pages.select("url", F.lit(None).cast("string").alias("digest"), both.alias("r")).select("url", "digest", "r.*")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve(warc_records(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    return found.select("record_id", "canonical", "response_id", "status", F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";").alias("headers"))


OP6_SQL = r"""
WITH p AS (
  SELECT page_id, md5(coalesce(html, '')) AS tag, octet_length(encode(html)) AS n,
         regexp_replace(regexp_replace(url, '#.*$', '', 's'), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM pages),
q AS (
  SELECT page_id, tag, n, regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^www\.|:80$|:443$', '', 'g') AS host,
         regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/$', '') AS path,
         list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_'))) AS params FROM p),
c AS (
  SELECT page_id, tag, n, host || CASE WHEN path = '' THEN '/' ELSE path END
         || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS canonical FROM q),
m AS (
  SELECT v.page_id, max(r.page_id) AS met FROM c v JOIN c r ON r.canonical = v.canonical AND r.page_id <= v.page_id + 1000 GROUP BY v.page_id)
SELECT v.page_id * 2 + 1 AS record_id, v.canonical, r.page_id * 2 AS response_id,
       CASE WHEN r.page_id IS NULL THEN 'orphan' WHEN r.tag = v.tag THEN 'resolved' ELSE 'changed' END AS status,
       CASE WHEN r.tag = v.tag THEN 'content-length=' || r.n || ';date=' || v.page_id || ';etag=W/' || v.tag
            ELSE 'date=' || v.page_id || ';etag=W/' || v.tag || ';set-cookie=x' END AS headers
FROM c v LEFT JOIN m USING (page_id) LEFT JOIN c r ON r.page_id = m.met
"""


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.occurrences(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def learned_rules(spark: SparkSession, sf_dir: str) -> list:
    sample = quality_rules.labelled_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality_rules.learn(sample)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality_rules.judge(docs, learned_rules(spark, sf_dir))
    return judged.select("doc_id", *quality_rules.BASE, "base_failed", "kept")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).select("doc_id", "line", "family", F.round("template_share", 6).alias("template_share"))


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest, folder = token_output.write(table(spark, sf_dir, "documents"), word_vocabulary(), end_id=2)
    return token_output.read(manifest, folder)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("conv_id")
    head = F.crc32(c.cast("string").cast("binary")) % 4
    return prefix_trie.rebuilt_trie(table(spark, sf_dir, "conversations"), donor=c - c % 20, head=head)


#: The checksum is folded bit by bit, by its polynomial.
OP11_SQL = r"""
WITH o AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
i AS (SELECT DISTINCT conv_id FROM o),
b AS (
  SELECT conv_id, conv_id - conv_id % 20 AS donor,
         list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)),
           lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], list_transform(range(8), lambda j: 0::UBIGINT)),
             lambda a, j: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END))) AS crc FROM i),
c AS (SELECT conv_id, donor, (xor(crc, 4294967295::UBIGINT) % 4)::BIGINT AS h FROM b),
r AS (
  SELECT c.conv_id, 0 AS own, pos, role, text FROM c JOIN o ON o.conv_id = c.donor AND pos < h
  UNION ALL SELECT c.conv_id, 1, pos, role, text FROM c JOIN o ON o.conv_id = c.conv_id AND pos >= h),
s AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, pos) AS depth, md5(length(role) || ':' || role || text) AS key,
         len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM r),
p AS (
  SELECT conv_id, depth, string_agg(key, '') OVER (PARTITION BY conv_id ORDER BY depth) AS path, words FROM s
  UNION ALL SELECT conv_id, 0, '', 0 FROM c),
n AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words FROM p GROUP BY path, depth),
k AS (SELECT substring(path, 1, 32 * (depth - 1)) AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
w AS (SELECT n.path, n.depth, n.conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, (n_convs - 1) * words AS saved FROM n LEFT JOIN k USING (path)),
u AS (
  SELECT substring(path, 1, 32 * up) AS path, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT *, unnest(range(0, depth + 1)) AS up FROM w) GROUP BY 1),
e AS (
  SELECT path, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids
  FROM (SELECT conv_id, arg_max(path, depth) AS path FROM p GROUP BY conv_id) GROUP BY path)
SELECT w.conv_id, w.depth, q.conv_id AS parent_conv_id, w.n_convs, w.n_children, u.n_leaves::BIGINT AS n_leaves, u.saved_tokens::BIGINT AS saved_tokens,
       sha256(coalesce(e.ids, '')) AS ends_sha256
FROM w JOIN u USING (path) LEFT JOIN e USING (path) LEFT JOIN n q ON w.depth > 0 AND q.path = substring(w.path, 1, 32 * (w.depth - 1))
"""


def op12_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokenizer_alignment.align_corpus(table(spark, sf_dir, "documents"), *map(public_tokenizers.path, ("byte_bpe_50k.json", "piece_bpe_32k.model")))


def queries() -> dict:
    return {f.__name__: f for f in (op1_jaccard_join, op2_token_counts, op3_suffix_dedup, op4_url_filters, op5_packing, op6_warc, op7_decontaminate, op8_quality_rules, op9_license_scan, op10_token_output, op11_prefix_trie, op12_simhash_dedup, op13_tokenizer_alignment)}


def oracle_sql() -> dict[str, str]:
    return {"op6_warc": OP6_SQL, "op11_prefix_trie": OP11_SQL}
