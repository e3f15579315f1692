"""Resolution of not-modified revisit records.

Each revisit is joined as of its time with the latest earlier full response of the same canonical URL, (time, record id)
giving the order. The join runs on two levels, so that one URL with a third of all records is dealt over many tasks: the
last response of each (URL, time slice) is a grouped maximum; a window over a URL's few slices carries it forward; a second
window runs inside each slice. Only record ids travel; headers are fetched for the responses that were met.

Validators are checked in this order: entity tags by weak comparison where both records have one, else modification dates
where both have one, else payload digests where both have one. A revisit whose validators agree, or that has none in common
with the response, is `resolved` (`unchecked` for the latter), a disagreeing one `changed`, one without a response `orphan`.
Of a revisit's headers, those that a 304 response may carry replace the response's; others of the revisit are left out.

Rows: records with a null URL, time or type neither resolve nor are resolved, and are returned as `orphan` if they are
revisits. Null headers count as none. Repeated rows, and records that share an id, are resolved each; of responses at one time and id the greatest digest
is met. Empty tables give an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Header fields that a not-modified response may send to replace stored ones.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
SLICES = 1024
MAP = "map<string,string>"


def canonical_url(url: Column) -> Column:
    """Host (lower case, without www. and default ports), path (no last slash, / if empty) and sorted parameters but utm_*."""
    rest = F.regexp_replace(F.regexp_replace(url, r"(?s)#.*$", ""), r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, r"(?s)^([^/?]*)", 1)), r"^www\.|:80$|:443$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"(?s)^[^/?]*([^?]*)", 1), "/$", "")
    params = F.array_sort(F.filter(F.split(F.regexp_extract(rest, r"(?s)\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.startswith("utm_")))
    return F.concat(host, F.when(path == "", "/").otherwise(path), F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise(""))


def _tag(headers: Column) -> Column:
    return F.regexp_replace(headers["etag"], "^W/", "")


def merged_headers(stored: Column, sent: Column) -> Column:
    """Stored headers, with those of a 304 response that it may send."""
    permitted = F.map_filter(sent, lambda k, _: k.isin(*PERMITTED))
    return F.map_concat(F.map_filter(stored, lambda k, _: ~F.array_contains(F.map_keys(permitted), k)), permitted)


def resolve(records: DataFrame, slices: int = SLICES) -> DataFrame:
    """Revisits of records (record_id, url, time long, type: response or revisit, headers map with lower-case names,
    digest): record_id, canonical, response_id, status, headers."""
    none = F.create_map().cast(MAP)
    rows = records.select("record_id", canonical_url(F.col("url")).alias("canonical"), "time", "type", F.coalesce("headers", none).alias("headers"), "digest")
    # One row with the table's time span.
    span = rows.agg(F.min("time").alias("since"), F.max("time").alias("until"))
    timed = rows.crossJoin(F.broadcast(span)).withColumn("slice", F.floor((F.col("time") - F.col("since")) * F.lit(float(slices)) / (F.col("until") - F.col("since") + 1)))
    events = timed.where(F.col("canonical").isNotNull() & F.col("time").isNotNull()).select("record_id", "canonical", "time", "slice", "type")
    here = F.when(F.col("type") == "response", F.struct("time", "record_id"))
    last = events.groupBy("canonical", "slice").agg(F.max(here).alias("last"))
    before = Window.partitionBy("canonical").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("canonical", "slice", F.max("last").over(before).alias("carried"))
    inside = Window.partitionBy("canonical", "slice").orderBy("time", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    met = events.withColumn("met", F.max(here).over(inside)).where("type = 'revisit'")
    met = met.join(carried, ["canonical", "slice"], "left").select("record_id", "canonical", "time", F.coalesce("met", "carried")["record_id"].alias("response_id")).distinct()

    # A record id may stand for records of several URLs, so it is joined with its URL and time.
    sent = rows.where("type = 'revisit'").join(met, ["record_id", "canonical", "time"], "left")
    stored = rows.where("type = 'response'").groupBy(F.col("record_id").alias("response_id"), "canonical").agg(F.max_by("headers", F.coalesce("digest", F.lit(""))).alias("stored"), F.max("digest").alias("stored_digest"), F.count("*").alias("found"))
    both = sent.join(stored, ["response_id", "canonical"], "left")
    h, s = F.col("headers"), F.coalesce("stored", none)
    same = F.coalesce(_tag(h) == _tag(s), h["last-modified"] == s["last-modified"], F.col("digest") == F.col("stored_digest"))
    status = F.when(F.col("found").isNull(), "orphan").when(same.isNull(), "unchecked").when(same, "resolved").otherwise("changed")
    return both.select("record_id", "canonical", "response_id", status.alias("status"), F.when(status.isin("resolved", "unchecked"), merged_headers(s, h)).otherwise(h).alias("headers"))
