"""WARC: resolve not-modified revisits to the latest earlier full response of the same canonical URL.

A revisit record with the server-not-modified profile has no payload: the server answered that an earlier response
still holds.  The join is as-of in time: per canonical URL, the last full response strictly before the revisit.  Its
validators must agree with those of the revisit (entity tags by weak comparison, else the modification date); then the
revisit gets its payload reference and the headers of that response, updated by the headers that such an answer may
carry.

Rows are dealt by ranges of (URL, time), so that one URL with a third of all records is spread over many tasks.  The
last response is found inside each range; ranges of the same URL then hand over one row each.

Defined results: a record without URL or time is resolved by nothing (``no_url``, ``no_time``) and resolves nothing.
Among responses of the same time the one with the largest record id counts.  Repeated revisits are each resolved.
Records that are neither full responses nor such revisits are ignored.  Headers are lists: names may repeat and are
compared without case; null lists are empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noticewindows.llm import store

# The profile of a not-modified revisit, and the fields a 304 answer may update.
NOT_MODIFIED = "http://netpreserve.org/warc/1.1/revisit/server-not-modified"
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
FULL_STATUS = (200, 203)
TRACKING = r"^(utm_[a-z]+|fbclid|gclid|ref|sessionid)="
HEADERS = "array<struct<name: string, value: string>>"


def canonical_url(url: Column) -> Column:
    """Host and path in one spelling: no scheme, user, ``www.``, default port, fragment, tracking parameter or last
    slash; host in lower case, parameters in order."""
    bare = F.regexp_replace(F.trim(url), r"(?s)#.*$", "")
    bare = F.regexp_replace(bare, r"(?i)^(https?:)?//", "")
    place = F.regexp_extract(bare, r"^[^/?]*", 0)
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(place, r"^.*@", "")), r":(80|443)?$", ""), r"^www\d*\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    wanted = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING)))
    tail = F.when(F.size(wanted) > 0, F.concat(F.lit("?"), F.array_join(wanted, "&"))).otherwise(F.lit(""))
    whole = F.concat(host, path, tail)
    return F.when(host != "", whole)


def header(headers: Column, name: str) -> Column:
    """The first value of a header field, null if absent."""
    return F.get(F.filter(headers, lambda h: F.lower(h["name"]) == name), F.lit(0))["value"]


def weak_tag(tag: Column) -> Column:
    return F.regexp_replace(F.trim(tag), r"^[Ww]/", "")


def merged_headers(response: Column, revisit: Column) -> Column:
    """The response's headers with those replaced that the revisit carries and may change."""
    update = F.filter(revisit, lambda h: F.lower(h["name"]).isin(*PERMITTED))
    changed = F.transform(update, lambda h: F.lower(h["name"]))
    return F.concat(F.filter(response, lambda h: ~F.coalesce(F.array_contains(changed, F.lower(h["name"])), F.lit(False))), update)


def resolve(records: DataFrame, parts: int | None = None) -> DataFrame:
    """One row per not-modified revisit of ``records`` (``record_id`` long, ``url``, ``captured_at`` timestamp, ``kind``
    response or revisit, ``profile``, ``status``, ``headers``, ``payload``): ``record_id, url, canonical, captured_at,
    response_id, response_at, outcome, headers, payload``."""
    spark = records.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    full = (F.col("kind") == "response") & F.col("status").isin(*FULL_STATUS)
    revisit = (F.col("kind") == "revisit") & (F.col("profile") == NOT_MODIFIED)
    rows = records.select(
        "record_id",
        "url",
        canonical_url(F.col("url")).alias("canonical"),
        "captured_at",
        F.unix_micros("captured_at").alias("at"),
        F.coalesce(full, F.lit(False)).alias("is_full"),
        F.coalesce(revisit, F.lit(False)).alias("is_revisit"),
        F.coalesce(F.col("headers"), F.array().cast(HEADERS)).alias("headers"),
        "payload",
    ).where("is_full OR is_revisit")
    placed = rows.where("canonical IS NOT NULL AND at IS NOT NULL")
    ranged = placed.repartitionByRange(parts, "canonical", "at").withColumn("part", F.spark_partition_id())
    ranged = store.stored(ranged, "warc-records")

    response = F.when(F.col("is_full"), F.struct("at", "record_id", F.struct("headers", "payload", "captured_at").alias("rest")))
    earlier = Window.partitionBy("part", "canonical").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    inside = ranged.withColumn("inside", F.max(response).over(earlier)).where("is_revisit")
    last = ranged.groupBy("canonical", "part").agg(F.max(response).alias("last"))
    before = Window.partitionBy("canonical").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    handed = last.withColumn("handed", F.max("last").over(before)).where("handed IS NOT NULL").select("canonical", "part", "handed")
    found = inside.join(handed, ["canonical", "part"], "left").withColumn("found", F.coalesce("inside", "handed"))

    own, other = F.col("headers"), F.col("found.rest.headers")
    tag, other_tag = weak_tag(header(own, "etag")), weak_tag(header(other, "etag"))
    date, other_date = header(own, "last-modified"), header(other, "last-modified")
    agree = F.when(tag.isNotNull() & other_tag.isNotNull(), tag == other_tag).when(date.isNotNull() & other_date.isNotNull(), date == other_date)
    outcome = F.when(F.col("found").isNull(), "no_earlier_response").when(agree.isNull(), "no_validator").when(agree, "resolved").otherwise("validator_mismatch")
    found = found.withColumn("outcome", outcome)
    good = F.col("outcome") == "resolved"
    resolved = found.select(
        "record_id",
        "url",
        "canonical",
        "captured_at",
        F.col("found.record_id").alias("response_id"),
        F.col("found.rest.captured_at").alias("response_at"),
        "outcome",
        F.when(good, merged_headers(other, own)).otherwise(own).alias("headers"),
        F.when(good, F.col("found.rest.payload")).alias("payload"),
    )
    lost = rows.where("is_revisit AND (canonical IS NULL OR at IS NULL)").select(
        "record_id",
        "url",
        "canonical",
        "captured_at",
        F.lit(None).cast("long").alias("response_id"),
        F.lit(None).cast("timestamp").alias("response_at"),
        F.when(F.col("canonical").isNull(), "no_url").otherwise("no_time").alias("outcome"),
        "headers",
        F.lit(None).cast(records.schema["payload"].dataType).alias("payload"),
    )
    return resolved.unionByName(lost)


def crawl_records(pages: DataFrame) -> DataFrame:
    """The pages as the records of a crawl: each page is a full response at second 100 * page_id, and three later
    conditional requests of its URL, written in other ways, were answered by not-modified.  The payload is a reference:
    page, bytes and digest.  Every seventh page has since changed, every eleventh sends no validator."""
    tag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"'))
    changed, silent = F.col("page_id") % 7 == 3, F.col("page_id") % 11 == 5
    field = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    pages = pages.select("page_id", "url", tag.alias("tag"), F.struct(F.col("page_id").alias("page"), F.octet_length(F.coalesce("html", F.lit(""))).cast("long").alias("n_bytes"), F.crc32(F.coalesce("html", F.lit("")).cast("binary")).alias("crc")).alias("payload"))
    day = F.concat(F.lit("day "), (F.col("page_id") % 28).cast("string"))
    response = pages.select(
        (F.col("page_id") * 4).alias("record_id"),
        "url",
        F.timestamp_seconds(F.col("page_id") * 100).alias("captured_at"),
        F.lit("response").alias("kind"),
        F.lit(None).cast("string").alias("profile"),
        F.lit(200).alias("status"),
        F.filter(F.array(field("Content-Type", F.lit("text/html")), field("Date", day), F.when(~silent, field("ETag", F.col("tag"))), field("Cache-Control", F.lit("max-age=60"))), lambda h: h.isNotNull()).alias("headers"),
        "payload",
    )
    again = pages.withColumn("k", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    spelled = F.when(F.col("k") == 1, F.concat("url", F.lit("#again"))).when(F.col("k") == 2, F.regexp_replace("url", r"^http:", "https:")).otherwise(F.concat(F.lit(" "), "url"))
    sent = F.when(changed & (F.col("k") == 3), F.lit('"other"')).when(F.col("k") == 2, F.concat(F.lit("W/"), "tag")).otherwise(F.col("tag"))
    revisit = again.select(
        (F.col("page_id") * 4 + F.col("k")).alias("record_id"),
        spelled.alias("url"),
        F.timestamp_seconds(F.col("page_id") * 100 + F.col("k") * 1_000_000).alias("captured_at"),
        F.lit("revisit").alias("kind"),
        F.lit(NOT_MODIFIED).alias("profile"),
        F.lit(304).alias("status"),
        F.array(field("Date", F.concat(F.lit("later "), F.col("k").cast("string"))), field("ETag", sent), field("Content-Length", F.lit("0"))).alias("headers"),
        F.lit(None).cast(pages.schema["payload"].dataType).alias("payload"),
    )
    return response.unionByName(revisit)


def op10_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve(crawl_records(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")))
    lines = F.array_join(F.transform("headers", lambda h: F.concat(h["name"], F.lit(": "), h["value"])), "|")
    return found.select("record_id", "canonical", "response_id", "outcome", lines.alias("header_lines"), F.col("payload.page").alias("payload_page"), F.col("payload.n_bytes").alias("payload_bytes"))


OP10_SQL = r"""
WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS html, '"' || md5(coalesce(html, '')) || '"' AS tag,
         page_id % 7 = 3 AS changed, page_id % 11 = 5 AS silent FROM pages
), spelled AS (
  SELECT page_id, k, tag, changed,
         CASE k WHEN 1 THEN url || '#again' WHEN 2 THEN regexp_replace(url, '^http:', 'https:') ELSE ' ' || url END AS url
  FROM p, (VALUES (1), (2), (3)) AS v(k)
), urls AS (
  SELECT url, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^(https?:)?//', '', 'i') AS bare
  FROM (SELECT DISTINCT url FROM (SELECT url FROM p UNION ALL SELECT url FROM spelled)) WHERE url IS NOT NULL
), cut AS (
  SELECT url,
         regexp_replace(regexp_replace(lower(regexp_replace(regexp_extract(bare, '^[^/?]*'), '^.*@', '')), ':(80|443)?$', ''), '^www\d*\.', '') AS host,
         regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
         list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'),
           lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_[a-z]+|fbclid|gclid|ref|sessionid)='))) AS args
  FROM urls
), canon AS (
  SELECT url, host || path || CASE WHEN len(args) > 0 THEN '?' || array_to_string(args, '&') ELSE '' END AS canonical
  FROM cut WHERE host <> ''
), responses AS (
  SELECT page_id, page_id * 100 AS at, canonical, tag, silent, strlen(html)::BIGINT AS n_bytes FROM p JOIN canon USING (url)
), revisits AS (
  SELECT page_id * 4 + k AS record_id, k, page_id * 100 + k * 1000000 AS at, canonical,
         CASE WHEN changed AND k = 3 THEN '"other"' WHEN k = 2 THEN 'W/' || tag ELSE tag END AS sent
  FROM spelled LEFT JOIN canon USING (url)
), found AS (
  SELECT r.record_id, r.k, r.canonical, r.sent, max_by(struct_pack(page_id := s.page_id, tag := s.tag, silent := s.silent, n_bytes := s.n_bytes), (s.at, s.page_id)) AS s
  FROM revisits r LEFT JOIN responses s ON r.canonical = s.canonical AND s.at < r.at
  GROUP BY ALL
), judged AS (
  SELECT *, CASE WHEN canonical IS NULL THEN 'no_url' WHEN s IS NULL OR s.page_id IS NULL THEN 'no_earlier_response' WHEN s.silent THEN 'no_validator'
                 WHEN regexp_replace(sent, '^W/', '') = s.tag THEN 'resolved' ELSE 'validator_mismatch' END AS outcome
  FROM found
)
SELECT record_id, canonical, s.page_id * 4 AS response_id, outcome,
       CASE WHEN outcome = 'resolved' THEN 'Content-Type: text/html|Cache-Control: max-age=60|Date: later ' || k || '|ETag: ' || sent
            ELSE 'Date: later ' || k || '|ETag: ' || sent || '|Content-Length: 0' END AS header_lines,
       CASE WHEN outcome = 'resolved' THEN s.page_id END AS payload_page,
       CASE WHEN outcome = 'resolved' THEN s.n_bytes END AS payload_bytes
FROM judged
"""
