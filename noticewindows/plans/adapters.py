"""The given tables seen as the inputs of the operators: posts, windows, ballots, logs, pages.

A view is a lazy plan, built once per session and folder.

Every view is a projection of whole tables.  Variety (faults, offsets, formats, who saw what) comes
from the tables' own columns; the SQL twins of these views are in ``oracle.py``.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticewindows import fixed_values as fv
from noticewindows.functions import textcols, timecols
from noticewindows.operators.replies import EVENT_STRUCT
from noticewindows.session import HUGE_METHOD, cut_lineage

NOW = "2024-01-15T12:00:00+00:00"
LATER = "2024-03-10T00:00:00+00:00"
CALENDAR_ZONE = "Etc/GMT-3"
TYPES = {
    "view": "maintenance",
    "signup": "crypto_closure",
    "error": "early_close",
    "click": "late_open",
    "purchase": "holiday_closure",
}
MEMBERS = ("m1", "m2", "m3")


def now() -> Column:
    return timecols.iso_instant(F.lit(NOW))


def later() -> Column:
    return timecols.iso_instant(F.lit(LATER))


def health_now() -> Column:
    return timecols.iso_instant(F.lit("2024-01-31T06:00:00"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set(*HUGE_METHOD)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape_events(table(spark, sf_dir, "events"))


def shape_events(rows: DataFrame) -> DataFrame:
    return rows.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("at"),
        "user_id",
        "event_type",
        "value",
        "props",
        F.regexp_extract("props", "([0-9]+)", 1).cast("long").alias("k"),
    )


def _affected() -> Column:
    return F.when(F.col("value") >= 50, "DESK-A, DESK-B").when(F.col("value") >= 20, "desk-c")


_WRITTEN: dict[tuple[SparkSession, str], DataFrame] = {}


@cache
def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as windows: firm is the user, the post is the user and the tens of ``k``."""
    if (spark, sf_dir) in _WRITTEN:
        return _WRITTEN[spark, sf_dir]
    return shape_windows(events(spark, sf_dir))


def written_windows(rows: DataFrame) -> DataFrame:
    """Events as windows, written once by evenly loaded tasks, however few pieces the events are stored in."""
    return cut_lineage(shape_windows(shape_events(rows.repartition("event_id"))), "windows")


@contextmanager
def windows_once(spark: SparkSession, sf_dir: str) -> Iterator[None]:
    """Inside, all views of windows read one table of them, written at the start.

    For queries that read the windows many times: their texts and keys are long expressions, which every view would
    work out again for every row.  The table belongs to one run of one query; the next run reads the events anew."""
    written = written_windows(table(spark, sf_dir, "events"))
    _forget_views()
    _WRITTEN[spark, sf_dir] = written
    try:
        yield
    finally:
        del _WRITTEN[spark, sf_dir]
        _forget_views()


def _forget_views() -> None:
    for view in (windows, tracked, raw_events, notices, ballots, replies, before, extraction, extracted_posts, inventory, post_state, held_rows):
        view.cache_clear()


def shape_windows(ev: DataFrame) -> DataFrame:
    kind = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])
    tens = F.floor(F.col("k") / 10)
    rows = ev.select(
        F.col("event_id").alias("pos"),
        (F.col("user_id") * 10 + tens).alias("arrival_seq"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("firm"),
        F.concat_ws("-", F.lit("post"), F.col("user_id").cast("string"), tens.cast("string")).alias("post_key"),
        F.try_element_at(kind, "event_type").alias("event_type"),
        _affected().alias("affected"),
        timecols.shift(
            F.date_trunc("day", "at"), F.floor(F.hour("at") / 6) * 21_600
        ).alias("start_at"),
        (F.floor(F.col("value") / 50) + 1).alias("hours"),
        "user_id",
        "k",
        "value",
        "at",
    )
    rows = rows.withColumn("end_at", timecols.shift(F.col("start_at"), F.col("hours") * 3600))
    rows = rows.withColumns(
        {
            "start_iso": timecols.iso_in_zone(F.col("start_at"), CALENDAR_ZONE),
            "end_iso": timecols.iso_in_zone(F.col("end_at"), CALENDAR_ZONE),
            "summary": textcols.build_summary(F.col("event_type"), F.col("affected"), F.lit(False)),
        }
    )
    rows = rows.withColumn(
        "event_key",
        textcols.event_key(F.col("post_key"), F.col("event_type"), F.col("start_iso"), F.col("end_iso")),
    )
    return rows.withColumns(
        {
            "entry_id": F.concat(F.when(F.col("event_type") == "crypto_closure", "ics:").otherwise("cal-"), "event_key"),
            "url": F.when(F.col("k") < 30, "").otherwise(F.concat(F.lit("https://example.org/"), "post_key")),
            "evidence": F.when(F.col("k") >= 60, "closes; at the stated hour").otherwise(""),
        }
    )


TRACKED = [
    "firm",
    "post_key",
    "arrival_seq",
    "pos",
    "event_key",
    "entry_id",
    "event_type",
    "summary",
    "start_iso",
    "end_iso",
    "evidence",
]


@cache
def tracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows(spark, sf_dir).select(*TRACKED)


@cache
def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Firms with a title and a page: every user, so firms without windows of a kind stay visible."""
    users = events(spark, sf_dir).groupBy("user_id").agg(F.max("value").alias("top"))
    firm = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    return users.select(
        firm.alias("firm"),
        F.when(F.col("top") >= 100, F.concat(F.lit("Desk "), F.col("user_id").cast("string"))).alias("title"),
        F.when(F.col("top") < 150, F.concat(F.lit("https://example.org/"), firm)).otherwise("").alias("firm_url"),
    )


@cache
def firms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zone and offset policy per firm."""
    users = events(spark, sf_dir).select("user_id").distinct()
    return users.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("firm"),
        F.when(F.col("user_id") < 50, "Etc/GMT-3")
        .when(F.col("user_id") < 100, "America/Chicago")
        .otherwise("Europe/London")
        .alias("timezone"),
        (F.col("user_id") >= 140).alias("require_stated_offset"),
    )


@cache
def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows as a model would write them: wall-clock strings with the faults that ``k`` stands for."""
    w = windows(spark, sf_dir)
    local = timecols.shift(F.col("start_at"), F.lit(10_800))
    hours = F.when(F.col("k") == 79, 72).when(F.col("k") == 89, 0).otherwise(F.col("hours"))
    end = timecols.shift(local, hours * 3600)
    k = F.col("k")
    own = F.when(k == 71, "+01:00").otherwise("")
    iso = "yyyy-MM-dd'T'HH:mm:ss"
    return w.select(
        "firm",
        "post_key",
        F.col("pos").alias("event_ord"),
        "event_type",
        F.when(k == 97, "whenever")
        .when(k == 70, F.date_format(local, "yyyy-MM-dd"))
        .otherwise(F.concat(F.date_format(local, iso), own))
        .alias("start_time"),
        F.concat(F.date_format(end, iso), own).alias("end_time"),
        F.when(k < 30, "+03:00")
        .when(k < 50, "GMT+3")
        .when(k < 60, F.lit(None))
        .when(k < 65, "UTC+0330")
        .when(k < 67, "EST")
        .otherwise("UTC-05:00")
        .alias("stated_utc_offset"),
        "affected",
        F.when(k.between(73, 75), "low").otherwise("high").alias("confidence"),
        F.when(k < 50, F.lit(None))
        .when(k < 60, "Dec 25 closed")
        .when(k < 80, "the Platform closes | at THE stated hour")
        .otherwise("markets reopen after the long break")
        .alias("evidence"),
        "user_id",
        "k",
        "arrival_seq",
    )


RAW = [
    "firm",
    "post_key",
    "event_ord",
    "event_type",
    "start_time",
    "end_time",
    "stated_utc_offset",
    "affected",
    "confidence",
    "evidence",
]


@cache
def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One post per (user, tens of k), with the sentence that some quotes are taken from."""
    posts = windows(spark, sf_dir).groupBy("firm", "post_key").agg(
        F.min("arrival_seq").alias("arrival_seq"), F.max("url").alias("url")
    )
    return posts.withColumn(
        "text",
        F.concat(F.lit("Notice "), "post_key", F.lit(": the platform closes, at the stated hour, today.")),
    )


@cache
def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as posts of their source."""
    docs = table(spark, sf_dir, "documents")
    key = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))
    return docs.select(
        F.col("source").alias("firm"),
        key.alias("post_key"),
        F.concat_ws("/", F.lit("https://example.org"), "source", key).alias("url"),
        "text",
        F.col("doc_id").alias("arrival_seq"),
        "doc_id",
        "lang",
        "n_chars",
        "source",
    )


@cache
def document_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was known before: Spanish posts are new, German ones have changed, short ones predate
    the record of held rows."""
    docs = documents(spark, sf_dir).filter("lang <> 'es'")
    text = F.when(F.col("lang") == "de", F.concat("text", F.lit(" (updated)"))).otherwise(F.col("text"))
    return docs.select(
        F.when(F.col("n_chars") < 300, "").otherwise(F.col("firm")).alias("firm"),
        "post_key",
        textcols.content_hash(text).alias("content_hash"),
        timecols.iso_instant(F.lit("2024-01-01T00:00:00")).alias("last_seen"),
        F.lit("").alias("url"),
        "arrival_seq",
        (F.col("n_chars") >= 500).alias("deferred_known"),
        F.col("source"),
    )


@cache
def document_firms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword gates per source, from the longest text each one has."""
    sources = documents(spark, sf_dir).groupBy("firm").agg(F.max("n_chars").alias("longest"))
    return sources.select(
        "firm",
        F.when(F.col("longest") > 12_000, F.array(F.lit(" Tion "), F.lit("EAUX")))
        .otherwise(F.array(F.lit("ñ"), F.lit(""), F.lit("thering")))
        .alias("keywords"),
    )


@cache
def ballots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three members over the raw rows; each overlooks some, writes times its own way, or abstains."""
    raw = raw_events(spark, sf_dir)
    k, n = F.col("k"), F.col("ballot_ord")
    rows = raw.select("*", F.posexplode(F.array(*[F.lit(m) for m in MEMBERS])).alias("ballot_ord", "voter"))
    seen = ~(
        ((n == 0) & k.between(0, 4))
        | ((n == 1) & (k.between(5, 9) | k.between(20, 24)))
        | ((n == 2) & (k.between(10, 14) | k.between(20, 24)))
    )
    fields = F.struct(
        "event_ord",
        "event_type",
        F.when(n == 1, F.substring("start_time", 1, 16)).otherwise(F.col("start_time")).alias("start_time"),
        "end_time",
        F.when(n == 0, F.lit(None)).otherwise(F.col("stated_utc_offset")).alias("stated_utc_offset"),
        F.when(n == 2, F.col("affected")).otherwise(F.substring("affected", 1, 6)).alias("affected"),
        "confidence",
        F.when(n == 0, "").otherwise(F.col("evidence")).alias("evidence"),
    ).cast(EVENT_STRUCT)
    abstains = ((n == 2) & (F.col("user_id") >= 120)) | ((n == 1) & (F.col("user_id") >= 140))
    answered = rows.groupBy("firm", "post_key", "voter", "ballot_ord", abstains.alias("abstains")).agg(
        F.array_sort(F.collect_list(F.when(seen, fields))).alias("found")
    )
    return answered.select(
        "firm",
        "post_key",
        "voter",
        "ballot_ord",
        F.when(F.col("abstains"), F.lit(None)).otherwise(F.col("found")).alias("events"),
        F.when(F.col("abstains"), F.concat(F.lit("no answer from "), "voter")).alias("error"),
    )


@cache
def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ballots as model replies: plain, fenced, after a reasoning block or in prose; some need a repair."""
    answers = ballots(spark, sf_dir)
    item = F.transform(
        "events",
        lambda e: F.to_json(
            F.struct(
                e["event_type"].alias("event_type"),
                e["start_time"].alias("start_time"),
                e["end_time"].alias("end_time"),
                e["stated_utc_offset"].alias("stated_utc_offset"),
                e["affected"].alias("affected"),
                e["confidence"].alias("confidence"),
                e["evidence"].alias("evidence"),
            )
        ),
    )
    array = F.concat(F.lit("["), F.array_join(item, ","), F.lit("]"))
    n = F.col("ballot_ord")
    good = (
        F.when(n == 0, array)
        .when(n == 1, F.concat(F.lit("<think>[1]\n</think>\n```json\n"), array, F.lit("\n```")))
        .otherwise(F.concat(F.lit("Here it is: "), array, F.lit(" as asked.")))
    )
    bad = F.when(n == 0, F.replace(array, F.lit('"event_type":"maintenance"'), F.lit('"event_type":5'))).otherwise("no idea")
    broken = F.col("error").isNotNull()
    tries = F.array(
        F.struct(F.lit(0).alias("model_ord"), F.lit(1).alias("attempt"), bad.alias("raw")),
        F.struct(F.lit(0).alias("model_ord"), F.lit(2).alias("attempt"), good.alias("raw")),
    )
    return answers.select(
        "firm", "post_key", "voter", "ballot_ord", "error", F.explode(tries).alias("t")
    ).select(
        "firm",
        "post_key",
        "voter",
        "ballot_ord",
        "t.model_ord",
        "t.attempt",
        F.when(~F.col("error").isNotNull(), F.col("t.raw")).alias("raw"),
        "error",
    )


@cache
def before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State before a run: everything but what sign-ups announce."""
    return tracked(spark, sf_dir).filter("event_type <> 'crypto_closure'")


@cache
def extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the run extracts: everything but what clicks announced; posts with k from 90 list nothing."""
    return shape_extraction(windows(spark, sf_dir))


def shape_extraction(w: DataFrame) -> DataFrame:
    rows = w.filter("event_type <> 'late_open' and k < 90")
    return rows.select(
        "firm",
        "post_key",
        F.col("pos").alias("event_ord"),
        "event_key",
        "event_type",
        "summary",
        "start_iso",
        "end_iso",
        "start_at",
        "end_at",
        "evidence",
    )


@cache
def extracted_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every post is extracted; those with k in the fifties are unchanged ones read once more."""
    return shape_extracted_posts(windows(spark, sf_dir))


def shape_extracted_posts(w: DataFrame) -> DataFrame:
    posts = w.groupBy("firm", "post_key").agg(
        F.min("arrival_seq").alias("proc_ord"), F.min("k").alias("k")
    )
    return posts.select("firm", "post_key", "proc_ord", F.col("k").between(50, 59).alias("recover"))


@cache
def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries an external calendar already has."""
    rows = windows(spark, sf_dir).filter("value >= 150")
    return rows.select("event_key", F.concat(F.lit("ext-"), "event_key").alias("entry_id")).distinct()


@cache
def post_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windows(spark, sf_dir).groupBy("firm", "post_key").agg(
        F.max("at").alias("last_seen"),
        F.min("arrival_seq").alias("arrival_seq"),
        F.max("url").alias("url"),
    )
    return rows.select(
        "firm",
        "post_key",
        textcols.content_hash(F.col("post_key")).alias("content_hash"),
        "last_seen",
        "url",
        "arrival_seq",
        F.lit(True).alias("deferred_known"),
    )


@cache
def held_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows held back: the raw rows of sign-ups."""
    return raw_events(spark, sf_dir).filter("event_type = 'crypto_closure'").select(*RAW)


@cache
def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape_access(events(spark, sf_dir))


def shape_access(ev: DataFrame) -> DataFrame:
    return ev.select(
        F.col("at").alias("ts"),
        F.when(F.col("event_type") == "view", "view").otherwise("feed").alias("kind"),
        F.col("user_id").alias("visitor_id"),
        F.concat(F.lit("addr-"), F.col("user_id").cast("string")).alias("addr"),
        F.col("props").alias("user_agent"),
    )


def monitor() -> Column:
    return F.col("user_agent") == '{"k": 0}'


@cache
def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape_runs(events(spark, sf_dir))


def shape_runs(ev: DataFrame) -> DataFrame:
    failed = F.col("event_type") == "error"
    return ev.select(
        F.col("event_id").alias("run_id"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("firm"),
        F.col("at").alias("ts"),
        F.when(failed, F.concat(F.lit("HTTP "), (500 + F.floor(F.col("k") / 50)).cast("string"))).alias("error"),
        F.when(F.col("event_type") == "click", F.array(F.lit("gate matched nothing")))
        .otherwise(F.array().cast("array<string>"))
        .alias("anomalies"),
    )


@cache
def fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir)
    k = F.col("k")
    return ev.select(
        F.concat(
            F.lit("https://h"), F.col("user_id").cast("string"), F.lit(".example.org/"), k.cast("string")
        ).alias("url"),
        F.when(F.col("value") < 20, 1).when(F.col("value") < 60, 2).otherwise(3).alias("attempt"),
        F.col("at").alias("ts"),
        F.when(k < 50, 200)
        .when(k < 60, 404)
        .when(k < 70, 429)
        .when(k < 80, 503)
        .when(k < 85, 403)
        .otherwise(200)
        .alias("status"),
        k.between(85, 89).alias("network_error"),
    )


@cache
def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages")
    return rows.withColumn("firm", F.regexp_extract("url", "^https?://([^/]+)", 1))


@cache
def page_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One profile per host."""
    hosts = pages(spark, sf_dir).select("firm").distinct()
    return hosts.select(
        F.col("firm").alias("name"),
        F.upper("firm").alias("display_name"),
        F.array(F.lit("main div.content"), F.lit("article")).alias("post_content_selectors"),
        F.lit("h1").alias("post_title_selector"),
        F.array(F.lit("nav"), F.lit("div.ad")).alias("strip_selectors"),
        F.lit(fv.MIN_CONTENT_CHARS).alias("min_content_chars"),
        F.array(F.lit("article")).alias("listing_content_selectors"),
        F.lit("h1").alias("listing_title_selector"),
        F.lit("TH").alias("listing_title_contains"),
        F.array(F.lit("nav li"), F.lit("a")).alias("link_selectors"),
        F.lit("e").alias("link_url_contains"),
        F.lit("update").alias("post_key_prefix"),
    )
