"""Registered queries: one callable per operator, over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticewindows import fixed_values as fv
from noticewindows.functions import postkeys, textcols, timecols
from noticewindows.operators import (
    evaluate,
    evidence,
    feed,
    health,
    reconcile,
    replies,
    report,
    usage,
    validate,
    vote,
    windows,
)
from noticewindows.operators import posts as post_ops
from noticewindows.plans import adapters as a
from noticewindows.plans import sync
from noticewindows.session import cut_lineage, run_folder
from noticewindows.sources import crawl, pages, profiles, state
from noticewindows.streaming import streams, timers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
POST = ["firm", "post_key"]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def windows_once(fn: Query) -> Query:
    """A query that reads the windows many times: each run writes them once, at its start."""

    @wraps(fn)
    def run(spark: SparkSession, d: str) -> DataFrame:
        with a.windows_once(spark, d):
            return fn(spark, d)

    return run


def _utc(name: str) -> Column:
    return timecols.utc_text(F.col(name)).alias(name.replace("_at", "_utc"))


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return windows.event_rows(a.tracked(spark, d).join(_urls(spark, d), POST), a.catalog(spark, d), a.now())


def _urls(spark: SparkSession, d: str) -> DataFrame:
    return a.notices(spark, d).select(*POST, "url")


# --- windows: what is scheduled ------------------------------------------------------------


@query
def w1_dedup_windows(spark: SparkSession, d: str) -> DataFrame:
    return windows.dedup_windows(a.tracked(spark, d)).select(
        "firm", "event_type", "start_iso", "end_iso", "summary", "post_key", "event_key", "pos"
    )


@query
def w2_next_window(spark: SparkSession, d: str) -> DataFrame:
    rows = windows.next_window(_rows(spark, d), ["maintenance", "early_close", "late_open"])
    return rows.select("firm", "event_key", "event_type", "start_utc", "end_utc", "status")


@query
def w3_schedule_board(spark: SparkSession, d: str) -> DataFrame:
    return windows.schedule_board(a.tracked(spark, d), a.now()).select(
        F.col("part").cast("long").alias("part"), "row_class", "firm", "summary", "start_iso", "end_iso"
    )


@query
def w4_order_events(spark: SparkSession, d: str) -> DataFrame:
    return windows.order_events(_rows(spark, d)).select("event_key", "firm", "start_utc", "status")


@query
def w8_select_feed(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d)
    return windows.select_feed(rows, _selections(spark, d)).groupBy("feed_id", "event_type").agg(
        F.count("*").alias("n"), F.min("start_utc").alias("first_start"), F.max("event_key").alias("last_key")
    )


def _selections(spark: SparkSession, d: str) -> DataFrame:
    """One feed for everything, one per type, one per firm, and one per firm for two types."""
    w = a.windows(spark, d)
    none = F.lit(None).cast("array<string>")
    everything = w.agg(F.count("*")).select(F.lit("all").alias("feed_id"), none.alias("firms"), none.alias("types"))
    kinds = w.select("event_type").distinct().select(
        F.concat(F.lit("type-"), "event_type").alias("feed_id"),
        none.alias("firms"),
        F.array("event_type").alias("types"),
    )
    users = w.select("firm").distinct()
    mine = users.select(
        F.concat(F.lit("firm-"), "firm").alias("feed_id"), F.array("firm").alias("firms"), none.alias("types")
    )
    two = users.select(
        F.concat(F.lit("two-"), "firm").alias("feed_id"),
        F.array("firm").alias("firms"),
        F.array(F.lit("late_open"), F.lit("early_close")).alias("types"),
    )
    return everything.unionByName(kinds).unionByName(mine).unionByName(two)


@query
def p12_future(spark: SparkSession, d: str) -> DataFrame:
    return windows.future_events(a.tracked(spark, d), a.now()).select("event_key", "pos", "end_iso")


@query
def p13_event_status(spark: SparkSession, d: str) -> DataFrame:
    rows = a.windows(spark, d)
    status = windows.event_status(F.col("start_at"), F.col("end_at"), a.now())
    return rows.select("firm", status.alias("status")).groupBy("firm", "status").agg(F.count("*").alias("n"))


@query
@windows_once
def j6_window_overlap(spark: SparkSession, d: str) -> DataFrame:
    found = windows.window_overlap(_rows(spark, d), _requests(spark, d))
    return found.select("req_id", "event_key", "firm", "event_type", "start_utc", "end_utc")


def _requests(spark: SparkSession, d: str) -> DataFrame:
    """Every sign-up asks what overlaps its next hours for its own firm; some leave the end open, some begin with the
    calendar, some end with it."""
    ev = a.events(spark, d).filter("event_type = 'signup'")
    to_at = timecols.shift(F.col("at"), (F.floor(F.col("value")) + 1) * 3600)
    first, last = F.lit("0001-01-02 00:00:00").cast("timestamp"), F.lit("9999-12-30 00:00:00").cast("timestamp")
    return ev.select(
        F.col("event_id").alias("req_id"),
        F.array(F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("firms"),
        F.when(F.col("k") < 50, F.array(F.lit("maintenance"), F.lit("late_open"))).alias("types"),
        F.when(F.col("k") >= 98, first).otherwise(F.col("at")).alias("from_at"),
        F.when(F.col("k") < 80, to_at).when(F.col("k") == 97, last).alias("to_at"),
    )


@query
@windows_once
def j6_window_overlap_all_firms(spark: SparkSession, d: str) -> DataFrame:
    """Requests without a firm: every purchase asks over every firm."""
    ev = a.events(spark, d).filter("event_type = 'purchase'")
    asked = ev.select(
        F.col("event_id").alias("req_id"),
        F.lit(None).cast("array<string>").alias("firms"),
        F.lit(None).cast("array<string>").alias("types"),
        F.col("at").alias("from_at"),
        timecols.shift(F.col("at"), F.lit(7200)).alias("to_at"),
    )
    return windows.window_overlap(_rows(spark, d), asked).select("req_id", "event_key", "firm")


@query
def j6_overlap_literal(spark: SparkSession, d: str) -> DataFrame:
    start = timecols.iso_instant(F.lit("2024-01-10T00:00:00"))
    end = timecols.iso_instant(F.lit("2024-01-12T06:00:00"))
    return windows.overlapping(a.windows(spark, d), start, end).select("event_key", "pos", _utc("start_at"))


@query
def j7_next_per_firm(spark: SparkSession, d: str) -> DataFrame:
    rows = windows.next_per_firm(_rows(spark, d), a.catalog(spark, d), ["holiday_closure"])
    return rows.select("firm", "firm_name", "event_key", "start_utc", "status")


@query
def j8_title_url_lookup(spark: SparkSession, d: str) -> DataFrame:
    rows = a.windows(spark, d).select("pos", "firm", "url")
    found = windows.title_url_lookup(rows, a.catalog(spark, d), "https://example.org/")
    return found.select("pos", "firm", "firm_name", "link")


@query
def j9_attribute_firm(spark: SparkSession, d: str) -> DataFrame:
    rows = windows.attribute_firm(a.document_state(spark, d), "srcX")
    return rows.groupBy("firm").agg(F.count("*").alias("posts"), F.max("post_key").alias("last_post"))


@query
def p14_parse_requests(spark: SparkSession, d: str) -> DataFrame:
    parsed = windows.parse_requests(_raw_requests(spark, d), a.firms(spark, d), fv.EVENT_TYPES, a.now())
    return parsed.select(
        "req_id",
        F.array_join("firms", ",").alias("firms"),
        F.array_join("types", ",").alias("types"),
        timecols.utc_text(F.col("from_at")).alias("from_utc"),
        timecols.utc_text(F.col("to_at")).alias("to_utc"),
        "error",
    )


def _raw_requests(spark: SparkSession, d: str) -> DataFrame:
    ev = a.events(spark, d)
    k, user = F.col("k"), F.concat(F.lit("u"), F.col("user_id").cast("string"))
    iso = F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss")
    return ev.select(
        F.col("event_id").alias("req_id"),
        F.when(k < 20, "")
        .when(k < 40, user)
        .when(k < 60, F.concat(user, F.lit(" , u1,,"), user))
        .when(k < 70, F.concat(user, F.lit(",nobody")))
        .when(k < 72, ",")
        .otherwise(F.lit(None))
        .alias("firm"),
        F.when(k < 30, "maintenance, other").when(k.between(72, 74), "nonsense").otherwise(" ").alias("type"),
        F.when(k < 10, F.date_format("at", "yyyy-MM-dd"))
        .when(k < 25, F.concat(iso, F.lit("Z")))
        .when(k < 50, F.concat(iso, F.lit("-02:30")))
        .when(k < 80, iso)
        .when(k < 85, "soon")
        .otherwise(F.lit(None))
        .alias("from_raw"),
        F.when(k < 50, "2024-01-31")
        .when(k < 75, "2024-01-16T00:00")
        .when(k.between(90, 92), "2024-13-01")
        .otherwise("")
        .alias("to_raw"),
    )


# --- posts ---------------------------------------------------------------------------------


@query
def s1_resolve_firms(spark: SparkSession, d: str) -> DataFrame:
    firms = profiles.resolve_firms(*_profile_tables(spark, d))
    return firms.select(
        "name",
        "display_name",
        "url",
        "timezone",
        F.array_join("keywords", "|").alias("keywords"),
        F.col("max_posts").cast("long").alias("max_posts"),
        F.col("max_age_days").cast("long").alias("max_age_days"),
    )


def _profile_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    stats = a.documents(spark, d).groupBy("source").agg(
        F.max("n_chars").alias("longest"), F.count_if(F.col("lang") == "fr").alias("french")
    )
    empty = F.array().cast("array<string>")
    base = stats.select(
        F.col("source").alias("name"),
        F.lit(None).cast("string").alias("display_name"),
        F.concat(F.lit("https://example.org/"), "source").alias("url"),
        F.array(F.lit("article")).alias("post_content_selectors"),
        F.when(F.col("longest") > 15_000, "America/Chicago").when(F.col("longest") > 9_000, "").alias("timezone"),
        F.when(F.col("french") > 6, F.array(F.lit("maison"), F.lit("fermé"))).alias("keywords"),
    )
    for column in profiles.PROFILE_SCHEMA.split(","):
        name, kind = column.split()
        if name not in base.columns:
            base = base.withColumn(name, F.lit(None).cast(kind))
    overrides = stats.select(
        F.col("source").alias("profile"),
        F.when(F.col("french") > 8, "https://example.net/").when(F.col("french") > 6, "").alias("url"),
        F.when(F.col("longest") > 20_000, "Europe/Paris").otherwise("").alias("timezone"),
        F.when(F.col("french") > 9, empty).when(F.col("french") > 7, F.array(F.lit("ouvert"))).alias("keywords"),
        F.when(F.col("longest") > 10_000, 2).alias("max_posts"),
        F.lit(None).cast("int").alias("max_age_days"),
        F.when(F.col("longest") < 8_000, False).alias("enabled"),
    )
    return profiles.with_profile_defaults(base), overrides


@query
def s2_check_profiles(spark: SparkSession, d: str) -> DataFrame:
    rows = a.pages(spark, d)
    listed = rows.select(
        F.col("firm").alias("profile"),
        F.lit(True).alias("enabled"),
        F.when(F.col("url").contains("/fr/"), "Europe/Paris")
        .when(F.col("url").contains("/de/"), "Mars/Base")
        .alias("timezone"),
    )
    hosts = rows.select("firm").distinct().select(
        F.col("firm").alias("name"),
        F.regexp_extract("firm", r"([^.]+\.[a-z]+)$", 1).alias("post_key_prefix"),
        F.lit("UTC").alias("timezone"),
    )
    zones = spark.createDataFrame([("UTC",), ("Europe/Paris",), ("Europe/London",)], "zone string")
    return profiles.check_profiles(hosts, listed, zones)


@query
def s3_extract_posts(spark: SparkSession, d: str) -> DataFrame:
    posts, errors = pages.extract_posts(a.pages(spark, d), a.page_profiles(spark, d))
    read = posts.select(
        "page_id", "title", F.length("text").cast("long").alias("n_chars"), "content_hash", F.lit(None).cast("string").alias("message")
    )
    return read.unionByName(
        errors.select(
            "page_id",
            F.lit(None).cast("string").alias("title"),
            F.lit(None).cast("long").alias("n_chars"),
            F.lit(None).cast("string").alias("content_hash"),
            F.regexp_extract("message", r"— (.*) \(", 1).alias("message"),
        )
    )


@query
def s4_extract_listing(spark: SparkSession, d: str) -> DataFrame:
    embedded, links = pages.extract_listing(a.pages(spark, d), a.page_profiles(spark, d))
    posts = embedded.select("page_id", F.lit(-1).cast("long").alias("link_ord"), F.col("content_hash").alias("found"))
    return posts.unionByName(
        links.select("page_id", F.col("link_ord").cast("long").alias("link_ord"), F.col("href").alias("found"))
    )


@query
def s5_post_key(spark: SparkSession, d: str) -> DataFrame:
    orders = a.table(spark, d, "orders")
    day, status, urgent = F.col("o_orderdate"), F.col("o_orderstatus"), F.substring("o_orderpriority", 1, 1)
    key = F.col("o_orderkey").cast("string")
    slug = F.lower(F.date_format(day, "d-MMM-yyyy"))
    rows = orders.select(
        "o_orderkey",
        F.when(status == "F", F.concat(F.lit("Update "), F.date_format(day, "d MMMM yyyy"), F.lit(" !")))
        .when(status == "O", F.date_format(day, "MMM dd yyyy"))
        .otherwise(F.concat(F.lit("  No. "), key, F.lit(": Sept 31 2020?")))
        .alias("title"),
        F.when(urgent == "1", F.concat(F.lit("https://example.org/a-"), slug, F.lit("/")))
        .when(urgent == "2", F.concat(F.lit("https://example.org/post-"), key))
        .otherwise("/")
        .alias("url"),
    )
    found = postkeys.post_key(F.col("title"), F.col("url"), F.lit("update"))
    return rows.select("o_orderkey", found.alias("post_key"))


@query
def s6_select_recent(spark: SparkSession, d: str) -> DataFrame:
    ev = a.events(spark, d)
    firm = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    key = F.concat(F.lit("e-"), F.col("event_id").cast("string"))
    url = F.concat_ws("-", F.lit("https://example.org/n"), F.col("event_id").cast("string"), F.lower(F.date_format("at", "'x'-d-MMM-yyyy")))
    embedded = (
        ev.filter("event_type = 'signup'")
        .groupBy(firm.alias("firm"))
        .agg(F.max("event_id").alias("event_id"))
        .select("firm", key.alias("post_key"), F.concat(F.lit("https://example.org/"), "firm").alias("url"))
    )
    links = ev.select(firm.alias("firm"), (F.lit(1 << 40) - F.col("event_id")).alias("pos"), url.alias("url"))
    outcome = (
        F.when(F.col("event_type") == "click", "gone")
        .when(F.col("event_type") == "error", "unreadable")
        .when((F.col("event_type") == "purchase") & (F.col("value") >= 60), "failed")
        .otherwise("ok")
    )
    fetched = ev.select(url.alias("url"), key.alias("post_key"), outcome.alias("outcome"))
    limits = ev.select(
        firm.alias("firm"), F.lit(4).alias("max_posts"), F.lit(14).alias("max_age_days")
    ).distinct()
    posts, errors = pages.select_recent(embedded, links, fetched, limits, F.to_date(F.lit("2024-01-29")))
    return posts.select("firm", "post_key", "rank", F.lit(None).cast("string").alias("message")).unionByName(
        errors.select(
            "firm", F.lit(None).cast("string").alias("post_key"), F.lit(None).cast("long").alias("rank"), "message"
        )
    )


@query
def p1_keyword_gate(spark: SparkSession, d: str) -> DataFrame:
    kept = post_ops.keyword_gate(a.documents(spark, d), a.document_firms(spark, d))
    return kept.select("firm", "post_key")


@query
def p2_changed_posts(spark: SparkSession, d: str) -> DataFrame:
    posts = post_ops.with_hash(a.documents(spark, d))
    known = a.document_state(spark, d).withColumn("firm", F.col("source"))
    return post_ops.changed_posts(posts, known).select("firm", "post_key", "content_hash", "status")


@query
def p3_touch_seen(spark: SparkSession, d: str) -> DataFrame:
    """The page lists every document but the French ones."""
    seen = a.documents(spark, d).filter("lang <> 'fr'")
    touched = post_ops.touch_seen(seen, a.document_state(spark, d), a.now())
    return touched.select("firm", "post_key", timecols.utc_text(F.col("last_seen")).alias("last_seen"), "url")


@query
def p15_build_prompts(spark: SparkSession, d: str) -> DataFrame:
    hints = a.document_firms(spark, d).select(
        F.col("firm").alias("name"), F.array_join("keywords", ", ").alias("prompt_hints")
    )
    prompts = post_ops.build_prompts(a.documents(spark, d), hints)
    after = F.substring_index("prompt", "nothing is scheduled.\n", -1)
    return prompts.select("firm", "post_key", F.sha2(after, 256).alias("tail_hash"))


# --- validation ----------------------------------------------------------------------------


def _judged(spark: SparkSession, d: str, rules: validate.EventRules) -> DataFrame:
    return validate.judge_events(
        a.raw_events(spark, d).select(*a.RAW),
        a.notices(spark, d),
        a.firms(spark, d),
        rules,
        a.now(),
        a.CALENDAR_ZONE,
    )


RULES = validate.EventRules(max_days_ahead=10)


@query
def p4_validate_events(spark: SparkSession, d: str) -> DataFrame:
    judged = _judged(spark, d, RULES)
    fine = F.col("reason").isNull()
    return judged.select(
        "firm",
        "post_key",
        "event_ord",
        "reason",
        "retryable",
        "benign",
        F.when(fine, F.col("start_iso")).alias("start_iso"),
        F.when(fine, F.col("end_iso")).alias("end_iso"),
        F.when(fine, F.col("event_key")).alias("event_key"),
        F.when(fine, F.col("summary")).alias("summary"),
        F.when(fine, F.when(F.col("low"), "low").otherwise(F.col("confidence"))).alias("confidence"),
        F.when(fine, F.col("kept_evidence")).alias("evidence"),
    )


@query
def p4_validate_strict(spark: SparkSession, d: str) -> DataFrame:
    strict = validate.EventRules(max_days_ahead=10, reject_low_confidence=True, require_evidence=True)
    judged = _judged(spark, d, strict)
    return judged.groupBy("reason", "retryable", "benign").agg(F.count("*").alias("n"))


@query
def p5_parse_offset(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    two = F.lpad(k.cast("string"), 2, "0")
    stated = (
        F.when(k < 30, F.concat(F.lit("+"), two, F.lit(":30")))
        .when(k < 60, F.concat(F.lit(" GMT-"), k.cast("string"), F.lit(" ")))
        .when(k < 80, F.concat(F.lit("UTC+3"), two))
        .when(k < 90, F.concat(F.lit("gmt+"), two))
        .otherwise(F.concat(F.lit("-12"), k.cast("string")))
    )
    rows = a.events(spark, d).select("event_id", stated.alias("stated"))
    return rows.select("event_id", timecols.parse_offset(F.col("stated")).cast("long").alias("seconds"))


@query
def p6_to_instant(spark: SparkSession, d: str) -> DataFrame:
    raw = a.raw_events(spark, d).join(a.firms(spark, d), "firm")
    checked = validate.check_times(raw, RULES, a.now())
    return checked.select("event_ord", _utc("start_at"), _utc("end_at"))


@query
def p7_evidence_check(spark: SparkSession, d: str) -> DataFrame:
    docs = a.documents(spark, d)
    first = F.replace(F.substring_index("text", ".", 1), F.lit(" "), F.lit(" | "))
    own = docs.select("doc_id", F.lit("own").alias("kind"), F.upper(first).alias("quote"))
    other = docs.select((F.col("doc_id") + 1).alias("doc_id"), F.lit("other").alias("kind"), first.alias("quote"))
    texts = validate.with_words(docs).select("doc_id", "text", "text_words")
    rows = own.unionByName(other).withColumn("quote_words", textcols.words(F.col("quote"))).join(texts, "doc_id")
    verdict = textcols.evidence_verdict(
        F.col("quote"), F.col("quote_words"), F.col("text"), F.col("text_words")
    )
    return rows.select("doc_id", "kind", verdict.alias("verdict"))


@query
def p8_evidence_search(spark: SparkSession, d: str) -> DataFrame:
    """Every benchmark text as a quote, sought in every document."""
    quotes = spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))
    return evidence.evidence_search(quotes, spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"))


@query
def p9_clean_evidence(spark: SparkSession, d: str) -> DataFrame:
    docs = a.documents(spark, d)
    return docs.select("doc_id", textcols.clean_evidence(F.col("text")).alias("evidence"))


@query
def p10_build_summary(spark: SparkSession, d: str) -> DataFrame:
    docs = a.documents(spark, d)
    kind = F.when(F.col("lang") == "fr", "early_close").when(F.col("lang") == "de", "unheard_of").otherwise("late_open")
    affected = F.when(F.col("n_chars") >= 300, F.col("text"))
    return docs.select(
        "doc_id", textcols.build_summary(kind, affected, F.col("lang") == "es").alias("summary")
    )


@query
def p11_build_description(spark: SparkSession, d: str) -> DataFrame:
    docs = a.documents(spark, d)
    quote = F.when(F.col("n_chars") >= 500, textcols.clean_evidence(F.col("text"))).otherwise("")
    text = textcols.build_description(F.col("text"), F.col("url"), F.col("lang") == "es", quote)
    return docs.select("doc_id", text.alias("description"))


@query
def id_content_hash(spark: SparkSession, d: str) -> DataFrame:
    posts = post_ops.with_hash(a.documents(spark, d))
    return posts.groupBy("content_hash").agg(F.count("*").alias("posts"))


# --- replies and votes ---------------------------------------------------------------------


@query
def v1_infer(spark: SparkSession, d: str) -> DataFrame:
    """A scripted model: the first answer of every second voter is broken, one voter is out of reach."""

    def make_client() -> Callable[[str, str], str]:
        def complete(prompt: str, model: str) -> str:
            if model == "down":
                raise ConnectionError("no route")
            if model == "sloppy" and "was not valid" not in prompt:
                return "sorry"
            return "[]"

        return complete

    prompts = post_ops.build_prompts(
        a.documents(spark, d), a.document_firms(spark, d).select(F.col("firm").alias("name"), F.lit("").alias("prompt_hints"))
    )
    asked = replies.infer(prompts, [("v1", ["sound"]), ("v2", ["down", "sloppy"])], make_client)
    return asked.groupBy("firm", "voter", "model_ord", "attempt", "raw", "error").agg(F.count("*").alias("n")).select(
        "firm",
        "voter",
        F.col("model_ord").cast("long").alias("model_ord"),
        F.col("attempt").cast("long").alias("attempt"),
        "raw",
        "error",
        "n",
    )


@query
def v2_parse_replies(spark: SparkSession, d: str) -> DataFrame:
    parsed = replies.parse_replies(a.replies(spark, d))
    rows = parsed.select(*POST, "voter", "attempt", "error", F.explode_outer("events").alias("e"))
    return rows.select(
        *POST,
        "voter",
        F.col("attempt").cast("long").alias("attempt"),
        "error",
        *[F.col(f"e.{c}").alias(c) for c in (*vote.FIELDS,)],
    )


@query
def v3_resolve_replies(spark: SparkSession, d: str) -> DataFrame:
    ballots = replies.resolve_replies(a.replies(spark, d))
    return ballots.select(*POST, "voter", F.size("events").cast("long").alias("events"), "error")


@query
def v4_tally(spark: SparkSession, d: str) -> DataFrame:
    rows = vote.tally(vote.ballot_rows(a.ballots(spark, d)))
    return rows.select(*POST, "key_0", "key_1", "key_2", F.array_join("voters", ",").alias("voters"))


@query
def v5_merge_variants(spark: SparkSession, d: str) -> DataFrame:
    rows = vote.tally(vote.ballot_rows(a.ballots(spark, d)), vote.panel_key())
    return rows.select(*POST, "key_1", "key_2", *vote.FIELDS)


@query
def v6_consensus(spark: SparkSession, d: str) -> DataFrame:
    kept, failures = vote.consensus(a.ballots(spark, d), 3)
    return kept.select(*POST, *vote.FIELDS, F.lit(None).cast("string").alias("error")).unionByName(
        failures.select(*POST, *[F.lit(None).cast("string").alias(c) for c in vote.FIELDS], "error")
    )


def _panel(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return vote.panel(a.ballots(spark, d), a.MEMBERS)


@query
def v7_panel(spark: SparkSession, d: str) -> DataFrame:
    kept, disputes, failures = _panel(spark, d)
    none = F.lit(None).cast("string")
    parts = [
        kept.select(*POST, F.lit("kept").alias("outcome"), *vote.FIELDS, none.alias("error")),
        disputes.select(*POST, F.lit("dispute").alias("outcome"), *vote.FIELDS, none.alias("error")),
        failures.select(*POST, F.lit("failure").alias("outcome"), *[none.alias(c) for c in vote.FIELDS], "error"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def v8_describe_dispute(spark: SparkSession, d: str) -> DataFrame:
    _, disputes, _ = _panel(spark, d)
    return disputes.select(*POST, "event_type", "start_time", "end_time", "dispute")


@query
def v9_flag_disputes(spark: SparkSession, d: str) -> DataFrame:
    _, disputes, _ = _panel(spark, d)
    flagged = vote.flag_disputes(disputes, a.notices(spark, d), a.firms(spark, d), RULES, a.now())
    return flagged.select(*POST, "event_type", "start_time", "end_time", "reason", "retryable", "benign")


# --- reconciliation ------------------------------------------------------------------------


@query
def j1_diff_events(spark: SparkSession, d: str) -> DataFrame:
    diff = reconcile.diff_events(a.before(spark, d), a.extraction(spark, d), a.extracted_posts(spark, d), a.now())
    return diff.select(*POST, "event_key", "change")


@query
def j2_shared_window(spark: SparkSession, d: str) -> DataFrame:
    found = reconcile.shared_window(a.extraction(spark, d), a.before(spark, d))
    return found.select(*POST, "event_ord", "holder_post", "holder_entry")


@query
def j3_other_references(spark: SparkSession, d: str) -> DataFrame:
    merged, _ = reconcile.merge_duplicates(a.tracked(spark, d), a.now())
    rows = reconcile.other_references(merged)
    return rows.select("entry_id", "post_key", "pos", "other_posts")


@query
def j4_adopt_existing(spark: SparkSession, d: str) -> DataFrame:
    rows = reconcile.adopt_existing(a.extraction(spark, d), a.inventory(spark, d))
    return rows.select("event_ord", "event_key", "calendar_entry")


@query
def j5_overlap_anti(spark: SparkSession, d: str) -> DataFrame:
    rows = reconcile.overlap_anti(a.extraction(spark, d), a.before(spark, d))
    return rows.select(*POST, "event_ord", "event_key")


def _plan(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.reconcile(
        a.before(spark, d),
        a.extraction(spark, d),
        a.extracted_posts(spark, d),
        a.inventory(spark, d),
        a.now(),
        real_calendar=True,
    )


@query
@windows_once
def r1_reconcile(spark: SparkSession, d: str) -> DataFrame:
    return _plan(spark, d).select(*POST, "event_key", "action", "entry_id")


@query
def r2_shrink_guard(spark: SparkSession, d: str) -> DataFrame:
    diff = reconcile.diff_events(a.before(spark, d), a.extraction(spark, d), a.extracted_posts(spark, d), a.now())
    return reconcile.shrink_guard(diff).select(*POST, "n_old", "n_new", "n_missing", "anomaly")


@query
def r3_merge_duplicates(spark: SparkSession, d: str) -> DataFrame:
    moved, deletes = reconcile.merge_duplicates(a.tracked(spark, d), a.now(), _failed_deletes(spark, d))
    kept = moved.select("firm", F.col("pos"), "entry_id", F.lit("tracked").alias("kind"))
    return kept.unionByName(
        deletes.select("firm", F.lit(None).cast("long").alias("pos"), "entry_id", F.lit("delete").alias("kind"))
    )


def _failed_deletes(spark: SparkSession, d: str) -> DataFrame:
    return a.windows(spark, d).filter("value >= 100").select("entry_id").distinct()


@query
def r4_promote_deferred(spark: SparkSession, d: str) -> DataFrame:
    held = a.held_rows(spark, d)
    no_text = a.notices(spark, d).withColumn("text", F.lit(""))
    judged = validate.judge_events(held, no_text, a.firms(spark, d), RULES, a.now(), a.CALENDAR_ZONE)
    judged = cut_lineage(judged.select(*POST, "event_ord", "event_key", "reason", "retryable"), "judged")
    promoted, still, dropped = reconcile.promote_deferred(judged, a.before(spark, d))
    out = None
    for name, rows in (("publish", promoted), ("held", still), ("rejected", dropped)):
        part = rows.select(*POST, "event_ord", "event_key", F.lit(name).alias("outcome"))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("event_key", F.when(F.col("outcome") == "publish", F.col("event_key")))


@query
def r5_recover_unchanged(spark: SparkSession, d: str) -> DataFrame:
    rows = reconcile.recover_unchanged(a.before(spark, d), a.extraction(spark, d))
    return rows.select(*POST, "event_key", "action", "entry_id")


@query
def r6_prune(spark: SparkSession, d: str) -> DataFrame:
    held = a.held_rows(spark, d).filter("affected is null")
    kept = reconcile.prune(a.post_state(spark, d), a.tracked(spark, d), held, a.later())
    return kept.select(*POST, "arrival_seq")


@query
@windows_once
def r7_apply_plan(spark: SparkSession, d: str) -> DataFrame:
    arrivals = a.post_state(spark, d)
    after = reconcile.apply_plan(a.before(spark, d), _plan(spark, d), a.extracted_posts(spark, d), arrivals)
    return after.select(*POST, "arrival_seq", "event_key", "entry_id", "event_type", "summary", "start_iso")


@query
@windows_once
def r8_run_firms(spark: SparkSession, d: str) -> DataFrame:
    """A whole sync over all firms with state; the pages of one firm could not be read, the others go on."""
    posts = a.notices(spark, d).select(*POST, "text", "url", F.col("arrival_seq").alias("pos"))
    posts, ballots = cut_lineage(posts, "posts"), cut_lineage(a.ballots(spark, d), "ballots")  # both are read many times
    tables = {
        "post_state": cut_lineage(a.post_state(spark, d), "post-state"),
        "tracked": a.before(spark, d),
        "deferred": a.held_rows(spark, d),
        "rejected_lines": spark.createDataFrame([], state.STATE_TABLES["rejected_lines"]),
    }
    firms = a.firms(spark, d).withColumn("keywords", F.array(F.lit("platform")))
    poisoned = a.firms(spark, d).filter("firm = 'u7'").select("firm", F.lit("listing unreadable").alias("message"))
    result = sync.sync(
        posts, ballots, tables, firms, RULES, a.now(), list(a.MEMBERS), scrape_errors=poisoned, inventory=a.inventory(spark, d), real_calendar=True
    )
    return result.outcomes.select("firm", "status", "posts_seen", "posts_relevant", "events_created", "events_deleted", "events_kept", "rejections")


@query
def w7_refcount_timeline(spark: SparkSession, d: str) -> DataFrame:
    """Every window of a firm requested and released along its posts."""
    w = a.windows(spark, d)
    adds = F.col("value") >= 20
    refs = w.select(
        *reconcile.WINDOW,
        F.col("arrival_seq").alias("proc_ord"),
        F.when(adds, 1).otherwise(0).alias("step"),
        F.col("pos").alias("tie"),
        F.when(adds, 1).otherwise(-1).alias("delta"),
    )
    opening = reconcile.opening_balance(a.before(spark, d), True)
    rows = reconcile.refcount_timeline(refs, opening)
    return rows.select("firm", F.col("tie").alias("pos"), "before", "balance")


# --- reports -------------------------------------------------------------------------------


def _post_status(spark: SparkSession, d: str) -> DataFrame:
    rows = a.windows(spark, d).groupBy("firm", "post_key").agg(
        F.max("value").alias("top"), F.min("k").alias("k")
    )
    return rows.select(
        *POST,
        (F.col("top") >= 60).alias("relevant"),
        F.when(F.col("k") % 10 == 0, "unchanged").otherwise("changed").alias("status"),
    )


def _rejections(spark: SparkSession, d: str) -> DataFrame:
    judged = _judged(spark, d, RULES).select(*validate.REJECTED)
    return validate.rejected(cut_lineage(judged, "judged"))


def _merges(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.merge_duplicates(a.tracked(spark, d), a.now())[1]


def _reports(spark: SparkSession, d: str) -> DataFrame:
    return report.run_report(
        _post_status(spark, d), _plan(spark, d), _rejections(spark, d), _merges(spark, d)
    )


@query
@windows_once
def g1_run_report(spark: SparkSession, d: str) -> DataFrame:
    return _reports(spark, d).select("firm", *report.COUNTERS)


@query
def g2_totals(spark: SparkSession, d: str) -> DataFrame:
    runs = a.events(spark, d).groupBy(
        F.dayofmonth("at").cast("long").alias("run_id"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("firm"),
    ).agg(
        F.count_if(F.col("event_type") == "signup").alias("events_created"),
        F.count_if(F.col("event_type") == "click").alias("events_deleted"),
        F.count("*").alias("posts_seen"),
    )
    return report.totals(runs).select(
        "run_id", "firm", "level", "posts_seen", "events_created", "events_deleted"
    )


@query
@windows_once
def f10_report_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = _reports(spark, d).withColumn("anomalies", F.col("events_deleted"))
    return report.report_summary(rows).select("firm", "summary")


@query
def g3_run_failed(spark: SparkSession, d: str) -> DataFrame:
    log = a.run_log(spark, d).withColumn("run_id", F.unix_timestamp(F.date_trunc("hour", "ts")))
    return health.run_failed(log).select("run_id", "failed", "firms")


def _anomalies(spark: SparkSession, d: str) -> DataFrame:
    diff = reconcile.diff_events(a.before(spark, d), a.extraction(spark, d), a.extracted_posts(spark, d), a.now())
    errors = a.run_log(spark, d).groupBy("firm").agg(F.max("error").alias("error"))
    return report.detect_anomalies(
        _post_status(spark, d), reconcile.shrink_guard(diff), _rejections(spark, d), errors
    )


@query
@windows_once
def g4_detect_anomalies(spark: SparkSession, d: str) -> DataFrame:
    return _anomalies(spark, d).select("firm", "code", "post_key", "anomaly")


@query
def g5_calendar_counts(spark: SparkSession, d: str) -> DataFrame:
    held = a.held_rows(spark, d)
    lines = report.rejected_lines(_rejections(spark, d))
    return report.calendar_counts(a.post_state(spark, d), a.tracked(spark, d), held, lines, a.now())


@query
def s12_calendar_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = a.windows(spark, d).withColumn("description", F.concat("url", F.lit(" "), "evidence"))
    out = report.calendar_rows(rows, a.CALENDAR_ZONE, (30, 10))
    return out.select(
        "reconcile_key",
        "summary",
        "description",
        F.concat_ws(" ", "start.date_time", "start.time_zone").alias("start"),
        F.concat_ws(" ", "end.date_time", "end.time_zone").alias("end"),
        "default_reminders",
        F.array_join(F.transform("reminders", lambda r: F.concat_ws(":", r["method"], r["minutes"].cast("string"))), ",").alias(
            "reminders"
        ),
    )


@query
@windows_once
def s13_payload_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = report.payload_lines(_plan(spark, d), _anomalies(spark, d))
    return lines.select("firm", "kind", "post_key", "line")


@query
def f9_describe(spark: SparkSession, d: str) -> DataFrame:
    w = a.windows(spark, d)
    start = F.when(F.col("k") >= 10, F.col("start_iso")).otherwise("")
    title = F.when(F.col("k") < 50, F.col("summary")).otherwise("")
    end = F.when(F.col("k") >= 5, F.col("end_iso")).otherwise("later")
    return w.select(
        "pos",
        report.describe_event(F.col("summary"), F.col("start_at"), F.col("end_at"), a.CALENDAR_ZONE).alias("event"),
        report.describe_tracked(title, F.col("event_key"), start, end).alias("tracked"),
    )


# --- health and usage ----------------------------------------------------------------------


def _health(spark: SparkSession, d: str) -> DataFrame:
    return health.firm_health(
        a.run_log(spark, d), a.health_now(), timecols.iso_instant(F.lit("2024-01-01T00:00:00")), 10 * 3600
    )


@query
def g6_firm_health(spark: SparkSession, d: str) -> DataFrame:
    return _health(spark, d).select(
        "firm",
        timecols.utc_text(F.col("last_success")).alias("last_success"),
        "last_error",
        "anomalies",
        "runs_ok",
        "runs_failed",
        F.floor("age_seconds").alias("age_seconds"),
        "stale",
        "status",
    )


@query
def g7_overall_health(spark: SparkSession, d: str) -> DataFrame:
    row = health.overall_health(
        a.run_log(spark, d), _health(spark, d), a.health_now(), a.now(), 10 * 3600
    )
    return row.select(
        "status",
        timecols.utc_text(F.col("last_run")).alias("last_run"),
        timecols.utc_text(F.col("last_success")).alias("last_success"),
        timecols.utc_text(F.col("next_run")).alias("next_run"),
        "last_error",
        "anomalies",
        "runs_ok",
        "runs_failed",
        "unhealthy",
    )


@query
def g7_unhealthy_firms(spark: SparkSession, d: str) -> DataFrame:
    rows = health.unhealthy(_health(spark, d))
    return rows.select("firm", "status", timecols.utc_text(F.col("since")).alias("since"))


@query
def f11_humanize(spark: SparkSession, d: str) -> DataFrame:
    age = (F.unix_micros(a.now()) - F.unix_micros("at")) / 1_000_000
    scale = F.when(F.col("k") < 50, 1.0).otherwise(0.001)
    return a.events(spark, d).select("event_id", timecols.humanize(F.floor(age * scale)).alias("age"))


@query
def w5_notify_once(spark: SparkSession, d: str) -> DataFrame:
    return health.notify_once(a.run_log(spark, d)).select("firm", "run_id", "error")


@query
def w6_heartbeat_due(spark: SparkSession, d: str) -> DataFrame:
    return health.heartbeat_due(a.run_log(spark, d), 1.0).select("firm", _utc("ts").alias("sent_utc"))


@query
def g8_usage_stats(spark: SparkSession, d: str) -> DataFrame:
    daily = usage.usage_stats(a.access_log(spark, d), a.monitor())
    return daily.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "views", "visitors", "feed_hits", "feed_clients")


@query
def g8_usage_totals(spark: SparkSession, d: str) -> DataFrame:
    return usage.usage_totals(usage.usage_stats(a.access_log(spark, d), a.monitor()))


# --- crawl ---------------------------------------------------------------------------------


@query
def s7_classify_fetch(spark: SparkSession, d: str) -> DataFrame:
    rows = crawl.classify_fetch(a.fetch_log(spark, d))
    return rows.groupBy("outcome", F.col("attempt").cast("long").alias("attempt")).agg(
        F.count("*").alias("n"), F.max(timecols.utc_text(F.col("next_attempt_at"))).alias("latest_next")
    )


@query
def s7_fetch_outcomes(spark: SparkSession, d: str) -> DataFrame:
    rows = crawl.fetch_outcomes(a.fetch_log(spark, d))
    return rows.select(
        "url",
        F.col("attempts").cast("long").alias("attempts"),
        "outcome",
        timecols.utc_text(F.col("next_attempt_at")).alias("next_attempt"),
    )


@query
def s8_robots_allowed(spark: SparkSession, d: str) -> DataFrame:
    urls = a.pages(spark, d).select("url")
    return crawl.robots_allowed(urls, _robots(spark, d)).select("url", "allowed", "crawl_delay")


def _robots(spark: SparkSession, d: str) -> DataFrame:
    hosts = a.pages(spark, d).select(crawl.host_of(F.col("url")).alias("host")).distinct()
    body = (
        F.when(F.col("host").contains("blog."), "User-agent: *\nDisallow: /en/ # no\nAllow: /\nCrawl-delay: 40\n")
        .when(F.col("host").contains("www."), "User-Agent: NoticeWindowsBot\nAllow: /fr\nDisallow: /\n\nUser-agent: *\nDisallow:\n")
        .when(F.col("host").contains("//m."), "User-agent: other\nUser-agent: mozilla\ndisallow: /es/%35\nCrawl-delay: 4\n\nDisallow: /\n")
        .otherwise("User-agent: *\n\nDisallow: /\n")
    )
    return hosts.select(
        "host", F.when(F.col("host").contains(".net"), 503).otherwise(200).alias("http_status"), body.alias("body")
    )


@query
def s9_plan_crawl(spark: SparkSession, d: str) -> DataFrame:
    ev = a.events(spark, d)
    host = F.concat(F.lit("https://h"), F.floor(F.col("user_id") / 50).cast("string"))
    frontier = ev.select(host.alias("host"), F.col("event_id").alias("req_id"), F.date_trunc("hour", "at").alias("requested_at"))
    delays = frontier.groupBy("host").agg(
        F.when(F.max("req_id") > 0, 30.0).alias("crawl_delay")
    ).filter("host <> 'https://h0'")
    slots = crawl.plan_crawl(frontier, delays)
    return slots.select("host", "req_id", _utc("slot_at"))


@query
@windows_once
def s10_state_round_trip(spark: SparkSession, d: str) -> DataFrame:
    root = run_folder(spark, "state")
    tables = {
        "post_state": a.post_state(spark, d),
        "tracked": a.tracked(spark, d),
        "deferred": a.held_rows(spark, d),
        "rejected_lines": report.rejected_lines(_rejections(spark, d)),
    }
    state.write_state(spark, root, 1, tables)
    back, _ = state.read_state(spark, root)
    held = back["deferred"].groupBy(*POST).agg(F.count("*").alias("held"))
    mine = back["tracked"].groupBy(*POST).agg(F.count("*").alias("tracked"), F.max("event_key").alias("last_key"))
    return back["post_state"].join(mine, POST, "left").join(held, POST, "left").select(
        *POST, "content_hash", "deferred_known", "tracked", "last_key", "held"
    )


# --- evaluation ----------------------------------------------------------------------------


def _eval(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Expected rows, rows found by the members as runs, the runs, the texts."""
    case = F.col("post_key").alias("case_id")
    expected = a.raw_events(spark, d).select(case, *a.RAW[2:])
    ballots = a.ballots(spark, d)
    runs = ballots.select(case, F.col("ballot_ord").alias("run"), "voter", "error")
    got = vote.ballot_rows(ballots).select(case, F.col("ballot_ord").alias("run"), *a.RAW[2:])
    return expected, got, runs, a.notices(spark, d).select(case, "text")


def _score(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.score(*_eval(spark, d))


@query
def g9_score(spark: SparkSession, d: str) -> DataFrame:
    return _score(spark, d).withColumn("run", F.col("run").cast("long"))


@query
def g10_norm_offset(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k").cast("string")
    stated = (
        F.when(F.col("k") < 20, F.concat(F.lit("gmt+"), k))
        .when(F.col("k") < 40, F.concat(F.lit(" UTC-0"), k, F.lit(":5 ")))
        .when(F.col("k") < 60, F.concat(F.lit("+03"), k))
        .when(F.col("k") < 80, F.concat(F.lit(" local "), k))
        .when(F.col("k") < 90, "")
    )
    return a.events(spark, d).select("event_id", evaluate.norm_offset(stated).alias("offset"))


@query
def g11_case_result(spark: SparkSession, d: str) -> DataFrame:
    expected, got, runs, texts = _eval(spark, d)
    scores = evaluate.score(expected, got, runs, texts)
    results = evaluate.case_result(scores, evaluate.identity_sets(got, runs), max_missing=2, max_extra=1)
    return results.select(
        "case_id", "runs", "passed", "stable", "missing", "extra", "offset_mismatches", "errors",
        "evidence_verified", "evidence_total",
    )


@query
def g11_report(spark: SparkSession, d: str) -> DataFrame:
    expected, got, runs, texts = _eval(spark, d)
    scores = evaluate.score(expected, got, runs, texts)
    return evaluate.report(
        evaluate.case_result(scores, evaluate.identity_sets(got, runs), max_missing=2, max_extra=1)
    )


@query
def g12_juror_scores(spark: SparkSession, d: str) -> DataFrame:
    expected, got, runs, texts = _eval(spark, d)
    scores = evaluate.score(expected, got, runs, texts).join(
        runs.select("case_id", "run", "voter"), ["case_id", "run"]
    )
    return evaluate.juror_scores(scores, max_missing=1, max_extra=0)


@query
def g13_extraction_cost(spark: SparkSession, d: str) -> DataFrame:
    posts = post_ops.with_hash(a.documents(spark, d))
    known = a.document_state(spark, d).withColumn("firm", F.col("source"))
    return evaluate.extraction_cost(post_ops.changed_posts(posts, known), 3)


@query
def w9_key_sets(spark: SparkSession, d: str) -> DataFrame:
    expected, got, runs, _ = _eval(spark, d)
    answered = runs.filter("error is null").select("case_id", "run")
    return evaluate.key_sets(expected.join(answered, "case_id"), got).withColumn("run", F.col("run").cast("long"))


# --- feeds ---------------------------------------------------------------------------------


def _feed_rows(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d)


@query
def s11_export_feed(spark: SparkSession, d: str) -> DataFrame:
    """Every selection as a feed: all windows, one type, one firm, two types of one firm; folded, with a zone block."""
    lines = feed.feed_lines(
        _feed_rows(spark, d), _selections(spark, d), a.catalog(spark, d), a.now(), a.CALENDAR_ZONE
    )
    numbers = [F.col(c).cast("long").alias(c) for c in ("part", "line_in_block", "fold_no")]
    return lines.select("feed_id", "arrival_seq", "pos", *numbers, "line")


@query
def s11_export_feed_files(spark: SparkSession, d: str) -> DataFrame:
    """Feeds written as packed text and read back: lines and octets per feed, in a zone with a zone block."""
    lines = feed.feed_lines(
        _feed_rows(spark, d), _selections(spark, d), a.catalog(spark, d), a.now(), a.CALENDAR_ZONE, (15,), 60, blocks_only=True
    )
    path = run_folder(spark, "feeds")
    feed.export_feed(lines, path, compression="gzip")
    back = spark.read.option("lineSep", "\r\n").schema("value string, feed_id string").text(path)
    return back.groupBy("feed_id").agg(
        F.count_if(~F.col("value").startswith(" ")).alias("lines"),
        F.count_if(F.col("value") == "BEGIN:VEVENT").alias("events"),
        F.count_if(F.col("value") == "TZOFFSETTO:+0300").alias("zone_lines"),
        (F.max(F.octet_length("value")) <= 75).alias("folded"),
    )


@query
def f1_ics_escape(spark: SparkSession, d: str) -> DataFrame:
    docs = a.documents(spark, d)
    text = F.concat("text", F.lit("; a,b \\ c\r\n"), "url")
    return docs.select("doc_id", textcols.ics_escape(text).alias("escaped"))


@query
def f2_ics_fold(spark: SparkSession, d: str) -> DataFrame:
    docs = a.documents(spark, d)
    line = F.concat(F.lit("DESCRIPTION:"), textcols.ics_escape(F.col("text")))
    rows = docs.select("doc_id", line.alias("line"), textcols.ics_fold(line).alias("parts"))
    plain = F.octet_length("line") == F.length("line")
    joined = F.concat(
        F.get("parts", 0), F.array_join(F.transform(F.slice("parts", 2, 1 << 30), lambda p: F.substring(p, 2, 1 << 30)), "")
    )
    return rows.select(
        "doc_id",
        F.sha2(joined, 256).alias("unfolded_hash"),
        (F.array_max(F.transform("parts", lambda p: F.octet_length(p))) <= 75).alias("short"),
        (F.array_min(F.transform("parts", lambda p: F.octet_length(p))) > 0).alias("filled"),
        F.when(plain, F.size("parts").cast("bigint")).alias("n_parts"),
        F.when(plain, F.octet_length(F.element_at("parts", -1)).cast("bigint")).alias("last_octets"),
    )


@query
def f3_ics_stamp(spark: SparkSession, d: str) -> DataFrame:
    w = a.windows(spark, d)
    return w.select(
        "pos",
        feed.ics_stamp("DTSTART", F.col("start_at"), F.lit("Etc/GMT-3"), F.col("k") >= 20).alias("start"),
        feed.ics_stamp("DTEND", F.col("end_at"), F.lit("America/Chicago"), F.lit(True)).alias("end"),
    )


def _spans(spark: SparkSession, d: str) -> DataFrame:
    """First and last window per firm, in the zone of the firm."""
    spans = a.windows(spark, d).groupBy("firm").agg(F.min("start_at").alias("first_at"), F.max("end_at").alias("last_at"))
    return spans.join(a.firms(spark, d), "firm").select(F.col("firm").alias("id"), F.col("timezone").alias("zone"), "first_at", "last_at")


@query
def f4_offset_transitions(spark: SparkSession, d: str) -> DataFrame:
    probe = _spans(spark, d).select(
        "id",
        "zone",
        (F.col("first_at") - F.expr("interval 366 day")).alias("from_at"),
        (F.col("last_at") + F.expr("interval 366 day")).alias("to_at"),
    )
    return feed.offset_transitions(probe).select("id", _utc("onset_at"), "before_s", "after_s")


@query
def f5_vtimezone_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = feed.vtimezone_lines(_spans(spark, d))
    return rows.select("id", "block_ord", F.array_join("lines", "|").alias("lines"))


@query
def f6_calendar_name(spark: SparkSession, d: str) -> DataFrame:
    facts = windows.select_feed(_rows(spark, d), _selections(spark, d)).groupBy("feed_id").agg(
        F.when(F.min("firm") == F.max("firm"), 1).otherwise(2).alias("n_firms"), F.min("firm").alias("one_firm")
    )
    return feed.calendar_name(_selections(spark, d).join(facts, "feed_id", "left"), a.catalog(spark, d))


@query
def f7_event_block(spark: SparkSession, d: str) -> DataFrame:
    w = a.windows(spark, d).withColumn("link", F.col("url"))
    block = feed.event_block(w, F.lit(a.CALENDAR_ZONE), F.col("k") >= 50, a.now(), (30,))
    return w.select("pos", F.posexplode(block).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("long"))


@query
def f8_feed_problems(spark: SparkSession, d: str) -> DataFrame:
    """The exported feeds of every firm, each damaged in a way that its name decides."""
    lines = feed.feed_lines(
        _feed_rows(spark, d), _selections(spark, d), a.catalog(spark, d), a.now(), "America/Chicago", blocks_only=True
    )
    numbered = feed.number_lines(lines)
    last = F.substring("feed_id", -1, 1)
    line = F.col("line")
    broken = numbered.withColumn(
        "line",
        F.when((last == "1") & line.startswith("UID:"), "UID:same")
        .when((last == "2") & line.startswith("DTSTAMP"), "X-STAMP:1")
        .when((last == "3") & (line == "END:VTIMEZONE"), "END:VTIME")
        .when((last == "4") & line.startswith("SUMMARY"), F.concat(line, F.lit("x" * 80)))
        .when((last == "5") & line.startswith("TZID:"), "TZID:Nowhere")
        .when((last == "6") & (line == "VERSION:2.0"), "X-VERSION:2.0")
        .when((last == "7") & (line == "END:VCALENDAR"), "END")
        .otherwise(line),
    ).withColumn("ended", (last != "8") | ~line.startswith("END:VCALENDAR"))
    broken = cut_lineage(broken, "exported")  # a feed is checked after it was exported
    return feed.feed_problems(broken).groupBy("feed_id", "code").agg(
        F.count("*").alias("n"), F.max("detail").alias("detail")
    )


# --- streams -------------------------------------------------------------------------------


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    schema = a.table(spark, d, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(d)


def _in_four(rows: DataFrame, by: str, folder: str) -> Iterator[DataFrame]:
    """A stream of all rows as they stand after each of four steps in the order of ``by`` (a long)."""
    low, high = rows.agg(F.min(by), F.max(by)).first()
    step = F.floor((F.col(by) - F.lit(low or 0)) * 4 / F.lit((high or 0) - (low or 0) + 1))
    for n in range(4):
        rows.filter(F.coalesce(step, F.lit(0)) == n).write.mode("append").parquet(f"{folder}/in")
        yield rows.sparkSession.readStream.schema(rows.schema).parquet(f"{folder}/in")


@query
def t1_changed_posts_stream(spark: SparkSession, d: str) -> DataFrame:
    """Documents as snapshots of one post per (source, language), in the order of their ids, in four steps."""
    folder = run_folder(spark, "t1")
    for docs in _in_four(a.table(spark, d, "documents"), "doc_id", folder):
        snapshots = docs.select(
            F.col("source").alias("firm"),
            F.col("lang").alias("post_key"),
            F.col("doc_id").alias("snapshot_id"),
            timecols.iso_instant(F.lit("2024-01-01")).alias("seen_at"),
            "text",
        )
        streams.changed_posts_stream(snapshots, folder).awaitTermination()
    out = streams.changes_so_far(streams.snapshot_rows(snapshots), folder)
    return out.select("firm", "post_key", "snapshot_id", "content_hash")


@query
@windows_once
def t2_reconcile_stream(spark: SparkSession, d: str) -> DataFrame:
    """The state before a run, then a micro-batch for each quarter of the firms, and the state after all of them.

    A batch reads and writes the state partitions of its firms: plan, duplicates, expired posts."""
    root, folder = run_folder(spark, "t2-state"), run_folder(spark, "t2")
    tables = {**state.empty_state(spark), "post_state": a.post_state(spark, d), "tracked": a.before(spark, d)}
    state.write_state(spark, root, 0, tables)
    inventory = a.inventory(spark, d)

    def firms_of(batch: DataFrame) -> DataFrame:
        return batch.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("firm")).distinct()

    def sync(old: dict[str, DataFrame], batch: DataFrame, batch_id: int) -> dict[str, DataFrame]:
        w = a.written_windows(batch)
        extracted = a.shape_extracted_posts(w)
        plan = reconcile.reconcile(
            old["tracked"], a.shape_extraction(w), extracted, inventory, a.now(), real_calendar=True
        )
        after = cut_lineage(reconcile.apply_plan(old["tracked"], plan, extracted, old["post_state"]), "tracked")
        after, _ = reconcile.merge_duplicates(after, a.now())
        posts = reconcile.prune(old["post_state"], after, old["deferred"], a.now())
        return {**old, "post_state": posts, "tracked": after.join(posts.select(*POST), POST, "left_semi")}

    events = a.table(spark, d, "events")
    for quarter in range(4):
        events.filter(F.pmod("user_id", F.lit(4)) == quarter).write.mode("append").parquet(f"{folder}/in")
        rows = spark.readStream.schema(events.schema).parquet(f"{folder}/in")
        streams.reconcile_stream(rows, root, f"{folder}/checkpoint", sync, firms_of).awaitTermination()
    tracked = state.read_state(spark, root)[0]["tracked"]
    return tracked.select(*POST, "arrival_seq", "event_key", "entry_id", "event_type", "summary", "start_iso")


def _between(rows: DataFrame, bounds: list[str | None]) -> list[DataFrame]:
    """All rows in steps: those before each bound (ISO) and after the one before it."""
    at = F.col("at")
    cuts = [None, *[timecols.iso_instant(F.lit(b)) for b in bounds], None]
    out = []
    for low, high in zip(cuts, cuts[1:], strict=False):
        step = rows if low is None else rows.filter(at >= low)
        out.append(step if high is None else step.filter(at < high))
    return out


def _with_clock(rows: DataFrame, tick: str) -> DataFrame:
    """``rows`` and a clock row."""
    clock = rows.sparkSession.range(1).select(*[
        (timecols.iso_instant(F.lit(tick)) if f.name == "at" else F.lit(None).cast(f.dataType)).alias(f.name) for f in rows.schema
    ])
    return rows.unionByName(clock)


HELD_SINCE = "2024-01-01T00:00:00"
CLOCKS = (HELD_SINCE, "2024-01-08T06:00:00", a.NOW)


@query
def t3_deferred_release_stream(spark: SparkSession, d: str) -> DataFrame:
    """Rows that are too far ahead at the first clock, released by the clocks after it."""
    streams.use_rocksdb(spark)
    no_text = a.notices(spark, d).withColumn("text", F.lit(""))
    first = timecols.iso_instant(F.lit(HELD_SINCE))
    judged = validate.judge_events(a.held_rows(spark, d), no_text, a.firms(spark, d), RULES, first, a.CALENDAR_ZONE)
    judged = cut_lineage(judged.select(*POST, "event_ord", "start_at", "end_at", "retryable"), "judged")
    held = judged.filter("retryable").select(*POST, "event_ord", "start_at", "end_at", first.alias("at"))
    later = [_with_clock(held.limit(0), tick) for tick in CLOCKS[1:]]
    out = streams.run_in_steps(
        [_with_clock(held, HELD_SINCE), *later], lambda rows: timers.deferred_release(rows, RULES.max_days_ahead), run_folder(spark, "t3")
    )
    return out.select(*POST, "event_ord", "outcome", timecols.utc_text(F.col("clock")).alias("clock"))


@query
def t4_state_expiry(spark: SparkSession, d: str) -> DataFrame:
    """Every window of the log is a sighting of its post; what is left at a late clock is what pruning would keep."""
    streams.use_rocksdb(spark)
    w = a.windows(spark, d)
    held = F.when((F.col("event_type") == "crypto_closure") & F.col("affected").isNull(), 1).otherwise(0)
    sightings = w.select(*POST, "at", "end_at", held.cast("long").alias("held"))
    steps = _between(sightings, ["2024-01-11T00:00:00", "2024-01-21T00:00:00"])
    steps[-1] = _with_clock(steps[-1], a.LATER)
    gone = streams.run_in_steps(steps, timers.state_expiry, run_folder(spark, "t4"))
    gone = gone.groupBy(*POST).agg(F.max("last_seen").alias("gone_seen"))
    posts = a.post_state(spark, d).join(gone, POST, "left")
    kept = posts.filter(F.col("gone_seen").isNull() | (F.col("last_seen") > timecols.shift(F.col("gone_seen"), F.lit(1))))
    return kept.select(*POST, "arrival_seq")


@query
def t5_stale_sources(spark: SparkSession, d: str) -> DataFrame:
    """Sources that are silent at the last clock: users, and nations, which never had a run."""
    streams.use_rocksdb(spark)
    log = a.run_log(spark, d).select("firm", F.col("ts").alias("at"), "error")
    nations = a.table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("firm"))
    started = timecols.iso_instant(F.lit("2024-01-01T00:00:00")).alias("started_at")
    sources = a.firms(spark, d).select("firm").unionByName(nations).select("firm", started)
    steps = _between(log, ["2024-01-11T00:00:00", "2024-01-21T00:00:00"])
    steps[-1] = _with_clock(steps[-1], "2024-01-31T06:00:00")
    told = streams.run_in_steps(steps, lambda rows: timers.stale_sources(rows, sources, 10 * 3600), run_folder(spark, "t5"))
    last = told.groupBy("firm").agg(F.max_by(F.struct("stale", "last_success"), "at").alias("last"))
    return last.filter("last.stale").select("firm", timecols.utc_text(F.col("last.last_success")).alias("last_success"))


@query
def t6_usage_stats_stream(spark: SparkSession, d: str) -> DataFrame:
    """Every day of the log, those included that the watermark has not closed."""
    access = a.shape_access(a.shape_events(_stream(spark, d, "events")))
    daily = streams.usage_stats_so_far(access, a.monitor(), run_folder(spark, "t6"))
    return daily.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "views", "visitors", "feed_hits", "feed_clients")


@query
def t7_notify_once_stream(spark: SparkSession, d: str) -> DataFrame:
    """The runs of all firms in four steps of time."""
    folder = run_folder(spark, "t7")
    for events in _in_four(a.table(spark, d, "events").withColumn("_at", F.unix_micros(F.col("ts").cast("timestamp"))), "_at", folder):
        log = a.shape_runs(a.shape_events(events.drop("_at"))).select("firm", "run_id", "ts", "error")
        streams.notify_once_stream(log, folder).awaitTermination()
    return streams.changes_so_far(log, folder).select("firm", "run_id", "error")
