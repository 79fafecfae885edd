"""Raw extracted rows to validated windows or rejections, in one pass of column expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticewindows import fixed_values as fv
from noticewindows.functions import textcols, timecols
from noticewindows.session import cut_lineage


@dataclass(frozen=True)
class EventRules:
    """Parameters of validation and reconciliation."""

    max_duration_hours: int = fv.MAX_DURATION_HOURS
    max_days_ahead: int = fv.MAX_DAYS_AHEAD
    reject_low_confidence: bool = False
    low_confidence_marker: str = fv.LOW_CONFIDENCE_MARKER
    delete_on_empty_extraction: bool = False
    require_evidence: bool = False
    summaries: dict[str, str] = field(default_factory=lambda: dict(fv.SUMMARIES))


def with_words(posts: DataFrame) -> DataFrame:
    """Posts with their words, computed once per post and not once per extracted row."""
    return posts.withColumn("text_words", textcols.words(F.col("text")))


def check_times(raw: DataFrame, rules: EventRules, now: Column) -> DataFrame:
    """Add ``start_at``, ``end_at`` and the first time rule that fails (``time_reason``).

    ``raw`` carries the firm's ``timezone`` and ``require_stated_offset``.  When both bounds fall
    back to the zone, order and length are judged on the clock, otherwise on instants.
    """
    offset = F.when(F.col("stated_utc_offset") != "", timecols.offset_of_parts(F.col("_o_text"), F.col("_o_parts")))
    start, end = F.col("start_time"), F.col("end_time")
    # columns of their own, so that their patterns are searched once per row
    rows = raw.withColumn("_o_text", timecols.strip(F.col("stated_utc_offset")))
    rows = rows.withColumn("_o_parts", timecols.offset_parts(F.col("_o_text")))
    rows = rows.withColumns(
        {
            "_s_local": timecols.iso_local(start),
            "_e_local": timecols.iso_local(end),
            "_s_own": timecols.iso_offset_s(start),
            "_e_own": timecols.iso_offset_s(end),
            "_stated": offset,
        }
    )
    s_own, e_own = F.col("_s_own"), F.col("_e_own")
    s_local, e_local = F.col("_s_local"), F.col("_e_local")
    zone, stated = F.col("timezone"), F.col("_stated")
    rows = rows.withColumns(
        {
            "start_at": timecols.to_instant(s_local, s_own, stated, zone),
            "end_at": timecols.to_instant(e_local, e_own, stated, zone),
        }
    )
    on_clock = s_own.isNull() & e_own.isNull()
    length = F.when(on_clock, F.unix_micros(e_local) - F.unix_micros(s_local)).otherwise(
        F.unix_micros("end_at") - F.unix_micros("start_at")
    )
    bad = F.when(s_local.isNull(), start).otherwise(end)
    naive = s_own.isNull() | e_own.isNull()
    micros = 1_000_000
    reason = (
        F.when(
            s_local.isNull() | e_local.isNull(),
            F.concat(F.lit(fv.REASON_UNPARSEABLE + "'"), F.coalesce(bad, F.lit("")), F.lit("'")),
        )
        .when(F.col("require_stated_offset") & stated.isNull() & naive, fv.REASON_NO_OFFSET)
        .when(length <= 0, fv.REASON_ORDER)
        .when(
            length > rules.max_duration_hours * 3600 * micros,
            f"duration exceeds {rules.max_duration_hours}h sanity cap",
        )
        .when(
            F.col("start_at") > timecols.shift(now, F.lit(rules.max_days_ahead * 86_400)),
            fv.REASON_TOO_FAR,
        )
        .when(F.col("end_at") <= now, fv.REASON_ENDED)
    )
    return rows.withColumn("time_reason", reason).drop("_s_local", "_e_local", "_s_own", "_e_own", "_stated", "_o_text", "_o_parts")


def _quotes_judged(raw: DataFrame, posts: DataFrame) -> DataFrame:
    """``q_firm, q_post, quote, quote_verdict, quote_line`` of the different quotes of each post: here alone quotes and
    whole texts meet, and a quote that many rows share is cleaned and judged once."""
    quotes = raw.select(F.col("firm").alias("q_firm"), F.col("post_key").alias("q_post"), F.col("evidence").alias("quote"))
    quotes = quotes.filter("quote is not null").distinct().withColumn("quote_words", textcols.words(F.col("quote")))
    texts = with_words(posts.select("firm", "post_key", "text"))
    found = textcols.quote_found(F.col("quote_words"), F.col("text"), F.col("text_words"))
    verdict = textcols.quote_verdict(F.col("quote"), F.col("quote_words"), F.coalesce(found, F.lit(True)))
    own = (F.col("q_firm") == F.col("firm")) & (F.col("q_post") == F.col("post_key"))
    return quotes.join(texts, own, "left").select(
        "q_firm", "q_post", "quote", verdict.alias("quote_verdict"), textcols.clean_evidence(F.col("quote")).alias("quote_line")
    )


def judge_events(
    raw: DataFrame,
    posts: DataFrame,
    firms: DataFrame,
    rules: EventRules,
    now: Column,
    calendar_zone: str = "UTC",
) -> DataFrame:
    """Every raw row with its verdict: ``reason`` NULL when accepted, and the window's columns.

    A verdict is a long expression.  A filter on it would be copied, expression and all, below every step it is made
    of, into code too large to compile; callers that filter verdicts write them first (``cut_lineage``).

    ``raw``: firm, post_key, event_ord and the extracted fields.  ``posts``: firm, post_key, text,
    url; a post without text accepts its quotes.  ``firms``: firm, timezone, require_stated_offset.
    """
    post = ["firm", "post_key"]
    # of a post only its link and the start of its text go onto its rows; one character more than is shown
    heads = posts.select(*post, "url", F.substring("text", 1, fv.EXCERPT_CHARS + 1).alias("excerpt"))
    rows = raw.join(heads, post, "left").join(
        firms.select("firm", "timezone", "require_stated_offset"), "firm", "left"
    )
    rows = rows.withColumns(
        {
            "timezone": F.coalesce("timezone", F.lit(fv.DEFAULT_ZONE)),
            "require_stated_offset": F.coalesce("require_stated_offset", F.lit(False)),
            "confidence": F.coalesce("confidence", F.lit("high")),
        }
    )
    rows = check_times(rows, rules, now)
    pairs = (("firm", "q_firm"), ("post_key", "q_post"), ("evidence", "quote"))
    own = [F.col(mine).eqNullSafe(F.col(theirs)) for mine, theirs in pairs]
    rows = rows.join(_quotes_judged(raw, posts), own, "left").drop("q_firm", "q_post", "quote")
    rows = rows.withColumn("quote_verdict", F.coalesce("quote_verdict", F.lit("none")))  # no quote at all
    reason = F.coalesce(
        "time_reason",
        F.when((F.col("confidence") == "low") & F.lit(rules.reject_low_confidence), fv.REASON_LOW),
    )
    if rules.require_evidence:
        no_quote = (
            F.when(F.col("quote_verdict") == "none", fv.REASON_NO_EVIDENCE)
            .when(F.col("quote_verdict") == "short", fv.REASON_SHORT_EVIDENCE)
            .when(F.col("quote_verdict") == "unfound", fv.REASON_UNFOUND_EVIDENCE)
        )
        reason = F.coalesce(reason, no_quote)
    low = (F.col("confidence") == "low") | (F.col("quote_verdict") == "unfound")
    rows = rows.withColumns(
        {
            "reason": reason,
            "low": low,
            "kept_evidence": F.when(F.col("quote_verdict") == "ok", F.col("quote_line")).otherwise(""),
            "start_iso": timecols.iso_in_zone(F.col("start_at"), calendar_zone),
            "end_iso": timecols.iso_in_zone(F.col("end_at"), calendar_zone),
        }
    )
    return rows.withColumns(
        {
            "retryable": F.col("reason").eqNullSafe(fv.REASON_TOO_FAR),
            "benign": F.coalesce(F.col("reason").isin(fv.REASON_ENDED, fv.REASON_LOW), F.lit(False)),
            "event_key": textcols.event_key(
                F.col("post_key"), F.col("event_type"), F.col("start_iso"), F.col("end_iso")
            ),
            "summary": textcols.build_summary(
                F.col("event_type"), F.col("affected"), low, rules.summaries, rules.low_confidence_marker
            ),
        }
    ).drop("quote_line")


def accepted(judged: DataFrame) -> DataFrame:
    """Windows ready for reconciliation."""
    return judged.filter("reason is null").select(
        "firm",
        "post_key",
        "event_ord",
        "event_key",
        "event_type",
        "summary",
        textcols.build_description(
            F.coalesce("excerpt", F.lit("")),
            F.coalesce("url", F.lit("")),
            F.col("low"),
            F.col("kept_evidence"),
        ).alias("description"),
        "start_at",
        "end_at",
        "start_iso",
        "end_iso",
        F.coalesce("url", F.lit("")).alias("source_url"),
        F.when(F.col("low"), "low").otherwise(F.col("confidence")).alias("confidence"),
        F.col("kept_evidence").alias("evidence"),
    )


REJECTED = [
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
    "reason",
    "retryable",
    "benign",
]


def rejected(judged: DataFrame) -> DataFrame:
    return judged.filter("reason is not null").select(*REJECTED)


def validate_events(
    raw: DataFrame,
    posts: DataFrame,
    firms: DataFrame,
    rules: EventRules,
    now: Column,
    calendar_zone: str = "UTC",
) -> tuple[DataFrame, DataFrame]:
    """``(events, rejections)``."""
    judged = cut_lineage(judge_events(raw, posts, firms, rules, now, calendar_zone), "judged")
    return accepted(judged), rejected(judged)
