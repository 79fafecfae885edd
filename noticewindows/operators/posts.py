"""Posts: keyword gate, change detection, last sight, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticewindows.functions import textcols

_PROMPT = """Extract the scheduled interruptions from the announcement below.

Reply with a JSON array and nothing else. Each element is an object:
{"event_type": one of "maintenance", "crypto_closure", "holiday_closure", "early_close",
"late_open", "symbol_event", "other"; "start_time" and "end_time": local ISO 8601 times;
"stated_utc_offset": the offset the text states, such as "+03:00", or null;
"affected": symbols or platforms as written, comma separated, or null;
"confidence": "high" when the text states the time outright, else "low";
"evidence": the shortest passage, word for word, that states date and time}

A closure of a whole day runs from 00:00 to 23:59 of that day. Give one element per window and
leave out whatever has no concrete date. Reply [] when nothing is scheduled.
"""


def is_relevant(text: Column, keywords: Column) -> Column:
    """True when the text holds any keyword, ignoring case and surrounding blanks."""
    lowered = F.lower(text)
    wanted = F.filter(F.transform(keywords, lambda k: F.lower(F.trim(k))), lambda k: k != "")
    return F.exists(wanted, lambda k: F.contains(lowered, k))


def keyword_gate(posts: DataFrame, firms: DataFrame) -> DataFrame:
    """Posts that hold a keyword of their firm.  ``firms``: firm, keywords."""
    return (
        posts.join(firms.select("firm", "keywords"), "firm")
        .filter(is_relevant(F.col("text"), F.col("keywords")))
        .drop("keywords")
    )


def changed_posts(posts: DataFrame, post_state: DataFrame) -> DataFrame:
    """Posts with ``status``: new, changed, reextract (held rows unknown) or unchanged."""
    known = post_state.select(
        "firm", "post_key", F.col("content_hash").alias("known_hash"), "deferred_known"
    )
    status = (
        F.when(F.col("known_hash").isNull(), "new")
        .when(F.col("known_hash") != F.col("content_hash"), "changed")
        .when(~F.coalesce("deferred_known", F.lit(False)), "reextract")
        .otherwise("unchanged")
    )
    return (
        posts.join(known, ["firm", "post_key"], "left")
        .withColumn("status", status)
        .drop("known_hash", "deferred_known")
    )


def touch_seen(posts: DataFrame, post_state: DataFrame, now: Column) -> DataFrame:
    """State rows with last sight, firm and URL renewed for every post on the page.

    State belongs to a firm and a post key; a row without a firm takes the one that lists its key (the last in name
    order where several do).
    """
    sighted = posts.groupBy("firm", "post_key").agg(F.max("url").alias("seen_url"), F.lit(True).alias("seen"))
    listed = sighted.groupBy("post_key").agg(
        F.max("firm").alias("seen_firm"), F.max_by("seen_url", "firm").alias("seen_url"), F.lit(True).alias("seen")
    )
    blank = F.coalesce("firm", F.lit("")) == ""
    seen = F.coalesce("seen", F.lit(False))
    joined = (
        post_state.filter(~blank)
        .join(sighted, ["firm", "post_key"], "left")
        .withColumn("seen_firm", F.col("firm"))
        .unionByName(post_state.filter(blank).join(listed, "post_key", "left"))
    )
    return (
        joined.withColumn("last_seen", F.when(seen, now).otherwise(F.col("last_seen")))
        .withColumn("firm", F.coalesce(F.nullif("seen_firm", F.lit("")), "firm"))
        .withColumn("url", F.when(seen, F.coalesce("seen_url", F.lit(""))).otherwise(F.col("url")))
        .select(*post_state.columns)
    )


def build_prompts(posts: DataFrame, profiles: DataFrame) -> DataFrame:
    """One prompt per post; hints of the firm's profile are put before the text."""
    hints = F.trim(F.coalesce("prompt_hints", F.lit("")))
    block = F.when(hints != "", F.concat(F.lit("\nAbout this source:\n"), hints, F.lit("\n"))).otherwise("")
    return posts.join(
        profiles.select(F.col("name").alias("firm"), "prompt_hints"), "firm", "left"
    ).select(
        "firm",
        "post_key",
        F.concat(F.lit(_PROMPT), block, F.lit("\nAnnouncement:\n---\n"), "text", F.lit("\n---\n")).alias(
            "prompt"
        ),
    )


def with_hash(posts: DataFrame) -> DataFrame:
    return posts.withColumn("content_hash", textcols.content_hash(F.col("text")))
