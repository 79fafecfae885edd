"""One sync over all firms: posts in, plan and new state out.

The flow is one lazy plan per table.  Inference is the only step that costs money, so replies enter as
a table: run :func:`work_list` and the inference job first, then :func:`sync`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticewindows.functions import timecols
from noticewindows.operators import posts as post_ops
from noticewindows.operators import reconcile, report, validate, vote
from noticewindows.session import cut_lineage

POST = ["firm", "post_key"]
RAW = [
    "event_ord",
    "event_type",
    "start_time",
    "end_time",
    "stated_utc_offset",
    "affected",
    "confidence",
    "evidence",
]


@dataclass(frozen=True)
class SyncResult:
    """Everything a run produces.  ``plan`` alone is a dry run; ``tables`` is the state to write."""

    plan: DataFrame
    tables: dict[str, DataFrame]
    rejections: DataFrame
    anomalies: DataFrame
    reports: DataFrame
    outcomes: DataFrame
    duplicates: DataFrame


def attribute(tables: dict[str, DataFrame], posts: DataFrame) -> dict[str, DataFrame]:
    """State rows written before firms were recorded get the firm that lists their post now."""
    owners = posts.groupBy("post_key").agg(F.max("firm").alias("owner"))

    def named(rows: DataFrame) -> DataFrame:
        blank = rows.filter("firm = ''").join(owners, "post_key", "left")
        blank = blank.withColumn("firm", F.coalesce("owner", "firm"))
        return rows.filter("firm <> ''").unionByName(blank.select(*rows.columns))

    return {name: named(rows) for name, rows in tables.items()}


def work_list(posts: DataFrame, post_state: DataFrame, firms: DataFrame) -> DataFrame:
    """Posts that pass the gate of their firm, with their change status.  Unchanged ones cost nothing."""
    gated = post_ops.keyword_gate(post_ops.with_hash(posts), firms)
    return post_ops.changed_posts(gated, post_state)


def sync(
    posts: DataFrame,
    ballots: DataFrame,
    tables: dict[str, DataFrame],
    firms: DataFrame,
    rules: validate.EventRules,
    now: Column,
    members: list[str],
    quorum: int = 0,
    scrape_errors: DataFrame | None = None,
    inventory: DataFrame | None = None,
    calendar_zone: str = "UTC",
    failed_deletes: DataFrame | None = None,
    real_calendar: bool = False,
) -> SyncResult:
    """Apply one set of ballots to the state.

    ``posts``: firm, post_key, text, url, pos (place on the page).  ``ballots`` as from
    ``replies.resolve_replies``.  A post without a usable answer, or a firm with a scrape error, is an
    error row of its firm; every other firm and post goes on.
    """
    spark = posts.sparkSession
    tables = attribute(tables, posts)
    state, tracked = tables["post_state"], tables["tracked"]
    listed = work_list(posts, state, firms)
    # which posts are due is asked many times below; texts are not carried along
    due = listed.filter("status <> 'unchanged'").select(*POST, "pos", "status", "content_hash", "url")
    due = cut_lineage(due, "due")
    kept, disputes, failures = vote.panel(ballots, members, quorum)
    failed = due.join(failures, POST).select("firm", "post_key", "error")
    answered = due.join(ballots.select(*POST).distinct(), POST, "left_semi")
    answered = answered.join(failures.select(*POST), POST, "left_anti")
    answered = cut_lineage(answered, "answered")
    extracted = answered.select(
        *POST, F.col("pos").cast("long").alias("proc_ord"), (F.col("status") == "reextract").alias("recover")
    )
    settings = firms.select("firm", "timezone", "require_stated_offset")
    raw = kept.join(extracted.select(*POST), POST, "left_semi").select(*POST, *RAW)
    judged = validate.judge_events(raw, posts, settings, rules, now, calendar_zone)
    judged = cut_lineage(judged, "judged")  # events and rejections are read many times below
    events, rejections = validate.accepted(judged), validate.rejected(judged)
    doubtful = disputes.join(extracted.select(*POST), POST, "left_semi").select(*POST, *RAW, "dispute")
    flagged = vote.flag_disputes(doubtful, posts, settings, rules, now)
    rejections = rejections.unionByName(flagged)

    held = tables["deferred"].join(extracted.select(*POST), POST, "left_anti")
    no_text = held.select(*POST).distinct().join(
        state.select(*POST, F.lit("").alias("text"), "url", "arrival_seq"), POST, "left"
    )
    again = validate.judge_events(held, no_text, settings, rules, now, calendar_zone)
    again = cut_lineage(again, "held")
    promoted, still, dropped = reconcile.promote_deferred(again, tracked)
    promoted = promoted.join(state.select(*POST, "arrival_seq"), POST).withColumn(
        "evidence", F.col("kept_evidence")
    )

    if inventory is None:
        inventory = spark.createDataFrame([], "event_key string, entry_id string")
    plan = reconcile.reconcile(
        tracked,
        events,
        extracted,
        inventory,
        now,
        rules.delete_on_empty_extraction,
        promoted=promoted,
        real_calendar=real_calendar,
    )

    last = state.agg(F.coalesce(F.max("arrival_seq"), F.lit(0))).scalar()
    fresh = answered.join(state.select(*POST), POST, "left_anti").select(
        *POST, (last + 1 + F.col("pos").cast("long")).alias("arrival_seq")
    )
    arrivals = state.select(*POST, "arrival_seq").unionByName(fresh)
    after = cut_lineage(reconcile.apply_plan(tracked, plan, extracted, arrivals), "tracked")
    after, deletes = reconcile.merge_duplicates(after, now, failed_deletes)

    touched = post_ops.touch_seen(posts, state, now)
    hashes = answered.select(*POST, "content_hash", "url")
    written = hashes.join(arrivals, POST).select(
        *POST,
        "content_hash",
        now.alias("last_seen"),
        "url",
        "arrival_seq",
        F.lit(True).alias("deferred_known"),
    )
    new_state = touched.join(written.select(*POST), POST, "left_anti").unionByName(written)
    deferred = (
        rejections.filter("retryable").select(*POST, *RAW).unionByName(still.select(*POST, *RAW))
    )
    lines = report.rejected_lines(rejections).select(*POST, "line")
    old_lines = tables["rejected_lines"].join(extracted.select(*POST), POST, "left_anti")
    dropped_lines = report.rejected_lines(dropped).select(*POST, "line")
    new_lines = old_lines.unionByName(lines).unionByName(dropped_lines)

    pruned = reconcile.prune(new_state, after, deferred, now)
    alive = pruned.select(*POST)
    new_tables = {
        "post_state": pruned,
        "tracked": after.join(alive, POST, "left_semi"),
        "deferred": deferred.join(alive, POST, "left_semi"),
        "rejected_lines": new_lines.join(alive, POST, "left_semi"),
    }

    sighted = posts.join(firms.select("firm", "keywords"), "firm").select(
        "firm", "post_key", post_ops.is_relevant(F.col("text"), F.col("keywords")).alias("relevant")
    )
    sighted = sighted.join(listed.select(*POST, "status"), POST, "left")
    diff = reconcile.diff_events(tracked, events, extracted, now)
    guards = reconcile.shrink_guard(diff, rules.delete_on_empty_extraction)
    errors = failed.select("firm", F.concat("post_key", F.lit(": "), "error").alias("error"))
    if scrape_errors is not None:
        errors = errors.unionByName(scrape_errors.select("firm", F.col("message").alias("error")))
    firm_errors = errors.groupBy("firm").agg(F.min("error").alias("error"))
    counted = rejections.select("firm", "retryable").unionByName(dropped.select("firm", "retryable"))
    all_rejected = rejections.unionByName(dropped.select(*rejections.columns))
    anomalies = report.detect_anomalies(sighted, guards, all_rejected, firm_errors)
    reports = report.run_report(sighted, plan, counted, deletes)
    outcomes = report.firm_outcomes(reports, anomalies, firm_errors)
    return SyncResult(plan, new_tables, all_rejected, anomalies, reports, outcomes, deletes)


def utc(text: str) -> Column:
    """A literal instant from ISO text; ``now`` is always a parameter."""
    return timecols.iso_instant(F.lit(text))
