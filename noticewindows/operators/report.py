"""What a run did: counters, anomalies, lines for people and rows for an external calendar."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticewindows.functions import timecols
from noticewindows.operators.reconcile import with_instants

COUNTERS = (
    "posts_seen",
    "posts_relevant",
    "posts_skipped_unchanged",
    "events_created",
    "events_deleted",
    "events_kept",
    "rejections",
    "events_deferred",
    "duplicates_merged",
)


def describe_event(summary: Column, start_at: Column, end_at: Column, zone: str) -> Column:
    """``summary — Tue 06 Jan 08:00–14:00`` on the zone's clock."""
    start, end = (F.from_utc_timestamp(c, zone) for c in (start_at, end_at))
    return F.concat(
        summary, F.lit(" — "), F.date_format(start, "EEE dd MMM HH:mm"), F.lit("–"), F.date_format(end, "HH:mm")
    )


def describe_tracked(summary: Column, event_key: Column, start_iso: Column, end_iso: Column) -> Column:
    """Title (or key) and start (or end) as far as they are known; raw text when it is no time."""
    blank = F.lit("")
    when = F.coalesce(F.nullif(start_iso, blank), end_iso)
    local = timecols.iso_local(when)
    return F.concat(
        F.coalesce(F.nullif(summary, blank), event_key),
        F.lit(" — "),
        F.coalesce(F.date_format(local, "EEE dd MMM HH:mm"), when),
    )


def run_report(
    posts: DataFrame, plan: DataFrame, rejections: DataFrame, merges: DataFrame | None = None
) -> DataFrame:
    """One row of counters per firm.

    ``posts``: firm, relevant, status.  Every input is reduced to one row per firm before they meet.
    """
    action = F.col("action")
    parts = [
        posts.groupBy("firm").agg(
            F.count("*").alias("posts_seen"),
            F.count_if("relevant").alias("posts_relevant"),
            F.count_if(F.col("relevant") & (F.col("status") == "unchanged")).alias("posts_skipped_unchanged"),
        ),
        plan.groupBy("firm").agg(
            F.count_if(action == "create").alias("events_created"),
            F.count_if(action == "delete").alias("events_deleted"),
            F.count_if(action.isin("keep", "refuse", "share", "adopt")).alias("events_kept"),
        ),
        rejections.groupBy("firm").agg(
            F.count_if(~F.col("retryable")).alias("rejections"),
            F.count_if("retryable").alias("events_deferred"),
        ),
    ]
    if merges is not None:
        parts.append(merges.groupBy("firm").agg(F.count("*").alias("duplicates_merged")))
    out = None
    for part in parts:
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if "duplicates_merged" not in out.columns:
        out = out.withColumn("duplicates_merged", F.lit(0).cast("long"))
    return out.groupBy("firm").agg(*[F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(c) for c in COUNTERS])


def totals(reports: DataFrame) -> DataFrame:
    """Per (run, firm), per run and overall in one pass; ``level`` 0 is a firm, 1 a run, 3 everything."""
    return reports.rollup("run_id", "firm").agg(
        F.grouping_id().cast("long").alias("level"),
        *[F.sum(c).cast("long").alias(c) for c in COUNTERS if c in reports.columns],
    )


def report_summary(reports: DataFrame, dry_run: bool = False, anomalies: str = "anomalies") -> DataFrame:
    """One sentence per report; parts that count nothing are left out.

    ``anomalies`` is a column with the number of anomalies.
    """

    def n(column: str) -> Column:
        return F.col(column).cast("string")

    def optional(column: str, before: str, after: str) -> Column:
        return F.when(F.col(column) > 0, F.concat(F.lit(before), n(column), F.lit(after))).otherwise("")

    text = F.concat(
        F.lit("[dry-run] " if dry_run else ""),
        F.when(F.col("firm") != "", F.concat("firm", F.lit(": "))).otherwise(""),
        F.lit("posts: "),
        n("posts_seen"),
        F.lit(" seen, "),
        n("posts_relevant"),
        F.lit(" relevant, "),
        n("posts_skipped_unchanged"),
        F.lit(" unchanged | events: "),
        n("events_created"),
        F.lit(" created, "),
        n("events_deleted"),
        F.lit(" removed, "),
        n("events_kept"),
        F.lit(" kept, "),
        n("rejections"),
        F.lit(" rejected extractions"),
        optional("events_deferred", ", ", " deferred (beyond max_days_ahead)"),
        optional("duplicates_merged", ", ", " duplicate calendar entries merged"),
        optional(anomalies, " | ", " anomaly/anomalies"),
    )
    return reports.withColumn("summary", text)


def rejected_lines(rejections: DataFrame) -> DataFrame:
    """One line per rejection that dropped a real window."""
    affected = F.coalesce("affected", F.lit(""))
    what = F.when(affected != "", F.concat(F.lit(" ("), affected, F.lit(")"))).otherwise("")
    line = F.concat("event_type", F.lit(" "), "start_time", what, F.lit(": "), "reason")
    return rejections.filter("not retryable and not benign").select(
        "firm", "post_key", "event_ord", line.alias("line")
    )


def detect_anomalies(
    posts: DataFrame,
    guards: DataFrame,
    rejections: DataFrame,
    firm_errors: DataFrame,
) -> DataFrame:
    """``(firm, code, post_key, anomaly)`` rows: gate, shrink, rejected, error.

    ``posts``: firm, relevant.  ``guards`` comes from ``shrink_guard``.  ``firm_errors``: firm, error.
    The lines of one post are joined; a post is one announcement, so that list is short.
    """
    gate = (
        posts.groupBy("firm")
        .agg(F.count("*").alias("n"), F.count_if("relevant").alias("hits"))
        .filter("n > 0 and hits = 0")
        .select(
            "firm",
            F.lit("gate").alias("code"),
            F.lit("").alias("post_key"),
            F.concat(
                F.lit("no keyword occurs in any of the "), F.col("n").cast("string"), F.lit(" posts read")
            ).alias("anomaly"),
        )
    )
    shrink = guards.select("firm", F.lit("shrink").alias("code"), "post_key", "anomaly")
    lines = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("event_ord", "line"))), lambda x: x["line"]), "; "
    )
    dropped = (
        rejected_lines(rejections)
        .groupBy("firm", "post_key")
        .agg(F.count("*").alias("n"), lines.alias("lines"))
        .select(
            "firm",
            F.lit("rejected").alias("code"),
            "post_key",
            F.concat(
                F.lit("post "),
                "post_key",
                F.lit(": "),
                F.col("n").cast("string"),
                F.lit(" extracted event(s) rejected and not published — "),
                "lines",
            ).alias("anomaly"),
        )
    )
    errors = firm_errors.filter("error is not null").select(
        "firm",
        F.lit("error").alias("code"),
        F.lit("").alias("post_key"),
        F.concat(F.lit("run of "), "firm", F.lit(" ended with: "), "error").alias("anomaly"),
    )
    return gate.unionByName(shrink).unionByName(dropped).unionByName(errors)


def calendar_counts(
    post_state: DataFrame, tracked: DataFrame, deferred: DataFrame, rejected: DataFrame, now: Column
) -> DataFrame:
    """Per firm what the state holds: upcoming windows, held rows, rejected lines."""
    parts = [
        post_state.groupBy("firm").agg(F.count("*").alias("posts")),
        with_instants(tracked)
        .groupBy("firm")
        .agg(F.count_if(F.col("end_at") > now).alias("events_upcoming")),
        deferred.groupBy("firm").agg(F.count("*").alias("events_deferred")),
        rejected.groupBy("firm").agg(F.count("*").alias("rejected_lines")),
    ]
    out = None
    for part in parts:
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    names = ("posts", "events_upcoming", "events_deferred", "rejected_lines")
    return out.groupBy("firm").agg(*[F.sum(F.coalesce(n, F.lit(0))).cast("long").alias(n) for n in names])


def payload_lines(plan: DataFrame, anomalies: DataFrame) -> DataFrame:
    """The lines of a run's notification, one row each: created, removed, anomaly.

    A table and not one text per firm: a run over many firms would otherwise collect them in one
    task.  A sink that wants a text writes these rows in ``(firm, kind_ord, post_key, ord)`` order.
    """
    text = describe_tracked(F.col("summary"), F.col("event_key"), F.col("start_iso"), F.col("end_iso"))
    changed = plan.filter("action in ('create', 'delete')")
    made = F.col("action") == "create"
    lines = changed.select(
        "firm",
        F.when(made, "created").otherwise("removed").alias("kind"),
        F.when(made, 0).otherwise(1).alias("kind_ord"),
        "post_key",
        F.col("event_key").alias("ord"),
        F.concat(F.when(made, "➕ ").otherwise("➖ "), text).alias("line"),
    )
    flagged = anomalies.select(
        "firm",
        F.lit("anomaly").alias("kind"),
        F.lit(2).alias("kind_ord"),
        "post_key",
        F.col("code").alias("ord"),
        F.concat(F.lit("• "), "anomaly").alias("line"),
    )
    return lines.unionByName(flagged)


def calendar_rows(events: DataFrame, zone: str, reminders_minutes: Sequence[int] = ()) -> DataFrame:
    """Rows to upsert into an external calendar, reconciled by ``reconcile_key``."""
    reminders = F.array(
        *[F.struct(F.lit("popup").alias("method"), F.lit(m).alias("minutes")) for m in reminders_minutes]
    ).cast("array<struct<method:string,minutes:int>>")
    return events.select(
        F.col("event_key").alias("reconcile_key"),
        "summary",
        "description",
        F.struct(F.col("start_iso").alias("date_time"), F.lit(zone).alias("time_zone")).alias("start"),
        F.struct(F.col("end_iso").alias("date_time"), F.lit(zone).alias("time_zone")).alias("end"),
        F.lit(not reminders_minutes).alias("default_reminders"),
        reminders.alias("reminders"),
    )


def firm_outcomes(reports: DataFrame, anomalies: DataFrame, firm_errors: DataFrame) -> DataFrame:
    """Per firm whether its part of the run was well: ``ok`` needs no error and no anomaly."""
    flagged = anomalies.filter("code <> 'error'").groupBy("firm").agg(F.count("*").alias("anomalies"))
    return (
        reports.join(flagged, "firm", "left")
        .join(firm_errors.select("firm", "error"), "firm", "full_outer")
        .withColumn("anomalies", F.coalesce("anomalies", F.lit(0)).cast("long"))
        .withColumn("ok", F.col("error").isNull() & (F.col("anomalies") == 0))
        .withColumn(
            "status",
            F.when(F.col("error").isNotNull(), "error").when(F.col("anomalies") > 0, "anomaly").otherwise("ok"),
        )
    )


