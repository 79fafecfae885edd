"""Health of sources over a run log: last success, staleness, notifications, heartbeats."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticewindows import fixed_values as fv
from noticewindows.functions import running, timecols
from noticewindows.session import cut_lineage


def run_failed(run_outcomes: DataFrame) -> DataFrame:
    """Runs with ``failed``: true only when every firm of the run had an error."""
    return run_outcomes.groupBy("run_id").agg(
        F.bool_and(F.col("error").isNotNull()).alias("failed"), F.count("*").alias("firms")
    )


def firm_health(
    run_outcomes: DataFrame, now: Column, started_at: Column, interval_seconds: float
) -> DataFrame:
    """Per firm: last success and error, counts, anomalies of the last run, age and status.

    ``run_outcomes``: run_id, firm, ts, error, anomalies (array).  Only a run without an error renews
    the last success.  Stale is *more* than two intervals since then, or since the start.
    """
    last = F.struct("ts", "run_id")
    good = F.col("error").isNull()
    rows = run_outcomes.groupBy("firm").agg(
        F.max(F.when(good, F.col("ts"))).alias("last_success"),
        F.max_by("error", last).alias("last_error"),
        F.max_by(F.array_join("anomalies", "; "), last).alias("anomalies"),
        F.count_if(good).alias("runs_ok"),
        F.count_if(~good).alias("runs_failed"),
    )

    def age(since: Column) -> Column:
        return (F.unix_micros(now) - F.unix_micros(since)) / 1_000_000

    limit = interval_seconds * fv.STALE_INTERVALS
    stale = F.lit(limit > 0) & (age(F.coalesce("last_success", started_at)) > limit)
    flagged = F.coalesce("anomalies", F.lit("")) != ""
    status = (
        F.when(F.col("last_error").isNotNull(), "error")
        .when(stale, "stale")
        .when(flagged, "anomaly")
        .otherwise("ok")
    )
    return rows.withColumns(
        {
            "age_seconds": F.round(age(F.col("last_success")), 1),
            "age_text": timecols.humanize(age(F.col("last_success"))),
            "stale": stale,
            "status": status,
        }
    ).withColumn("ok", F.col("status") == "ok")


def overall_health(
    runs: DataFrame, health: DataFrame, now: Column, started_at: Column, interval_seconds: float
) -> DataFrame:
    """One row for the deployment, from its run log and the health of its firms.

    ``runs``: run_id, ts, error, anomalies (of the whole run).  Precedence: error, stale, anomaly,
    degraded (some firm is not ok), ok.
    """
    last = F.struct("ts", "run_id")
    good = F.col("error").isNull()
    loop = runs.agg(
        F.max("ts").alias("last_run"),
        F.max(F.when(good, F.col("ts"))).alias("last_success"),
        F.max_by("error", last).alias("last_error"),
        F.max_by(F.array_join("anomalies", "; "), F.when(good, last)).alias("anomalies"),
        F.count_if(good).alias("runs_ok"),
        F.count_if(~good).alias("runs_failed"),
    )
    unhealthy = health.agg(F.count_if(~F.col("ok"))).scalar()
    limit = interval_seconds * fv.STALE_INTERVALS
    age = (F.unix_micros(now) - F.unix_micros(F.coalesce("last_success", started_at))) / 1_000_000
    status = (
        F.when(F.col("last_error").isNotNull(), "error")
        .when(F.lit(limit > 0) & (age > limit), "stale")
        .when(F.coalesce("anomalies", F.lit("")) != "", "anomaly")
        .when(F.col("unhealthy") > 0, "degraded")
        .otherwise("ok")
    )
    step = F.lit(int(interval_seconds))
    return loop.withColumn("unhealthy", unhealthy).withColumns(
        {
            "status": status,
            "next_run": F.when(F.lit(interval_seconds > 0), timecols.shift(F.col("last_run"), step)),
        }
    )


def unhealthy(firms: DataFrame) -> DataFrame:
    """``firm, status, since`` of every firm that is not ok, from :func:`firm_health`; ``since``: its last success."""
    return firms.filter("status <> 'ok'").select("firm", "status", F.col("last_success").alias("since"))


def notify_once(run_log: DataFrame) -> DataFrame:
    """Errors worth a message: those that differ from the run before; a success resets.

    ``run_log``: firm, run_id, ts, error (NULL on success).  The log of a firm is scanned in even
    ranges, so a firm with very many runs is not one task.
    """
    rows = running.in_ranges(run_log, ["firm"], ["ts", "run_id"], "bucket", "run-log")
    rows = running.previous_value(rows, ["firm"], "bucket", ["ts", "run_id"], "error", "previous_error")
    fresh = F.col("error").isNotNull() & ~F.col("error").eqNullSafe(F.col("previous_error"))
    return rows.filter(fresh).drop("bucket")


def heartbeat_due(run_log: DataFrame, hours: float) -> DataFrame:
    """Runs at which a heartbeat goes out: the first, then each at least ``hours`` after the last one.

    Greedy, so every emission depends on the one before.  Every run gets its successor once, the first run at
    least ``hours`` later: it lies in the next slice of that length or is the first of a later slice.  The runs
    that follow from the first one are then collected by doubling: the known ones plus what a jump over as many
    steps reaches, with jumps twice as long each round.  The number of joins is the logarithm of the number of
    slices.  ``run_log``: firm, ts.  Zero hours is off.
    """
    if hours <= 0:
        return run_log.select("firm", "ts").limit(0)
    step = int(timedelta(hours=hours).total_seconds() * 1_000_000)
    runs = run_log.filter("firm is not null and ts is not null").select("firm", F.unix_micros("ts").alias("us")).distinct()
    bounds = runs.agg(F.min("us").alias("lo"), F.max("us").alias("hi")).first()
    if bounds["lo"] is None:
        return run_log.select("firm", "ts").limit(0)
    slices = (bounds["hi"] - bounds["lo"]) // step + 1
    runs = runs.withColumn("slice", F.floor((F.col("us") - bounds["lo"]) / step))
    data = runs.select("firm", "slice", F.col("us").alias("at"), F.col("us").alias("found"), F.lit(None).cast("long").alias("us"))
    asked = runs.select("firm", (F.col("slice") + 1).alias("slice"), (F.col("us") + step).alias("at"), F.lit(None).cast("long").alias("found"), "us")
    onward = Window.partitionBy("firm", "slice").orderBy("at").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    near = data.unionByName(asked).withColumn("near", F.min("found").over(onward)).filter("us is not null").select("firm", "us", "near")
    later = Window.partitionBy("firm").orderBy("slice").rangeBetween(2, Window.unboundedFollowing)
    far = runs.groupBy("firm", "slice").agg(F.min("us").alias("first")).withColumn("far", F.min("first").over(later))
    jumps = (
        runs.join(near, ["firm", "us"])
        .join(far.select("firm", "slice", "far"), ["firm", "slice"])
        .select("firm", "us", F.coalesce("near", "far").alias("to"))
        .filter("to is not null")
    )
    jumps = cut_lineage(jumps, "heartbeat-jumps")
    sent = runs.groupBy("firm").agg(F.min("us").alias("us"))
    reach = 1
    while True:
        sent = cut_lineage(sent.unionByName(sent.join(jumps, ["firm", "us"]).select("firm", F.col("to").alias("us"))), "heartbeats")
        reach *= 2
        if reach >= slices:
            break
        next_jumps = jumps.select("firm", F.col("us").alias("start"), F.col("to").alias("us")).join(jumps, ["firm", "us"])
        jumps = cut_lineage(next_jumps.select("firm", F.col("start").alias("us"), "to"), "heartbeat-jumps")
    return sent.select("firm", F.timestamp_micros("us").alias("ts"))
