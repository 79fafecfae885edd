"""Votes over ballots: tallies, merged variants, consensus, panels and disputes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticewindows.functions import timecols
from noticewindows.operators import validate
from noticewindows.session import cut_lineage

POST = ("firm", "post_key")
FIELDS = (
    "event_type",
    "start_time",
    "end_time",
    "stated_utc_offset",
    "affected",
    "confidence",
    "evidence",
)


def exact_key() -> list[Column]:
    """Type and both times as written."""
    return [F.col("event_type"), F.col("start_time"), F.col("end_time")]


def panel_key() -> list[Column]:
    """Type and both times cut to minutes, so that formats of different voters agree."""
    return [
        F.col("event_type"),
        timecols.minutes_text(F.col("start_time")),
        timecols.minutes_text(F.col("end_time")),
    ]


def ballot_rows(ballots: DataFrame) -> DataFrame:
    """One row per (ballot, event).  Abstained and empty ballots have none."""
    return ballots.select(*POST, "voter", "ballot_ord", F.explode("events").alias("e")).select(
        *POST, "voter", "ballot_ord", "e.*"
    )


def tally(rows: DataFrame, key: Sequence[Column] | None = None) -> DataFrame:
    """Per post and key: the merged event, its voters in first-seen order, and its place.

    Two aggregations with partial results.  The first makes it one vote per voter, so that the lists
    of the second are as long as the panel and no longer.
    """
    names = [f"key_{n}" for n in range(3)]
    keyed = rows.withColumns(dict(zip(names, key or exact_key(), strict=True))).withColumn(
        "ord", F.struct("ballot_ord", "event_ord")
    )
    votes = keyed.groupBy(*POST, *names, "voter").agg(
        F.min("ord").alias("ord"), F.min_by(F.struct(*FIELDS), "ord").alias("e")
    )
    offset, affected, evidence = F.col("e.stated_utc_offset"), F.col("e.affected"), F.col("e.evidence")
    longest = F.struct(
        F.length(F.coalesce(affected, F.lit(""))), -F.col("ord.ballot_ord"), -F.col("ord.event_ord")
    )
    merged = votes.groupBy(*POST, *names).agg(
        F.min("ord").alias("ord"),
        F.array_sort(F.collect_list(F.struct("ord", "voter"))).alias("_votes"),
        F.min_by("e", "ord").alias("_base"),
        F.min_by(offset, F.when(offset != "", F.col("ord"))).alias("_offset"),
        F.max_by(affected, longest).alias("_affected"),
        F.min_by(evidence, F.when(evidence != "", F.col("ord"))).alias("_evidence"),
    )
    return merged.select(
        *POST,
        *names,
        "ord",
        F.transform("_votes", lambda v: v["voter"]).alias("voters"),
        "_base.event_type",
        "_base.start_time",
        "_base.end_time",
        F.coalesce("_base.stated_utc_offset", "_offset").alias("stated_utc_offset"),
        F.col("_affected").alias("affected"),
        "_base.confidence",
        F.coalesce("_evidence", "_base.evidence").alias("evidence"),
    )


def consensus(ballots: DataFrame, runs: int) -> tuple[DataFrame, DataFrame]:
    """``(events, failures)``: what a majority of ``runs`` runs agree on, word for word.

    A run that failed fails its post.  With one run its rows are kept as they are.
    """
    failures = (
        ballots.groupBy(*POST)
        .agg(
            F.count_if(F.col("events").isNotNull()).alias("answered"),
            F.max_by("error", F.when(F.col("events").isNull(), F.col("ballot_ord"))).alias("error"),
        )
        .filter(F.col("answered") < runs)
        .select(*POST, F.coalesce("error", F.lit("a run is missing")).alias("error"))
    )
    rows = ballot_rows(ballots).join(failures.select(*POST), list(POST), "left_anti")
    if runs == 1:
        return rows.select(*POST, "event_ord", *FIELDS), failures
    kept = tally(rows).filter(F.size("voters") >= runs // 2 + 1)
    return kept.select(*POST, F.col("ord.event_ord").alias("event_ord"), *FIELDS), failures


def panel(
    ballots: DataFrame, members: Sequence[str], quorum: int = 0
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(kept, disputes, failures)``: agreed by ``quorum`` members, by fewer, and posts nobody can judge.

    An abstention counts against every event.  A post with fewer answers than the quorum is a failure.
    """
    quorum = quorum or len(members) // 2 + 1
    listed = F.array(*[F.lit(m) for m in members])
    answers = ballots.groupBy(*POST).agg(
        F.count_if(F.col("events").isNotNull()).alias("answered"),
        F.array_join(
            F.transform(
                F.array_sort(
                    F.collect_list(
                        F.when(
                            F.col("error") != "",
                            F.struct("ballot_ord", F.concat_ws(": ", "voter", "error").alias("line")),
                        )
                    )
                ),
                lambda x: x["line"],
            ),
            "; ",
        ).alias("errors"),
    )
    failures = answers.filter(F.col("answered") < quorum).select(
        *POST,
        F.concat(
            F.lit("only "),
            F.col("answered").cast("string"),
            F.lit(f" of {len(members)} panel models answered and {quorum} must agree — "),
            "errors",
        ).alias("error"),
    )
    counted = (
        tally(ballot_rows(ballots), panel_key())
        .join(failures.select(*POST), list(POST), "left_anti")
        .withColumn("event_ord", F.row_number().over(Window.partitionBy(*POST).orderBy("ord", *FIELDS)).cast("long") - 1)
    )
    enough = F.size("voters") >= quorum
    kept = counted.filter(enough).select(*POST, "event_ord", "voters", *FIELDS)
    disputes = counted.filter(~enough).select(
        *POST,
        "event_ord",
        "voters",
        *FIELDS,
        describe_dispute(F.col("voters"), listed, quorum).alias("dispute"),
    )
    return kept, disputes, failures


def describe_dispute(voters: Column, members: Column, quorum: int) -> Column:
    """Who extracted it and who did not, in panel order."""
    return F.concat(
        F.lit("only "),
        F.size(voters).cast("string"),
        F.lit(" of "),
        F.size(members).cast("string"),
        F.lit(f" models extracted it (quorum {quorum}): "),
        F.array_join(voters, ", "),
        F.lit(" did; "),
        F.array_join(F.array_except(members, voters), ", "),
        F.lit(" did not"),
    )


def flag_disputes(
    disputes: DataFrame,
    posts: DataFrame,
    firms: DataFrame,
    rules: validate.EventRules,
    now: Column,
) -> DataFrame:
    """Disputes as rejections, where validation would accept the event or only hold it back."""
    judged = validate.judge_events(disputes, posts, firms, rules, now)
    judged = cut_lineage(judged.select(*POST, "event_ord", *FIELDS, "dispute", "reason", "retryable"), "disputed")
    worth = judged.filter(F.col("reason").isNull() | F.col("retryable"))
    return worth.select(
        *POST,
        "event_ord",
        *FIELDS,
        F.col("dispute").alias("reason"),
        F.lit(False).alias("retryable"),
        F.lit(False).alias("benign"),
    )
