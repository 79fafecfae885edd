"""Scores of extracted rows against expected ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticewindows.functions import textcols, timecols

KEY = ("event_type", "start_time", "end_time")
RUN = ("case_id", "run")


def norm_offset(value: Column) -> Column:
    """``+3``, ``GMT+03:00`` and ``+03:00`` alike; text that is no offset stays, NULL stays NULL."""
    stripped = timecols.strip(value)
    text = F.regexp_replace(F.regexp_replace(F.upper(stripped), "^UTC", ""), "^GMT", "")
    pattern = r"^([+-]?)\s*([+-]?\d+)\s*(?::\s*([+-]?\d+)?\s*)?$"
    sign = F.when(F.regexp_extract(text, pattern, 1) == "-", "-").otherwise("+")
    hours = F.regexp_extract(text, pattern, 2).cast("decimal(38,0)").cast("string")
    minutes = F.coalesce(F.nullif(F.regexp_extract(text, pattern, 3), F.lit("")), F.lit("0"))
    minutes = minutes.cast("decimal(38,0)").cast("string")

    def two(n: Column) -> Column:
        return F.when(F.length(n) < 2, F.lpad(n, 2, "0")).otherwise(n)

    fits = text.rlike(pattern)
    return F.when(fits, F.concat(sign, two(hours), F.lit(":"), two(minutes))).otherwise(
        F.when(value != "", stripped)
    )


def _last_per_key(rows: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """A key listed several times counts once, with its last row."""
    return rows.groupBy(*by, *KEY).agg(
        F.max_by(F.struct("stated_utc_offset", "affected"), "event_ord").alias("row")
    )


def key_sets(expected: DataFrame, got: DataFrame) -> DataFrame:
    """Every key per (case, run) with ``side``: matched, missing or extra.

    ``expected``: case_id, run and the key.  One full outer join answers both differences and the
    intersection.
    """
    e = expected.select(*RUN, *KEY).distinct().withColumn("e", F.lit(True))
    g = got.select(*RUN, *KEY).distinct().withColumn("g", F.lit(True))
    side = (
        F.when(F.col("e") & F.col("g"), "matched").when(F.col("g").isNull(), "missing").otherwise("extra")
    )
    return e.join(g, [*RUN, *KEY], "full_outer").select(*RUN, *KEY, side.alias("side"))


def score(expected: DataFrame, got: DataFrame, runs: DataFrame, texts: DataFrame) -> DataFrame:
    """One score row per (case, run).

    ``expected``: case_id and raw rows.  ``got``: case_id, run and raw rows.  ``runs``: case_id, run,
    error (NULL when it answered); a run with an error scores nothing.  ``texts``: case_id, text.
    """
    answered = runs.filter("error is null").select(*RUN)
    e = _last_per_key(expected, ("case_id",)).join(answered, "case_id")
    e = e.select(*RUN, *KEY, F.col("row").alias("e"))
    g = _last_per_key(got, RUN).select(*RUN, *KEY, F.col("row").alias("g"))
    both = F.col("e").isNotNull() & F.col("g").isNotNull()
    same = norm_offset(F.col("e.stated_utc_offset")).eqNullSafe(norm_offset(F.col("g.stated_utc_offset")))
    had = F.coalesce("e.affected", F.lit("")) != ""
    has = F.coalesce("g.affected", F.lit("")) != ""
    keys = (
        e.join(g, [*RUN, *KEY], "full_outer")
        .groupBy(*RUN)
        .agg(
            F.count_if(both).alias("matched"),
            F.count_if(F.col("g").isNull()).alias("missing"),
            F.count_if(F.col("e").isNull()).alias("extra"),
            F.count_if(both & ~same).alias("offset_mismatches"),
            F.count_if(both & had & ~has).alias("affected_missing"),
        )
    )
    quotes = evidence_counts(got, texts)
    counts = ("matched", "missing", "extra", "offset_mismatches", "affected_missing")
    evidence = ("evidence_verified", "evidence_total")
    return (
        runs.select(*RUN, "error")
        .join(keys, list(RUN), "left")
        .join(quotes, list(RUN), "left")
        .select(
            *RUN,
            "error",
            *[
                F.when(F.col("error").isNull(), F.coalesce(c, F.lit(0))).otherwise(0).cast("long").alias(c)
                for c in (*counts, *evidence)
            ],
        )
    )


def evidence_counts(got: DataFrame, texts: DataFrame) -> DataFrame:
    """Per run how many rows there are and how many quotes occur in the text of their case."""
    words = texts.select("case_id", textcols.words(F.col("text")).alias("text_words"))
    quoted = got.withColumn("quote_words", textcols.words(F.col("evidence"))).join(words, "case_id", "left")
    verdict = textcols.evidence_verdict(
        F.col("evidence"), F.col("quote_words"), F.lit("x"), F.coalesce("text_words", F.lit(""))
    )
    return quoted.groupBy(*RUN).agg(
        F.count_if(verdict == "ok").alias("evidence_verified"), F.count("*").alias("evidence_total")
    )


def run_passed(max_missing: int = 0, max_extra: int = 0) -> Column:
    return (
        F.col("error").isNull()
        & (F.col("missing") <= max_missing)
        & (F.col("extra") <= max_extra)
        & (F.col("offset_mismatches") == 0)
    )


def identity_sets(got: DataFrame, runs: DataFrame) -> DataFrame:
    """Per run a fingerprint of its set of keys, order and repeats apart.

    A sum of hashes of the distinct keys, with their number: it adds up in parts, so that no set is
    collected.  A run with an error is the empty set.
    """
    keys = got.join(runs.filter("error is null").select(*RUN), list(RUN), "left_semi")
    keys = keys.select(*RUN, *KEY).distinct()
    # two independent hashes, each kept within 40 bits so that their sums cannot overflow
    mask = (1 << 40) - 1
    prints = keys.groupBy(*RUN).agg(
        F.count("*").alias("n"),
        F.sum(F.xxhash64(*KEY).bitwiseAND(mask)).alias("h1"),
        F.sum(F.xxhash64(F.lit("#"), *KEY).bitwiseAND(mask)).alias("h2"),
    )
    zero = F.lit(0)
    return runs.select(*RUN).join(prints, list(RUN), "left").select(
        *RUN,
        F.concat_ws(":", F.coalesce("n", zero), F.coalesce("h1", zero), F.coalesce("h2", zero)).alias("identity"),
    )


def case_result(
    scores: DataFrame, identities: DataFrame, max_missing: int = 0, max_extra: int = 0
) -> DataFrame:
    """Per case: ``passed`` when every run passed, ``stable`` when all runs found the same keys."""
    sets = identities.groupBy("case_id").agg(
        (F.min("identity") == F.max("identity")).alias("stable")
    )
    return (
        scores.groupBy("case_id")
        .agg(
            F.count("*").alias("runs"),
            F.bool_and(run_passed(max_missing, max_extra)).alias("passed"),
            F.max("missing").alias("missing"),
            F.max("extra").alias("extra"),
            F.max("offset_mismatches").alias("offset_mismatches"),
            F.count_if(F.col("error").isNotNull()).alias("errors"),
            F.sum("evidence_verified").cast("long").alias("evidence_verified"),
            F.sum("evidence_total").cast("long").alias("evidence_total"),
        )
        .join(sets, "case_id", "left")
    )


def report(results: DataFrame) -> DataFrame:
    """The verdict over all cases."""
    return results.agg(
        F.count("*").alias("cases"),
        F.coalesce(F.bool_and("passed"), F.lit(True)).alias("passed"),
        F.count_if("passed").alias("passed_cases"),
        F.count_if("stable").alias("stable_cases"),
    )


def juror_scores(
    scores: DataFrame, max_missing: int = 0, max_extra: int = 0
) -> DataFrame:
    """Per (case, panel member) its own score over runs.

    ``scores`` is :func:`score` over ballots, with ``voter`` naming the member; an abstention is an
    error.
    """
    return scores.groupBy("case_id", "voter").agg(
        F.bool_and(run_passed(max_missing, max_extra)).alias("passed"),
        F.sum("matched").cast("long").alias("matched"),
        F.max("missing").alias("missing"),
        F.max("extra").alias("extra"),
        F.max("offset_mismatches").alias("offset_mismatches"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
    )


def extraction_cost(posts: DataFrame, calls_per_post: int) -> DataFrame:
    """Model calls per firm: posts that are new or changed cost, unchanged ones do not."""
    due = F.col("status") != "unchanged"
    return posts.groupBy("firm").agg(
        F.count_if(due).alias("posts"), (F.count_if(due) * calls_per_post).alias("calls")
    )
