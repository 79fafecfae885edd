"""Quality rules: a threshold table compiled into one Spark projection.

``RULES`` holds one row per rule: a metric, a comparison and a bound.  ``apply_rules`` adds the base counts and the
verdict as columns; everything is a built-in expression, no user function runs.

Defined results: a null text has no words, fails the base rule and is not kept; so does a text of blanks.  Rows are
judged on their own: repeated rows get equal verdicts, extra columns pass through.  Input columns named like a result
are replaced.  Windows are compared by their 64-bit hash.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = r"[\x20\x09-\x0D]+"
SOLID = r"[^\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

# Function words of the languages served; compared in lower case with the bare word.
STOP_WORDS = (
    # English
    "the of and to in a is that it was for on are as with be by at this from or an not have which "
    # French
    "le la les de des du un une et en que qui dans pour pas sur au par est avec ce se il elle "
    # German
    "der die das und den dem von zu mit sich auf für ist im nicht ein eine als auch es "
    # Spanish
    "el los las del y no una su al lo como más pero sus con por para sin"
).split()


class Rule(NamedTuple):
    name: str
    metric: str
    compare: str  # ">=" or "<="
    bound: float


RULES = (
    Rule("short_words", "mean_word_chars", ">=", 2.0),
    Rule("long_words", "mean_word_chars", "<=", 14.0),
    Rule("symbols", "symbols_per_word", "<=", 0.30),
    Rule("stop_words", "stop_word_share", ">=", 0.02),
    Rule("repeated_lines", "dup_line_share", "<=", 0.50),
    Rule("word_lines", "words_per_line", ">=", 2.0),
)


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top.cast("double") / bottom).otherwise(F.lit(0.0))


METRICS = {
    "mean_word_chars": lambda c: _ratio(c["word_chars"], c["n_words"]),
    "symbols_per_word": lambda c: _ratio(c["n_symbols"], c["n_words"]),
    "stop_word_share": lambda c: _ratio(c["n_stop_words"], c["n_words"]),
    "dup_line_share": lambda c: _ratio(c["n_dup_lines"], c["n_lines"]),
    "words_per_line": lambda c: _ratio(c["n_words"], c["n_lines"]),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words")


def _repeat_columns(df: DataFrame) -> DataFrame:
    """Words covered by three-word windows that the text holds twice or more.

    Windows are hashed, sorted with their place, and kept where a neighbour has the same hash; the places of those
    windows, in order, each add the words that the window before did not cover.  All in the row, n log n.
    """
    word = lambda i, k: F.get("_words", i + k)
    places = F.sequence(F.lit(0), F.size("_words") - 3)
    df = df.withColumn(
        "_windows",
        F.when(F.size("_words") >= 3, F.transform(places, lambda i: F.xxhash64(word(i, 0), word(i, 1), word(i, 2)))).otherwise(F.array().cast("array<bigint>")),
    )
    df = df.withColumn(
        "_sorted",
        F.when(
            F.size(F.array_distinct("_windows")) < F.size("_windows"),
            F.sort_array(F.arrays_zip(F.col("_windows").alias("h"), F.sequence(F.lit(0), F.size("_windows") - 1).alias("at"))),
        ),
    )
    same = lambda x, i: F.coalesce(F.get("_sorted", i)["h"] == x["h"], F.lit(False))
    df = df.withColumn("_at", F.sort_array(F.transform(F.filter("_sorted", lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["at"])))
    covered = F.aggregate(
        F.transform("_at", lambda p, i: F.least(F.lit(3), F.coalesce(p - F.get("_at", i - 1), F.lit(3)))),
        F.lit(0).cast("bigint"),
        lambda total, x: total + x,
    )
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("bigint")))


def base_counts(df: DataFrame, text: str = "text", stop_words: tuple[str, ...] | list[str] = STOP_WORDS) -> DataFrame:
    """Add the counts of ``COUNTS`` (long) to every row."""
    df = df.drop(*[c for c in COUNTS if c != text]).withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    df = df.withColumns(
        {
            "_words": F.array_remove(F.split("_text", BLANK), ""),
            "_lines": F.filter(F.split("_text", "\n"), lambda line: line.rlike(SOLID)),
        }
    )
    df = _repeat_columns(df)
    return df.withColumns(
        {
            "n_words": F.size("_words").cast("bigint"),
            "word_chars": F.length(F.array_join("_words", "")).cast("bigint"),
            "n_symbols": F.regexp_count("_text", F.lit(SYMBOL)).cast("bigint"),
            "n_lines": F.size("_lines").cast("bigint"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
            "n_stop_words": F.size(F.filter("_words", lambda w: F.lower(w).isin(*stop_words))).cast("bigint"),
        }
    ).drop("_text", "_words", "_lines", "_windows", "_sorted", "_at")


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """True where every rule of the table holds."""
    columns = {name: F.col(name) for name in COUNTS}
    passed = F.lit(True)
    for rule in rules:
        value = METRICS[rule.metric](columns)
        passed = passed & (value >= rule.bound if rule.compare == ">=" else value <= rule.bound)
    return passed


def apply_rules(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add the base counts, ``base_failed`` and ``kept`` to every row of ``df``."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    counted = base_counts(df, text).withColumn("base_failed", failed)
    return counted.withColumn("kept", ~F.col("base_failed") & verdict(rules))


def keep_good(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``df`` that pass, with their own columns only.

    The filter hangs on a row number that is always at least 0: the optimizer does not move such a filter below the
    counts, where each use of a count would be written out again."""
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{text}`").alias("text"))
    judged = apply_rules(packed, "text", rules).select("row", (F.col("kept") & (F.monotonically_increasing_id() >= 0)).alias("kept"))
    return judged.where("kept").select("row.*")


RESULT = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return apply_rules(documents).select(*RESULT)


_STOP_SQL = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))

OP2_SQL = rf"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), places AS (
  SELECT doc_id, unnest(range(0, len(w) - 2)) AS i, w FROM base WHERE len(w) >= 3
), windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i + 1], w[i + 2], w[i + 3]) AS n FROM places
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
  FROM windows, (VALUES (0), (1), (2)) AS v(k) WHERE n >= 2 GROUP BY doc_id
), counts AS (
  SELECT b.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines,
         coalesce(c.n_repeat_words, 0)::BIGINT AS n_repeat_words,
         len(list_filter(w, lambda x: lower(x) IN ({_STOP_SQL}))) AS n_stop
  FROM base b LEFT JOIN covered c ON b.doc_id = c.doc_id
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed
         AND word_chars >= 2.0 * n_words AND word_chars <= 14.0 * n_words
         AND n_symbols::DOUBLE / n_words <= 0.30 AND n_stop::DOUBLE / n_words >= 0.02
         AND n_dup_lines::DOUBLE / n_lines <= 0.50 AND n_words::DOUBLE / n_lines >= 2.0 AS kept
FROM judged
"""
