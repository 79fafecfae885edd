"""Questions over tracked windows: visible copies, status, overlaps, next window, schedule board."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticewindows import fixed_values as fv
from noticewindows.functions import cells, timecols
from noticewindows.operators.reconcile import WINDOW, with_instants
from noticewindows.session import cut_lineage

_ORDER = ("arrival_seq", "pos")


def attribute_firm(rows: DataFrame, default_firm: str = "") -> DataFrame:
    """Rows written before firms were recorded belong to ``default_firm``."""
    return rows.withColumn("firm", F.coalesce(F.nullif("firm", F.lit("")), F.lit(default_firm)))


def first_copy(rows: DataFrame, identity: Sequence[str]) -> DataFrame:
    """One row per identity, the one that arrived first.

    An aggregate and not a ranking: copies are reduced before the shuffle, so a window announced by
    very many posts costs one row per task.
    """
    rest = [c for c in rows.columns if c not in identity]
    best = F.min_by(F.struct(*rest), F.struct(*_ORDER)).alias("_row")
    return rows.groupBy(*identity).agg(best).select(*identity, "_row.*")


def _shown(tracked: DataFrame) -> DataFrame:
    return tracked.filter("summary <> '' and start_iso <> ''")


def dedup_windows(tracked: DataFrame) -> DataFrame:
    """The first post's copy of every window; rows without title or start are not shown."""
    return first_copy(_shown(tracked), WINDOW)


def event_status(start_at: Column, end_at: Column, now: Column) -> Column:
    return F.when(end_at <= now, "past").when(start_at <= now, "live").otherwise("upcoming")


def future_events(tracked: DataFrame, now: Column) -> DataFrame:
    """Tracked rows that have not ended (an end without an offset is UTC)."""
    return with_instants(tracked).filter(F.col("end_at") > now)


def title_url_lookup(rows: DataFrame, catalog: DataFrame, default_url: str = "") -> DataFrame:
    """Display name and link: the post's own URL, else the firm's page, else ``default_url``.

    ``catalog``: firm, title, firm_url.
    """
    blank = F.lit("")
    return (
        rows.join(catalog.select("firm", "title", "firm_url"), "firm", "left")
        .withColumn("firm_name", F.coalesce("title", "firm"))
        .withColumn(
            "link",
            F.coalesce(F.nullif("url", blank), F.nullif("firm_url", blank), F.lit(default_url)),
        )
        .drop("title", "firm_url")
    )


def event_rows(tracked: DataFrame, catalog: DataFrame, now: Column, default_firm: str = "") -> DataFrame:
    """Every visible window with status, names and UTC times."""
    rows = with_instants(dedup_windows(attribute_firm(tracked, default_firm)))
    rows = rows.filter("start_at is not null and end_at is not null")
    rows = rows.withColumns(
        {
            "status": event_status(F.col("start_at"), F.col("end_at"), now),
            "start_utc": timecols.utc_text(F.col("start_at")),
            "end_utc": timecols.utc_text(F.col("end_at")),
        }
    )
    return title_url_lookup(rows, catalog)


def order_events(rows: DataFrame) -> DataFrame:
    """By start instant, firm and id; the last step before rows leave Spark."""
    return rows.orderBy("start_at", "firm", "event_key")


def overlapping(rows: DataFrame, start: Column, end: Column | None = None) -> DataFrame:
    """Windows that overlap one half-open range; without ``end`` the range is open."""
    hit = F.col("end_at") > start
    return rows.filter(hit if end is None else hit & (F.col("start_at") < end))


def window_overlap(rows: DataFrame, requests: DataFrame) -> DataFrame:
    """Windows for each of many requests: ``end > from and (to is null or start < to)``.

    ``requests``: req_id, firms, types (NULL arrays are no filter), from_at, to_at (may be NULL).
    Windows and requests meet in aligned cells of time (:mod:`cells`): a range of any length, or without an end, is a
    few rows, and a pair is found once.  Requests that name firms join on firm and cell, the others on the cell.
    """
    rows = cut_lineage(rows, "visible")  # read for both cases of both kinds of requests
    asked = requests.select("req_id", "firms", F.col("types").alias("_types"), "from_at", "to_at")
    hit = (
        (F.col("end_at") > F.col("from_at"))
        & (F.col("to_at").isNull() | (F.col("start_at") < F.col("to_at")))
        & (F.col("_types").isNull() | F.array_contains("_types", F.col("event_type")))
    )
    named = asked.filter("firms is not null").withColumn("firm", F.explode(F.array_distinct("firms"))).drop("firms")
    of_all = asked.filter("firms is null").drop("firms")
    found = rows.limit(0).select(F.lit(None).cast(requests.schema["req_id"].dataType).alias("req_id"), *rows.columns)
    for side, keys in ((named, ["firm"]), (of_all, [])):
        for pairs in cells.overlaps(rows, side, keys, ("start_at", "end_at"), ("from_at", "to_at"), hit):
            found = found.unionByName(pairs.select("req_id", *rows.columns))
    return found


def parse_requests(requests: DataFrame, firms: DataFrame, types: Sequence[str], now: Column) -> DataFrame:
    """Query parameters to filters, or an ``error``.

    ``requests``: req_id, firm, type, from_raw, to_raw (NULL or blank means absent).  ``firms``: firm.
    A date of ten characters is midnight UTC, a time without an offset is UTC; a set is comma
    separated, every value must be known, and a set of nothing but commas is an error.  A refused type is answered with
    the known ones; known firms are not listed, as their number grows with the catalog.
    """

    def values(column: str) -> Column:
        parts = F.transform(F.split(F.coalesce(column, F.lit("")), ","), lambda v: timecols.strip(v))
        return F.array_sort(F.array_distinct(F.filter(parts, lambda v: v != "")))

    def given(column: str) -> Column:
        return timecols.strip(F.coalesce(column, F.lit(""))) != ""

    rows = requests.withColumns({"firms": values("firm"), "types": values("type")})
    asked = rows.select("req_id", F.explode("firms").alias("firm"))
    unknown = (
        asked.join(firms.select("firm").distinct(), "firm", "left_anti")
        .groupBy("req_id")
        .agg(F.array_sort(F.collect_list("firm")).alias("bad_firms"))
    )
    rows = rows.join(unknown, "req_id", "left")
    bad_types = F.filter("types", lambda v: ~v.isin(*types))

    def set_error(column: str, bad: Column, found: str, known: Sequence[str] = ()) -> Column:
        wrong = given(column) & ((F.size(bad) > 0) | (F.size(found) == 0))
        listed = F.when(F.size(bad) > 0, F.concat(F.lit("'"), F.array_join(bad, "', '"), F.lit("'"))).otherwise("")
        known_ones = f"; known: {', '.join(sorted(known))}" if known else ""
        return F.when(wrong, F.concat(F.lit(f"unknown {column}: ["), listed, F.lit(f"]{known_ones}")))

    def instant(column: str) -> Column:
        text = timecols.strip(F.coalesce(column, F.lit("")))
        text = F.regexp_replace(text, "[Zz]$", "+00:00")
        value = timecols.iso_instant(text)
        return F.when(F.length(text) == 10, F.date_trunc("day", value)).otherwise(value)

    def instant_error(column: str, name: str, value: str) -> Column:
        wrong = (F.coalesce(column, F.lit("")) != "") & F.col(value).isNull()
        return F.when(
            wrong,
            F.concat(F.lit(f"{name} is neither a date nor a time in ISO form: '"), column, F.lit("'")),
        )

    rows = rows.withColumns({"_from": instant("from_raw"), "to_at": instant("to_raw")})
    rows = rows.withColumn(
        "from_at", F.when(F.coalesce("from_raw", F.lit("")) == "", now).otherwise(F.col("_from"))
    )
    bad_firms = F.coalesce("bad_firms", F.array().cast("array<string>"))
    error = F.coalesce(
        set_error("firm", bad_firms, "firms"),
        set_error("type", bad_types, "types", types),
        instant_error("from_raw", "from", "_from"),
        instant_error("to_raw", "to", "to_at"),
        F.when(F.col("to_at") <= F.col("from_at"), "the range ends before it starts ('to' <= 'from')"),
    )
    return rows.select(
        "req_id",
        F.when(given("firm"), F.col("firms")).alias("firms"),
        F.when(given("type"), F.col("types")).alias("types"),
        "from_at",
        "to_at",
        error.alias("error"),
    )


def next_window(rows: DataFrame, types: Sequence[str] | None = None) -> DataFrame:
    """Per firm the window in progress or the next to start, after the type filter."""
    live = rows.filter("status <> 'past'")
    if types is not None:
        live = live.filter(F.col("event_type").isin(*types))
    rest = [c for c in live.columns if c != "firm"]
    best = F.min_by(F.struct(*rest), F.struct("start_at", "event_key")).alias("_row")
    return live.groupBy("firm").agg(best).select("firm", "_row.*")


def next_per_firm(
    rows: DataFrame, catalog: DataFrame, types: Sequence[str] | None = None
) -> DataFrame:
    """Every firm of the catalog with its next window, or NULLs when nothing is scheduled."""
    upcoming = next_window(rows, types).drop("firm_name")
    return catalog.select("firm", F.coalesce("title", "firm").alias("firm_name")).join(
        upcoming, "firm", "left"
    )


def schedule_board(
    tracked: DataFrame, now: Column, past_limit: int = fv.PAST_ROWS, default_firm: str = ""
) -> DataFrame:
    """Rows of the status page: all upcoming by start, then the newest past ones.

    Identity leaves the type out.  ``part`` is 0 for upcoming and 1 for past; the cap on past rows is
    a top-k over the whole table.
    """
    identity = ["firm", "summary", "start_iso", "end_iso"]
    rows = with_instants(first_copy(_shown(attribute_firm(tracked, default_firm)), identity))
    rows = rows.filter("start_at is not null and end_at is not null")
    upcoming = rows.filter(F.col("end_at") > now).withColumn(
        "row_class", F.when(F.col("start_at") <= now, "live").otherwise("soon")
    )
    past = (
        rows.filter(F.col("end_at") <= now)
        .orderBy(F.desc("start_at"), *_ORDER)
        .limit(past_limit)
        .withColumn("row_class", F.lit("past"))
    )
    return upcoming.withColumn("part", F.lit(0)).unionByName(past.withColumn("part", F.lit(1)))


def select_feed(rows: DataFrame, selections: DataFrame, salt: int = 32, carried: Sequence[str] = ()) -> DataFrame:
    """``(feed_id, row)`` for every feed a row belongs to: optional firm set and optional type set.

    ``selections``: feed_id, firms, types; NULL is no filter, a value listed twice counts once.  Filters become equality keys, with
    ``*`` for no filter, so this is a hash join of the rows that can match.  The key of unfiltered
    feeds would hold every row, so that key is salted.  ``carried``: columns of ``selections`` that go along.
    """
    star = F.array(F.lit("*"))
    kinds = selections.select(
        "feed_id",
        F.explode(F.coalesce(F.array_distinct("firms"), star)).alias("k_firm"),
        "types",
        *carried,
    ).select("feed_id", *carried, "k_firm", F.explode(F.coalesce(F.array_distinct("types"), star)).alias("k_type"))
    salted = kinds.withColumn(
        "k_salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1)))
    )
    cells = F.array(
        *[
            F.struct(f.alias("k_firm"), t.alias("k_type"))
            for f in (F.col("firm"), F.lit("*"))
            for t in (F.col("event_type"), F.lit("*"))
        ]
    )
    offered = rows.select("*", F.explode(cells).alias("_k")).select(
        *rows.columns, "_k.*", F.pmod(F.xxhash64("event_key"), F.lit(salt)).cast("int").alias("k_salt")
    )
    return offered.join(salted, ["k_firm", "k_type", "k_salt"]).select("feed_id", *carried, *rows.columns)
