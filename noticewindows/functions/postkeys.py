"""Dates in titles and URLs, and the identity of a post."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticewindows import fixed_values as fv


def _month_number(name: Column) -> Column:
    table = F.create_map(
        *[F.lit(x) for n, names in enumerate(fv.MONTHS, 1) for key in names for x in (key, f"{n:02d}")]
    )
    return F.try_element_at(table, F.lower(name))


def _date(text: Column, pattern: str, day: int, month: int) -> Column:
    day_text = F.lpad(F.regexp_extract(text, pattern, day), 2, "0")
    iso = F.concat(
        F.regexp_extract(text, pattern, 3),
        F.lit("-"),
        _month_number(F.regexp_extract(text, pattern, month)),
        F.lit("-"),
        day_text,
    )
    return F.when(text.rlike(pattern), F.to_date(F.try_to_timestamp(iso, F.lit("yyyy-MM-dd"))))


def date_in(text: Column) -> Column:
    """The date in ``28 May 2026``, ``Jun 4 2026`` or a slug; day-first is tried first."""
    return F.coalesce(
        _date(text, fv.DATE_DAY_FIRST, 1, 2), _date(text, fv.DATE_MONTH_FIRST, 2, 1)
    )


def last_segment(url: Column) -> Column:
    return F.substring_index(F.regexp_replace(url, "/+$", ""), "/", -1)


def post_key(title: Column, url: Column, prefix: Column) -> Column:
    """Date in the title, else in the URL's last segment, else that segment, else a title slug."""
    day = F.coalesce(date_in(title), date_in(last_segment(url)))
    slug = F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(
        F.concat(prefix, F.lit("-"), F.date_format(day, "yyyy-MM-dd")),
        F.nullif(last_segment(url), F.lit("")),
        slug,
    )
