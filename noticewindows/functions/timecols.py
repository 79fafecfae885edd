"""Column functions for wall-clock strings, offsets, zones and instants.

The session zone is always UTC, so a "local" column below is a wall-clock value carried in a
``TimestampType`` column as if it were UTC; only ``*_at`` columns are true instants.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticewindows import fixed_values as fv

# a date, or a date and a time of at least hours and minutes, then optionally an offset
_ISO = (
    r"^\d{4}-\d{2}-\d{2}"
    r"(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?(?:Z|[+-]\d{2}:?\d{2})?)?$"
)
_OWN_OFFSET = r"(?<=:\d{2}(?:\.\d{1,6})?)(?:Z|[+-]\d{2}:?\d{2})$"
_STRIP = r"^\s+|\s+$"


def _col(value: Column | str) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def strip(text: Column) -> Column:
    """Both ends trimmed of any white space, not only of blanks."""
    return F.regexp_replace(text, _STRIP, "")


def iso_instant(text: Column) -> Column:
    """The instant of ISO 8601 text; without an offset it is UTC.  NULL when it is no such text."""
    # the cast wants seconds in front of an offset
    whole = F.regexp_replace(text, r"^(.{16})(Z|[+-])", "$1:00$2")
    return F.when(text.rlike(_ISO), whole.try_cast("timestamp"))


def _may_end_in_offset(text: Column) -> Column:
    """False only where ``_OWN_OFFSET`` cannot match, which is the common case and told without a pattern: an offset has
    a ``Z``, a ``+``, or a ``-`` behind the first colon."""
    colon = F.call_function("locate", F.lit(":"), text)
    return text.contains("Z") | text.contains("+") | (F.call_function("locate", F.lit("-"), text, colon) > 0)


def iso_local(text: Column) -> Column:
    """The wall-clock part of ISO 8601 text, its own offset left aside."""
    plain = F.when(_may_end_in_offset(text), F.regexp_replace(text, _OWN_OFFSET, "")).otherwise(text)
    return iso_instant(plain)


def iso_offset_s(text: Column) -> Column:
    """The offset that ISO 8601 text carries itself, in seconds; NULL when it has none."""
    return F.when(
        _may_end_in_offset(text) & text.rlike(_OWN_OFFSET), F.unix_seconds(iso_local(text)) - F.unix_seconds(iso_instant(text))
    )


def parse_offset(stated: Column) -> Column:
    """Seconds east of UTC of a stated offset such as ``GMT+3``; NULL when it is not usable."""
    text = strip(stated)
    return offset_of_parts(text, offset_parts(text))


def offset_parts(text: Column) -> Column:
    """Sign, hours and minutes of a stripped stated offset, each with a mark behind it and the numbers with a zero in
    front, so that absent minutes are none; other text stays as it is.

    One search finds all three: as a column of its own it runs once per row."""
    return F.regexp_replace(text, fv.STATED_OFFSET, "$1\u00010$2\u00010$3\u0001")


def offset_of_parts(text: Column, parts: Column) -> Column:
    """Seconds of a stripped stated offset and its parts; NULL when it is not usable."""
    part = lambda n: F.substring_index(F.substring_index(parts, "\u0001", n), "\u0001", -1)
    hours, minutes = part(2).try_cast("int"), part(3).try_cast("int")
    sign = F.when(part(1) == "-", -1).otherwise(1)
    return F.when((parts != text) & (hours <= 23) & (minutes <= 59), sign * (hours * 3600 + minutes * 60))


def shift(ts: Column, seconds: Column) -> Column:
    """``ts`` moved by whole seconds, keeping microseconds."""
    return F.timestamp_micros(F.unix_micros(ts) + seconds.cast("long") * 1_000_000)


def to_instant(local: Column, own_offset_s: Column, stated_offset_s: Column, zone: Column) -> Column:
    """Own offset first, the stated one next, the source's zone last (first pass of a repeated hour)."""
    offset = F.coalesce(own_offset_s, stated_offset_s)
    return F.when(offset.isNotNull(), shift(local, -offset)).otherwise(F.to_utc_timestamp(local, zone))


def zone_offset_s(ts: Column, zone: Column | str) -> Column:
    """Seconds east of UTC in ``zone`` at the instant ``ts``."""
    local = F.from_utc_timestamp(ts, _col(zone))
    return F.unix_seconds(local) - F.unix_seconds(ts)


def offset_text(seconds: Column, separator: str = ":") -> Column:
    """``+03:00`` (or ``+0300`` with an empty separator)."""
    clock = F.date_format(F.timestamp_seconds(F.abs(seconds)), f"HH{separator}mm")
    return F.concat(F.when(seconds < 0, "-").otherwise("+"), clock)


def iso_in_zone(ts: Column, zone: Column | str) -> Column:
    """The instant as ISO text on the zone's clock; microseconds only when they are not zero."""
    local = F.from_utc_timestamp(ts, _col(zone))
    text = F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.regexp_replace(text, r"\.000000$", ""), offset_text(zone_offset_s(ts, zone)))


def minutes_text(text: Column) -> Column:
    """ISO text cut to minutes, offset kept, so ``08:00`` and ``08:00:00`` are one statement."""
    offset = iso_offset_s(text)
    tail = F.when(offset.isNull(), "").otherwise(offset_text(offset))
    return F.coalesce(F.concat(F.date_format(iso_local(text), "yyyy-MM-dd'T'HH:mm"), tail), text)


def repeated_hour(ts: Column, zone: Column | str) -> Column:
    """True in the second pass of an hour that the zone's clock shows twice."""
    zone = _col(zone)
    return F.to_utc_timestamp(F.from_utc_timestamp(ts, zone), zone) != ts


def utc_text(ts: Column) -> Column:
    """ISO text of an instant in UTC, for results that leave Spark."""
    return iso_in_zone(ts, "UTC")


def humanize(seconds: Column) -> Column:
    """A compact age such as ``4 min`` or ``3 h``."""
    s = F.greatest(seconds.cast("double"), F.lit(0.0))

    def part(divisor: int, unit: str) -> Column:
        return F.concat(F.floor(s / divisor).cast("long").cast("string"), F.lit(f" {unit}"))

    return (
        F.when(s < 90, part(1, "s"))
        .when(s < 5400, part(60, "min"))
        .when(s < 172_800, part(3600, "h"))
        .otherwise(part(86_400, "d"))
    )
