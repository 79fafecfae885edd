"""Intervals of time as aligned cells, so that "a point lies in an interval" becomes an equality join.

Time is cut into base cells of ``UNIT`` seconds; two neighbours make a cell of the next level, and so on.  An interval
is the union of a few disjoint aligned cells, at most two per level, however long it is.  A point lies in one cell of
each level.  The cells of an interval and of a point inside it have exactly one cell in common: joined on the cell, a
pair is found once.  Base cells are coarse, so the exact comparison follows the join.

Two intervals overlap when the start of one lies in the other: :func:`overlaps` splits on which one that is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

UNIT = 4096
LEVELS = 28  # 2**28 base cells are 34,000 years
_ORIGIN = 1 << 37  # seconds before 1970, so that numbers of cells are positive
PER_TASK = 5_000  # rows of both sides for each task of a join on cells alone


def _base(at: Column) -> Column:
    return F.floor((F.unix_seconds(at) + F.lit(_ORIGIN)) / F.lit(UNIT)).cast("long")


def _code(level: Column, cell: Column) -> Column:
    return F.lit(1 << 40) * level.cast("long") + cell


def interval_cells(low: Column, high: Column, levels: int = LEVELS) -> Column:
    """The disjoint cells that make up [low, high], both ends included; none where low > high or one is NULL."""
    first, after = _base(low), _base(high) + 1

    def of_level(level: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("long"), level)
        left = F.call_function("shiftright", first + size - 1, level)
        right = F.call_function("shiftright", after, level)
        inside = left < right
        # whatever is not the half of a larger cell inside: an odd first cell, an even last one
        return F.array(F.when(inside & (left % 2 == 1), _code(level, left)), F.when(inside & (right % 2 == 1), _code(level, right - 1)))

    both = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), of_level))
    return F.filter(both, lambda c: c.isNotNull())


def point_cells(at: Column, levels: int) -> Column:
    """The cells of levels 0 .. ``levels`` that hold the instant."""
    base = _base(at)
    return F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda k: _code(k, F.call_function("shiftright", base, k)))


def _spans(left: DataFrame, right: DataFrame, ends: tuple[tuple[str, str], tuple[str, str]]) -> list[Row]:
    """Per side the seconds between which its starts lie, the base cells of its longest interval (NULL if one is open)
    and its number of rows, in one job."""
    rows = None
    for n, (side, (low, high)) in enumerate(zip((left, right), ends, strict=True)):
        seconds = F.unix_seconds(low)
        size = _base(F.col(high)) - _base(F.col(low)) + 1
        row = side.agg(
            F.min(seconds).alias("first"),
            (F.max(seconds) + 1).alias("last"),
            F.when(~F.bool_or(F.col(high).isNull()), F.coalesce(F.max(size), F.lit(0))).alias("longest"),
            F.count("*").alias("rows"),
        ).withColumn("n", F.lit(n))
        rows = row if rows is None else rows.unionByName(row)
    found = {r["n"]: r for r in rows.collect()}
    return [found[0], found[1]]


def overlaps(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_ends: tuple[str, str], right_ends: tuple[str, str], hit: Column, how: str = "inner"
) -> list[DataFrame]:
    """Two joins that together hold every pair with equal ``keys`` and ``hit`` once, or for ``left_semi`` every left row
    that has a partner (in one or both).  No joins at all when a side is empty.

    ``hit`` must imply that the intervals share an instant; an end may be NULL for "open".  The columns of the two
    sides must differ, but for the keys.  Intervals are cut to where the points of the other side lie: the extent of
    those is asked for beforehand, so both sides should be tables.  Points are dealt to no level above that of the longest
    interval: hours among hours are three or four rows, whatever time all of them span.

    Without ``keys`` the pairs can be the square of the rows, so tasks are counted by rows and not by the few bytes that
    are shuffled; where time has fewer cells than there are tasks, the left rows of a cell are dealt to several.
    """
    out = []
    spans = _spans(left, right, (left_ends, right_ends))
    if spans[0]["first"] is None or spans[1]["first"] is None:
        return out
    cases = ((left, right, left_ends[0], right_ends, *spans), (right, left, right_ends[0], left_ends, *reversed(spans)))
    for inside, around, point, (low, high), points_of, ranges_of in cases:
        first, last = points_of["first"], points_of["last"]
        levels = min(LEVELS, int((last - first) // UNIT + 2).bit_length())
        if ranges_of["longest"] is not None:  # a cell of level n is made of 2**n base cells
            levels = min(levels, max(int(ranges_of["longest"]), 1).bit_length() - 1)
        start = F.greatest(F.col(low), F.timestamp_seconds(F.lit(first).cast("long")))
        end = F.least(F.col(high), F.timestamp_seconds(F.lit(last).cast("long")))  # NULL is passed over: an open end is the last point
        points = inside.withColumn("_cell", F.explode(point_cells(F.col(point), levels)))
        ranges = around.withColumn("_cell", F.explode(interval_cells(start, end, levels)))
        one, two = (points, ranges) if inside is left else (ranges, points)
        at = [*keys, "_cell"]
        if not keys and how == "inner":
            tasks = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), (spans[0]["rows"] + spans[1]["rows"]) // PER_TASK)
            deal = min(32, max(1, tasks // int((last - first) // UNIT + 1)))
            one = one.withColumn("_deal", F.pmod(F.monotonically_increasing_id(), F.lit(deal)))
            two = two.withColumn("_deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(deal - 1).cast("long"))))
            at = [*at, "_deal"]
            one, two = one.repartition(tasks, *at), two.repartition(tasks, *at)
        # a pair with equal starts belongs to the first case
        later = F.col(left_ends[0]) >= F.col(right_ends[0])
        mine = later if inside is left else ~later
        if how == "left_semi":
            renamed = two.select(*[F.col(c).alias(f"_k_{c}") if c in (*keys, "_cell") else F.col(c) for c in two.columns])
            same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in keys] + [F.col("_cell") == F.col("_k__cell")]
            condition = mine & hit
            for c in same:
                condition = condition & c
            out.append(one.join(renamed, condition, "left_semi").drop("_cell"))
        else:
            out.append(one.join(two, at).filter(mine & hit).drop("_cell", "_deal"))
    return out
