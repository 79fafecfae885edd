"""Ordered scans that stay spread out when one key holds a large share of the rows.

A plain ``Window.partitionBy(key).orderBy(...)`` puts a whole key into one task.  Here the order is
cut into buckets: every bucket is scanned on its own, one summary row per (key, bucket) is scanned across
buckets, and the two are put together.  The second scan sees buckets, never rows.

:func:`in_ranges` makes buckets of even size whatever the values are: it sorts all rows once into ranges of
(key, order) and numbers the ranges.  A column of the rows will do as bucket where it cannot pile up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticewindows.session import cut_lineage


def in_ranges(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], bucket: str, label: str = "ordered", more: dict[str, Column] | None = None
) -> DataFrame:
    """``df`` with ``bucket``, the number of the range of (key, order) that a row falls into, and with the columns of
    ``more``, made once the rows are in their ranges.

    ``order`` should be unique within a key: rows that are equal in it stay together.  The ranges are written to the
    shared folder, because they follow from a sample and all later steps must see the same ones.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(tasks, *keys, *order).withColumn(bucket, F.spark_partition_id().cast("long"))
    return cut_lineage(placed.withColumns(more or {}), label)


def _scan(
    df: DataFrame,
    keys: Sequence[str],
    bucket: str,
    order: Sequence[Column | str],
    local: dict[str, tuple[Column, Column]],
    carried: dict[str, Column],
) -> DataFrame:
    """Add, per name: the in-bucket window column and the value carried in from earlier buckets."""
    # the rows are shuffled once, by a struct, which also places and finds NULL keys; summaries are made before that
    at = F.struct(*[F.col(c).alias(f"k{n}") for n, c in enumerate((*keys, bucket))])
    inside = Window.partitionBy("__at").orderBy(*order)
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    summary = df.groupBy(*keys, bucket).agg(*[c[1].alias(f"__s_{n}") for n, c in local.items()])
    summary = summary.select(at.alias("__at"), *[carried[n].over(before).alias(f"__c_{n}") for n in local])
    placed = df.withColumn("__at", at).repartition("__at")
    out = placed.select("*", *[c[0].over(inside).alias(f"__l_{n}") for n, c in local.items()])
    return out.join(summary, "__at", "left").drop("__at")


def running_sum(
    df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[Column | str], sums: dict[str, Column]
) -> DataFrame:
    """Running sums up to and including the row, one new column per entry of ``sums``."""
    out = _scan(
        df,
        keys,
        bucket,
        order,
        {n: (F.sum(c), F.sum(c)) for n, c in sums.items()},
        {n: F.sum(f"__s_{n}") for n in sums},
    )
    for n in sums:
        out = out.withColumn(n, F.coalesce(f"__l_{n}", F.lit(0)) + F.coalesce(f"__c_{n}", F.lit(0)))
    return out.drop(*[f"__{p}_{n}" for n in sums for p in "lc"])


def running_max(
    df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[Column | str], maxima: dict[str, Column]
) -> DataFrame:
    """Running maxima up to and including the row; NULLs are passed over."""
    out = _scan(
        df,
        keys,
        bucket,
        order,
        {n: (F.max(c), F.max(c)) for n, c in maxima.items()},
        {n: F.max(f"__s_{n}") for n in maxima},
    )
    for n in maxima:
        local, carried = F.col(f"__l_{n}"), F.col(f"__c_{n}")
        best = F.when(local.isNull() | (carried > local), carried).otherwise(local)
        out = out.withColumn(n, best)
    return out.drop(*[f"__{p}_{n}" for n in maxima for p in "lc"])


def previous_value(
    df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[str], value: str, name: str
) -> DataFrame:
    """The value of the row before, across buckets; NULL on a key's first row."""
    boxed = F.struct(F.col(value).alias("v"))
    last = F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order))
    out = _scan(
        df,
        keys,
        bucket,
        order,
        {name: (F.lag(boxed, 1), last)},
        {name: F.last(f"__s_{name}", ignorenulls=True)},
    )
    picked = F.coalesce(F.col(f"__l_{name}"), F.col(f"__c_{name}"))
    return out.withColumn(name, picked["v"]).drop(f"__l_{name}", f"__c_{name}")
