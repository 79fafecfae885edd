"""Daily usage of pages and feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticewindows import fixed_values as fv
from noticewindows.functions import textcols


def access_rows(access_log: DataFrame, monitor: Column) -> DataFrame:
    """Access rows with their day and the hash of their client; feed pulls of the monitor left out.

    ``access_log``: ts, kind (``view`` or ``feed``), visitor_id, addr, user_agent.
    """
    counted = (F.col("kind") == "view") | ~monitor
    return access_log.filter(counted).select(
        F.to_date("ts").alias("day"),
        "ts",
        "kind",
        F.when(F.col("kind") == "view", F.col("visitor_id").cast("string"))
        .otherwise(textcols.client_hash(F.col("addr"), F.col("user_agent")))
        .alias("who"),
    )


def capped(count: Column, cap: int | None) -> Column:
    return count if cap is None else F.least(count, F.lit(cap))


def daily_stats(per_who: DataFrame, cap: int | None = None) -> DataFrame:
    """One row per day from one row per (day, kind, who) with its count ``n``."""
    view = F.col("kind") == "view"
    return per_who.groupBy("day").agg(
        F.coalesce(F.sum(F.when(view, F.col("n"))), F.lit(0)).alias("views"),
        capped(F.count_if(view), cap).alias("visitors"),
        F.coalesce(F.sum(F.when(~view, F.col("n"))), F.lit(0)).alias("feed_hits"),
        capped(F.count_if(~view), cap).alias("feed_clients"),
    )


def usage_stats(
    access_log: DataFrame,
    monitor: Column,
    cap: int | None = None,
    days: int | None = None,
) -> DataFrame:
    """Per day: views, visitors, feed_hits, feed_clients; with ``cap`` distinct counts end there, with ``days`` only
    the newest days are kept.

    First one row per (day, kind, who) with a count, then one row per day: a busy day is reduced in
    every task before it meets, and no distinct set is ever held in one place.
    """
    per_who = access_rows(access_log, monitor).groupBy("day", "kind", "who").agg(F.count("*").alias("n"))
    daily = daily_stats(per_who, cap)
    if days is None:
        return daily
    # one row per day is left here, so this ranking is as long as the calendar
    newest = F.row_number().over(Window.orderBy(F.desc("day")))
    return daily.withColumn("rank", newest).filter(F.col("rank") <= days).drop("rank")


def usage_totals(daily: DataFrame) -> DataFrame:
    """Totals over the kept days."""
    return daily.agg(
        F.sum("views").cast("long").alias("views"), F.sum("feed_hits").cast("long").alias("feed_hits")
    )
