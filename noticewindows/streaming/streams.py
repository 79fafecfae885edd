"""The same operators over streams: change detection, reconcile, usage, notifications (timers: ``timers``).

State is watermarked or written as versioned tables, so a query continues where it stopped.
The keyed processors of ``timers`` need the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from noticewindows.functions import running, textcols
from noticewindows.operators import usage
from noticewindows.session import cut_lineage, released
from noticewindows.sources import state

FULL_STATE_EVERY = 16  # batches
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _last_values(spark: SparkSession, folder: str, batch_id: int, ddl: str) -> DataFrame:
    """The last value of every key before a batch: the newest row of each since the last batch that held all keys."""
    first = max(batch_id - 1, 0) // FULL_STATE_EVERY * FULL_STATE_EVERY
    paths = [f"{folder}/state/batch={n}" for n in range(first, batch_id)]
    if not paths:
        return spark.createDataFrame([], ddl)
    rows = spark.read.schema(f"{ddl}, batch int").option("basePath", f"{folder}/state").parquet(*paths)
    keys = rows.columns[:-2]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(rows.columns[-2]), "batch").alias("_row"))
    return newest.select(*keys, "_row.*")


def changes_query(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, folder: str, cleared: bool = False, **trigger
) -> StreamingQuery:
    """Append to ``folder``/out the rows whose ``value`` differs from the row before of the same key, across batches.

    A micro-batch is sorted once into even ranges of (key, order), so a key with most of the rows is spread over all
    tasks; what goes from range to range is one row per key and range, what goes from batch to batch one row per
    key, the last value.  It stands before the rows of the batch as one more row.  Every ``FULL_STATE_EVERY`` batches
    the state is written whole, in between the keys of the batch.  A batch that runs again overwrites what it wrote.
    Rows of a later batch count as later.  With ``cleared`` a NULL is never reported, it only ends the value before.
    """
    kinds = rows.schema
    ddl = ", ".join(f"`{c}` {kinds[c].dataType.simpleString()}" for c in (*keys, value))

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        with released():
            given = cut_lineage(batch, "stream-batch")
            last = _last_values(spark, folder, batch_id, ddl)
            here = given.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
            same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
            both = given.withColumn("_new", F.lit(True)).unionByName(
                last.join(here, same, "left_semi").withColumn("_new", F.lit(False)), allowMissingColumns=True
            )
            by = ["_new", *order]
            placed = running.in_ranges(both, keys, by, "_range", "stream-ranges")
            scanned = running.previous_value(placed, keys, "_range", by, value, "_before")
            changed = F.col("_new") & ~F.col(value).eqNullSafe(F.col("_before"))
            if cleared:
                changed = changed & F.col(value).isNotNull()
            scanned.filter(changed).select(*rows.columns).write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")
            newest = placed.groupBy(*keys).agg(F.max_by(F.struct(value), F.struct(*by)).alias("_row")).select(*keys, "_row.*")
            if batch_id % FULL_STATE_EVERY == 0:
                newest = newest.unionByName(last.join(here, same, "left_anti"))
            newest.write.mode("overwrite").parquet(f"{folder}/state/batch={batch_id}")
            if batch_id % FULL_STATE_EVERY == 1:  # the batch that wrote the state whole is done for good
                for n in range(max(0, batch_id - 1 - FULL_STATE_EVERY), batch_id - 1):
                    state.remove(spark, f"{folder}/state/batch={n}")

    return (
        rows.writeStream.foreachBatch(step)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def changes_so_far(rows: DataFrame, folder: str) -> DataFrame:
    """What a ``changes_query`` over ``rows`` has written to ``folder``."""
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{folder}/out").select(*rows.columns)


def snapshot_rows(snapshots: DataFrame) -> DataFrame:
    """``snapshots``: firm, post_key, snapshot_id, seen_at, text.  Only the hash goes on."""
    return snapshots.select(
        "firm", "post_key", "snapshot_id", "seen_at", textcols.content_hash(F.col("text")).alias("content_hash")
    )


def changed_posts_stream(snapshots: DataFrame, folder: str, **trigger) -> StreamingQuery:
    """Snapshots whose text differs from the one before, per (firm, post_key)."""
    rows = snapshot_rows(snapshots)
    return changes_query(rows, ["firm", "post_key"], ["seen_at", "snapshot_id"], "content_hash", folder, **trigger)


def notify_once_stream(run_log: DataFrame, folder: str, **trigger) -> StreamingQuery:
    """Errors that differ from the run before; a success clears the last error of its firm."""
    rows = run_log.select("firm", "run_id", "ts", "error")
    return changes_query(rows, ["firm"], ["ts", "run_id"], "error", folder, cleared=True, **trigger)


def usage_stats_stream(
    access_log: DataFrame, monitor: Column, cap: int | None = None, delay: str = "1 day"
) -> DataFrame:
    """Daily usage per tumbling window; a closed day is final and later rows for it are dropped.

    Two chained stateful aggregations, as in the batch form: one row per (day, kind, who), then one
    per day.
    """
    rows = usage.access_rows(access_log, monitor).withWatermark("ts", delay)
    day = F.window("ts", "1 day")
    per_who = rows.groupBy(day, "kind", "who").agg(F.count("*").alias("n"))
    view = F.col("kind") == "view"
    return (
        per_who.groupBy(F.window("window", "1 day"))
        .agg(
            F.coalesce(F.sum(F.when(view, F.col("n"))), F.lit(0)).alias("views"),
            usage.capped(F.count_if(view), cap).alias("visitors"),
            F.coalesce(F.sum(F.when(~view, F.col("n"))), F.lit(0)).alias("feed_hits"),
            usage.capped(F.count_if(~view), cap).alias("feed_clients"),
        )
        .select(F.to_date("window.start").alias("day"), "views", "visitors", "feed_hits", "feed_clients")
    )


def usage_stats_so_far(
    access_log: DataFrame, monitor: Column, folder: str, cap: int | None = None, delay: str = "1 day"
) -> DataFrame:
    """Daily usage after a bounded run of the stream, days that are still open included.

    The stream keeps one count per (day, kind, who) and writes the changed ones of every batch to the batch's own
    folder, which a replay overwrites; the newest count of each key is the table that days are summed from.
    """
    rows = usage.access_rows(access_log, monitor).withWatermark("ts", delay)
    counts = rows.groupBy(F.window("ts", "1 day"), "kind", "who").agg(F.count("*").alias("n"))

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.select(F.to_date("window.start").alias("day"), "kind", "who", "n").write.mode("overwrite").parquet(
            f"{folder}/out/batch={batch_id}"
        )

    query = (
        counts.writeStream.outputMode("update")
        .foreachBatch(step)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    written = access_log.sparkSession.read.schema("day date, kind string, who string, n long, batch long").parquet(f"{folder}/out")
    newest = written.groupBy("day", "kind", "who").agg(F.max_by("n", "batch").alias("n"))
    return usage.daily_stats(newest, cap)


def reconcile_stream(
    posts: DataFrame,
    root: str,
    checkpoint: str,
    sync: Callable[[dict[str, DataFrame], DataFrame, int], dict[str, DataFrame]],
    firms_of: Callable[[DataFrame], DataFrame] | None = None,
) -> StreamingQuery:
    """One micro-batch is one sync: state in, ``sync``, state out.

    ``sync(tables, batch, batch_id)`` returns the new state tables.  With ``firms_of(batch)``, a table of ``firm``, it
    gets the rows of these firms (and rows without a firm), and only their partitions are read and written.  The
    pointer of the state names the query and the batch that made it: only the same batch of the same query is skipped,
    a query with a new checkpoint goes on from the state there is.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        query_id = spark.read.json(f"{checkpoint}/metadata").first()["id"]
        name = f"{query_id} {batch_id}"
        if state.applied_step(spark, root) == name:
            return
        version = (state.current_version(spark, root) or 0) + 1
        if firms_of is None:
            tables, _ = state.read_state(spark, root)
            state.write_state(spark, root, version, sync(tables, batch, batch_id), name)
            return
        mine = firms_of(batch).select("firm").union(spark.range(1).select(F.lit("").alias("firm"))).distinct()
        parts = state.parts_of(spark, root, firms_of(batch))
        tables, _ = state.read_state(spark, root, parts)
        new = sync({n: t.join(mine, "firm", "left_semi") for n, t in tables.items()}, batch, batch_id)
        others = {n: t.join(mine, "firm", "left_anti") for n, t in tables.items()}
        state.write_state(spark, root, version, {n: new[n].select(*t.columns).unionByName(t) for n, t in others.items()}, name, parts)

    return (
        posts.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def run_to_table(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a bounded stream to its end into a Parquet folder, and read that folder."""
    spark = stream.sparkSession
    query = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def run_in_steps(steps: Sequence[DataFrame], shape: Callable[[DataFrame], DataFrame], folder: str) -> DataFrame:
    """Run a stream to its end after each of ``steps`` has arrived, always from the same checkpoint.

    What one step brings, in however many files, is one micro-batch; its output follows the clock that it brings."""
    spark = steps[0].sparkSession
    for rows in steps:
        rows.write.mode("append").parquet(f"{folder}/in")
        stream = shape(spark.readStream.schema(steps[0].schema).parquet(f"{folder}/in"))
        out = run_to_table(stream, folder)
    return out
