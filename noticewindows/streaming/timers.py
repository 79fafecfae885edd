"""Streams that act when time passes: state expiry, deferred release, stale sources.

Time is event time.  The input of each stream holds rows of its own kind and clock rows (a tick of the scheduler, or
the timestamps of a ``rate`` source); the watermark over both is the clock.  A run over stored files therefore gives the
same result whenever it is made, and ends.  Posts are kept in ``SHARDS`` shards by hash: a call per post costs some
milliseconds whatever it does, a call per shard handles the posts of the shard as columns.  A shard has one timer, at
the next instant something is due.  Sources (:func:`stale_sources`) are few and keep a timer each.

Clock rows have a null firm; they only move the watermark.  Rows that are not newer than the clock are late and
dropped, as in any stream with a watermark.  The processors need the RocksDB state store (:func:`streams.use_rocksdb`).
A checkpoint belongs to its number of shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from noticewindows import fixed_values as fv

DAY_MS = 86_400_000
SHARDS = 512
_POST = ["firm", "post_key"]


def _us(column: pd.Series) -> pd.Series:
    """Microseconds of a timestamp column without nulls."""
    return column.astype("datetime64[us]").astype("int64")


def _ms(column: pd.Series) -> pd.Series:
    """Milliseconds of a timestamp column, NaN where it is null.  Timers count milliseconds."""
    filled = column.astype("datetime64[us]")
    return (filled.astype("int64") // 1000).where(filled.notna())


class _Timers:
    """One timer per key that moves: the old one goes when a new one is set."""

    def __init__(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle

    def move(self, old: int | None, new: int | None) -> None:
        if old == new:
            return
        if old is not None and old >= 0:
            self._handle.deleteTimer(old)
        if new is not None and new >= 0:
            self._handle.registerTimer(new)


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64(*_POST), F.lit(shards)).alias("shard")


def _records(rows: pd.DataFrame) -> list[tuple]:
    return list(rows.astype(object).where(rows.notna(), None).itertuples(index=False, name=None))


# --- state expiry --------------------------------------------------------------------------


class _Expiry(StatefulProcessor):
    """What is known of the posts of a shard, each until it was long unseen, holds nothing back and all its windows
    have ended."""

    _COLUMNS = [*_POST, "last_seen", "last_end", "held"]

    def __init__(self, days: int) -> None:
        self._keep = days * DAY_MS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._posts = handle.getListState("posts", "firm string, post_key string, last_seen long, last_end long, held long")
        self._timer = handle.getValueState("timer", "due long")
        self._timers = _Timers(handle)

    def _known(self) -> pd.DataFrame:
        return pd.DataFrame(list(self._posts.get()), columns=self._COLUMNS)

    def _expires(self, posts: pd.DataFrame) -> pd.Series:
        """The first instant at which nothing keeps a post; -1 while rows are held back."""
        due = (posts["last_seen"] + self._keep).clip(lower=posts["last_end"]) + 1
        return due.where(posts["held"] <= 0, -1).astype("int64")

    def _keep_posts(self, posts: pd.DataFrame) -> None:
        old = self._timer.get()[0] if self._timer.exists() else None
        if posts.empty:
            self._posts.clear()
        else:
            self._posts.put(_records(posts[self._COLUMNS]))
        due = self._expires(posts)
        due = due[due >= 0]
        new = int(due.min()) if len(due) else None
        self._timers.move(old, new)
        if new is None:
            self._timer.clear()
        elif new != old:
            self._timer.update((new,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        given = []
        for frame in rows:
            frame = frame[frame["firm"].notna()]
            if len(frame):
                made = frame[_POST].assign(last_seen=_ms(frame["at"]), last_end=_ms(frame["end_at"]).fillna(-1), held=frame["held"])
                given.append(made.astype({"last_seen": "int64", "last_end": "int64", "held": "int64"}))
        if not given:
            return iter(())
        if self._posts.exists():
            given.append(self._known())
        every = pd.concat(given, ignore_index=True).groupby(_POST, dropna=False, sort=False, as_index=False)
        self._keep_posts(every.agg({"last_seen": "max", "last_end": "max", "held": "sum"}))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        posts = self._known()
        due = self._expires(posts)
        over = (due >= 0) & (due <= timerValues.getCurrentWatermarkInMs())
        self._timer.clear()  # this one is gone by itself
        self._keep_posts(posts[~over])
        if over.any():
            gone = posts.loc[over, _POST].assign(
                last_seen=pd.to_datetime(posts["last_seen"][over], unit="ms"), expired_at=pd.to_datetime(due[over], unit="ms")
            )
            yield gone.reset_index(drop=True)


def state_expiry(
    sightings: DataFrame, days: int = fv.PRUNE_AFTER_DAYS, delay: str = "0 seconds", shards: int = SHARDS
) -> DataFrame:
    """A row for every post whose state goes, as soon as the clock allows it.

    ``sightings``: firm, post_key, at, end_at (of a window it announces, or NULL), held (rows held back: +n, or -n when
    they are released).  A post that is seen again afterwards starts anew.
    """
    rows = sightings.select(*_POST, "at", "end_at", F.col("held").cast("long").alias("held"), _shard(shards)).withWatermark("at", delay)
    return rows.groupBy("shard").transformWithStateInPandas(
        _Expiry(days), "firm string, post_key string, last_seen timestamp, expired_at timestamp", "Append", "EventTime"
    )


# --- deferred release ----------------------------------------------------------------------


class _Release(StatefulProcessor):
    """Rows held back by the posts of a shard, until the instant at which they come within range."""

    _COLUMNS = ["release_ms", *_POST, "event_ord", "end_ms"]

    def __init__(self, days: int) -> None:
        self._ahead = days * DAY_MS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._held = handle.getListState("held", "release_ms long, firm string, post_key string, event_ord long, end_ms long")
        self._timer = handle.getValueState("timer", "due long")
        self._timers = _Timers(handle)

    def _wait_for(self, old: int | None, new: int | None) -> None:
        self._timers.move(old, new)
        if new is not None and new != old:
            self._timer.update((new,))

    @staticmethod
    def _judged(clock: int, rows: pd.DataFrame) -> pd.DataFrame:
        outcome = (rows["end_ms"] <= clock).map({True: "rejected", False: "publish"})
        made = rows[[*_POST, "event_ord"]].assign(outcome=outcome, clock=pd.Timestamp(clock, unit="ms"))
        return made.reset_index(drop=True)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        clock, ready, first = timerValues.getCurrentWatermarkInMs(), [], None
        for frame in rows:
            frame = frame[frame["firm"].notna()]
            if not len(frame):
                continue
            made = frame[[*_POST, "event_ord"]].assign(release_ms=_ms(frame["start_at"]) - self._ahead, end_ms=_ms(frame["end_at"]))
            made = made[self._COLUMNS].astype({"release_ms": "int64", "event_ord": "int64", "end_ms": "int64"})
            due = made["release_ms"] <= clock
            if due.any():
                ready.append(made[due])
            if not due.all():
                self._held.appendList(_records(made[~due]))
                low = int(made["release_ms"][~due].min())
                first = low if first is None else min(first, low)
        if first is not None:
            old = self._timer.get()[0] if self._timer.exists() else None
            self._wait_for(old, first if old is None else min(old, first))
        if ready:
            yield self._judged(clock, pd.concat(ready, ignore_index=True))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        clock = timerValues.getCurrentWatermarkInMs()
        held = pd.DataFrame(list(self._held.get()), columns=self._COLUMNS)
        over = held["release_ms"] <= clock
        left = held[~over]
        self._timer.clear()  # this one is gone by itself
        if left.empty:
            self._held.clear()
        else:
            self._held.put(_records(left))
            self._wait_for(None, int(left["release_ms"].min()))
        if over.any():
            yield self._judged(clock, held[over])


def deferred_release(
    held: DataFrame, max_days_ahead: int = fv.MAX_DAYS_AHEAD, delay: str = "0 seconds", shards: int = SHARDS
) -> DataFrame:
    """Held rows at the first clock that brings them within range: ``outcome`` publish, or rejected when that clock
    finds them ended.

    ``held``: firm, post_key, event_ord, start_at, end_at, at (when it was held back).
    """
    rows = held.select(*_POST, "event_ord", "start_at", "end_at", "at", _shard(shards)).withWatermark("at", delay)
    return rows.groupBy("shard").transformWithStateInPandas(
        _Release(max_days_ahead), "firm string, post_key string, event_ord long, outcome string, clock timestamp", "Append", "EventTime"
    )


# --- stale sources -------------------------------------------------------------------------


class _Stale(StatefulProcessor):
    """The last success of a source, and whether its silence has been reported."""

    def __init__(self, limit_ms: int) -> None:
        self._limit = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        # the last success in microseconds (-1: none), the millisecond from which silence counts, whether it was reported
        self._source = handle.getValueState("source", "success long, since long, stale boolean")
        self._timers = _Timers(handle)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        since = int(_ms(initialState["started_at"]).min())
        self._source.update((-1, since, False))
        self._timers.move(None, since + self._limit + 1)

    @staticmethod
    def _told(key, stale: bool, success: int, at: int) -> pd.DataFrame:
        last = pd.to_datetime([success], unit="us") if success >= 0 else pd.Series([pd.NaT], dtype="datetime64[ns]")
        return pd.DataFrame({"firm": [key[0]], "stale": [stale], "last_success": last, "at": pd.to_datetime([at], unit="ms")})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if key[0] is None:
            return
        known = self._source.exists()
        success, since, stale = self._source.get() if known else (-1, -1, False)
        newest, first = success, None
        for frame in rows:
            if len(frame):
                at = _us(frame["at"])
                first = int(at.min()) if first is None else min(first, int(at.min()))
                good = at[frame["error"].isna()]
                newest = max(newest, int(good.max())) if len(good) else newest
        if first is None or (known and newest == success):
            return
        start = (newest if newest >= 0 else first) // 1000  # a source that is in no catalog counts from its first run
        due = start + self._limit + 1
        late = due <= timerValues.getCurrentWatermarkInMs()
        self._timers.move(since + self._limit + 1 if known and not stale else None, None if late else due)
        if stale and not late:
            yield self._told(key, False, newest, start)
        if late and not stale:
            yield self._told(key, True, newest, due)
        self._source.update((newest, start, late))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        success, since, stale = self._source.get()
        if not stale and expiredTimerInfo.getExpiryTimeInMs() == since + self._limit + 1:
            self._source.update((success, since, True))
            yield self._told(key, True, success, since + self._limit + 1)


def stale_sources(run_log: DataFrame, catalog: DataFrame, interval_seconds: float, delay: str = "0 seconds") -> DataFrame:
    """A row whenever a source falls silent for more than two intervals, and when it is back.

    ``run_log``: firm, at, error.  ``catalog``: firm, started_at of every source, so that one without a single run is
    known from the start.
    """
    limit = int(interval_seconds * fv.STALE_INTERVALS * 1000)
    rows = run_log.select("firm", "at", "error").withWatermark("at", delay)
    first = catalog.select("firm", "started_at").groupBy("firm")
    return rows.groupBy("firm").transformWithStateInPandas(
        _Stale(limit), "firm string, stale boolean, last_success timestamp, at timestamp", "Append", "EventTime", first
    )
