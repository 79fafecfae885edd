"""Previous windows and newly extracted ones to an explicit plan, and the plan to new state.

Inside one run a firm's posts are taken in page order, and later posts see what earlier ones did.
That order is kept without a loop: every release and every request of a window becomes a -1 or +1 in
a timeline per (firm, window), and the running balance says what each of them means.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticewindows import fixed_values as fv
from noticewindows.functions import cells, running, timecols
from noticewindows.session import cut_lineage

POST = ["firm", "post_key"]
WINDOW = ["firm", "event_type", "start_iso", "end_iso", "summary"]
_EVENT = ["event_type", "summary", "start_iso", "end_iso", "evidence"]
PROMOTED = 1 << 40  # promotions come after every post of the page


def future(end_at: Column, now: Column) -> Column:
    """Not ended yet; an end at this very moment has ended."""
    return end_at > now


def is_placeholder(entry_id: Column) -> Column:
    return entry_id.startswith(fv.PLACEHOLDER_PREFIX)


def with_instants(tracked: DataFrame) -> DataFrame:
    """``start_at`` and ``end_at`` of tracked rows; a missing start reads as the end."""
    end_at = timecols.iso_instant(F.col("end_iso"))
    start_at = F.when(
        F.coalesce(F.col("start_iso"), F.lit("")) == "", end_at
    ).otherwise(timecols.iso_instant(F.col("start_iso")))
    return tracked.withColumns({"start_at": start_at, "end_at": end_at})


def _first_per_key(rows: DataFrame, order: Column) -> DataFrame:
    """One row per (post, event_key): the first in ``order``."""
    rest = [c for c in rows.columns if c not in (*POST, "event_key")]
    best = F.min_by(F.struct(*rest), order).alias("_row")
    return rows.groupBy(*POST, "event_key").agg(best).select(*POST, "event_key", "_row.*")


def diff_events(tracked: DataFrame, new: DataFrame, extracted: DataFrame, now: Column) -> DataFrame:
    """Full outer join of old and new windows of the extracted posts, with ``change``.

    ``extracted``: firm, post_key, proc_ord, recover.  ``change``: kept, added, ended or missing.
    """
    old = _first_per_key(
        with_instants(tracked.join(extracted.select(*POST), POST, "left_semi")).select(
            *POST, "event_key", "entry_id", "pos", "end_at", *_EVENT
        ),
        F.col("pos"),
    )
    fresh = _first_per_key(
        new.select(*POST, "event_key", "event_ord", *_EVENT), F.col("event_ord")
    )
    o = old.select(*POST, "event_key", F.struct("entry_id", "pos", "end_at", *_EVENT).alias("old"))
    n = fresh.select(*POST, "event_key", F.struct("event_ord", *_EVENT).alias("new"))
    change = (
        F.when(F.col("old").isNotNull() & F.col("new").isNotNull(), "kept")
        .when(F.col("new").isNotNull(), "added")
        .when(future(F.col("old.end_at"), now), "missing")
        .otherwise("ended")
    )
    return (
        o.join(n, [*POST, "event_key"], "full_outer")
        .withColumn("change", change)
        .join(extracted.select(*POST, "proc_ord", "recover"), POST)
    )


def guard_posts(diff: DataFrame, delete_on_empty: bool = False) -> DataFrame:
    """Per post its counts and ``guarded``: future rows missing, nothing new, and no override."""
    counts = diff.groupBy(*POST).agg(
        F.count_if(F.col("old").isNotNull()).alias("n_old"),
        F.count_if(F.col("new").isNotNull()).alias("n_new"),
        F.count_if(F.col("change") == "missing").alias("n_missing"),
        F.count_if(F.col("change") == "added").alias("n_added"),
    )
    guarded = (F.col("n_missing") > 0) & (F.col("n_added") == 0) & F.lit(not delete_on_empty)
    return counts.withColumn("guarded", guarded)


def shrink_guard(diff: DataFrame, delete_on_empty: bool = False) -> DataFrame:
    """One anomaly row per post that lost future windows and gained none."""
    return (
        guard_posts(diff.filter(~F.col("recover")), delete_on_empty)
        .filter("guarded")
        .select(*POST, "n_old", "n_new", "n_missing", _guard_text().alias("anomaly"))
    )


def _guard_text() -> Column:
    def n(c: str) -> Column:
        return F.col(c).cast("string")

    return F.concat(
        F.lit("post "),
        "post_key",
        F.lit(" previously extracted "),
        n("n_old"),
        F.lit(" event(s) and now extracts "),
        n("n_new"),
        F.lit(" with none new — refusing to delete "),
        n("n_missing"),
        F.lit(" future event(s)"),
    )


def overlap_anti(new: DataFrame, tracked: DataFrame) -> DataFrame:
    """New windows that overlap nothing of their own post: not the same key, and no closed overlap
    with a tracked window of the same (or no) type.

    Both sides meet in aligned cells of time (:mod:`cells`), so the join has a full equality key (post and cell), a
    window of any length is a few rows, and a post with very many windows is spread over its cells.  Only tracked
    windows of the posts in ``new`` are read further.
    """
    left = cut_lineage(new.select(*POST, "event_key", "event_type", "start_at", "end_at"), "overlap-new")
    here = left.select(*POST).distinct()
    old = tracked.select(*POST, "event_key", "event_type", "start_iso", "end_iso").alias("o").join(
        here.alias("h"), F.col("o.firm").eqNullSafe(F.col("h.firm")) & (F.col("o.post_key") == F.col("h.post_key")), "left_semi"
    )
    right = cut_lineage(
        with_instants(old).select(
            *POST,
            F.col("event_key").alias("t_key"),
            F.col("event_type").alias("t_type"),
            F.col("start_at").alias("t_start"),
            F.col("end_at").alias("t_end"),
        ),
        "overlap-old",
    )
    t_key = right.select(F.col("firm").alias("t_firm"), F.col("post_key").alias("t_post"), "t_key")
    own = F.col("firm").eqNullSafe(F.col("t_firm")) & (F.col("post_key") == F.col("t_post"))
    hit = left.select(*POST, "event_key").join(t_key, own & (F.col("event_key") == F.col("t_key")), "left_semi")
    kind = (F.coalesce("t_type", F.lit("")) == "") | (F.col("t_type") == F.col("event_type"))
    touch = (F.col("start_at") <= F.col("t_end")) & (F.col("t_start") <= F.col("end_at"))
    timed = right.filter("t_start is not null and t_end is not null")
    for part in cells.overlaps(left, timed, POST, ("start_at", "end_at"), ("t_start", "t_end"), kind & touch, "left_semi"):
        hit = hit.unionByName(part.select(*POST, "event_key"))
    return new.join(hit.distinct(), [*POST, "event_key"], "left_anti")


def shared_window(new: DataFrame, tracked: DataFrame) -> DataFrame:
    """New windows that another post of the firm already tracks, with the earliest holder's entry.

    Per window only the earliest holder and the earliest holder of any other post are needed, so the
    holders are reduced before they are joined.
    """
    holders = tracked.filter("start_iso <> '' and start_iso is not null").select(
        *WINDOW, "post_key", "entry_id", F.struct("arrival_seq", "pos").alias("ord")
    )
    per_post = holders.groupBy(*WINDOW, "post_key").agg(
        F.min("ord").alias("ord"), F.min_by("entry_id", "ord").alias("entry_id")
    )
    first = per_post.groupBy(*WINDOW).agg(
        F.min_by(F.struct("post_key", "ord", "entry_id"), "ord").alias("h1")
    )
    second = (
        per_post.join(first.select(*WINDOW, F.col("h1.post_key").alias("p1")), WINDOW)
        .filter(F.col("post_key") != F.col("p1"))
        .groupBy(*WINDOW)
        .agg(F.min_by(F.struct("post_key", "ord", "entry_id"), "ord").alias("h2"))
    )
    two = first.join(second, WINDOW, "left")
    holder = F.when(F.col("h1.post_key") != F.col("post_key"), F.col("h1")).otherwise(F.col("h2"))
    return (
        new.join(two, WINDOW)
        .withColumn("_h", holder)
        .filter("_h is not null")
        .withColumns({"holder_post": F.col("_h.post_key"), "holder_entry": F.col("_h.entry_id")})
        .drop("h1", "h2", "_h")
    )


def other_references(tracked: DataFrame) -> DataFrame:
    """Tracked rows with the number of *other* posts that point at the same entry."""
    posts = tracked.select("entry_id", "firm", "post_key").distinct().groupBy("entry_id").agg(
        F.count("*").alias("n_posts")
    )
    return tracked.join(posts, "entry_id").withColumn("other_posts", F.col("n_posts") - 1).drop("n_posts")


def adopt_existing(new: DataFrame, calendar_inventory: DataFrame) -> DataFrame:
    """New windows with the entry the calendar already has for their key, if any."""
    known = calendar_inventory.groupBy("event_key").agg(F.min("entry_id").alias("calendar_entry"))
    return new.join(known, "event_key", "left")


def refcount_timeline(refs: DataFrame, opening: DataFrame) -> DataFrame:
    """Running reference count per (firm, window) in processing order.

    ``refs``: the window's columns, proc_ord, step (0 release, 1 request), tie, delta.  ``opening``:
    the window's columns, held, entry_id.  Adds ``balance`` (after the row) and ``before``.
    """
    start = opening.select(*WINDOW, "held", F.col("entry_id").alias("opening_entry"))
    rows = (
        refs.join(start, WINDOW, "left")
        .withColumn("held", F.coalesce("held", F.lit(0)).cast("long"))
    )
    rows = running.in_ranges(rows, WINDOW, ["proc_ord", "step", "tie"], "block", "references")
    rows = running.running_sum(
        rows, WINDOW, "block", ["proc_ord", "step", "tie"], {"moved": F.col("delta").cast("long")}
    )
    return rows.withColumns(
        {
            "balance": F.col("held") + F.col("moved"),
            "before": F.col("held") + F.col("moved") - F.col("delta"),
        }
    )


def opening_balance(tracked: DataFrame, real_calendar: bool) -> DataFrame:
    """References per window before the run, and the earliest holder's entry.

    In a real calendar a placeholder has no entry behind it and cannot be shared.
    """
    held = tracked.filter("start_iso <> '' and start_iso is not null")
    if real_calendar:
        held = held.filter(~is_placeholder(F.col("entry_id")))
    # one reference per post and key, however often a post lists it
    once = _first_per_key(
        held.select(*WINDOW, "post_key", "event_key", "entry_id", "arrival_seq", "pos"),
        F.struct("arrival_seq", "pos"),
    )
    return once.groupBy(*WINDOW).agg(
        F.count("*").alias("held"), F.min_by("entry_id", F.struct("arrival_seq", "pos")).alias("entry_id")
    )


def reconcile(
    tracked: DataFrame,
    new: DataFrame,
    extracted: DataFrame,
    calendar_inventory: DataFrame,
    now: Column,
    delete_on_empty: bool = False,
    promoted: DataFrame | None = None,
    real_calendar: bool = False,
) -> DataFrame:
    """The plan of one run: what happens to every window of the posts that were extracted.

    The diff and the timeline are each read several times, so both are written to the shared folder
    once, and so is the plan itself: a table that a dry run shows and :func:`apply_plan` reads.

    ``action``: keep, refuse, history, release, delete, share, adopt or create.  ``promoted`` rows are
    requests of posts that were not extracted; they come after every other request.
    """
    diff = diff_events(tracked, new, extracted, now)
    guards = guard_posts(diff, delete_on_empty).select(*POST, "guarded")
    survivors = overlap_anti(
        with_instants(new.drop("start_at", "end_at")).join(
            extracted.filter("recover").select(*POST), POST, "left_semi"
        ),
        tracked,
    ).select(*POST, "event_key", F.lit(True).alias("clear")).distinct()
    rows = diff.join(guards, POST, "left").join(survivors, [*POST, "event_key"], "left")
    recover, change = F.col("recover"), F.col("change")
    step = (
        F.when(change == "added", F.when(~recover | F.col("clear"), "add"))
        .when(recover | (change == "kept"), "keep")
        .when(F.col("guarded"), F.when(change == "ended", "keep").otherwise("refuse"))
        .when(change == "missing", "drop")
        .otherwise("history")
    )
    side = F.when(F.col("old").isNotNull(), F.struct(*[F.col(f"old.{c}").alias(c) for c in _EVENT])).otherwise(
        F.struct(*[F.col(f"new.{c}").alias(c) for c in _EVENT])
    )
    rows = rows.withColumn("step", step).filter("step is not null").select(
        *POST,
        "proc_ord",
        "event_key",
        F.coalesce("new.event_ord", "old.pos").alias("tie"),
        F.col("old.entry_id").alias("old_entry"),
        "step",
        side.alias("e"),
    ).select("*", "e.*").drop("e")
    rows = cut_lineage(rows, "diff")
    settled = rows.filter(F.col("step").isin("keep", "refuse", "history")).select(
        *POST, "proc_ord", "event_key", F.col("old_entry").alias("entry_id"), F.col("step").alias("action"), "tie", *_EVENT
    )
    moving = rows.filter(F.col("step").isin("add", "drop")).withColumn("delta", F.when(F.col("step") == "add", 1).otherwise(-1))
    if promoted is not None:
        extra = _first_per_key(
            promoted.select(*POST, "event_key", "event_ord", "arrival_seq", *_EVENT), F.col("event_ord")
        )
        moving = moving.unionByName(
            extra.select(
                *POST,
                (F.lit(PROMOTED) + F.col("arrival_seq")).alias("proc_ord"),
                "event_key",
                F.col("event_ord").alias("tie"),
                F.lit(None).cast("string").alias("old_entry"),
                F.lit("add").alias("step"),
                *_EVENT,
                F.lit(1).alias("delta"),
            )
        )
    decided = _decide(moving, opening_balance(tracked, real_calendar), calendar_inventory)
    return cut_lineage(settled.unionByName(decided), "plan")


def _decide(moving: DataFrame, opening: DataFrame, inventory: DataFrame) -> DataFrame:
    """Releases and requests to delete, release, share, adopt and create."""
    # a window without a start has no identity to share: each such row is its own window
    alone = F.coalesce("start_iso", F.lit("")) == ""
    refs = moving.withColumn("_kind", F.col("step")).withColumn(
        "step", F.when(F.col("delta") < 0, 0).otherwise(1)
    )
    timeline = refcount_timeline(refs.filter(~alone), opening)
    lone = refs.filter(alone).withColumns(
        {
            "before": F.when(F.col("delta") < 0, F.lit(1)).otherwise(F.lit(0)).cast("long"),
            "balance": F.when(F.col("delta") < 0, F.lit(0)).otherwise(F.lit(1)).cast("long"),
            "opening_entry": F.lit(None).cast("string"),
            "block": F.lit(0).cast("long"),
        }
    )
    rows = timeline.select(*lone.columns).unionByName(lone)
    rows = adopt_existing(rows, inventory)
    action = (
        F.when(F.col("_kind") == "drop", F.when(F.col("balance") > 0, "release").otherwise("delete"))
        .when(F.col("before") > 0, "share")
        .when(F.col("calendar_entry").isNotNull(), "adopt")
        .otherwise("create")
    )
    fresh = F.coalesce("calendar_entry", F.concat(F.lit(fv.PLACEHOLDER_PREFIX), "event_key"))
    rows = cut_lineage(rows.withColumn("action", action), "timeline")
    started = F.when(
        F.col("action").isin("adopt", "create"), F.struct("proc_ord", "step", "tie", fresh.alias("entry"))
    )
    rows = running.running_max(
        rows, WINDOW, "block", ["proc_ord", "step", "tie"], {"island": started}
    )
    entry = (
        F.when(F.col("_kind") == "drop", F.col("old_entry"))
        .when(F.col("action") == "share", F.coalesce("island.entry", "opening_entry"))
        .otherwise(fresh)
    )
    return rows.select(
        *POST, "proc_ord", "event_key", entry.alias("entry_id"), "action", "tie", *_EVENT
    )


def merge_duplicates(
    tracked: DataFrame, now: Column, failed_deletes: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(tracked', deletes)``: future windows with several entries are pointed at one of them.

    The earliest real entry survives, or the earliest placeholder when there is no real one.  Entries
    whose delete failed stay as they are for the next run.
    """
    live = with_instants(tracked).filter(
        (F.coalesce("start_iso", F.lit("")) != "") & future(F.col("end_at"), now)
    )
    order = F.struct(is_placeholder(F.col("entry_id")), F.col("arrival_seq"), F.col("pos"))
    # most windows have one entry; only the others are joined with anything
    survivors = live.groupBy(*WINDOW).agg(
        F.min_by("entry_id", order).alias("survivor"), (F.min("entry_id") != F.max("entry_id")).alias("several")
    )
    survivors = survivors.filter("several").drop("several")
    pairs = (
        live.select(*WINDOW, "entry_id")
        .distinct()
        .join(survivors, WINDOW)
        .filter("entry_id <> survivor")
    )
    if failed_deletes is not None:
        pairs = pairs.join(failed_deletes.select("entry_id").distinct(), "entry_id", "left_anti")
    pairs = pairs.select(*WINDOW, "entry_id", "survivor")
    deletes = pairs.filter(~is_placeholder(F.col("entry_id"))).select(*WINDOW, "entry_id", "survivor")
    on_end = with_instants(tracked).withColumn("_live", future(F.col("end_at"), now))
    moved = (
        on_end.join(pairs.withColumn("_live", F.lit(True)), [*WINDOW, "entry_id", "_live"], "left")
        .withColumn("entry_id", F.coalesce("survivor", "entry_id"))
        .select(*tracked.columns)
    )
    return moved, deletes


def promote_deferred(
    judged: DataFrame, tracked: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(promoted, still_deferred, newly_rejected)`` of held rows judged again.

    ``judged`` comes from :func:`validate.judge_events` over the held rows of posts that were not
    extracted, with empty post texts.  A key the post already tracks is not published again.
    """
    known = tracked.select(*POST, "event_key").distinct()
    promoted = judged.filter("reason is null").join(known, [*POST, "event_key"], "left_anti")
    still = judged.filter("retryable")
    dropped = judged.filter("reason is not null and not retryable")
    return promoted, still, dropped


def recover_unchanged(tracked: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of "re-extract once" posts: all tracked rows, and new ones that overlap none of them."""
    kept = tracked.select(*POST, "event_key", "entry_id", *_EVENT, F.lit("keep").alias("action"))
    added = overlap_anti(new, tracked).select(
        *POST,
        "event_key",
        F.lit(None).cast("string").alias("entry_id"),
        *_EVENT,
        F.lit("add").alias("action"),
    )
    return kept.join(new.select(*POST).distinct(), POST, "left_semi").unionByName(added)


def prune(
    post_state: DataFrame, tracked: DataFrame, deferred: DataFrame, now: Column, days: int = fv.PRUNE_AFTER_DAYS
) -> DataFrame:
    """``post_state`` without posts long unseen, holding nothing back, whose windows have all ended."""
    busy = (
        with_instants(tracked).filter(F.col("end_at") >= now).select(*POST)
        .unionByName(deferred.select(*POST))
        .distinct()
    )
    cutoff = timecols.shift(now, F.lit(-days * 86_400))
    old = post_state.filter(F.col("last_seen") < cutoff).join(busy, POST, "left_anti").select(*POST)
    return post_state.join(old, POST, "left_anti")


def apply_plan(tracked: DataFrame, plan: DataFrame, extracted: DataFrame, arrivals: DataFrame) -> DataFrame:
    """Tracked rows after the plan: extracted posts from the plan, all others as they were.

    ``arrivals``: firm, post_key, arrival_seq for every post the plan speaks of.
    """
    stays = F.col("action").isin("keep", "refuse", "history", "share", "adopt", "create")
    before = tracked.select(*POST, "event_key", "pos")
    before = before.groupBy(*POST, "event_key").agg(F.min("pos").alias("pos"))
    last = before.groupBy(*POST).agg(F.max("pos").alias("last_pos"))
    planned = (
        plan.filter(stays)
        .join(before, [*POST, "event_key"], "left")
        .join(last, POST, "left")
        .join(arrivals.select(*POST, "arrival_seq"), POST, "left")
    )
    # new windows of a post follow what it holds, in the order in which they were extracted
    extracted_order = Window.partitionBy(*POST, F.col("pos").isNull()).orderBy("tie", "event_key")
    place = F.coalesce("pos", F.coalesce("last_pos", F.lit(0)) + F.row_number().over(extracted_order))
    fresh = planned.withColumn("pos", place).select(*tracked.columns)
    return tracked.join(extracted.select(*POST), POST, "left_anti").unionByName(fresh)
