"""Reconciliation against a small sequential model of the rules, and state rules one by one."""

import random

from datetime import datetime

from pyspark.sql import functions as F

from noticewindows.functions import timecols
from noticewindows.operators import posts as posts_ops
from noticewindows.operators import reconcile, windows
from noticewindows.plans import sync as sync_plan
from noticewindows.operators import validate
from noticewindows.sources import state
from noticewindows.streaming import streams

TRACKED = state.STATE_TABLES["tracked"]
NEW = (
    "firm string, post_key string, event_ord long, event_key string, event_type string, summary string, "
    "start_iso string, end_iso string, start_at timestamp, end_at timestamp, evidence string"
)
NOW = "2026-06-01T00:00:00"


def iso(n):
    """Window ``n``: two hours on day ``n`` counted from now; negative ones are over."""
    day = f"2026-06-{n + 1:02d}" if n >= 0 else f"2026-05-{31 + n:02d}"
    return f"{day}T10:00:00+00:00", f"{day}T12:00:00+00:00"


def key(post, n):
    return f"{post}:{n}"


def tracked_row(firm, post, seq, pos, n, entry=None, kind="other", start=True):
    s, e = iso(n)
    return (firm, post, seq, pos, key(post, n), entry or f"e{n}", kind, f"w{n}", s if start else "", e, "")


def new_row(firm, post, pos, n, kind="other"):
    s, e = iso(n)
    return (firm, post, pos, key(post, n), kind, f"w{n}", s, e, None, None, "")


def run(spark, tracked, new, posts, inventory=(), **more):
    t = spark.createDataFrame(tracked, TRACKED)
    n = spark.createDataFrame(new, NEW).withColumns(
        {c: timecols.iso_instant(F.col(c.replace("_at", "_iso"))) for c in ("start_at", "end_at")}
    )
    p = spark.createDataFrame(posts, "firm string, post_key string, proc_ord long, recover boolean")
    i = spark.createDataFrame(list(inventory), "event_key string, entry_id string")
    plan = reconcile.reconcile(t, n, p, i, timecols.iso_instant(F.lit(NOW)), **more)
    arrivals = p.select("firm", "post_key", F.col("proc_ord").alias("arrival_seq"))
    return t, p, plan, reconcile.apply_plan(t, plan, p, arrivals)


def actions(plan, firm=None):
    rows = plan.collect()
    return {(r.post_key, r.event_key.split(":")[1]): r.action for r in rows if firm in (None, r.firm)}


def model(old, new, order):
    """Sequential reading of the rules: posts in page order, drops before adds, shared by window."""
    held = {p: set(w) for p, w in old.items()}
    out = {}
    for post in order:
        before, found = held.get(post, set()), set(new.get(post, ()))
        missing = {n for n in before - found if n >= 0}
        if missing and not (found - before):
            for n in before:
                out[post, str(n)] = "refuse" if n in missing else "keep"
            continue
        keep = set()
        for n in sorted(before - found):
            if n < 0:
                out[post, str(n)] = "history"
                keep.add(n)
                continue
            others = any(n in w for p, w in held.items() if p != post)
            out[post, str(n)] = "release" if others else "delete"
        for n in before & found:
            out[post, str(n)] = "keep"
        for n in found - before:
            others = any(n in w for p, w in held.items() if p != post)
            out[post, str(n)] = "share" if others else "create"
        held[post] = keep | found
    return out, held


def test_plan_equals_sequential_model_on_many_firms(spark):
    rng = random.Random(11)
    tracked, new, posts, want, final = [], [], [], {}, {}
    for f in range(150):
        firm = f"f{f}"
        names = [f"{firm}p{i}" for i in range(rng.randint(1, 5))]
        old = {p: {n for n in range(-2, 5) if rng.random() < 0.4} for p in names if rng.random() < 0.8}
        fresh = {p: {n for n in range(-2, 5) if rng.random() < 0.4} for p in names}
        order = [p for p in names if rng.random() < 0.85]
        rng.shuffle(order)
        want[firm], final[firm] = model(old, {p: fresh[p] for p in order}, order)
        for seq, p in enumerate(old):
            tracked += [tracked_row(firm, p, seq, i, n, f"{firm}-e{n}") for i, n in enumerate(sorted(old[p]))]
        for o, p in enumerate(order):
            posts.append((firm, p, o, False))
            new += [new_row(firm, p, i, n) for i, n in enumerate(sorted(fresh[p]))]
    _, _, plan, after = run(spark, tracked, new, posts)
    got = {}
    for r in plan.collect():
        got.setdefault(r.firm, {})[r.post_key, r.event_key.split(":")[1]] = r.action
    for firm, rows in want.items():
        assert got.get(firm, {}) == rows, firm
    left = {}
    for r in after.collect():
        left.setdefault((r.firm, r.post_key), set()).add(int(r.event_key.split(":")[1]))
    for firm, held in final.items():
        for p, w in held.items():
            assert left.get((firm, p), set()) == w


def test_shared_entry_ids_follow_the_window(spark):
    rows = [tracked_row("f", "a", 1, 0, 1, "real1"), tracked_row("f", "a", 1, 1, 2, "real2")]
    new = [new_row("f", "a", 0, 3), new_row("f", "b", 0, 1), new_row("f", "b", 1, 3), new_row("f", "c", 0, 4)]
    _, _, plan, _ = run(
        spark, rows, new, [("f", "b", 0, False), ("f", "a", 1, False), ("f", "c", 2, False)],
        [(key("c", 4), "ext4")],
    )
    got = {(r.post_key, r.event_key[-1]): (r.action, r.entry_id) for r in plan.collect()}
    assert got["b", "1"] == ("share", "real1")  # a still holds it when b asks
    assert got["b", "3"] == ("create", "ics:b:3")
    assert got["a", "3"] == ("share", "ics:b:3")
    assert got["a", "1"] == ("release", "real1")  # b holds it by then
    assert got["a", "2"] == ("delete", "real2")
    assert got["c", "4"] == ("adopt", "ext4")


def test_guard_and_its_override(spark):
    rows = [tracked_row("f", "a", 1, 0, 1), tracked_row("f", "a", 1, 1, 2)]
    _, _, plan, _ = run(spark, rows, [new_row("f", "a", 0, 1)], [("f", "a", 0, False)])
    assert actions(plan) == {("a", "1"): "keep", ("a", "2"): "refuse"}
    _, _, plan, after = run(spark, rows, [], [("f", "a", 0, False)], delete_on_empty=True)
    assert set(actions(plan).values()) == {"delete"} and after.count() == 0


def test_recover_adds_only_what_overlaps_nothing(spark):
    rows = [tracked_row("f", "a", 1, 0, 1)]
    drifted = list(new_row("f", "a", 0, 1))
    drifted[3], drifted[7] = "a:drift", "2026-06-02T12:30:00+00:00"
    new = [tuple(drifted), new_row("f", "a", 1, 5), new_row("f", "a", 2, 1)]
    _, _, plan, _ = run(spark, rows, new, [("f", "a", 0, True)])
    assert {(r.event_key, r.action) for r in plan.collect()} == {("a:1", "keep"), ("a:5", "create")}


def test_placeholders_are_not_shared_into_a_real_calendar(spark):
    rows = [tracked_row("f", "a", 1, 0, 1, "ics:a:1")]
    posts = [("f", "b", 0, False)]
    _, _, plan, _ = run(spark, rows, [new_row("f", "b", 0, 1)], posts, real_calendar=True)
    assert actions(plan) == {("b", "1"): "create"}
    _, _, plan, _ = run(spark, rows, [new_row("f", "b", 0, 1)], posts)
    assert actions(plan) == {("b", "1"): "share"}


def test_second_run_changes_nothing(spark):
    new = [new_row("f", "a", 0, 1), new_row("f", "b", 0, 1), new_row("f", "b", 1, -1)]
    posts = [("f", "a", 0, False), ("f", "b", 1, False)]
    _, _, plan, after = run(spark, [], new, posts)
    rows = [tuple(r) for r in after.collect()]
    _, _, again, _ = run(spark, rows, new, posts)
    assert set(actions(again).values()) == {"keep"}


def test_merge_duplicates(spark):
    rows = [
        tracked_row("f", "a", 1, 0, 1, "ics:a"),
        tracked_row("f", "b", 2, 0, 1, "real-b"),
        tracked_row("f", "c", 3, 0, 1, "real-c"),
        tracked_row("f", "c", 3, 1, -1, "old-c"),
        tracked_row("f", "a", 1, 1, -1, "old-a"),
        tracked_row("g", "z", 4, 0, 1, "real-z"),
    ]
    t = spark.createDataFrame(rows, TRACKED)
    now = timecols.iso_instant(F.lit(NOW))
    moved, deletes = reconcile.merge_duplicates(t, now)
    assert {r.entry_id for r in deletes.collect()} == {"real-c"}
    got = {(r.post_key, r.pos): r.entry_id for r in moved.collect()}
    assert got == {
        ("a", 0): "real-b", ("b", 0): "real-b", ("c", 0): "real-b",
        ("c", 1): "old-c", ("a", 1): "old-a", ("z", 0): "real-z",
    }
    again, more = reconcile.merge_duplicates(moved, now)
    assert more.count() == 0 and sorted(map(tuple, again.collect())) == sorted(map(tuple, moved.collect()))
    failed = spark.createDataFrame([("real-c",)], "entry_id string")
    kept, none = reconcile.merge_duplicates(t, now, failed)
    assert none.count() == 0
    assert {r.entry_id for r in kept.filter("post_key = 'c'").collect()} == {"real-c", "old-c"}


def test_prune(spark):
    seen = [("old", "2026-04-01"), ("held", "2026-04-01"), ("busy", "2026-04-01"), ("new", "2026-05-30"), ("bare", "2026-04-01")]
    posts = spark.createDataFrame([("f", p, s) for p, s in seen], "firm string, post_key string, s string")
    posts = posts.withColumn("last_seen", timecols.iso_instant(F.col("s")))
    t = spark.createDataFrame([tracked_row("f", "old", 1, 0, -2), tracked_row("f", "busy", 2, 0, 3)], TRACKED)
    d = spark.createDataFrame([("f", "held")], "firm string, post_key string")
    left = reconcile.prune(posts, t, d, timecols.iso_instant(F.lit(NOW)))
    assert {r.post_key for r in left.collect()} == {"held", "busy", "new"}


def test_windows_without_a_start_never_share_but_are_deleted(spark):
    rows = [tracked_row("f", "a", 1, 0, 1, "real", start=False)]
    _, _, plan, _ = run(spark, rows, [new_row("f", "a", 0, 2)], [("f", "a", 0, False)])
    assert actions(plan) == {("a", "1"): "delete", ("a", "2"): "create"}


def test_state_round_trip_missing_columns_and_corruption(spark, tmp_path):
    root = str(tmp_path / "state")
    tables, warnings = state.read_state(spark, root)
    assert all(t.count() == 0 for t in tables.values()) and warnings.count() == 0
    rows = spark.createDataFrame([tracked_row("f", "a", 1, 0, 1)], TRACKED)
    state.write_state(spark, root, 1, {**tables, "tracked": rows.drop("evidence", "summary")})
    state.write_state(spark, root, 2, {**tables, "tracked": rows.drop("evidence", "summary")})
    assert state.current_version(spark, root) == 2
    back = state.read_state(spark, root)[0]["tracked"].first()
    assert (back.evidence, back.summary, back.event_key) == ("", "", "a:1")
    (tmp_path / "state" / "CURRENT").write_text("nonsense")
    tables, warnings = state.read_state(spark, root)
    assert warnings.count() == 1 and tables["tracked"].count() == 0
    (tmp_path / "state" / "CURRENT").write_text("7")
    assert state.read_state(spark, root)[1].count() == 1


def ballot(post, voter, n, events, error=None):
    found = None
    if events is not None:
        found = [(i, "other", s, e, "+00:00", None, "high", None) for i, (s, e) in enumerate(events)]
    return ("f", post, voter, n, found, error)


def test_sync_end_to_end(spark):
    from noticewindows.operators import replies

    firms = spark.createDataFrame(
        [("f", ["maintenance"], "UTC", False), ("g", ["maintenance"], "UTC", False)],
        "firm string, keywords array<string>, timezone string, require_stated_offset boolean",
    )
    posts_ddl = "firm string, post_key string, text string, url string, pos long"
    ballots_ddl = f"firm string, post_key string, voter string, ballot_ord int, events array<{replies.EVENT_STRUCT}>, error string"
    posts = spark.createDataFrame(
        [("f", "p1", "Maintenance soon", "u1", 0), ("f", "p2", "maintenance too", "u2", 1), ("f", "p3", "swap news", "u3", 2),
         ("g", "q1", "nothing here", "u4", 0)],
        posts_ddl,
    )
    near, far = ("2026-06-03T10:00", "2026-06-03T12:00"), ("2026-11-03T10:00", "2026-11-03T12:00")
    votes = spark.createDataFrame(
        [ballot("p1", v, n, [near, far]) for n, v in enumerate(("m1", "m2", "m3"))]
        + [ballot("p2", "m1", 0, [near]), ballot("p2", "m2", 1, None, "down"), ballot("p2", "m3", 2, None, "down")],
        ballots_ddl,
    )
    rules = validate.EventRules()
    members = ["m1", "m2", "m3"]
    first = sync_plan.sync(posts, votes, state.empty_state(spark), firms, rules, sync_plan.utc(NOW), members)
    assert {r.action for r in first.plan.collect()} == {"create"}
    assert first.tables["tracked"].count() == 1 and first.tables["deferred"].count() == 1
    report = {r.firm: r for r in first.reports.collect()}
    assert (report["f"].posts_seen, report["f"].posts_relevant, report["f"].events_created, report["f"].events_deferred) == (3, 2, 1, 1)
    codes = {(r.firm, r.code) for r in first.anomalies.collect()}
    assert codes == {("g", "gate"), ("f", "error")}
    status = {r.firm: r.status for r in first.outcomes.collect()}
    assert status == {"f": "error", "g": "anomaly"}

    tables = {n: spark.createDataFrame(t.collect(), t.schema) for n, t in first.tables.items()}
    assert {r.post_key for r in tables["post_state"].collect()} == {"p1"}
    # later: the page is empty, the far window has come within range, no model is asked
    none, nobody = spark.createDataFrame([], posts_ddl), spark.createDataFrame([], ballots_ddl)
    later = sync_plan.sync(none, nobody, tables, firms, rules, sync_plan.utc("2026-08-01T00:00:00"), members)
    assert [r.action for r in later.plan.collect()] == ["create"]
    assert later.tables["deferred"].count() == 0
    assert later.tables["tracked"].count() == 2
    unchanged = sync_plan.work_list(posts, tables["post_state"], firms)
    assert {(r.post_key, r.status) for r in unchanged.collect()} == {("p1", "unchanged"), ("p2", "new")}


def test_rows_without_a_firm_get_the_firm_of_their_post(spark):
    posts = spark.createDataFrame([("f", "a")], "firm string, post_key string")
    rows = spark.createDataFrame([tracked_row("", "a", 1, 0, 1), tracked_row("", "z", 1, 0, 1), tracked_row("g", "a", 1, 0, 2)], TRACKED)
    got = sync_plan.attribute({"tracked": rows}, posts)["tracked"]
    assert sorted((r.firm, r.post_key, r.entry_id) for r in got.collect()) == [("", "z", "e1"), ("f", "a", "e1"), ("g", "a", "e2")]


def test_first_copy_wins(spark):
    rows = [tracked_row("f", "b", 2, 0, 1, "late"), tracked_row("f", "a", 1, 0, 1, "early"), tracked_row("f", "a", 1, 1, 2, "x", start=False)]
    got = windows.dedup_windows(spark.createDataFrame(rows, TRACKED)).collect()
    assert [(r.post_key, r.entry_id) for r in got] == [("a", "early")]


def test_new_windows_keep_the_order_of_extraction(spark):
    old = [tracked_row("f", "p", 0, 4, 9)]
    new = [new_row("f", "p", n, w) for n, w in enumerate([3, 1, 5, 2, 4, 9])]
    *_, after = run(spark, old, new, [("f", "p", 0, False)])
    rows = sorted(after.collect(), key=lambda r: r.pos)
    assert [r.event_key.split(":")[1] for r in rows] == ["9", "3", "1", "5", "2", "4"]
    assert [r.pos for r in rows] == [4, 5, 6, 7, 8, 9]


def test_firms_may_share_a_post_key(spark):
    ddl = state.STATE_TABLES["post_state"]
    columns = spark.createDataFrame([], ddl).columns
    base = dict.fromkeys(columns)
    rows = [
        tuple({**base, "firm": f, "post_key": "k", "url": f"old-{f}"}[c] for c in columns) for f in ("a", "b", "c", "")
    ]
    posts = spark.createDataFrame([("a", "k", "new-a"), ("b", "k", "new-b")], "firm string, post_key string, url string")
    got = posts_ops.touch_seen(posts, spark.createDataFrame(rows, ddl), timecols.iso_instant(F.lit(NOW))).collect()
    assert sorted((r.firm, r.url, r.last_seen is not None) for r in got) == [
        ("a", "new-a", True), ("b", "new-b", True), ("b", "new-b", True), ("c", "old-c", False)
    ]


def test_a_new_checkpoint_goes_on_from_the_state(spark, tmp_path):
    root, seen = str(tmp_path / "state"), []
    spark.range(3).write.parquet(str(tmp_path / "in"))
    state.write_state(spark, root, 7, state.empty_state(spark))

    def sync(tables, batch, batch_id):
        seen.append(batch.count())
        return tables

    for checkpoint in ("one", "one", "two"):
        rows = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
        streams.reconcile_stream(rows, root, str(tmp_path / checkpoint), sync).awaitTermination()
    assert seen == [3, 3] and state.current_version(spark, root) == 9


def windows_of(n_firms, n_posts, moved=0):
    """Raw answers of two members for every post: windows whose days depend on the firm, the post and ``moved``."""
    found = {}
    for f in range(n_firms):
        for p in range(n_posts):
            day = 2 + (f + 2 * p + moved) % 5
            found[f"f{f}", f"p{p}"] = [(n, f"2026-06-{day + n:02d}T08:00:00", f"2026-06-{day + n:02d}T10:00:00") for n in range(2)]
    return found


def test_stream_of_batches_equals_as_many_syncs(spark, tmp_path):
    """Whole syncs: new, changed and unchanged posts, duplicates, held rows, expired posts; two firms a batch."""
    rules = validate.EventRules(max_days_ahead=4, max_duration_hours=48)
    now = timecols.iso_instant(F.lit("2026-06-01T00:00:00"))
    firms = spark.createDataFrame([(f"f{n}", ["closed"], "UTC", False) for n in range(4)], "firm string, keywords array<string>, timezone string, require_stated_offset boolean")
    ddl = "firm string, post_key string, text string, url string, pos long, answer string"

    def batch(numbers, moved):
        rows = []
        for (firm, post), found in windows_of(4, 3, moved).items():
            if int(firm[1:]) in numbers:
                answer = ";".join(f"{n},{s},{e}" for n, s, e in found)
                rows.append((firm, post, f"closed {firm} {post} {moved}", f"https://e.org/{post}", int(post[1:]), answer))
        return spark.createDataFrame(rows, ddl)

    steps = [batch((0, 1), 0), batch((0, 3), 1), batch((3,), 2)]
    kind = "array<struct<event_ord:bigint,event_type:string,start_time:string,end_time:string,stated_utc_offset:string,affected:string,confidence:string,evidence:string>>"

    def run_sync(tables, rows, batch_id=0):
        item = F.transform(F.split("answer", ";"), lambda x: F.split(x, ","))
        events = F.transform(item, lambda x: F.struct(
            x[0].cast("long").alias("event_ord"), F.lit("maintenance").alias("event_type"), x[1].alias("start_time"), x[2].alias("end_time"),
            F.lit(None).cast("string").alias("stated_utc_offset"), F.lit(None).cast("string").alias("affected"), F.lit("high").alias("confidence"), F.lit(None).cast("string").alias("evidence"),
        )).cast(kind)
        ballots = rows.select("firm", "post_key", F.posexplode(F.array(F.lit("m1"), F.lit("m2"))).alias("ballot_ord", "voter"), events.alias("events"), F.lit(None).cast("string").alias("error"))
        posts = rows.select("firm", "post_key", "text", "url", "pos")
        mine = firms.join(rows.select("firm").distinct(), "firm", "left_semi")
        return sync_plan.sync(posts, ballots, tables, mine, rules, now, ["m1", "m2"]).tables

    old_post = ("f0", "long gone", "x", datetime(2026, 1, 1), "", -5, True)
    first = {**state.empty_state(spark), "post_state": spark.createDataFrame([old_post], state.STATE_TABLES["post_state"])}
    root, plain = str(tmp_path / "state"), str(tmp_path / "plain")
    state.write_state(spark, root, 0, first)
    state.write_state(spark, plain, 0, first)
    for n, rows in enumerate(steps):
        rows.write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(ddl).parquet(str(tmp_path / "in"))
        streams.reconcile_stream(stream, root, str(tmp_path / "checkpoint"), run_sync, lambda b: b.select("firm").distinct()).awaitTermination()
        tables, _ = state.read_state(spark, plain)
        here = [r.firm for r in rows.select("firm").distinct().collect()]
        new = run_sync({t: x.filter(F.col("firm").isin(here)) for t, x in tables.items()}, rows)
        state.write_state(spark, plain, n + 1, {t: new[t].select(*x.columns).unionByName(x.filter(~F.col("firm").isin(here))) for t, x in tables.items()})
    got, want = state.read_state(spark, root)[0], state.read_state(spark, plain)[0]
    for name in state.STATE_TABLES:
        rows = [sorted(map(str, t[name].collect())) for t in (got, want)]
        assert rows[0] == rows[1], name
    assert got["tracked"].count() > 0 and got["deferred"].count() > 0
    assert got["post_state"].filter("post_key = 'long gone'").isEmpty()
    # the last batch was one firm: one partition of its own, all others as before
    manifest = state._manifest(spark, root, 3)
    for of in manifest["tables"].values():
        assert sum(v == 3 for v in of.values()) <= 1
    left = {p.name for p in (tmp_path / "state").glob("MANIFEST.*")}
    assert left == {"MANIFEST.2", "MANIFEST.3"}
    kept = {(p.parent.parent.name, int(p.parent.name[2:]), int(p.name[5:])) for p in (tmp_path / "state" / "data").glob("*/w=*/part=*")}
    named = {(t, v, p) for m in (2, 3) for t, of in state._manifest(spark, root, m)["tables"].items() for p, v in of.items()}
    assert kept == named
