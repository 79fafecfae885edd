"""Pages, crawl tables, health, usage, feeds and streams on small tables."""

import gzip
import pathlib
import random
import re
import time
import urllib.robotparser
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from noticewindows import fixed_values as fv
from noticewindows.functions import cells, running, timecols
from noticewindows.operators import feed, health, usage, windows
from noticewindows.plans import adapters
from noticewindows.sources import crawl, pages, profiles
from noticewindows.streaming import streams, timers

LONG = "word " * 60
DETAIL = f"""<html><body><main><nav>menu</nav><div class="content tu"><h1>Update  28 May 2026</h1><p>{LONG}<b>bold
<br>line<section class="related x"><p>teaser</p></section><script>bad()</script></div>
<div class="content">{LONG}</div></main></body></html>"""


def profile_rows(spark, **over):
    base = {
        "name": "f", "url": "https://e.org/list", "post_content_selectors": ["div.content.tu", "main div.content"],
        "listing_content_selectors": ["div.content.tu"], "listing_title_contains": "update",
        "link_selectors": ["li.card", "a.more"], "link_url_contains": "/news/", "strip_selectors": ["section.related"],
        "post_key_prefix": "upd", **over,
    }
    ddl = profiles.PROFILE_SCHEMA
    names = [c.split()[0] for c in ddl.split(",")]
    return profiles.with_profile_defaults(spark.createDataFrame([tuple(base.get(n) for n in names)], ddl))


def page(spark, html, url="https://e.org/news/x"):
    return spark.createDataFrame([(1, "f", url, html)], "page_id long, firm string, url string, html string")


def test_detail_page(spark):
    posts, errors = pages.extract_posts(page(spark, DETAIL), profile_rows(spark))
    post = posts.first()
    assert (post.post_key, post.title) == ("upd-2026-05-28", "Update  28 May 2026")
    assert post.text.endswith("bold line") or post.text.endswith("bold\nline") or "line" in post.text
    assert "teaser" not in post.text and "bad()" not in post.text and errors.count() == 0


def test_short_content_is_an_error_that_names_what_was_tried(spark):
    html = "<main><div class='content tu'>short</div></main>"
    posts, errors = pages.extract_posts(page(spark, html), profile_rows(spark))
    assert posts.count() == 0
    message = errors.first().message
    assert "'div.content.tu' matched but held only 5 chars" in message
    assert "'main div.content' matched but held only 5 chars" in message


def test_listing(spark):
    html = DETAIL.replace("</main>", """<ul><li class='card'><p><a href='/news/a'>a</a></p></li><li class="card"><a href="/other/b">b</a></li>
      <li class=card><a href="../news/a">again</a></li></ul><a class="more" href="https://x.org/news/c?q=1">c</a></main>""")
    embedded, links = pages.extract_listing(page(spark, html, "https://e.org/list/"), profile_rows(spark))
    assert embedded.first().post_key == "upd-2026-05-28"
    assert [r.href for r in links.orderBy("link_ord").collect()] == ["https://e.org/news/a", "https://x.org/news/c?q=1"]
    none, _ = pages.extract_listing(page(spark, html), profile_rows(spark, listing_title_contains="holiday"))
    assert none.count() == 0


def test_select_recent(spark):
    firms = spark.createDataFrame([("f", 3, 14), ("g", 3, 14), ("h", 3, 14)], "firm string, max_posts int, max_age_days int")
    embedded = spark.createDataFrame([("f", "k0", "u0")], "firm string, post_key string, url string")
    links = [("f", "u0"), ("f", "n-1-jan-2026"), ("f", "u2"), ("f", "u3"), ("f", "u4"), ("f", "u5"), ("g", "v1"), ("g", "v2"), ("h", "w1")]
    links = spark.createDataFrame([(f, n, u) for n, (f, u) in enumerate(links)], "firm string, pos long, url string")
    fetched = spark.createDataFrame(
        [("u0", "k0", "ok"), ("n-1-jan-2026", "old", "ok"), ("u2", "k2", "gone"), ("u3", "k3", "ok"), ("u4", "k4", "ok"),
         ("u5", "k5", "failed"), ("v1", "kv", "failed"), ("v2", "kw", "ok"), ("w1", "kx", "unreadable")],
        "url string, post_key string, outcome string",
    )
    posts, errors = pages.select_recent(embedded, links, fetched, firms, F.to_date(F.lit("2026-06-01")))
    assert [(r.firm, r.post_key) for r in posts.orderBy("firm", "rank").collect()] == [("f", "k0"), ("f", "k3"), ("f", "k4")]
    assert {(r.firm, r.message) for r in errors.collect()} == {("g", "no page came from v1"), ("h", "no announcement posts found")}


def test_profile_overrides(spark):
    p = profile_rows(spark, timezone="", keywords=["k"])
    rows = [("f", None, "", [], None, None, None)]
    firm = profiles.resolve_firms(p, spark.createDataFrame(rows, profiles.OVERRIDE_SCHEMA)).first()
    assert (firm.display_name, firm.timezone, tuple(firm.keywords)) == ("F", "Etc/GMT-3", fv.DEFAULT_KEYWORDS)
    off = [("f", None, None, None, None, None, False)]
    assert profiles.resolve_firms(p, spark.createDataFrame(off, profiles.OVERRIDE_SCHEMA)).count() == 0


def test_read_profiles_from_files(spark, tmp_path):
    (tmp_path / "desk.json").write_text('{"url": "https://e.org", "post_content_selectors": "article", "keywords": ["a", "b"]}')
    (tmp_path / "bad.json").write_text('{"name": "bad"}')
    got = {r.name: r for r in profiles.read_profiles(spark, str(tmp_path)).collect()}
    desk = got["desk"]
    assert (desk.display_name, desk.post_content_selectors, desk.keywords, desk.problem) == ("DESK", ["article"], ["a", "b"], None)
    assert "url" in got["bad"].problem


def test_robots_agree_with_the_standard_library(spark):
    bodies = [
        "User-agent: *\nDisallow: /a/\nAllow: /a/b\n",
        f"User-agent: other\nUser-agent: {fv.BOT_TOKEN}\nDisallow: /\n\nUser-agent: *\nDisallow:\n",
        "User-agent: *\nDisallow: /x%20y\nCrawl-delay: 4\n",
        "User-agent: *\n\nDisallow: /\n",
        f"Disallow: /\nUser-agent: {fv.BOT_TOKEN} # us\nAllow: /a\nDisallow: /\nCrawl-delay: 90\n",
        "",
        "User-agent: mozilla\nDisallow: /q?z=1\n\nUser-agent: *\nDisallow: /c\n",
    ]
    paths = ["", "/", "/a/b", "/a/c", "/x y", "/x%20y/z", "/q?z=1&y", "/c/d"]
    robots = spark.createDataFrame([(f"https://h{n}", 200, b) for n, b in enumerate(bodies)] + [("https://down", 503, "x")], "host string, http_status int, body string")
    urls = [f"https://h{n}{p}" for n in range(len(bodies)) for p in paths] + ["https://down/a"]
    got = {r.url: r for r in crawl.robots_allowed(spark.createDataFrame([(u,) for u in urls], "url string"), robots).collect()}
    for n, body in enumerate(bodies):
        parser = urllib.robotparser.RobotFileParser()
        parser.parse(body.splitlines())
        for p in paths:
            url = f"https://h{n}{p}"
            want = parser.can_fetch(fv.USER_AGENT, url) and parser.can_fetch(fv.BOT_TOKEN, url)
            assert got[url].allowed == want, (body, url)
    assert got["https://h2/"].crawl_delay == 4.0 and got["https://h4/"].crawl_delay == 30.0
    assert got["https://down/a"].allowed and got["https://down/a"].crawl_delay is None


def test_crawl_slots_equal_a_queue(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), n, datetime(2026, 1, 1) + timedelta(seconds=rng.randint(0, 400))) for n in range(120)]
    frontier = spark.createDataFrame(rows, "host string, req_id long, requested_at timestamp")
    delays = spark.createDataFrame([("b", 7.0)], "host string, crawl_delay double")
    got = {r.req_id: r.slot_at for r in crawl.plan_crawl(frontier, delays).collect()}
    for host, step in (("a", 2), ("b", 7)):
        last = None
        for _, n, at in sorted((r for r in rows if r[0] == host), key=lambda r: (r[2], r[1])):
            last = at if last is None else max(at, last + timedelta(seconds=step))
            assert got[n] == last


def test_heartbeats_and_notifications_equal_loops(spark):
    rng = random.Random(4)
    start = datetime(2026, 1, 1)
    rows = [(rng.choice("abc"), n, start + timedelta(minutes=rng.randint(0, 60 * 24 * 6)), rng.choice([None, "A", "B"])) for n in range(150)]
    log = spark.createDataFrame(rows, "firm string, run_id long, ts timestamp, error string")
    sent = {(r.firm, r.ts) for r in health.heartbeat_due(log, 24).collect()}
    noted = {r.run_id for r in health.notify_once(log).collect()}
    want_sent, want_noted = set(), set()
    for firm in "abc":
        last, before = None, None
        for _, n, ts, error in sorted((r for r in rows if r[0] == firm), key=lambda r: (r[2], r[1])):
            if last is None or ts - last >= timedelta(hours=24):
                want_sent.add((firm, ts))
                last = ts
            if error is not None and error != before:
                want_noted.add(n)
            before = error
    assert sent == want_sent and noted == want_noted
    assert health.heartbeat_due(log, 0).count() == 0


def test_firm_health(spark):
    at = datetime(2026, 1, 2)
    rows = [
        (1, "ok", at, None, []), (1, "bad", at - timedelta(hours=3), None, []), (2, "bad", at, "boom", []),
        (1, "quiet", at - timedelta(hours=12), None, []), (1, "edge", at - timedelta(hours=4), None, []), (1, "odd", at, None, ["gate"]),
    ]
    log = spark.createDataFrame(rows, "run_id long, firm string, ts timestamp, error string, anomalies array<string>")
    got = health.firm_health(log, timecols.iso_instant(F.lit("2026-01-02T00:00:00")), timecols.iso_instant(F.lit("2026-01-01")), 7200)
    assert {r.firm: r.status for r in got.collect()} == {"ok": "ok", "bad": "error", "quiet": "stale", "edge": "ok", "odd": "anomaly"}


def test_usage_caps_and_days(spark):
    rows = [(datetime(2026, 1, d, 5), "view", v, "a", "x") for d in (1, 2, 3) for v in range(5)]
    rows += [(datetime(2026, 1, 3, 6), "feed", 0, "a", ua) for ua in ("x", "y", "mon")]
    log = spark.createDataFrame(rows, "ts timestamp, kind string, visitor_id long, addr string, user_agent string")
    got = usage.usage_stats(log, F.col("user_agent") == "mon", cap=3, days=2).orderBy("day").collect()
    assert [(r.views, r.visitors, r.feed_hits, r.feed_clients) for r in got] == [(5, 3, 0, 0), (5, 3, 2, 2)]


def feed_frame(spark, rows, feed_id="x"):
    return spark.createDataFrame([(feed_id, n, line, True) for n, line in enumerate(rows)], "feed_id string, line_no long, line string, ended boolean")


GOOD = [
    "BEGIN:VCALENDAR", "VERSION:2.0", "PRODID:x", "BEGIN:VTIMEZONE", "TZID:Z", "BEGIN:STANDARD", "END:STANDARD", "END:VTIMEZONE",
    "BEGIN:VEVENT", "UID:1", "DTSTAMP:1", "DTSTART;TZID=Z:1", "BEGIN:VALARM", "END:VALARM", "END:VEVENT", "END:VCALENDAR",
]


def test_feed_checker(spark):
    def codes(rows, **more):
        return sorted(r.code for r in feed.feed_problems(feed_frame(spark, rows), block=5, **more).collect())

    assert codes(GOOD) == []
    assert codes(GOOD, min_events=2) == ["no-events"]
    assert codes([x.replace("END:VALARM", "END:VEVENT") for x in GOOD]) == ["structure"]
    assert codes([x for x in GOOD if x != "UID:1"]) == ["event"]
    assert codes([x.replace("TZID:Z", "TZID:Y") for x in GOOD]) == ["timezone"]
    assert codes(GOOD[:-1] + ["BEGIN:X"]) == ["structure"]
    assert codes(GOOD[:14] + ["END:VEVENT"] + GOOD[8:]) != []
    assert codes([GOOD[0], "X:" + "y" * 80, *GOOD[1:]]) == ["folding"]
    assert codes([GOOD[0], "X:a\nb", *GOOD[1:]]) == ["line-endings"]
    assert codes([*GOOD[:1], *GOOD[1:], "X-STRAY:1", *GOOD]) == ["event", "structure"]  # between two calendars, UIDs twice
    at = GOOD.index("UID:1")
    long = ["UID:" + "u" * 71, " tail-1"]
    other = [x if x != "UID:1" else "UID:" + "u" * 71 for x in GOOD]
    other.insert(other.index("UID:" + "u" * 71) + 1, " tail-2")
    both = GOOD[:at] + long + GOOD[at + 1 : -1] + other[other.index("BEGIN:VEVENT") :]
    assert codes(both) == []
    problem = feed.feed_problems(feed_frame(spark, GOOD[:-1] + ["BEGIN:X", "END:VCALENDAR"]), block=5).collect()
    assert [r.code for r in problem] == ["structure"]


def test_exported_feed_is_sound_in_every_zone(spark, tmp_path):
    rows = [(f"k{n}", f"2026-{m:02d}-{d:02d}T01:30:00") for n, (m, d) in enumerate([(1, 5), (3, 29), (10, 25), (11, 1)])]
    w = spark.createDataFrame(rows, "event_key string, s string").select(
        F.lit("f").alias("firm"), F.lit("other").alias("event_type"), "event_key", F.concat(F.lit("⚠️ a; b, "), F.repeat(F.lit("é"), 60)).alias("summary"),
        F.lit("q").alias("evidence"), F.lit("").alias("link"), F.monotonically_increasing_id().alias("arrival_seq"), F.lit(0).alias("pos"),
        timecols.iso_instant(F.col("s")).alias("start_at"), timecols.shift(timecols.iso_instant(F.col("s")), F.lit(7200)).alias("end_at"),
    )
    selections = spark.createDataFrame([("all", None, None), ("none", ["g"], ["late_open"])], "feed_id string, firms array<string>, types array<string>")
    names = spark.createDataFrame([("f", "Desk F")], "firm string, title string")
    now = timecols.iso_instant(F.lit("2026-01-01"))
    for zone in ("Europe/London", "America/Chicago", "Etc/GMT-3", "UTC"):
        lines = feed.feed_lines(w, selections, names, now, zone, (15, 60), 360)
        path = str(tmp_path / zone.replace("/", "-"))
        feed.export_feed(lines, path, 3)
        assert feed.feed_problems(feed.number_lines(lines), min_events=0).count() == 0
        text = b""
        for part in sorted((tmp_path / zone.replace("/", "-") / "feed_id=all").glob("part-*")):
            text += part.read_bytes()
        assert text.startswith(b"BEGIN:VCALENDAR\r\n") and text.endswith(b"END:VCALENDAR\r\n")
        assert text.count(b"BEGIN:VEVENT") == 4 and all(len(x) <= 75 for x in text.split(b"\r\n"))
        assert b"X-WR-CALNAME:Desk F Trading Updates" in text
        if zone == "Europe/London":
            assert b"DTSTART:20261025T013000Z" in text  # second pass of the repeated hour
            assert b"TZNAME:BST" in text and b"BEGIN:DAYLIGHT" in text
        none = b"".join(p.read_bytes() for p in (tmp_path / zone.replace("/", "-") / "feed_id=none").glob("part-*"))
        assert b"X-WR-CALNAME:G Trading Updates (late_open)" in none


def test_blocks_are_exported_as_the_same_files_and_dealt_once(spark, tmp_path):
    """Blocks are shuffled whole, not line by line; whether a feed is in the zone is joined to selections, not to lines."""
    at = "timestamp'2026-10-25 00:30:00' + make_interval(0, 0, 0, 0, cast(id as int))"
    w = spark.range(0, 300, 1, 4).select(
        F.concat(F.lit("f"), (F.col("id") % 7).cast("string")).alias("firm"), F.when(F.col("id") % 2 == 0, "other").otherwise("late_open").alias("event_type"),
        F.concat(F.lit("k"), "id").alias("event_key"), F.repeat(F.lit("é"), 50).alias("summary"), F.lit("q").alias("evidence"), F.lit("l").alias("link"),
        F.lit(5).alias("arrival_seq"), F.col("id").alias("pos"), F.expr(at).alias("start_at"), F.expr(f"{at} + interval 2 hours").alias("end_at"),
    )
    ids = [("all", None, None), ("one", ["f1"], None), ("two", ["f2", "f3"], ["other"]), ("none", ["g"], None)]
    selections = spark.createDataFrame(ids, "feed_id string, firms array<string>, types array<string>")
    names = spark.createDataFrame([(f"f{n}", f"Desk {n}") for n in range(7)], "firm string, title string")
    for zone in ("Europe/London", "UTC"):
        given = (w, selections, names, timecols.iso_instant(F.lit("2026-01-01")), zone, (15,), 60)
        lines, blocks = feed.feed_lines(*given), feed.feed_lines(*given, blocks_only=True)
        local = zone != "UTC"
        assert lines.filter("feed_id = 'one' and line like 'DTSTART;TZID=Europe/London:%'").count() == (42 if local else 0)
        assert lines.filter("feed_id = 'one' and line like 'DTSTART:%Z'").count() == (1 if local else 43)  # one in the repeated hour
        assert blocks.filter("part = 2").count() == 300 + 43 + 43 and blocks.count() < lines.count() / 10
        plan = blocks._jdf.queryExecution().optimizedPlan().toString()
        assert not [x for x in plan.splitlines() if "Join LeftOuter" in x and "lines" in x]
        got = {}
        for name, rows in (("lines", lines), ("blocks", blocks)):
            path = tmp_path / f"{name}-{zone[:3]}"
            feed.export_feed(rows, str(path), 3)
            got[name] = {f: b"".join(p.read_bytes() for p in sorted((path / f"feed_id={f}").glob("part-*"))) for f, _, _ in ids}
        assert got["blocks"] == got["lines"] and got["blocks"]["all"].count(b"BEGIN:VEVENT") == 300


def test_overlap_equals_brute_force(spark):
    rng = random.Random(9)
    base = datetime(2026, 1, 1)

    def span(hours):
        s = base + timedelta(hours=rng.randint(0, 200))
        return s, s + timedelta(hours=rng.randint(1, hours))

    ev = [(f"f{rng.randint(0, 2)}", rng.choice(["other", "late_open"]), f"k{n}", *span(60)) for n in range(60)]
    rq = []
    for n in range(40):
        s, e = span(80)
        rq.append((n, rng.choice([None, ["f0"], ["f1", "f2"]]), rng.choice([None, ["other"]]), s, rng.choice([e, None])))
    # ranges of any length: to the end of the calendar, from its beginning, empty and reversed ones
    ev += [("f0", "other", "far", base, datetime(9999, 12, 30)), ("f1", "other", "early", datetime(1, 1, 2), base + timedelta(hours=30)), ("f0", "other", "point", base, base)]
    rq += [(100, None, None, datetime(1, 1, 2), None), (101, ["f1"], None, datetime(1, 1, 2), datetime(9999, 12, 30)), (102, None, None, base + timedelta(hours=50), base + timedelta(hours=10)), (103, ["f0", "f1"], None, datetime(9999, 1, 1), None)]
    events = spark.createDataFrame(ev, "firm string, event_type string, event_key string, start_at timestamp, end_at timestamp")
    asked = spark.createDataFrame(rq, "req_id long, firms array<string>, types array<string>, from_at timestamp, to_at timestamp")
    got = sorted((r.req_id, r.event_key) for r in windows.window_overlap(events, asked).collect())
    want = sorted(
        (q, k) for q, fs, ts, a, b in rq for f, t, k, s, e in ev
        if (fs is None or f in fs) and (ts is None or t in ts) and e > a and (b is None or s < b)
    )
    assert got == want


def test_one_moment_is_spread_over_all_ranges(spark):
    """Every request of one host at the same instant: ranges stay even and the slots are right."""
    n, at = 4000, datetime(2026, 1, 1)
    frontier = spark.range(n).select(F.lit("https://h").alias("host"), F.col("id").alias("req_id"), F.lit(at).cast("timestamp").alias("requested_at"))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        ranged = running.in_ranges(frontier, ["host"], ["requested_at", "req_id"], "bucket")
        sizes = [r["count"] for r in ranged.groupBy("bucket").count().collect()]
        assert len(sizes) == 8 and max(sizes) <= 2 * n / 8
        delays = spark.createDataFrame([], "host string, crawl_delay double")
        slots = crawl.plan_crawl(frontier, delays).orderBy("req_id").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    assert [r.slot_at for r in slots] == [at + timedelta(seconds=2 * k) for k in range(n)]


def steps_of(spark, ddl, steps):
    return [spark.createDataFrame(rows, ddl) for rows in steps]


def test_release_follows_the_clock(spark, tmp_path):
    streams.use_rocksdb(spark)
    day = lambda n, h=0: datetime(2024, 1, 1) + timedelta(days=n, hours=h)
    tick = lambda at: (None, None, None, None, None, at)
    held = [
        ("f", "p", 1, day(11), day(12), day(0)),  # in range from day 1
        ("f", "p", 2, day(11), day(11, 1), day(0)),  # same instant, has ended by the only later clock
        ("f", "p", 3, day(40), day(41), day(0)),
        ("g", "q", 4, day(9), day(10), day(0)),  # within range when it arrives
        ("g", "q", 5, day(15), day(16), day(0)),  # in range at the clock itself
    ]
    ddl = "firm string, post_key string, event_ord long, start_at timestamp, end_at timestamp, at timestamp"
    run = lambda rows: timers.deferred_release(rows, 10)
    for clocks in ([day(5), day(11, 12)], [day(11, 12)]):
        steps = steps_of(spark, ddl, [[*held, tick(day(0))], *[[tick(c)] for c in clocks]])
        out = streams.run_in_steps(steps, run, str(tmp_path / f"t3-{len(clocks)}"))
        got = {r.event_ord: (r.outcome, r.clock) for r in out.collect()}
        want = {}
        for _, _, n, start, end, _ in held:
            due = [c for c in [day(0), *clocks] if c >= start - timedelta(days=10)]
            if due:
                want[n] = ("rejected" if end <= due[0] else "publish", due[0])
        assert got == want and 3 not in got


def test_state_expires_unless_something_keeps_it(spark, tmp_path):
    streams.use_rocksdb(spark)
    day = lambda n: datetime(2024, 1, 1) + timedelta(days=n)
    tick = lambda at: (None, None, at, None, None)
    steps = [
        [("f", "gone", day(0), day(1), 0), ("f", "window", day(0), day(60), 0), ("f", "held", day(0), day(1), 1), ("f", "freed", day(0), None, 1), ("f", "again", day(0), None, 0), tick(day(1))],
        [("f", "seen", day(20), day(1), 0), ("f", "freed", day(30), None, -1), tick(day(46))],
        [("f", "again", day(50), None, 0), tick(day(60))],
        [tick(day(61))],
        [tick(day(80))],
    ]
    ddl = "firm string, post_key string, at timestamp, end_at timestamp, held long"
    out = streams.run_in_steps(steps_of(spark, ddl, steps), timers.state_expiry, str(tmp_path / "t4"))
    # seen on day 20: gone after day 65; freed on day 30: after day 75; the window ends on day 60: still there on it
    got = sorted((r.post_key, r.last_seen, r.expired_at - timedelta(milliseconds=1)) for r in out.collect())
    assert got == [("again", day(0), day(45)), ("freed", day(30), day(75)), ("gone", day(0), day(45)), ("seen", day(20), day(65)), ("window", day(0), day(60))]


def test_silent_sources_are_told_once_and_when_they_are_back(spark, tmp_path):
    streams.use_rocksdb(spark)
    at = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    catalog = spark.createDataFrame([(f, at(0)) for f in ("never", "back", "fresh", "down")], "firm string, started_at timestamp")
    steps = [
        [("back", at(1), None), ("fresh", at(1), None), ("down", at(1), "x"), ("unlisted", at(1), "x"), (None, at(3), None)],
        [("fresh", at(3.5), None), ("down", at(3.5), "x"), (None, at(4), None)],
        [("back", at(5), None), ("fresh", at(5), None), (None, at(6), None)],
    ]
    ddl = "firm string, at timestamp, error string"
    out = streams.run_in_steps(steps_of(spark, ddl, steps), lambda rows: timers.stale_sources(rows, catalog, 3600), str(tmp_path / "t5"))
    got = sorted((r.firm, r.stale, r.last_success) for r in out.collect())
    assert got == [("back", False, at(5)), ("back", True, at(1)), ("down", True, None), ("never", True, None), ("unlisted", True, None)]


def test_changes_of_a_hot_key_over_batches_equal_a_loop(spark, tmp_path, monkeypatch):
    """Six batches; one firm has most of the rows, and its errors last over batches; whole states every second batch."""
    monkeypatch.setattr(streams, "FULL_STATE_EVERY", 2)
    rng, folder, tail, want = random.Random(4), str(tmp_path / "log"), {}, []
    ddl = "firm string, run_id long, ts timestamp, error string, extra int"
    for step in range(6):
        rows = []
        for n in range(80):
            firm = rng.choice(["hot"] * 6 + ["a", "b", None]) if step != 3 else "hot"
            rows.append((firm, 100 * step + n, datetime(2026, 6, 1, step, n // 9), rng.choice([None, "E1", "E1", "E1", "E2"]), n))
        for firm, run, _, error, _ in sorted(rows, key=lambda r: (r[2], r[1])):
            if error is not None and error != tail.get(firm):
                want.append((firm or "", run))
            tail[firm] = error
        spark.createDataFrame(rows, ddl).repartition(1).write.mode("append").parquet(f"{folder}/in")
        log = spark.readStream.schema(ddl).parquet(f"{folder}/in")
        streams.notify_once_stream(log, folder).awaitTermination()
    out = streams.changes_so_far(log.select("firm", "run_id", "ts", "error"), folder)
    assert sorted((r.firm or "", r.run_id) for r in out.collect()) == sorted(want)
    assert sorted(p.name for p in (tmp_path / "log" / "state").iterdir()) == ["batch=4", "batch=5"]
    shared = pathlib.Path(spark.conf.get("spark.checkpoint.dir"))
    assert not list(shared.glob("stream-*"))  # nothing of a batch stays


def test_entry_and_registered_names(spark):
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names
    df = entry.entry(spark)
    assert df.columns == ["firm", "firm_name", "event_key", "start_utc", "status"] and df.count() > 0
    assert adapters.MEMBERS == ("m1", "m2", "m3")


def test_a_firm_listed_twice_counts_once(spark):
    rows = spark.createDataFrame([("f", "other", "k")], "firm string, event_type string, event_key string")
    asked = spark.createDataFrame([("x", ["f", "f"], ["other", "other"])], "feed_id string, firms array<string>, types array<string>")
    assert windows.select_feed(rows, asked).count() == 1


def test_posts_of_one_shard_expire_and_are_released_each_at_its_own_time(spark, tmp_path):
    """Forty posts in two shards; every post goes and is released at the first clock after its own instant."""
    streams.use_rocksdb(spark)
    day = lambda n: datetime(2024, 1, 1) + timedelta(days=n)
    clocks, posts = (day(46), day(50), day(61), day(99)), range(40)
    seen = [[("f", f"p{n}", day(n % 7), day(n), 0) for n in posts] + [("f", "p3", day(7), None, 1)], *[[(None, None, c, None, None)] for c in clocks]]
    out = streams.run_in_steps(
        steps_of(spark, "firm string, post_key string, at timestamp, end_at timestamp, held long", seen),
        lambda rows: timers.state_expiry(rows, shards=2), str(tmp_path / "expiry"),
    )
    want = {f"p{n}": (day(n % 7), day(n % 7 + 45)) for n in posts if n != 3}
    assert {r.post_key: (r.last_seen, r.expired_at - timedelta(milliseconds=1)) for r in out.collect()} == want and out.count() == 39
    held = [("f", f"p{n}", n, day(30 + n), day(31 + 2 * (n % 20)), day(0)) for n in posts]
    steps = [held + [(None, None, None, None, None, day(22))], *[[(None, None, None, None, None, c)] for c in clocks]]
    out = streams.run_in_steps(
        steps_of(spark, "firm string, post_key string, event_ord long, start_at timestamp, end_at timestamp, at timestamp", steps),
        lambda rows: timers.deferred_release(rows, 10, shards=2), str(tmp_path / "release"),
    )
    got = {r.post_key: (r.event_ord, r.outcome, r.clock) for r in out.collect()}
    for _, key, n, start, end, _ in held:
        due = next(c for c in (day(22), *clocks) if c >= start - timedelta(days=10))
        assert got[key] == (n, "rejected" if end <= due else "publish", due)
    assert len(got) == 40 == out.count()


def test_an_empty_feed_is_named_after_the_only_firm(spark):
    feeds = spark.createDataFrame([("all", None, None, None, None)], "feed_id string, firms array<string>, types array<string>, n_firms int, one_firm string")
    names = spark.createDataFrame([("f", "Desk F"), ("", "blank")], "firm string, title string")
    assert feed.calendar_name(feeds, names).first().name.startswith("Desk F")


def test_offset_changes_are_looked_for_once_per_zone(spark):
    """Very many ids of two zones; the days of a zone are walked through once, not once per id."""
    ids = spark.range(0, 60_000, 1, 8).select(
        F.concat(F.lit("i"), "id").alias("id"),
        F.when(F.col("id") % 2 == 0, "Europe/London").otherwise("Etc/GMT-3").alias("zone"),
        F.expr("timestamp'2024-03-31 01:00:00' - make_interval(0, 0, 0, 0, 0, 0, id % 2)").alias("from_at"),
        F.expr("timestamp'2025-03-30 01:00:00' - make_interval(0, 0, 0, 0, 0, 0, cast(id / 2 as int) % 2)").alias("to_at"),
    )
    started = time.monotonic()
    got = feed.offset_transitions(ids).groupBy("zone", "onset_at", "before_s", "after_s").count().collect()
    assert time.monotonic() - started < 60
    # the start of a span is outside of it, its end inside
    want = {(datetime(2024, 10, 27, 1), 3600, 0): 30_000, (datetime(2025, 3, 30, 1), 0, 3600): 15_000}
    assert {(r.onset_at, r.before_s, r.after_s): r["count"] for r in got} == want


def test_the_checker_of_feeds_carries_no_texts_on(spark):
    shared = pathlib.Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(shared.glob("feed-l*"))
    assert feed.feed_problems(feed_frame(spark, GOOD), block=5).count() == 0
    written = set(shared.glob("feed-l*")) - before
    assert written and all(not {"line", "params"} & set(spark.read.parquet(str(p)).columns) for p in written)


def test_windows_written_once_give_the_same_views(spark):
    """Queries that read the windows many times read one table of them; each run writes its own, and none stays behind."""
    from noticewindows.plans import adapters as a
    from noticewindows.plans import catalog

    d = "/root/testdata/sf0.001"
    lazy = a.before(spark, d)
    with a.windows_once(spark, d):
        views = [a.before(spark, d), a.extraction(spark, d), a.raw_events(spark, d), a.notices(spark, d), a.inventory(spark, d)]
        for view in views:  # no view works out a window again
            plan = view._jdf.queryExecution().optimizedPlan().toString()
            assert "sha2" not in plan and "props" not in plan
        first = a.windows(spark, d)
    assert a.before(spark, d)._jdf.queryExecution().optimizedPlan().toString().count("sha2") >= 1
    with a.windows_once(spark, d):
        assert a.windows(spark, d) is not first
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(views[0]) == rows(lazy)
    assert {"g1_run_report", "s10_state_round_trip", "t2_reconcile_stream"} <= {n for n, q in catalog.QUERIES.items() if hasattr(q, "__wrapped__")}


def test_ordered_scans_shuffle_their_rows_once(spark, tmp_path):
    """A text that goes along with a running sum is in one exchange, NULL keys and all."""
    rows = [(k, n, n % 5, f"text {n}") for n in range(60) for k in ("a", "b", None)]
    path = str(tmp_path / "scanned")
    spark.createDataFrame(rows, "k string, n long, v long, words string").write.parquet(path)
    df = spark.read.parquet(path).withColumn("b", F.floor(F.col("n") / 7))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for large tables
    try:
        out = running.running_sum(df, ["k"], "b", ["n"], {"s": F.col("v")})
        plan = out._jdf.queryExecution().explainString(out._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    inputs = re.findall(r"\(\d+\) Exchange[^\n]*\nInput[^\n]*", plan)
    assert len(inputs) > 1 and sum("words#" in x for x in inputs) == 1
    got = {(r.k, r.n): r.s for r in out.collect()}
    assert len(got) == 180 and all(s == sum(i % 5 for i in range(n + 1)) for (_, n), s in got.items())


def test_blocks_are_numbered_as_their_lines_are(spark):
    """Blocks are placed whole, without the lines of their windows: those are made, folded and numbered at the end."""
    at = "timestamp'2026-10-25 00:30:00' + make_interval(0, 0, 0, 0, cast(id as int))"
    w = spark.range(0, 90, 1, 4).select(
        F.when(F.col("id") % 9 > 0, F.concat(F.lit("f"), (F.col("id") % 3).cast("string"))).alias("firm"), F.lit("other").alias("event_type"),
        F.concat(F.lit("k"), "id").alias("event_key"), F.repeat(F.lit("é"), 50).alias("summary"), F.lit("q").alias("evidence"), F.lit("l").alias("link"),
        (F.col("id") % 4).alias("arrival_seq"), F.col("id").alias("pos"), F.expr(at).alias("start_at"), F.expr(f"{at} + interval 2 hours").alias("end_at"),
    )
    selections = spark.createDataFrame([("all", None, None), ("one", ["f1"], None)], "feed_id string, firms array<string>, types array<string>")
    names = spark.createDataFrame([("f1", "Desk")], "firm string, title string")
    for zone in ("Europe/London", "UTC"):
        given = (w, selections, names, timecols.iso_instant(F.lit("2026-01-01")), zone, (15, 60), 60)
        blocks = feed.feed_lines(*given, blocks_only=True)
        assert blocks.filter("part = 2 and lines is not null").count() == 0
        want = sorted(map(tuple, feed.number_lines(feed.feed_lines(*given)).collect()))
        got = sorted(map(tuple, feed.number_lines(blocks).collect()))
        assert got == want and sum(r[2].startswith("BEGIN:VEVENT") for r in got) == 90 + 30  # windows without a firm are in "all"


def test_the_checker_of_feeds_drops_texts_before_it_shuffles_and_joins_pieces_across_blocks(spark):
    shared = pathlib.Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(shared.glob("feed-pieces*"))
    at = GOOD.index("UID:1")
    folded = [" FRONT"] + [x for line in GOOD for x in ((line[:3], "", f" {line[3:6]}", f"\t{line[6:]}") if len(line) > 6 else (line,))]
    big = [*GOOD[:at], "DESCRIPTION:" + "d" * 60, " " + "e" * 60, "TRANSP:T", "SUMMARY:s", *GOOD[at:]]
    rows = [(f, n, line, True) for f, lines in (("folded", folded[1:]), ("front", folded), ("big", big)) for n, line in enumerate(lines)]
    lines = spark.createDataFrame(rows, "feed_id string, line_no long, line string, ended boolean")
    for block in (1, 2, 5, 100):
        got = [(r.feed_id, r.code, r.detail[:11]) for r in feed.feed_problems(lines, block=block).collect()]
        assert got == [("front", "structure", "not wrapped")]
    tables = set(shared.glob("feed-pieces*")) - before
    assert len(tables) == 4
    for table in tables:
        pieces = [r.piece for r in spark.read.parquet(str(table)).filter("feed_id = 'big'").collect()]
        assert pieces and not any("ddd" in x for x in pieces)


def test_selections_are_dealt_to_firms_and_types_and_windows_are_shuffled_to_feeds_once(spark, tmp_path):
    path = str(tmp_path / "windows")
    spark.range(0, 200, 1, 4).select(
        F.concat(F.lit("f"), (F.col("id") % 7).cast("string")).alias("firm"), F.lit("other").alias("event_type"), F.concat(F.lit("k"), "id").alias("event_key"),
        F.lit("s").alias("summary"), F.lit("q").alias("evidence"), F.lit("l").alias("link"), F.col("id").alias("arrival_seq"), F.lit(0).alias("pos"),
        F.expr("timestamp'2026-01-05 00:30:00'").alias("start_at"), F.expr("timestamp'2026-01-05 02:30:00'").alias("end_at"),
    ).write.parquet(path)
    selections = spark.createDataFrame([("all", None, None), ("one", ["f1"], None), ("two", ["f1"], ["other"])], "feed_id string, firms array<string>, types array<string>")
    names = spark.createDataFrame([("f1", "Desk")], "firm string, title string")
    blocks = feed.feed_lines(spark.read.parquet(path), selections, names, timecols.iso_instant(F.lit("2026-01-01")), "Etc/GMT-3", blocks_only=True)
    plan = blocks._jdf.queryExecution().optimizedPlan().toString()
    assert blocks.filter("part = 2").count() == 200 + 29 + 29
    assert not [x for x in plan.splitlines() if "Generate" in x and "event_key" in x] and "BEGIN:VEVENT" not in plan


def test_packed_feeds_are_the_same_feeds(spark, tmp_path):
    """Packed files in name order are one packed file; blocks are sorted whole, and small feeds do not make one large task."""
    at = "timestamp'2026-10-25 00:30:00' + make_interval(0, 0, 0, 0, cast(id as int))"
    w = spark.range(0, 400, 1, 4).select(
        F.concat(F.lit("f"), (F.col("id") % 50).cast("string")).alias("firm"), F.lit("other").alias("event_type"), F.concat(F.lit("k"), "id").alias("event_key"),
        F.repeat(F.lit("é🏖️"), 20).alias("summary"), F.lit("q").alias("evidence"), F.lit("l").alias("link"),
        F.lit(5).alias("arrival_seq"), (F.col("id") * 7 % 400).alias("pos"), F.expr(at).alias("start_at"), F.expr(f"{at} + interval 2 hours").alias("end_at"),
    )
    ids = [("all", None, None), *[(f"one-{n}", [f"f{n}"], None) for n in range(50)]]
    selections = spark.createDataFrame(ids, "feed_id string, firms array<string>, types array<string>")
    names = spark.createDataFrame([(f"f{n}", f"Desk {n}") for n in range(50)], "firm string, title string")
    blocks = feed.feed_lines(w, selections, names, timecols.iso_instant(F.lit("2026-01-01")), "Europe/London", (15,), 60, blocks_only=True)
    got = {}
    for packing in ("none", "gzip"):
        path = tmp_path / packing
        feed.export_feed(blocks, str(path), 7, packing)
        files = {f: sorted((path / f"feed_id={f}").glob("part-*")) for f, _, _ in ids}
        assert len(files["all"]) > 1 and all(p.name.endswith(".gz") == (packing == "gzip") for ps in files.values() for p in ps)
        whole = {f: b"".join(p.read_bytes() for p in ps) for f, ps in files.items()}
        got[packing] = {f: gzip.decompress(data) if packing == "gzip" else data for f, data in whole.items()}
    assert got["gzip"] == got["none"]
    uids = re.findall(rb"\r\nUID:k(\d+)@", got["gzip"]["all"])
    assert sorted(uids, key=lambda x: int(x) * 7 % 400) == uids and len(uids) == 400
    back = spark.read.option("lineSep", "\r\n").schema("value string, feed_id string").text(str(tmp_path / "gzip"))
    assert back.groupBy("feed_id").agg(F.max(F.octet_length("value")).alias("n")).filter("n > 75").count() == 0


def test_overlaps_without_keys_are_spread_by_rows(spark, monkeypatch):
    """Everything within one hour, so in one cell: the pairs, the square of the rows, are made by many tasks."""
    monkeypatch.setattr(cells, "PER_TASK", 20, raising=False)
    w = spark.range(0, 300, 1, 3).select(
        F.lit("f").alias("firm"), F.lit("other").alias("event_type"), F.concat(F.lit("k"), "id").alias("event_key"),
        F.expr("timestamp'2026-01-05 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, cast(id as int))").alias("start_at"),
        F.expr("timestamp'2026-01-05 00:10:00' + make_interval(0, 0, 0, 0, 0, 0, cast(id as int))").alias("end_at"),
    )
    asked = spark.range(0, 200, 1, 3).select(
        F.col("id").alias("req_id"), F.lit(None).cast("array<string>").alias("firms"), F.lit(None).cast("array<string>").alias("types"),
        F.expr("timestamp'2026-01-05 00:01:00' + make_interval(0, 0, 0, 0, 0, 0, cast(id as int))").alias("from_at"),
        F.expr("timestamp'2026-01-05 00:02:00' + make_interval(0, 0, 0, 0, 0, 0, cast(id as int))").alias("to_at"),
    )
    got = windows.window_overlap(w, asked).select("req_id", "event_key", F.spark_partition_id().alias("task")).collect()
    pairs = [(r.req_id, int(r.event_key[1:])) for r in got]
    assert len(set(pairs)) == len(pairs)
    assert set(pairs) == {(q, k) for q in range(200) for k in range(300) if k + 600 > q + 60 and k < q + 120}
    share = {}
    for r in got:
        share[r.task] = share.get(r.task, 0) + 1
    assert len(share) >= 10 and max(share.values()) < len(pairs) / 4
