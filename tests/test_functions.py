"""Column functions against plain Python on small frames."""

import hashlib
from datetime import UTC, datetime
from zoneinfo import ZoneInfo

from pyspark.sql import functions as F

from noticewindows.functions import postkeys, running, textcols, timecols
from noticewindows.operators import evaluate, feed, validate

ZONES = ["America/Chicago", "Europe/London", "Australia/Sydney", "Etc/GMT-3", "UTC"]
# both sides of every 2026 change of the zones above, and the repeated hours
INSTANTS = [
    "2026-01-15T09:30:00",
    "2026-03-08T07:30:00",
    "2026-03-08T08:30:00",
    "2026-03-29T00:30:00",
    "2026-03-29T01:30:00",
    "2026-04-04T15:30:00",
    "2026-04-04T16:30:00",
    "2026-06-01T12:00:00",
    "2026-10-03T15:30:00",
    "2026-10-03T16:30:00",
    "2026-10-25T00:30:00",
    "2026-10-25T01:30:00",
    "2026-11-01T06:30:00",
    "2026-11-01T07:30:00",
]


def one(spark, column, rows, ddl):
    return [r[0] for r in spark.createDataFrame(rows, ddl).select(column).collect()]


def test_iso_and_stamp_follow_every_zone(spark):
    rows = [(i, z) for i in INSTANTS for z in ZONES]
    df = spark.createDataFrame(rows, "t string, z string").withColumn("ts", timecols.iso_instant(F.col("t")))
    got = df.select(
        "t",
        "z",
        timecols.iso_in_zone(F.col("ts"), F.col("z")).alias("iso"),
        feed.ics_stamp("DTSTART", F.col("ts"), F.col("z"), F.lit(True)).alias("stamp"),
    ).collect()
    for r in got:
        utc = datetime.fromisoformat(r.t).replace(tzinfo=UTC)
        local = utc.astimezone(ZoneInfo(r.z))
        assert r.iso == local.isoformat()
        repeated = local.fold == 1 and local.replace(fold=0).utcoffset() != local.utcoffset()
        want = (
            f"DTSTART:{utc:%Y%m%dT%H%M%SZ}" if repeated else f"DTSTART;TZID={r.z}:{local:%Y%m%dT%H%M%S}"
        )
        assert r.stamp == want


def test_iso_parsing(spark):
    rows = [
        ("2026-06-06",),
        ("2026-06-06T08:00",),
        ("2026-06-06 08:00:00.5",),
        ("2026-06-06T08:00:00+03:00",),
        ("2026-06-06T08:00Z",),
        ("2026",),
        ("2026-02-31T08:00:00",),
        ("whenever",),
        (None,),
    ]
    df = spark.createDataFrame(rows, "t string")
    got = df.select(
        timecols.iso_local(F.col("t")).cast("string"), timecols.iso_offset_s(F.col("t"))
    ).collect()
    assert [tuple(r) for r in got] == [
        ("2026-06-06 00:00:00", None),
        ("2026-06-06 08:00:00", None),
        ("2026-06-06 08:00:00.5", None),
        ("2026-06-06 08:00:00", 10800),
        ("2026-06-06 08:00:00", 0),
        (None, None),
        (None, None),
        (None, None),
        (None, None),
    ]


def test_stated_offsets(spark):
    cases = {
        "+03:00": 10800,
        "GMT+3": 10800,
        "UTC-0530": -19800,
        "+330": 12600,
        " +3 ": 10800,
        "gmt+3": None,
        "+24:00": None,
        "+03:60": None,
        "EST": None,
        "": None,
    }
    got = one(spark, timecols.parse_offset(F.col("v")), [(k,) for k in cases], "v string")
    assert got == list(cases.values())


def test_norm_offset_keeps_its_quirk(spark):
    cases = {"+3": "+03:00", "GMT+03:00": "+03:00", "+0330": "+330:00", "x": "x", "": None, None: None, "5": "+05:00"}
    got = one(spark, evaluate.norm_offset(F.col("v")), [(k,) for k in cases], "v string")
    assert got == list(cases.values())


def test_post_keys(spark):
    cases = {
        ("Trading Update 28 May 2026", "https://e.org/x"): "u-2026-05-28",
        ("Update | Jun 4 2026", "https://e.org/x"): "u-2026-06-04",
        ("no date", "https://e.org/a/update-28-may-2026/"): "u-2026-05-28",
        ("no date", "https://e.org/a/slug-here/"): "slug-here",
        ("31 Feb 2026", "https://e.org/plain"): "plain",
        ("4 Sept 2026", "https://e.org/plain"): "plain",
        ("Hello,  World!", "/"): "hello-world",
    }
    got = one(
        spark, postkeys.post_key(F.col("t"), F.col("u"), F.lit("u")), list(cases), "t string, u string"
    )
    assert got == list(cases.values())


def test_words_and_verdicts(spark):
    text = "Plat­form maintenance | Saturday, 6 June: 08:00 – 14:00 (GMT+3) für Straße ﬁn"
    cases = {
        "platform MAINTENANCE Saturday 6 June": "ok",
        "maintenance | saturday | 6 | june | 08:00": "ok",
        "für STRASSE fin": "short",
        "gmt 3 für strasse fin": "ok",
        "markets are closed all day": "unfound",
        "Dec 25 closed": "short",
        "  ": "none",
        None: "none",
    }
    df = spark.createDataFrame([(k, text) for k in cases], "q string, t string")
    verdict = textcols.evidence_verdict(
        F.col("q"), textcols.words(F.col("q")), F.col("t"), textcols.words(F.col("t"))
    )
    assert [r[0] for r in df.select(verdict).collect()] == list(cases.values())


def test_summary_and_clean_evidence(spark):
    affected = ", ".join(f"SYM{i}.cash" for i in range(20))
    df = spark.createDataFrame(
        [("maintenance", "MT4\r\nX:\x00y", False), ("nope", affected, True), ("other", None, False)],
        "k string, a string, low boolean",
    )
    got = [r[0] for r in df.select(textcols.build_summary(F.col("k"), F.col("a"), F.col("low"))).collect()]
    assert got[0] == "⚠️ Platform Maintenance — MT4X:y"
    assert got[1].startswith("ℹ️ Trading Update — SYM0.cash") and got[1].endswith("… (unconfirmed)")
    assert got[2] == "ℹ️ Trading Update"
    cleaned = one(
        spark, textcols.clean_evidence(F.col("q")), [("a\n b ​c ",), ("x" * 301,), (None,)], "q string"
    )
    assert cleaned == ["a b c", "x" * 300 + "…", ""]


def test_escape_and_fold(spark):
    raw = "⚠️ a;b,c\\n\r\nd " + "🏖️ Zürich " * 20
    df = spark.createDataFrame([(raw,)], "t string")
    line = textcols.ics_escape(F.col("t"))
    row = df.select(line.alias("line"), textcols.ics_fold(line).alias("parts")).first()
    assert row.line.startswith("⚠️ a\\;b\\,c\\\\n\\nd ")
    assert all(len(p.encode()) <= 75 for p in row.parts)
    assert row.parts[0] + "".join(p[1:] for p in row.parts[1:]) == row.line
    assert all(p.startswith(" ") for p in row.parts[1:])


def test_hashes(spark):
    got = one(
        spark, textcols.event_key(*[F.col(c) for c in "abcd"]), [("p", "other", "s", "e")], "a string, b string, c string, d string"
    )
    assert got == [hashlib.sha256(b"p|other|s|e").hexdigest()[:16]]


def test_bucketed_scans_equal_plain_ones(spark):
    import random

    rng = random.Random(5)
    rows = [(rng.choice("ab"), i, rng.randint(-5, 5), rng.choice([None, "x", "y"])) for i in range(200)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, n int, v int, e string").withColumn("b", F.floor(F.col("n") / 7))
    out = running.running_sum(df, ["k"], "b", ["n"], {"s": F.col("v")})
    out = running.running_max(out, ["k"], "b", ["n"], {"m": F.when(F.col("v") > 0, F.col("v"))})
    out = running.previous_value(out, ["k"], "b", ["n"], "e", "p")
    got = {r.n: (r.s, r.m, r.p) for r in out.collect()}
    for key in "ab":
        total, best, before = 0, None, None
        for _, n, v, e in sorted(r for r in rows if r[0] == key):
            total += v
            if v > 0:
                best = v if best is None else max(best, v)
            assert got[n] == (total, best, before)
            before = e


def test_points_are_dealt_to_no_level_above_the_longest_interval(spark):
    from noticewindows.functions import cells

    rows = [(n, n % 97 * 40_000 + n, n % 97 * 40_000 + n + n % 5 * 3000) for n in range(300)]

    def side(p, data):
        at = spark.createDataFrame([("k", *r) for r in data], f"k string, {p}n long, {p}s long, {p}e long")
        return at.select("k", f"{p}n", F.timestamp_seconds(f"{p}s").alias(f"{p}low"), F.timestamp_seconds(f"{p}e").alias(f"{p}high"))

    hit = (F.col("alow") <= F.col("bhigh")) & (F.col("blow") <= F.col("ahigh"))
    for more in ([], [(900, 0, 4_000_000)], [(900, 5, None)]):
        b = [*rows[::3], *more]
        joins = cells.overlaps(side("a", rows), side("b", b), ["k"], ("alow", "ahigh"), ("blow", "bhigh"), F.coalesce(hit, F.col("alow") >= F.col("blow")))
        got = sorted((r.an, r.bn) for j in joins for r in j.select("an", "bn").collect())
        assert got == sorted((x[0], y[0]) for x in rows for y in b if (y[2] is None or x[1] <= y[2]) and y[1] <= x[2])
    one, other = cells._spans(side("a", rows), side("b", [(900, 5, None)]), (("alow", "ahigh"), ("blow", "bhigh")))
    assert one["longest"] == 4 and other["longest"] is None


def test_offsets_are_told_from_text_as_their_patterns_tell_them(spark):
    """The tests without a pattern that go before the patterns change no result, whatever the text looks like."""
    texts = ["2024-01-02T03:04", "2024-01-02T03:04Z", "2024-01-02T03:04:05.5-0330", "2024-01-02T03:04+03:00\n", "2024-01-02", "10:00-03:00", "-03:00", "a-b:00Z", "x:00-y", "", None]
    plain = F.regexp_replace("v", timecols._OWN_OFFSET, "")
    own = F.when(F.col("v").rlike(timecols._OWN_OFFSET), F.unix_seconds(timecols.iso_instant(plain)) - F.unix_seconds(timecols.iso_instant(F.col("v"))))
    rows = spark.createDataFrame([(t,) for t in texts], "v string")
    got = rows.select(timecols.iso_local(F.col("v")).eqNullSafe(timecols.iso_instant(plain)), timecols.iso_offset_s(F.col("v")).eqNullSafe(own))
    assert all(a and b for a, b in got.collect())
    stated = {"+0330 ": 12_600, "GMT-3": -10_800, "+24": None, "+03:60": None, "\u0001+3": None, "-\u00013\u000130\u0001": None, " UTC+0530 ": 19_800, "": None, "+": None, None: None}
    found = spark.createDataFrame([(t,) for t in stated], "v string").select("v", timecols.parse_offset(F.col("v"))).collect()
    assert {r[0]: r[1] for r in found} == stated
    # the offset is searched for in one place of the plan
    raw = spark.createDataFrame([("2024-01-02T03:04", "2024-01-02T05:04", "+3", "UTC", False)], "start_time string, end_time string, stated_utc_offset string, timezone string, require_stated_offset boolean")
    plan = validate.check_times(raw, validate.EventRules(), F.lit("2024-01-01").cast("timestamp"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("UTC|GMT") == 1


def test_folding_equals_a_cut_by_octets(spark):
    """Lines of characters of one to four octets around every limit; no line leaves the JVM to be folded."""
    import random

    def fold(text):
        data, out, room = text.encode(), [], 75
        while len(data) > room:
            stop = room
            while data[stop] & 0xC0 == 0x80:
                stop -= 1
            out.append(data[:stop].decode())
            data, room = data[stop:], 74
        return [out[0], *(" " + x for x in (*out[1:], data.decode()))] if out else [data.decode()]

    rng = random.Random(3)
    texts = ["", "x" * 75, "x" * 76, "x" * 149, "x" * 150, "x" * 10_000, "\n" * 200, "é" * 38, "🏖" * 19]
    texts += ["".join(rng.choice("ab é€🏖\r\n\u0080\u00bf\t") for _ in range(rng.randint(10, 300))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    folded = df.select("t", textcols.ics_fold(F.col("t")).alias("parts"))
    assert "Python" not in folded._jdf.queryExecution().executedPlan().toString()
    rows = folded.collect()
    assert all(r.parts == ([None] if r.t is None else fold(r.t)) for r in rows) and len(rows) == len(texts) + 1
