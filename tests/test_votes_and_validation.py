"""Validation, replies and votes: the edge cases as small tables."""

import json
import random

from pyspark.sql import functions as F

from noticewindows import fixed_values as fv
from noticewindows.functions import textcols, timecols
from noticewindows.operators import evidence, replies, validate, vote

RAW = (
    "firm string, post_key string, event_ord long, event_type string, start_time string, end_time string, "
    "stated_utc_offset string, affected string, confidence string, evidence string"
)
TEXT = "Platform maintenance on Saturday 6 June, 08:00 – 14:00 (GMT+3), all platforms."


def raw(n, start="2026-06-06T08:00:00", end="2026-06-06T14:00:00", off="+03:00", firm="f", conf="high", ev=None, aff=None):
    return (firm, "p", n, "maintenance", start, end, off, aff, conf, ev)


def judge(spark, rows, rules=None, now="2026-06-01T12:00:00", text=TEXT):
    firms = spark.createDataFrame(
        [("f", "America/Chicago", False), ("strict", "Europe/London", True)],
        "firm string, timezone string, require_stated_offset boolean",
    )
    posts = spark.createDataFrame(
        [("f", "p", text, "https://e.org/p"), ("strict", "p", text, "")],
        "firm string, post_key string, text string, url string",
    )
    judged = validate.judge_events(
        spark.createDataFrame(rows, RAW), posts, firms, rules or validate.EventRules(),
        timecols.iso_instant(F.lit(now)), "Etc/GMT-3",
    )
    return {r.event_ord: r for r in judged.collect()}


def test_rules_in_order(spark):
    got = judge(
        spark,
        [
            raw(1),
            raw(2, off=None),
            raw(3, start="2026-06-06T14:00:00", end="2026-06-06T08:00:00"),
            raw(4, end="2026-06-09T08:00:00"),
            raw(5, start="2027-06-06T08:00:00", end="2027-06-06T14:00:00"),
            raw(6, start="2026-05-01T08:00:00", end="2026-05-01T14:00:00"),
            raw(7, start="whenever"),
            raw(8, off=None, firm="strict"),
            raw(9, start="2026-06-06T08:00:00+01:00", end="2026-06-06T14:00:00+01:00", off=None, firm="strict"),
            raw(10, ev="saturday | 6 june | 08:00"),
            raw(11, ev="the desk is closed on friday"),
            raw(12, ev="Dec 25"),
            raw(13, conf="low"),
        ],
    )
    assert got[1].reason is None and got[1].start_iso == "2026-06-06T08:00:00+03:00"
    assert got[2].start_iso == "2026-06-06T16:00:00+03:00"
    assert got[3].reason == "end is not after start"
    assert got[4].reason == "duration exceeds 48h sanity cap"
    assert (got[5].reason, got[5].retryable) == ("too far in the future", True)
    assert (got[6].reason, got[6].benign) == ("already ended", True)
    assert got[7].reason.startswith("unparseable datetime")
    assert got[8].reason == fv.REASON_NO_OFFSET
    assert got[9].reason is None and got[9].start_iso == "2026-06-06T10:00:00+03:00"
    assert got[10].kept_evidence and not got[10].low
    assert got[11].low and got[11].kept_evidence == "" and got[11].summary.endswith("(unconfirmed)")
    assert not got[12].low and got[12].kept_evidence == ""
    assert got[13].low and got[13].reason is None


def test_filters_on_verdicts_do_not_repeat_the_rules(spark):
    """A filter on ``reason`` used to be copied below all steps, with every pattern in it, into code too large to compile."""
    firms = spark.createDataFrame([("f", "UTC", False)], "firm string, timezone string, require_stated_offset boolean")
    posts = spark.createDataFrame([("f", "p", TEXT, "")], "firm string, post_key string, text string, url string")
    rows = spark.createDataFrame(
        [raw(1, ev="saturday 6 june 08:00"), raw(2, ev="saturday 6 june 08:00", start="whenever"), raw(3, firm=None, ev="not in any text"), raw(4, start="2027-06-06T08:00:00", end="2027-06-06T14:00:00")],
        RAW,
    )
    now = timecols.iso_instant(F.lit("2026-06-01T12:00:00"))
    events, rejections = validate.validate_events(rows, posts, firms, validate.EventRules(), now)
    flagged = vote.flag_disputes(rows.withColumn("dispute", F.lit("one of two")), posts, firms, validate.EventRules(), now)
    for found in (events, rejections, flagged):
        assert "RLIKE" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r.event_ord: (r.evidence, r.confidence) for r in events.collect()} == {
        1: ("saturday 6 june 08:00", "high"),
        3: ("not in any text", "high"),  # no post, no text to look in
    }
    assert {(r.event_ord, r.retryable) for r in rejections.collect()} == {(2, False), (4, True)}
    assert {r.event_ord for r in flagged.collect()} == {1, 3, 4}


def test_toggles_and_empty_text(spark):
    strict = validate.EventRules(reject_low_confidence=True, require_evidence=True)
    got = judge(spark, [raw(1, conf="low"), raw(2), raw(3, ev="Dec 25"), raw(4, ev="not in here at all")], strict)
    assert [got[n].reason for n in (1, 2, 3, 4)] == [
        fv.REASON_LOW,
        fv.REASON_NO_EVIDENCE,
        fv.REASON_SHORT_EVIDENCE,
        fv.REASON_UNFOUND_EVIDENCE,
    ]
    assert judge(spark, [raw(1, ev="not in here at all")], strict, text="")[1].reason is None


def test_clock_decides_when_both_bounds_fall_back_to_the_zone(spark):
    # 48 hours on the clock across the autumn change are 49 real hours: allowed
    got = judge(
        spark,
        [raw(1, start="2026-10-31T12:00:00", end="2026-11-02T12:00:00", off=None)],
        now="2026-10-01T00:00:00",
    )
    assert got[1].reason is None


def events_json(*items):
    return json.dumps([{"event_type": "other", "start_time": "2026-06-06T08:00:00", "end_time": "x", **i} for i in items])


def test_reply_texts(spark):
    good = events_json({})
    cases = [
        (good, 1),
        (f"```json\n{good}\n```", 1),
        (f"<think>[maybe]\n</think>{good}", 1),
        (f"Sure: {good} done", 1),
        ("[]", 0),
        ("nothing", None),
        (events_json({"start_time": 5}), None),
        (events_json({}, {"event_type": "party"}), None),
        (events_json({"confidence": None}), None),
        (events_json({"evidence": None, "surplus": 1, "affected": "a"}), 1),
        (events_json({"affected": 3}), None),
        ('{"a": 1}', None),
    ]
    df = spark.createDataFrame(
        [("f", f"p{n}", "v", 0, 0, 1, c[0], None) for n, c in enumerate(cases)], replies.REPLY_SCHEMA
    )
    got = {r.post_key: r for r in replies.parse_replies(df).collect()}
    for n, (text, size) in enumerate(cases):
        found = got[f"p{n}"].events
        assert (None if found is None else len(found)) == size, text
        assert (replies._problem(text) is None) == (size is not None), text


def test_infer_repairs_and_falls_back(spark):
    def make_client():
        def complete(prompt, model):
            if model == "down":
                raise RuntimeError("quota")
            if model == "fixable":
                return "[]" if "not valid" in prompt else "oops"
            return "never"

        return complete

    prompts = spark.createDataFrame([("f", "p", "hi")], "firm string, post_key string, prompt string")
    calls = replies.infer(
        prompts, [("a", ["down", "fixable"]), ("b", ["bad"]), ("c", ["down"])], make_client
    )
    rows = sorted((r.voter, r.model_ord, r.attempt, r.raw, r.error) for r in calls.collect())
    assert rows == [
        ("a", 0, 1, None, "quota"),
        ("a", 1, 1, "oops", None),
        ("a", 1, 2, "[]", None),
        ("b", 0, 1, "never", None),
        ("b", 0, 2, "never", None),
        ("c", 0, 1, None, "quota"),
    ]
    ballots = {r.voter: r for r in replies.resolve_replies(calls).collect()}
    assert ballots["a"].events == [] and ballots["a"].error is None
    assert ballots["b"].events is None and ballots["b"].error == "invalid reply"
    assert ballots["c"].error == "quota"


def ballots(spark, *answers):
    """answers: (voter, list of (start, offset, affected, evidence)) or (voter, None)."""
    rows = []
    for n, (voter, events) in enumerate(answers):
        found = None
        if events is not None:
            found = [
                (i, "other", e[0], "2026-06-06T14:00:00", e[1], e[2], "high", e[3]) for i, e in enumerate(events)
            ]
        rows.append(("f", "p", voter, n, found, None if events is not None else "down"))
    return spark.createDataFrame(
        rows,
        f"firm string, post_key string, voter string, ballot_ord int, events array<{replies.EVENT_STRUCT}>, error string",
    )


AT8, AT8S = "2026-06-06T08:00", "2026-06-06T08:00:00"
ROW = (AT8S, None, None, None)


def test_panel(spark):
    kept, disputes, failures = vote.panel(
        ballots(spark, ("m1", [ROW]), ("m2", [(AT8, None, None, None)]), ("m3", [])), ["m1", "m2", "m3"]
    )
    assert [tuple(r.voters) for r in kept.collect()] == [("m1", "m2")] and disputes.count() == 0
    assert failures.count() == 0
    kept, disputes, _ = vote.panel(ballots(spark, ("m1", [ROW]), ("m2", []), ("m3", None)), ["m1", "m2", "m3"])
    assert kept.count() == 0
    assert disputes.first().dispute == (
        "only 1 of 3 models extracted it (quorum 2): m1 did; m2, m3 did not"
    )
    kept, disputes, failures = vote.panel(
        ballots(spark, ("m1", [ROW]), ("m2", None), ("m3", None)), ["m1", "m2", "m3"]
    )
    assert kept.count() == disputes.count() == 0
    assert failures.first().error == (
        "only 1 of 3 panel models answered and 2 must agree — m2: down; m3: down"
    )


def test_merge_keeps_the_most_explicit(spark):
    rows = vote.tally(
        vote.ballot_rows(
            ballots(
                spark,
                ("r1", [(AT8S, "", "ab", ""), (AT8S, "+9", "longest of all", "late")]),
                ("r2", [(AT8S, "+3", "abcd", "said so")]),
                ("r3", [(AT8S, "+4", "efgh", "other")]),
            )
        )
    )
    row = rows.first()
    assert rows.count() == 1 and row.voters == ["r1", "r2", "r3"]
    # an empty offset is a value, a repeated event of one voter is no vote, ties go to the first
    assert (row.stated_utc_offset, row.affected, row.evidence) == ("", "abcd", "said so")


def test_consensus(spark):
    two_of_three = ballots(spark, ("r1", [ROW]), ("r2", [ROW]), ("r3", []))
    assert vote.consensus(two_of_three, 3)[0].count() == 1
    exact = ballots(spark, ("r1", [ROW]), ("r2", [(AT8, None, None, None)]), ("r3", []))
    assert vote.consensus(exact, 3)[0].count() == 0
    failed = ballots(spark, ("r1", [ROW]), ("r2", [ROW]), ("r3", None))
    kept, failures = vote.consensus(failed, 3)
    assert kept.count() == 0 and failures.first().error == "down"
    alone = ballots(spark, ("r1", [ROW, ROW]))
    assert vote.consensus(alone, 1)[0].count() == 2


def test_quotes_are_found_and_other_runs_never_become_rows(spark):
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(0, 400))) for _ in range(60)]
    hot = "the same footer on every page of all"
    texts = [f"{t} {hot}" for t in texts] + [None, "", "one two three", f"{hot} {hot}"]
    quotes = [" ".join(t.split()[5:14]) for t in texts[:20]] + [hot.upper(), "w1 w2", None, "", "not in any text at all", texts[3], "page of all w"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked = spark.createDataFrame(list(enumerate(quotes)), "quote_id long, quote string")

    def plain(t):
        return " ".join((t or "").lower().split())

    want = {
        (q, i)
        for q, quote in enumerate(quotes)
        for i, text in enumerate(texts)
        if len(plain(quote).split()) >= evidence.RUN and f" {plain(quote)} " in f" {plain(text)} "
    }
    assert {(r.quote_id, r.doc_id) for r in evidence.evidence_search(asked, docs).collect()} == want
    assert evidence.evidence_search(asked.limit(0), docs).collect() == []
    assert evidence.evidence_search(asked, docs.limit(0)).collect() == []

    held = docs.select("doc_id", textcols.words(F.col("text")).alias("text_words")).filter("text_words <> ''")
    runs = asked.select(F.explode(evidence._runs(textcols.words(F.col("quote")))).alias("run"))
    passed = evidence.wanted_runs(held, runs)
    true = held.select("doc_id", F.explode(evidence._runs(F.col("text_words"))).alias("run")).join(runs.distinct(), "run", "left_semi").select("doc_id", "run")
    assert true.exceptAll(passed).isEmpty()
    assert true.count() <= passed.count() <= 1.02 * true.count()
    assert "getbit" in passed._jdf.queryExecution().optimizedPlan().toString().split("Generate explode")[1].splitlines()[0]
