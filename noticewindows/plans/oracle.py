"""SQL twins of the registered queries, written on their own and run over the same tables.

Shared views come first; a query names the views it needs and they are put in front of it.
"""

from __future__ import annotations

import re

from noticewindows import fixed_values as fv

NOW = "TIMESTAMP '2024-01-15 12:00:00'"
LATER = "TIMESTAMP '2024-03-10 00:00:00'"
HEALTH_NOW = "TIMESTAMP '2024-01-31 06:00:00'"


def iso(ts: str, shift_hours: int = 0, offset: str = "+00:00") -> str:
    """ISO text of a naive UTC column; seconds only, microseconds when they are not zero."""
    moved = ts if not shift_hours else f"({ts} + INTERVAL {shift_hours} HOUR)"
    plain = f"strftime({moved}, '%Y-%m-%dT%H:%M:%S')"
    micro = f"strftime({moved}, '%Y-%m-%dT%H:%M:%S.%f')"
    return f"(CASE WHEN epoch_us({ts}) % 1000000 = 0 THEN {plain} ELSE {micro} END || '{offset}')"


def title(kind: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fv.SUMMARIES.items())
    return f"(CASE {kind} {cases} ELSE '{fv.SUMMARIES['other']}' END)"


VIEWS: dict[str, str] = {
    "ev": """SELECT event_id, ts AS tm, user_id, event_type, value, props,
        CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events""",
    "w0": """SELECT event_id AS pos, user_id * 10 + k // 10 AS arrival_seq, 'u' || user_id AS firm,
        'post-' || user_id || '-' || (k // 10) AS post_key,
        CASE event_type WHEN 'view' THEN 'maintenance' WHEN 'signup' THEN 'crypto_closure'
          WHEN 'error' THEN 'early_close' WHEN 'click' THEN 'late_open' ELSE 'holiday_closure' END AS event_type,
        CASE WHEN value >= 50 THEN 'DESK-A, DESK-B' WHEN value >= 20 THEN 'desk-c' END AS affected,
        date_trunc('day', tm) + to_hours(CAST(6 * (extract(hour FROM tm) // 6) AS INTEGER)) AS start_at,
        CAST(1 + floor(value / 50) AS BIGINT) AS hours, user_id, k, value, tm FROM ev""",
    "w1": f"""SELECT *, start_at + to_hours(CAST(hours AS INTEGER)) AS end_at,
        {title('event_type')} || coalesce(' — ' || affected, '') AS summary FROM w0""",
    "w2": f"""SELECT *, {iso('start_at', 3, '+03:00')} AS start_iso, {iso('end_at', 3, '+03:00')} AS end_iso,
        CASE WHEN k < 30 THEN '' ELSE 'https://example.org/' || post_key END AS url,
        CASE WHEN k >= 60 THEN 'closes; at the stated hour' ELSE '' END AS evidence FROM w1""",
    "w3": """SELECT *, substr(sha256(post_key || '|' || event_type || '|' || start_iso || '|' || end_iso), 1, 16)
        AS event_key FROM w2""",
    "w": """SELECT *, CASE WHEN event_type = 'crypto_closure' THEN 'ics:' ELSE 'cal-' END || event_key AS entry_id
        FROM w3""",
    "catalog": """SELECT 'u' || user_id AS firm, CASE WHEN max(value) >= 100 THEN 'Desk ' || user_id END AS title,
        CASE WHEN max(value) < 150 THEN 'https://example.org/u' || user_id ELSE '' END AS firm_url
        FROM ev GROUP BY user_id""",
    "firms": """SELECT DISTINCT 'u' || user_id AS firm,
        CASE WHEN user_id < 50 THEN 'Etc/GMT-3' WHEN user_id < 100 THEN 'America/Chicago' ELSE 'Europe/London' END AS timezone,
        CASE WHEN user_id < 50 THEN 3 WHEN user_id < 100 THEN -6 ELSE 0 END AS zone_h,
        user_id >= 140 AS require_stated_offset FROM ev""",
    "dedup": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY firm, event_type, start_iso, end_iso, summary
        ORDER BY arrival_seq, pos) AS rn FROM w) WHERE rn = 1""",
    "post_url": "SELECT firm, post_key, max(url) AS post_url, min(arrival_seq) AS seq FROM w GROUP BY ALL",
    "rows0": f"""SELECT d.firm, d.event_type, d.start_iso, d.end_iso, d.summary, d.post_key, d.event_key, d.pos,
        d.arrival_seq, d.start_at, d.end_at, d.evidence, p.post_url,
        CASE WHEN d.end_at <= {NOW} THEN 'past' WHEN d.start_at <= {NOW} THEN 'live' ELSE 'upcoming' END AS status,
        {iso('d.start_at')} AS start_utc, {iso('d.end_at')} AS end_utc
        FROM dedup d JOIN post_url p USING (firm, post_key)""",
    "rws": """SELECT r.*, coalesce(c.title, r.firm) AS firm_name,
        coalesce(nullif(r.post_url, ''), nullif(c.firm_url, ''), '') AS link
        FROM rows0 r LEFT JOIN catalog c USING (firm)""",
    "sel": """SELECT 'all' AS feed_id, NULL AS one, NULL AS types
        UNION ALL SELECT DISTINCT 'type-' || event_type, NULL, [event_type] FROM w
        UNION ALL SELECT DISTINCT 'firm-' || firm, firm, NULL FROM w
        UNION ALL SELECT DISTINCT 'two-' || firm, firm, ['late_open', 'early_close'] FROM w""",
    "feed": """SELECT s.feed_id, r.* FROM sel s JOIN rws r
        ON (s.one IS NULL OR s.one = r.firm) AND (s.types IS NULL OR list_contains(s.types, r.event_type))""",
    "docs": """SELECT source AS firm, 'doc-' || doc_id AS post_key, 'https://example.org/' || source || '/doc-' || doc_id AS url,
        text, doc_id, lang, n_chars, source FROM documents""",
    "doc_state": """SELECT CASE WHEN n_chars < 300 THEN '' ELSE firm END AS firm, post_key,
        sha256(CASE WHEN lang = 'de' THEN text || ' (updated)' ELSE text END) AS content_hash,
        n_chars >= 500 AS deferred_known, source FROM docs WHERE lang <> 'es'""",
    "doc_status": """SELECT d.firm, d.post_key, sha256(d.text) AS content_hash,
        CASE WHEN s.post_key IS NULL THEN 'new' WHEN s.content_hash <> sha256(d.text) THEN 'changed'
          WHEN NOT s.deferred_known THEN 'reextract' ELSE 'unchanged' END AS status
        FROM docs d LEFT JOIN doc_state s ON s.source = d.firm AND s.post_key = d.post_key""",
    "raw0": f"""SELECT *, start_at + INTERVAL 3 HOUR AS l_start,
        start_at + INTERVAL 3 HOUR + to_hours(CAST(CASE k WHEN 79 THEN 72 WHEN 89 THEN 0 ELSE hours END AS INTEGER)) AS l_end
        FROM w""",
    "raw": """SELECT firm, post_key, pos AS event_ord, event_type,
        CASE WHEN k = 97 THEN 'whenever' WHEN k = 70 THEN strftime(l_start, '%Y-%m-%d')
          ELSE strftime(l_start, '%Y-%m-%dT%H:%M:%S') || CASE WHEN k = 71 THEN '+01:00' ELSE '' END END AS start_time,
        strftime(l_end, '%Y-%m-%dT%H:%M:%S') || CASE WHEN k = 71 THEN '+01:00' ELSE '' END AS end_time,
        CASE WHEN k < 30 THEN '+03:00' WHEN k < 50 THEN 'GMT+3' WHEN k < 60 THEN NULL WHEN k < 65 THEN 'UTC+0330'
          WHEN k < 67 THEN 'EST' ELSE 'UTC-05:00' END AS stated_utc_offset,
        affected, CASE WHEN k BETWEEN 73 AND 75 THEN 'low' ELSE 'high' END AS confidence,
        CASE WHEN k < 50 THEN NULL WHEN k < 60 THEN 'Dec 25 closed' WHEN k < 80 THEN 'the Platform closes | at THE stated hour'
          ELSE 'markets reopen after the long break' END AS evidence, user_id, k FROM raw0""",
    "inst": """SELECT r.*, f.require_stated_offset,
        try_strptime(substr(start_time, 1, 19), ['%Y-%m-%dT%H:%M:%S', '%Y-%m-%dT%H:%M', '%Y-%m-%d']) AS s0,
        try_strptime(substr(end_time, 1, 19), ['%Y-%m-%dT%H:%M:%S']) AS e0,
        CASE stated_utc_offset WHEN '+03:00' THEN 180 WHEN 'GMT+3' THEN 180 WHEN 'UTC+0330' THEN 210
          WHEN 'UTC-05:00' THEN -300 END AS stated_min, f.zone_h * 60 AS zone_min,
        CASE WHEN end_time LIKE '%+01:00' THEN 60 END AS own_min
        FROM raw r JOIN firms f USING (firm)""",
    "judged0": """SELECT *, s0 - to_minutes(CAST(coalesce(own_min, stated_min, zone_min) AS INTEGER)) AS start_at,
        e0 - to_minutes(CAST(coalesce(own_min, stated_min, zone_min) AS INTEGER)) AS end_at,
        CASE WHEN evidence IS NULL THEN 'none' WHEN evidence = 'Dec 25 closed' THEN 'short'
          WHEN evidence LIKE 'the Platform%' THEN 'ok' ELSE 'unfound' END AS verdict FROM inst""",
    "judged": f"""SELECT *, CASE
          WHEN s0 IS NULL THEN 'unparseable datetime: Invalid isoformat string: ''' || start_time || ''''
          WHEN require_stated_offset AND stated_min IS NULL AND own_min IS NULL THEN '{fv.REASON_NO_OFFSET}'
          WHEN e0 <= s0 THEN 'end is not after start'
          WHEN e0 - s0 > INTERVAL 48 HOUR THEN 'duration exceeds 48h sanity cap'
          WHEN start_at > {NOW} + INTERVAL 10 DAY THEN 'too far in the future'
          WHEN end_at <= {NOW} THEN 'already ended' END AS reason FROM judged0""",
    "acc": f"""SELECT *, reason IS NOT NULL AND reason = 'too far in the future' AS retryable,
        reason IS NOT NULL AND reason = 'already ended' AS benign,
        confidence = 'low' OR verdict = 'unfound' AS low,
        {iso('start_at', 3, '+03:00')} AS start_iso, {iso('end_at', 3, '+03:00')} AS end_iso FROM judged""",
    "voters": "SELECT * FROM (VALUES (0, 'm1'), (1, 'm2'), (2, 'm3')) t(n, voter)",
    "ballots0": """SELECT r.firm, r.post_key, v.n, v.voter, r.event_ord, r.event_type, r.user_id,
        CASE WHEN n = 1 THEN substr(start_time, 1, 16) ELSE start_time END AS start_time, end_time,
        CASE WHEN n = 0 THEN NULL ELSE stated_utc_offset END AS stated_utc_offset,
        CASE WHEN n = 2 THEN affected ELSE substr(affected, 1, 6) END AS affected, confidence,
        CASE WHEN n = 0 THEN '' ELSE evidence END AS evidence,
        NOT ((n = 0 AND k BETWEEN 0 AND 4) OR (n = 1 AND (k BETWEEN 5 AND 9 OR k BETWEEN 20 AND 24))
          OR (n = 2 AND (k BETWEEN 10 AND 14 OR k BETWEEN 20 AND 24))) AS seen,
        (n = 2 AND user_id >= 120) OR (n = 1 AND user_id >= 140) AS abstains,
        (n * 1000000000000 + event_ord) AS ord
        FROM raw r CROSS JOIN voters v""",
    "bruns": """SELECT firm, post_key, n, voter, bool_or(abstains) AS abstains, count(*) FILTER (seen) AS found
        FROM ballots0 GROUP BY ALL""",
    "brows": """SELECT *, CASE WHEN length(start_time) = 19 AND start_time LIKE '____-__-__T__:__:__' THEN substr(start_time, 1, 16)
          WHEN length(start_time) = 10 THEN start_time || 'T00:00'
          WHEN length(start_time) = 25 THEN substr(start_time, 1, 16) || substr(start_time, 20) ELSE start_time END AS start_m,
        CASE WHEN length(end_time) = 25 THEN substr(end_time, 1, 16) || substr(end_time, 20) ELSE substr(end_time, 1, 16) END AS end_m
        FROM ballots0 WHERE seen AND NOT abstains""",
    "answered": "SELECT firm, post_key, count(*) FILTER (NOT abstains) AS n_answered FROM bruns GROUP BY ALL",
    "before": "SELECT * FROM w WHERE event_type <> 'crypto_closure'",
    "extraction": "SELECT *, pos AS event_ord FROM w WHERE event_type <> 'late_open' AND k < 90",
    "eposts": """SELECT firm, post_key, min(arrival_seq) AS proc_ord, min(k) BETWEEN 50 AND 59 AS recover
        FROM w GROUP BY ALL""",
    "old1": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY firm, post_key, event_key ORDER BY pos) AS q FROM before) WHERE q = 1",
    "new1": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY firm, post_key, event_key ORDER BY event_ord) AS q FROM extraction) WHERE q = 1",
    "diff": f"""SELECT coalesce(o.firm, n.firm) AS firm, coalesce(o.post_key, n.post_key) AS post_key,
        coalesce(o.event_key, n.event_key) AS event_key,
        CASE WHEN o.pos IS NOT NULL AND n.pos IS NOT NULL THEN 'kept' WHEN n.pos IS NOT NULL THEN 'added'
          WHEN o.end_at > {NOW} THEN 'missing' ELSE 'ended' END AS change,
        o.pos IS NOT NULL AS in_old, n.pos IS NOT NULL AS in_new, o.entry_id AS old_entry,
        coalesce(n.pos, o.pos) AS tie, coalesce(o.event_type, n.event_type) AS event_type,
        coalesce(o.summary, n.summary) AS summary, coalesce(o.start_iso, n.start_iso) AS start_iso,
        coalesce(o.end_iso, n.end_iso) AS end_iso, coalesce(o.start_at, n.start_at) AS start_at,
        coalesce(o.end_at, n.end_at) AS end_at
        FROM old1 o FULL JOIN new1 n ON o.post_key = n.post_key AND o.event_key = n.event_key""",
    "guards": """SELECT d.firm, d.post_key, e.recover, count(*) FILTER (in_old) AS n_old, count(*) FILTER (in_new) AS n_new,
        count(*) FILTER (change = 'missing') AS n_missing, count(*) FILTER (change = 'added') AS n_added
        FROM diff d JOIN eposts e USING (firm, post_key) GROUP BY ALL""",
    "clear": """SELECT * FROM extraction x WHERE NOT EXISTS (SELECT 1 FROM before b WHERE b.post_key = x.post_key
        AND (b.event_key = x.event_key OR (b.event_type = x.event_type AND x.start_at <= b.end_at AND b.start_at <= x.end_at)))""",
    "steps": """SELECT d.*, e.proc_ord, CASE
          WHEN change = 'added' THEN CASE WHEN NOT e.recover OR d.event_key IN (SELECT event_key FROM clear) THEN 'add' END
          WHEN e.recover OR change = 'kept' THEN 'keep'
          WHEN g.n_missing > 0 AND g.n_added = 0 THEN CASE WHEN change = 'ended' THEN 'keep' ELSE 'refuse' END
          WHEN change = 'missing' THEN 'drop' ELSE 'history' END AS step
        FROM diff d JOIN eposts e USING (firm, post_key) JOIN guards g USING (firm, post_key)""",
    "opening": """SELECT firm, event_type, start_iso, end_iso, summary, count(*) AS held,
        arg_min(entry_id, arrival_seq * 100000000 + pos) AS opening_entry
        FROM old1 GROUP BY ALL""",
    "timeline": """SELECT s.*, coalesce(o.held, 0) AS held, o.opening_entry, CASE WHEN step = 'add' THEN 1 ELSE -1 END AS delta,
        coalesce(o.held, 0) + sum(CASE WHEN step = 'add' THEN 1 ELSE -1 END) OVER (
          PARTITION BY s.firm, s.event_type, s.start_iso, s.end_iso, s.summary
          ORDER BY proc_ord, step = 'add', tie ROWS UNBOUNDED PRECEDING) AS balance
        FROM steps s LEFT JOIN opening o USING (firm, event_type, start_iso, end_iso, summary)
        WHERE step IN ('add', 'drop')""",
    "ext": "SELECT DISTINCT event_key AS ext_key, 'ext-' || event_key AS ext_entry FROM w WHERE value >= 150",
    "decided": """SELECT t.*, CASE WHEN step = 'drop' THEN CASE WHEN balance > 0 THEN 'release' ELSE 'delete' END
          WHEN balance - delta > 0 THEN 'share' WHEN ext_key IS NOT NULL THEN 'adopt' ELSE 'create' END AS action,
        coalesce(ext_entry, 'ics:' || event_key) AS fresh FROM timeline t LEFT JOIN ext ON ext_key = event_key""",
    "plan": """SELECT firm, post_key, event_key, step AS action, old_entry AS entry_id, proc_ord, summary, start_iso, end_iso, event_type
        FROM steps WHERE step IN ('keep', 'refuse', 'history')
        UNION ALL SELECT firm, post_key, event_key, action, CASE WHEN step = 'drop' THEN old_entry
          WHEN action = 'share' THEN coalesce(last_value(CASE WHEN action IN ('adopt', 'create') THEN fresh END IGNORE NULLS) OVER (
            PARTITION BY firm, event_type, start_iso, end_iso, summary ORDER BY proc_ord, step = 'add', tie
            ROWS UNBOUNDED PRECEDING), opening_entry) ELSE fresh END, proc_ord, summary, start_iso, end_iso, event_type FROM decided""",
    "live": f"""SELECT * FROM w WHERE end_at > {NOW}""",
    "merge0": """SELECT firm, event_type, start_iso, end_iso, summary,
        (arg_min(entry_id, ((entry_id LIKE 'ics:%')::BIGINT, arrival_seq, pos))) AS survivor FROM live GROUP BY ALL""",
    "pairs": """SELECT DISTINCT l.firm, l.event_type, l.start_iso, l.end_iso, l.summary, l.entry_id, m.survivor
        FROM live l JOIN merge0 m USING (firm, event_type, start_iso, end_iso, summary) WHERE l.entry_id <> m.survivor""",
    "pstat": """SELECT firm, post_key, max(value) >= 60 AS relevant,
        CASE WHEN min(k) % 10 = 0 THEN 'unchanged' ELSE 'changed' END AS status FROM w GROUP BY ALL""",
    "rep": """SELECT firm, (SELECT count(*) FROM pstat p WHERE p.firm = f.firm) AS posts_seen,
        (SELECT count(*) FROM pstat p WHERE p.firm = f.firm AND relevant) AS posts_relevant,
        (SELECT count(*) FROM pstat p WHERE p.firm = f.firm AND relevant AND status = 'unchanged') AS posts_skipped_unchanged,
        (SELECT count(*) FROM plan p WHERE p.firm = f.firm AND action = 'create') AS events_created,
        (SELECT count(*) FROM plan p WHERE p.firm = f.firm AND action = 'delete') AS events_deleted,
        (SELECT count(*) FROM plan p WHERE p.firm = f.firm AND action IN ('keep', 'refuse', 'share', 'adopt')) AS events_kept,
        (SELECT count(*) FROM acc a WHERE a.firm = f.firm AND reason IS NOT NULL AND NOT retryable) AS rejections,
        (SELECT count(*) FROM acc a WHERE a.firm = f.firm AND retryable) AS events_deferred,
        (SELECT count(*) FROM pairs p WHERE p.firm = f.firm AND entry_id NOT LIKE 'ics:%') AS duplicates_merged
        FROM firms f""",
    "rlog": """SELECT event_id AS run_id, 'u' || user_id AS firm, tm AS ts,
        CASE WHEN event_type = 'error' THEN 'HTTP ' || CAST(500 + k // 50 AS VARCHAR) END AS error,
        CASE WHEN event_type = 'click' THEN 'gate matched nothing' ELSE '' END AS anomalies FROM ev""",
    "hlth": f"""SELECT firm, max(ts) FILTER (error IS NULL) AS last_success, arg_max_null(error, run_id) AS last_error,
        arg_max(anomalies, run_id) AS anomalies, count(*) FILTER (error IS NULL) AS runs_ok,
        count(*) FILTER (error IS NOT NULL) AS runs_failed FROM rlog GROUP BY firm""",
    "hstat": f"""SELECT *, epoch_us({HEALTH_NOW}) - epoch_us(last_success) AS age_us,
        epoch_us({HEALTH_NOW}) - epoch_us(coalesce(last_success, TIMESTAMP '2024-01-01')) > 72000000000 AS stale FROM hlth""",
    "hfin": """SELECT *, CASE WHEN last_error IS NOT NULL THEN 'error' WHEN stale THEN 'stale' WHEN anomalies <> '' THEN 'anomaly'
        ELSE 'ok' END AS status FROM hstat""",
    "flog": """SELECT 'https://h' || user_id || '.example.org/' || k AS url,
        CASE WHEN value < 20 THEN 1 WHEN value < 60 THEN 2 ELSE 3 END AS attempt, tm AS ts,
        CASE WHEN k < 50 THEN 200 WHEN k < 60 THEN 404 WHEN k < 70 THEN 429 WHEN k < 80 THEN 503 WHEN k < 85 THEN 403 ELSE 200 END AS status,
        k BETWEEN 85 AND 89 AS network_error FROM ev""",
    "fout": """SELECT *, CASE WHEN (network_error OR status = 429 OR status >= 500) THEN CASE WHEN attempt >= 3 THEN 'error' ELSE 'retry' END
        WHEN status IN (404, 410) THEN 'gone' WHEN status >= 400 THEN 'error' ELSE 'ok' END AS outcome FROM flog""",
    "fnext": """SELECT *, CASE WHEN outcome = 'retry' THEN ts + to_seconds(CAST(2 ** attempt AS INTEGER)) END AS next_at FROM fout""",
    "exp1": """SELECT post_key AS case_id, event_type, start_time, end_time,
        arg_max_null(stated_utc_offset, event_ord) AS off, arg_max_null(affected, event_ord) AS aff FROM raw GROUP BY ALL""",
    "got1": """SELECT post_key AS case_id, n AS run, event_type, start_time, end_time,
        arg_max_null(stated_utc_offset, event_ord) AS off, arg_max_null(affected, event_ord) AS aff
        FROM brows GROUP BY ALL""",
    "runs": """SELECT post_key AS case_id, n AS run, voter, abstains,
        CASE WHEN abstains THEN 'no answer from ' || voter END AS error FROM bruns""",
    "norm": """SELECT * FROM (VALUES ('+03:00', '+03:00'), ('GMT+3', '+03:00'), ('UTC+0330', '+330:00'), ('EST', 'EST'),
        ('UTC-05:00', '-05:00')) t(raw_off, norm_off)""",
    "ekeys": """SELECT r.case_id, r.run, e.event_type, e.start_time, e.end_time, a.norm_off AS off, e.aff
        FROM runs r JOIN exp1 e USING (case_id) LEFT JOIN norm a ON a.raw_off = e.off WHERE NOT r.abstains""",
    "gkeys": "SELECT g.*, a.norm_off AS noff FROM got1 g LEFT JOIN norm a ON a.raw_off = g.off",
    "sides": """SELECT coalesce(e.case_id, g.case_id) AS case_id, coalesce(e.run, g.run) AS run,
        coalesce(e.event_type, g.event_type) AS event_type, coalesce(e.start_time, g.start_time) AS start_time,
        coalesce(e.end_time, g.end_time) AS end_time, e.case_id IS NOT NULL AS in_e, g.case_id IS NOT NULL AS in_g,
        e.off IS DISTINCT FROM g.noff AS off_differs, coalesce(e.aff, '') <> '' AND coalesce(g.aff, '') = '' AS lost
        FROM ekeys e FULL JOIN gkeys g ON e.case_id = g.case_id AND e.run = g.run AND e.event_type = g.event_type
          AND e.start_time = g.start_time AND e.end_time = g.end_time""",
    "score": """SELECT r.case_id, r.run, r.voter, r.error, coalesce(b.matched, 0) AS matched, coalesce(b.missing, 0) AS missing,
        coalesce(b.extra, 0) AS extra, coalesce(b.offs, 0) AS offset_mismatches, coalesce(b.lost, 0) AS affected_missing,
        coalesce(q.ok, 0) AS evidence_verified, coalesce(q.total, 0) AS evidence_total
        FROM runs r LEFT JOIN (SELECT case_id, run, count(*) FILTER (in_e AND in_g) AS matched,
          count(*) FILTER (NOT in_g) AS missing, count(*) FILTER (NOT in_e) AS extra,
          count(*) FILTER (in_e AND in_g AND off_differs) AS offs, count(*) FILTER (in_e AND in_g AND lost) AS lost
          FROM sides GROUP BY ALL) b USING (case_id, run)
        LEFT JOIN (SELECT post_key AS case_id, n AS run, count(*) FILTER (evidence LIKE 'the Platform%') AS ok, count(*) AS total
          FROM brows GROUP BY ALL) q USING (case_id, run)""",
    "passed": """SELECT *, error IS NULL AND missing <= 2 AND extra <= 1 AND offset_mismatches = 0 AS good,
        error IS NULL AND missing <= 1 AND extra <= 0 AND offset_mismatches = 0 AS alone FROM score""",
    "idsets": """SELECT r.case_id, r.run, coalesce(string_agg(DISTINCT g.event_type || g.start_time || g.end_time, '|'
        ORDER BY g.event_type || g.start_time || g.end_time), '') AS ids
        FROM runs r LEFT JOIN got1 g USING (case_id, run) GROUP BY ALL""",
    "cases": """SELECT p.case_id, count(*) AS runs, bool_and(good) AS passed, max(missing) AS missing, max(extra) AS extra,
        max(offset_mismatches) AS offset_mismatches, count(*) FILTER (error IS NOT NULL) AS errors,
        CAST(sum(evidence_verified) AS BIGINT) AS evidence_verified, CAST(sum(evidence_total) AS BIGINT) AS evidence_total,
        (SELECT count(DISTINCT ids) <= 1 FROM idsets i WHERE i.case_id = p.case_id) AS stable
        FROM passed p GROUP BY p.case_id""",
}


def _needs(sql: str, known: list[str]) -> list[str]:
    """Views that ``sql`` reads, deepest first; a view only reads views listed before it."""
    words = set(re.findall(r"(?:FROM|JOIN|IN \(SELECT \w+ FROM)\s+([a-z_0-9]+)", sql))
    found: list[str] = []
    for n, name in enumerate(known):
        if name in words:
            found += [d for d in _needs(VIEWS[name], known[:n]) if d not in found]
            if name not in found:
                found.append(name)
    return found


def _full(sql: str) -> str:
    names = _needs(sql, list(VIEWS))
    head = ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
    word = "WITH RECURSIVE" if sql.startswith("WITH RECURSIVE") else "WITH"
    if sql.startswith("WITH"):
        return f"{word} {head}, {sql[len(word):]}" if names else sql
    return f"WITH {head} {sql}" if names else sql


def _esc(expr: str) -> str:
    text = f"replace({expr}, chr(13), '')"
    for old, new in (("'\\'", "'\\\\'"), ("';'", "'\\;'"), ("','", "'\\,'"), ("chr(10)", "'\\n'")):
        text = f"replace({text}, {old}, {new})"
    return text


def _clean(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '[\\p{{C}}\\p{{Z}}]+', ' ', 'g'))"


def _tally(key: str) -> str:
    """Votes by key, then the merged row per key."""
    keys = key.split(", ")
    first = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY firm, post_key, {key}, voter ORDER BY ord) AS q
        FROM brows) WHERE q = 1"""
    grouped = ", ".join(keys)
    return f"""SELECT firm, post_key, {grouped}, count(*) AS votes, string_agg(voter, ',' ORDER BY ord) AS voters,
        arg_min_null(event_type, ord) AS b_type, arg_min(start_time, ord) AS b_start, arg_min(end_time, ord) AS b_end,
        coalesce(arg_min_null(stated_utc_offset, ord),
          arg_min(stated_utc_offset, ord) FILTER (stated_utc_offset <> '')) AS b_off,
        arg_max_null(affected, length(coalesce(affected, '')) * 10000000000000 - ord) AS b_aff,
        arg_min(confidence, ord) AS b_conf,
        coalesce(arg_min(evidence, ord) FILTER (evidence <> ''), arg_min_null(evidence, ord)) AS b_evi
        FROM ({first}) GROUP BY firm, post_key, {grouped}"""


_EXACT = _tally("event_type, start_time, end_time")
_PANEL = _tally("event_type, start_m, end_m")
_MERGED = """b_type AS event_type, b_start AS start_time, b_end AS end_time, b_off AS stated_utc_offset, b_aff AS affected,
    b_conf AS confidence, b_evi AS evidence"""
_OTHERS = """array_to_string(list_filter(['m1', 'm2', 'm3'], lambda m: NOT list_contains(string_split(voters, ','), m)), ', ')"""
_DISPUTE = f"""'only ' || votes || ' of 3 models extracted it (quorum 2): ' || replace(voters, ',', ', ') || ' did; ' || {_OTHERS}
    || ' did not'"""
_QUORATE = "JOIN answered a USING (firm, post_key) WHERE n_answered >= 2"

SQL_BODY: dict[str, str] = {
    "w1_dedup_windows": "SELECT firm, event_type, start_iso, end_iso, summary, post_key, event_key, pos FROM dedup",
    "w2_next_window": """SELECT firm, event_key, event_type, start_utc, end_utc, status FROM (SELECT *, row_number() OVER (
        PARTITION BY firm ORDER BY start_at, event_key) AS n FROM rws WHERE status <> 'past'
        AND event_type IN ('maintenance', 'early_close', 'late_open')) WHERE n = 1""",
    "w3_schedule_board": f"""WITH d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY firm, summary, start_iso, end_iso
          ORDER BY arrival_seq, pos) AS n FROM w) WHERE n = 1),
        p AS (SELECT * FROM d WHERE end_at <= {NOW} ORDER BY start_at DESC, arrival_seq, pos LIMIT 6)
        SELECT 0::BIGINT AS part, CASE WHEN start_at <= {NOW} THEN 'live' ELSE 'soon' END AS row_class, firm, summary, start_iso, end_iso
        FROM d WHERE end_at > {NOW} UNION ALL SELECT 1, 'past', firm, summary, start_iso, end_iso FROM p""",
    "w4_order_events": "SELECT event_key, firm, start_utc, status FROM rws ORDER BY start_at, firm, event_key",
    "w8_select_feed": """SELECT feed_id, event_type, count(*) AS n, min(start_utc) AS first_start, max(event_key) AS last_key
        FROM feed GROUP BY ALL""",
    "p12_future": f"SELECT event_key, pos, end_iso FROM w WHERE end_at > {NOW}",
    "p13_event_status": f"""SELECT firm, CASE WHEN end_at <= {NOW} THEN 'past' WHEN start_at <= {NOW} THEN 'live' ELSE 'upcoming' END
        AS status, count(*) AS n FROM w GROUP BY ALL""",
    "j6_window_overlap": """SELECT e.event_id AS req_id, r.event_key, r.firm, r.event_type, r.start_utc, r.end_utc
        FROM ev e JOIN rws r ON r.firm = 'u' || e.user_id AND r.end_at > CASE WHEN e.k >= 98 THEN TIMESTAMP '0001-01-02' ELSE e.tm END
          AND (e.k = 97 AND r.start_at < TIMESTAMP '9999-12-30' OR e.k >= 80 AND e.k <> 97 OR r.start_at < e.tm + to_hours(CAST(1 + floor(e.value) AS INTEGER)))
          AND (e.k >= 50 OR r.event_type IN ('maintenance', 'late_open')) WHERE e.event_type = 'signup'""",
    "j6_window_overlap_all_firms": """SELECT e.event_id AS req_id, r.event_key, r.firm FROM ev e JOIN rws r
        ON r.end_at > e.tm AND r.start_at < e.tm + INTERVAL 2 HOUR WHERE e.event_type = 'purchase'""",
    "j6_overlap_literal": f"""SELECT event_key, pos, {iso('start_at')} AS start_utc FROM w
        WHERE end_at > TIMESTAMP '2024-01-10' AND start_at < TIMESTAMP '2024-01-12 06:00:00'""",
    "j7_next_per_firm": """SELECT c.firm, coalesce(c.title, c.firm) AS firm_name, n.event_key, n.start_utc, n.status FROM catalog c
        LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY firm ORDER BY start_at, event_key) AS q FROM rws
          WHERE status <> 'past' AND event_type = 'holiday_closure') WHERE q = 1) n USING (firm)""",
    "j8_title_url_lookup": """SELECT w.pos, w.firm, coalesce(c.title, w.firm) AS firm_name,
        coalesce(nullif(w.url, ''), nullif(c.firm_url, ''), 'https://example.org/') AS link FROM w JOIN catalog c USING (firm)""",
    "j9_attribute_firm": """SELECT coalesce(nullif(firm, ''), 'srcX') AS firm, count(*) AS posts, max(post_key) AS last_post
        FROM doc_state GROUP BY 1""",
    "p14_parse_requests": f"""WITH q AS (SELECT event_id AS req_id, k, tm, 'u' || user_id AS u, date_trunc('second', tm) AS sec FROM ev),
        r AS (SELECT req_id, CASE WHEN k < 20 THEN NULL WHEN k < 40 THEN u WHEN k < 60 THEN
            CASE WHEN u = 'u1' THEN 'u1' WHEN u < 'u1' THEN u || ',u1' ELSE 'u1,' || u END
            WHEN k < 70 THEN 'nobody,' || u WHEN k < 72 THEN '' END AS firms,
          CASE WHEN k < 30 THEN 'maintenance,other' WHEN k BETWEEN 72 AND 74 THEN 'nonsense' END AS types,
          CASE WHEN k < 10 THEN date_trunc('day', tm) WHEN k < 25 THEN sec WHEN k < 50 THEN sec + INTERVAL 150 MINUTE
            WHEN k < 80 THEN sec WHEN k < 85 THEN NULL ELSE {NOW} END AS f,
          CASE WHEN k < 50 THEN TIMESTAMP '2024-01-31' WHEN k < 75 THEN TIMESTAMP '2024-01-16' END AS t, k FROM q)
        SELECT req_id, firms, types, {iso('f')} AS from_utc, {iso('t')} AS to_utc,
          CASE WHEN k BETWEEN 60 AND 69 THEN 'unknown firm: [''nobody'']' WHEN k BETWEEN 70 AND 71 THEN 'unknown firm: []'
            WHEN k BETWEEN 72 AND 74 THEN 'unknown type: [''nonsense'']; known: {", ".join(sorted(fv.EVENT_TYPES))}'
            WHEN k BETWEEN 80 AND 84 THEN 'from is neither a date nor a time in ISO form: ''soon'''
            WHEN k BETWEEN 90 AND 92 THEN 'to is neither a date nor a time in ISO form: ''2024-13-01'''
            WHEN t <= f THEN 'the range ends before it starts (''to'' <= ''from'')' END AS error FROM r""",
    "s1_resolve_firms": """WITH s AS (SELECT source, max(n_chars) AS x, count(*) FILTER (lang = 'fr') AS fr FROM documents GROUP BY source)
        SELECT source AS name, upper(source) AS display_name,
          CASE WHEN fr > 8 THEN 'https://example.net/' ELSE 'https://example.org/' || source END AS url,
          CASE WHEN x > 20000 THEN 'Europe/Paris' WHEN x > 15000 THEN 'America/Chicago' ELSE 'Etc/GMT-3' END AS timezone,
          CASE WHEN fr > 9 THEN 'maintenance|market is closed|ctrader|holiday|crypto' WHEN fr > 7 THEN 'ouvert'
            WHEN fr > 6 THEN 'maison|fermé' ELSE 'maintenance|market is closed|ctrader|holiday|crypto' END AS keywords,
          CASE WHEN x > 10000 THEN 2::BIGINT ELSE 4 END AS max_posts, 14::BIGINT AS max_age_days FROM s WHERE x >= 8000""",
    "s2_check_profiles": """WITH h AS (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, url FROM pages)
        SELECT 'listed twice' AS rule, host AS subject FROM h GROUP BY host HAVING count(*) > 1
        UNION ALL SELECT 'shared post key prefix', regexp_extract(host, '([^.]+\\.[a-z]+)$', 1) FROM (SELECT DISTINCT host FROM h)
          GROUP BY 2 HAVING count(*) > 1
        UNION ALL SELECT DISTINCT 'unknown zone', 'Mars/Base' FROM h WHERE url LIKE '%/de/%' AND url NOT LIKE '%/fr/%'""",
    "s3_extract_posts": """WITH p AS (SELECT page_id, trim(replace(replace(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '&quot;', '"'), '&amp;', '&')) AS title,
          array_to_string(list_filter(list_transform(string_split_regex(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '<[^>]*>'),
            lambda x: trim(replace(replace(replace(replace(x, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), E' \\n\\t\\r')),
            lambda x: x <> ''), ' ') AS text FROM pages)
        SELECT page_id, CASE WHEN length(text) >= 200 THEN title END AS title, CASE WHEN length(text) >= 200 THEN length(text) END AS n_chars,
          CASE WHEN length(text) >= 200 THEN sha256(text) END AS content_hash,
          CASE WHEN length(text) < 200 THEN '''article'' matched but held only ' || length(text) || ' chars' END AS message FROM p""",
    "s4_extract_listing": """WITH p AS (SELECT page_id, url, regexp_extract(url, '^(https?://[^/]+)', 1) AS root,
          regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) AS title,
          array_to_string(list_filter(list_transform(string_split_regex(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '<[^>]*>'),
            lambda x: trim(replace(replace(replace(replace(x, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), E' \\n\\t\\r')),
            lambda x: x <> ''), ' ') AS text, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hrefs FROM pages),
        l AS (SELECT page_id, root || replace(h, '&amp;', '&') AS href, i FROM (SELECT page_id, root, unnest(hrefs) AS h, generate_subscripts(hrefs, 1) AS i FROM p)),
        u AS (SELECT page_id, href, min(i) AS i FROM l WHERE href LIKE '%e%' GROUP BY ALL)
        SELECT page_id, -1::BIGINT AS link_ord, sha256(text) AS found FROM p WHERE length(text) >= 200 AND lower(title) LIKE '%th%'
        UNION ALL SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1, href FROM u""",
    "s5_post_key": """SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F', 'O') OR o_orderpriority LIKE '1%' THEN 'update-' || strftime(o_orderdate, '%Y-%m-%d')
        WHEN o_orderpriority LIKE '2%' THEN 'post-' || o_orderkey
        ELSE 'no-' || o_orderkey || '-sept-31-2020' END AS post_key FROM orders""",
    "s6_select_recent": """WITH f AS (SELECT 'u' || user_id AS firm, -event_id AS pos, 'e-' || event_id AS post_key, event_type, value, tm FROM ev),
        own AS (SELECT firm, arg_max(post_key, -pos) AS post_key FROM f WHERE event_type = 'signup' GROUP BY firm),
        c AS (SELECT firm, post_key, -100000000 AS pos, 'ok' AS outcome FROM own UNION ALL
          SELECT f.firm, f.post_key, f.pos, CASE WHEN event_type = 'purchase' AND value >= 60 THEN 'failed' ELSE 'ok' END FROM f
          LEFT JOIN own o USING (firm) WHERE event_type NOT IN ('click', 'error') AND CAST(tm AS DATE) >= DATE '2024-01-15'
          AND NOT (f.post_key IS NOT DISTINCT FROM o.post_key AND NOT (event_type = 'purchase' AND value >= 60))),
        r AS (SELECT *, row_number() OVER (PARTITION BY firm ORDER BY CASE WHEN pos = -100000000 THEN -1e18 ELSE pos END) AS rank FROM c),
        k AS (SELECT * FROM r WHERE rank <= 4), bad AS (SELECT firm, arg_min(post_key, pos) AS post_key FROM k WHERE outcome = 'failed' GROUP BY firm),
        ok AS (SELECT * FROM k WHERE outcome = 'ok' AND firm NOT IN (SELECT firm FROM bad))
        SELECT firm, post_key, rank, NULL AS message FROM ok
        UNION ALL SELECT DISTINCT f.firm, NULL, NULL::BIGINT, CASE WHEN bad.firm IS NOT NULL THEN 'no page came from https://example.org/n-' || substr(bad.post_key, 3)
          || '-x-' || lower(strftime(e.ts, '%-d-%b-%Y')) ELSE 'no announcement posts found' END
          FROM f LEFT JOIN bad USING (firm) LEFT JOIN events e ON 'e-' || e.event_id = bad.post_key
          WHERE f.firm NOT IN (SELECT firm FROM ok)""",
    "p1_keyword_gate": """WITH s AS (SELECT source, max(n_chars) AS x FROM documents GROUP BY source)
        SELECT d.firm, d.post_key FROM docs d JOIN s ON s.source = d.firm WHERE CASE WHEN x > 12000
        THEN contains(lower(text), 'tion') OR contains(lower(text), 'eaux') ELSE contains(lower(text), 'ñ') OR contains(lower(text), 'thering') END""",
    "p2_changed_posts": "SELECT firm, post_key, content_hash, status FROM doc_status",
    "p3_touch_seen": f"""SELECT CASE WHEN d.lang <> 'fr' THEN d.firm WHEN d.n_chars < 300 THEN '' ELSE d.firm END AS firm, d.post_key,
        CASE WHEN d.lang <> 'fr' THEN {iso(NOW)} ELSE '2024-01-01T00:00:00+00:00' END AS last_seen,
        CASE WHEN d.lang <> 'fr' THEN d.url ELSE '' END AS url FROM docs d WHERE lang <> 'es'""",
    "p8_evidence_search": r"""WITH q AS (SELECT item_id AS quote_id, trim(regexp_replace(lower(text), '[^\p{L}\p{N}_]+', ' ', 'g')) AS w FROM benchmark),
        t AS (SELECT doc_id, trim(regexp_replace(lower(text), '[^\p{L}\p{N}_]+', ' ', 'g')) AS w FROM documents)
        SELECT quote_id, doc_id FROM q JOIN t ON contains(' ' || t.w || ' ', ' ' || q.w || ' ') WHERE len(string_split(q.w, ' ')) >= 4""",
    "p15_build_prompts": """WITH s AS (SELECT source, max(n_chars) AS x FROM documents GROUP BY source)
        SELECT d.firm, d.post_key, sha256(chr(10) || 'About this source:' || chr(10)
          || trim(CASE WHEN x > 12000 THEN ' Tion , EAUX' ELSE 'ñ, , thering' END) || chr(10) || chr(10)
          || 'Announcement:' || chr(10) || '---' || chr(10) || text || chr(10) || '---' || chr(10)) AS tail_hash
        FROM docs d JOIN s ON s.source = d.firm""",
    "p4_validate_events": f"""SELECT firm, post_key, event_ord, reason, retryable, benign,
        CASE WHEN reason IS NULL THEN start_iso END AS start_iso, CASE WHEN reason IS NULL THEN end_iso END AS end_iso,
        CASE WHEN reason IS NULL THEN substr(sha256(post_key || '|' || event_type || '|' || start_iso || '|' || end_iso), 1, 16) END AS event_key,
        CASE WHEN reason IS NULL THEN {title('event_type')} || coalesce(' — ' || affected, '') || CASE WHEN low THEN ' (unconfirmed)' ELSE '' END END AS summary,
        CASE WHEN reason IS NULL THEN CASE WHEN low THEN 'low' ELSE confidence END END AS confidence,
        CASE WHEN reason IS NULL THEN CASE WHEN verdict = 'ok' THEN evidence ELSE '' END END AS evidence FROM acc""",
    "p4_validate_strict": f"""WITH s AS (SELECT coalesce(reason, CASE WHEN confidence = 'low' THEN '{fv.REASON_LOW}' END,
          CASE verdict WHEN 'none' THEN '{fv.REASON_NO_EVIDENCE}' WHEN 'short' THEN '{fv.REASON_SHORT_EVIDENCE}'
            WHEN 'unfound' THEN '{fv.REASON_UNFOUND_EVIDENCE}' END) AS reason FROM judged)
        SELECT reason, reason IS NOT NULL AND reason = 'too far in the future' AS retryable,
          reason IS NOT NULL AND reason IN ('already ended', '{fv.REASON_LOW}') AS benign, count(*) AS n FROM s GROUP BY ALL""",
    "p5_parse_offset": """SELECT event_id, CASE WHEN k < 30 THEN CASE WHEN k <= 23 THEN k * 3600 + 1800 END
        WHEN k < 60 THEN NULL WHEN k < 80 THEN CASE WHEN k < 60 THEN 3 * 3600 + k * 60 END WHEN k < 90 THEN NULL
        ELSE NULL END AS seconds FROM ev""",
    "p6_to_instant": f"SELECT event_ord, {iso('start_at')} AS start_utc, {iso('end_at')} AS end_utc FROM judged0",
    "p7_evidence_check": """WITH t AS (SELECT doc_id, text, trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '[^\\p{L}\\p{N}_]+', ' ', 'g')) AS tw,
          split_part(text, '.', 1) AS q FROM documents),
        p AS (SELECT doc_id, 'own' AS kind, upper(q) AS q FROM t UNION ALL SELECT doc_id + 1, 'other', q FROM t),
        x AS (SELECT p.doc_id, kind, p.q, trim(regexp_replace(replace(lower(p.q), 'ß', 'ss'), '[^\\p{L}\\p{N}_]+', ' ', 'g')) AS qw, t.tw
          FROM p JOIN t ON t.doc_id = p.doc_id)
        SELECT doc_id, kind, CASE WHEN regexp_replace(q, '\\s+', '', 'g') = '' THEN 'none'
          WHEN qw = '' OR len(string_split(qw, ' ')) < 4 THEN 'short'
          WHEN contains(' ' || tw || ' ', ' ' || qw || ' ') THEN 'ok' ELSE 'unfound' END AS verdict FROM x""",
    "p9_clean_evidence": f"""SELECT doc_id, rtrim(left({_clean('text')}, 300)) || CASE WHEN length({_clean('text')}) > 300 THEN '…' ELSE '' END AS evidence
        FROM documents""",
    "p10_build_summary": f"""WITH d AS (SELECT doc_id, lang, CASE lang WHEN 'fr' THEN '{fv.SUMMARIES['early_close']}' WHEN 'de' THEN '{fv.SUMMARIES['other']}'
          ELSE '{fv.SUMMARIES['late_open']}' END AS head,
          CASE WHEN n_chars >= 300 THEN trim(regexp_replace(text, '[\\p{{C}}\\p{{Zl}}\\p{{Zp}}\\x{{00A0}}]', '', 'g')) ELSE '' END AS a FROM documents)
        SELECT doc_id, head || CASE WHEN a = '' THEN '' WHEN length(a) > 70 THEN ' — ' || regexp_replace(left(a, 70), '[, ]+$', '') || '…' ELSE ' — ' || a END
          || CASE WHEN lang = 'es' THEN ' (unconfirmed)' ELSE '' END AS summary FROM d""",
    "p11_build_description": f"""WITH d AS (SELECT *, rtrim(left({_clean('text')}, 300)) || CASE WHEN length({_clean('text')}) > 300 THEN '…' ELSE '' END AS q FROM docs)
        SELECT doc_id, CASE WHEN lang = 'es' THEN '{fv.LOW_CONFIDENCE_NOTE}' || chr(10) || chr(10) ELSE '' END
          || CASE WHEN n_chars >= 500 AND q <> '' THEN 'Announcement: “' || q || '”' || chr(10) || chr(10) ELSE '' END
          || left(text, 800) || CASE WHEN length(text) > 800 THEN '…' ELSE '' END || chr(10) || chr(10) || 'Source: ' || url || chr(10)
          || '{fv.ATTRIBUTION}' AS description FROM d""",
    "id_content_hash": "SELECT sha256(text) AS content_hash, count(*) AS posts FROM documents GROUP BY 1",
    "v1_infer": """WITH c AS (SELECT source AS firm, count(*) AS n FROM documents GROUP BY 1)
        SELECT firm, 'v1' AS voter, 0::BIGINT AS model_ord, 1::BIGINT AS attempt, '[]' AS raw, NULL AS error, n FROM c
        UNION ALL SELECT firm, 'v2', 0, 1, NULL, 'no route', n FROM c UNION ALL SELECT firm, 'v2', 1, 1, 'sorry', NULL, n FROM c
        UNION ALL SELECT firm, 'v2', 1, 2, '[]', NULL, n FROM c""",
    "v2_parse_replies": """WITH a AS (SELECT b.*, t.attempt FROM bruns b, (VALUES (1), (2)) t(attempt)),
        hit AS (SELECT firm, post_key, n, bool_or(event_type = 'maintenance' AND seen) AS has FROM ballots0 GROUP BY ALL),
        g AS (SELECT a.*, NOT abstains AND (attempt = 2 OR (a.n = 0 AND NOT has)) AS good FROM a JOIN hit USING (firm, post_key, n))
        SELECT g.firm, g.post_key, g.voter, attempt::BIGINT AS attempt,
          CASE WHEN good THEN NULL WHEN g.abstains THEN 'no answer from ' || g.voter ELSE 'invalid reply' END AS error,
          b.event_type, b.start_time, b.end_time, b.stated_utc_offset, b.affected, b.confidence, b.evidence
        FROM g LEFT JOIN brows b ON good AND b.firm = g.firm AND b.post_key = g.post_key AND b.n = g.n""",
    "v3_resolve_replies": """SELECT firm, post_key, voter, CASE WHEN abstains THEN NULL ELSE found END AS events,
        CASE WHEN abstains THEN 'no answer from ' || voter END AS error FROM bruns""",
    "v4_tally": f"""SELECT firm, post_key, event_type AS key_0, start_time AS key_1, end_time AS key_2, voters FROM ({_EXACT})""",
    "v5_merge_variants": f"SELECT firm, post_key, start_m AS key_1, end_m AS key_2, {_MERGED} FROM ({_PANEL})",
    "v6_consensus": f"""SELECT t.firm, t.post_key, {_MERGED}, NULL AS error FROM ({_EXACT}) t JOIN answered a USING (firm, post_key)
        WHERE n_answered = 3 AND votes >= 2 UNION ALL
        SELECT firm, post_key, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'no answer from ' || max(voter) FROM bruns WHERE abstains GROUP BY ALL""",
    "v7_panel": f"""SELECT t.firm, t.post_key, CASE WHEN votes >= 2 THEN 'kept' ELSE 'dispute' END AS outcome, {_MERGED}, NULL AS error
        FROM ({_PANEL}) t {_QUORATE} UNION ALL
        SELECT firm, post_key, 'failure', NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'only ' || count(*) FILTER (NOT abstains)
          || ' of 3 panel models answered and 2 must agree — ' || string_agg(voter || ': no answer from ' || voter, '; ' ORDER BY n) FILTER (abstains)
          FROM bruns GROUP BY firm, post_key HAVING count(*) FILTER (NOT abstains) < 2""",
    "v8_describe_dispute": f"""SELECT t.firm, t.post_key, b_type AS event_type, b_start AS start_time, b_end AS end_time, {_DISPUTE} AS dispute
        FROM ({_PANEL}) t {_QUORATE} AND votes < 2""",
    "v9_flag_disputes": f"""WITH d AS (SELECT t.firm, t.post_key, {_MERGED}, {_DISPUTE} AS dispute FROM ({_PANEL}) t {_QUORATE} AND votes < 2),
        i AS (SELECT d.*, f.require_stated_offset, f.zone_h * 60 AS zone_min,
          try_strptime(substr(start_time, 1, 19), ['%Y-%m-%dT%H:%M:%S', '%Y-%m-%dT%H:%M', '%Y-%m-%d']) AS s0,
          try_strptime(substr(end_time, 1, 19), ['%Y-%m-%dT%H:%M:%S']) AS e0,
          CASE stated_utc_offset WHEN '+03:00' THEN 180 WHEN 'GMT+3' THEN 180 WHEN 'UTC+0330' THEN 210 WHEN 'UTC-05:00' THEN -300 END AS st,
          CASE WHEN start_time LIKE '%+01:00' THEN 60 END AS s_own, CASE WHEN end_time LIKE '%+01:00' THEN 60 END AS e_own FROM d JOIN firms f USING (firm)),
        j AS (SELECT *, s0 - to_minutes(CAST(coalesce(s_own, st, zone_min) AS INTEGER)) AS sa, e0 - to_minutes(CAST(coalesce(e_own, st, zone_min) AS INTEGER)) AS ea FROM i)
        SELECT firm, post_key, event_type, start_time, end_time, dispute AS reason, false AS retryable, false AS benign FROM j
        WHERE s0 IS NOT NULL AND NOT (require_stated_offset AND st IS NULL AND (s_own IS NULL OR e_own IS NULL)) AND ea > sa AND ea - sa <= INTERVAL 48 HOUR
          AND (sa > {NOW} + INTERVAL 10 DAY OR ea > {NOW})""",
    "j1_diff_events": "SELECT firm, post_key, event_key, change FROM diff",
    "j2_shared_window": """SELECT x.firm, x.post_key, x.event_ord, arg_min(b.post_key, b.arrival_seq * 100000000 + b.pos) AS holder_post,
        arg_min(b.entry_id, b.arrival_seq * 100000000 + b.pos) AS holder_entry FROM extraction x JOIN before b
        USING (firm, event_type, start_iso, end_iso, summary) WHERE b.post_key <> x.post_key GROUP BY ALL""",
    "j3_other_references": """WITH m AS (SELECT coalesce(p.survivor, t.entry_id) AS entry_id, t.firm, t.post_key, t.pos FROM w t
          LEFT JOIN pairs p USING (firm, event_type, start_iso, end_iso, summary, entry_id)),
        c AS (SELECT entry_id, count(DISTINCT post_key) AS n FROM m GROUP BY 1)
        SELECT m.entry_id, post_key, pos, n - 1 AS other_posts FROM m JOIN c USING (entry_id)""",
    "j4_adopt_existing": "SELECT event_ord, event_key, ext_entry AS calendar_entry FROM extraction LEFT JOIN ext ON ext_key = event_key",
    "j5_overlap_anti": "SELECT firm, post_key, event_ord, event_key FROM clear",
    "r1_reconcile": "SELECT firm, post_key, event_key, action, entry_id FROM plan",
    "r2_shrink_guard": """SELECT firm, post_key, n_old, n_new, n_missing, 'post ' || post_key || ' previously extracted ' || n_old
        || ' event(s) and now extracts ' || n_new || ' with none new — refusing to delete ' || n_missing || ' future event(s)' AS anomaly
        FROM guards WHERE NOT recover AND n_missing > 0 AND n_added = 0""",
    "r3_merge_duplicates": """WITH failed AS (SELECT DISTINCT entry_id FROM w WHERE value >= 100),
        p AS (SELECT * FROM pairs WHERE entry_id NOT IN (SELECT entry_id FROM failed))
        SELECT t.firm, t.pos, coalesce(p.survivor, t.entry_id) AS entry_id, 'tracked' AS kind FROM w t
          LEFT JOIN p USING (firm, event_type, start_iso, end_iso, summary, entry_id)
        UNION ALL SELECT firm, NULL, entry_id, 'delete' FROM p WHERE entry_id NOT LIKE 'ics:%'""",
    "r4_promote_deferred": """WITH h AS (SELECT *, substr(sha256(post_key || '|' || event_type || '|' || start_iso || '|' || end_iso), 1, 16) AS event_key
          FROM acc WHERE event_type = 'crypto_closure')
        SELECT firm, post_key, event_ord, CASE WHEN reason IS NULL THEN event_key END AS event_key,
          CASE WHEN reason IS NULL THEN 'publish' WHEN retryable THEN 'held' ELSE 'rejected' END AS outcome FROM h
        WHERE reason IS NOT NULL OR NOT EXISTS (SELECT 1 FROM before b WHERE b.post_key = h.post_key AND b.event_key = h.event_key)""",
    "r5_recover_unchanged": """SELECT firm, post_key, event_key, 'keep' AS action, entry_id FROM before WHERE post_key IN (SELECT post_key FROM extraction)
        UNION ALL SELECT firm, post_key, event_key, 'add', NULL FROM clear""",
    "r6_prune": f"""SELECT firm, post_key, min(arrival_seq) AS arrival_seq FROM w GROUP BY firm, post_key
        HAVING NOT (max(tm) < {LATER} - INTERVAL 45 DAY AND count(*) FILTER (end_at >= {LATER}) = 0
          AND count(*) FILTER (event_type = 'crypto_closure' AND affected IS NULL) = 0)""",
    "r7_apply_plan": """SELECT firm, post_key, seq AS arrival_seq, event_key, entry_id, event_type, summary, start_iso FROM plan JOIN post_url USING (firm, post_key)
        WHERE action IN ('keep', 'refuse', 'history', 'share', 'adopt', 'create')""",
    "w7_refcount_timeline": """WITH r AS (SELECT *, CASE WHEN value >= 20 THEN 1 ELSE -1 END AS delta FROM w),
        t AS (SELECT r.firm, r.pos, delta, coalesce(held, 0) + sum(delta) OVER (PARTITION BY r.firm, r.event_type, r.start_iso, r.end_iso, r.summary
          ORDER BY arrival_seq, delta, pos ROWS UNBOUNDED PRECEDING) AS balance FROM r LEFT JOIN opening USING (firm, event_type, start_iso, end_iso, summary))
        SELECT firm, pos, CAST(balance - delta AS BIGINT) AS before, CAST(balance AS BIGINT) AS balance FROM t""",
    "g1_run_report": """SELECT firm, posts_seen, posts_relevant, posts_skipped_unchanged, events_created, events_deleted, events_kept,
        rejections, events_deferred, duplicates_merged FROM rep""",
    "f10_report_summary": """SELECT firm, firm || ': posts: ' || posts_seen || ' seen, ' || posts_relevant || ' relevant, ' || posts_skipped_unchanged
        || ' unchanged | events: ' || events_created || ' created, ' || events_deleted || ' removed, ' || events_kept || ' kept, ' || rejections
        || ' rejected extractions' || CASE WHEN events_deferred > 0 THEN ', ' || events_deferred || ' deferred (beyond max_days_ahead)' ELSE '' END
        || CASE WHEN duplicates_merged > 0 THEN ', ' || duplicates_merged || ' duplicate calendar entries merged' ELSE '' END
        || CASE WHEN events_deleted > 0 THEN ' | ' || events_deleted || ' anomaly/anomalies' ELSE '' END AS summary FROM rep""",
    "g2_totals": """SELECT run_id, firm, grouping(run_id, firm) AS level, CAST(sum(p) AS BIGINT) AS posts_seen,
        CAST(sum(c) AS BIGINT) AS events_created, CAST(sum(x) AS BIGINT) AS events_deleted FROM (
          SELECT CAST(extract(day FROM tm) AS BIGINT) AS run_id, 'u' || user_id AS firm, count(*) AS p,
            count(*) FILTER (event_type = 'signup') AS c, count(*) FILTER (event_type = 'click') AS x FROM ev GROUP BY ALL)
        GROUP BY ROLLUP (run_id, firm)""",
    "g3_run_failed": """SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS run_id, bool_and(error IS NOT NULL) AS failed, count(*) AS firms
        FROM rlog GROUP BY 1""",
    "g4_detect_anomalies": """SELECT firm, 'gate' AS code, '' AS post_key, 'no keyword occurs in any of the ' || count(*) || ' posts read' AS anomaly
          FROM pstat GROUP BY firm HAVING count(*) FILTER (relevant) = 0
        UNION ALL SELECT firm, 'shrink', post_key, 'post ' || post_key || ' previously extracted ' || n_old
          || ' event(s) and now extracts ' || n_new || ' with none new — refusing to delete ' || n_missing || ' future event(s)'
          FROM guards WHERE NOT recover AND n_missing > 0 AND n_added = 0
        UNION ALL SELECT firm, 'rejected', post_key, 'post ' || post_key || ': ' || count(*) || ' extracted event(s) rejected and not published — '
          || string_agg(event_type || ' ' || start_time || coalesce(' (' || affected || ')', '') || ': ' || reason, '; ' ORDER BY event_ord)
          FROM acc WHERE reason IS NOT NULL AND NOT retryable AND NOT benign GROUP BY firm, post_key
        UNION ALL SELECT firm, 'error', '', 'run of ' || firm || ' ended with: ' || max(error) FROM rlog WHERE error IS NOT NULL GROUP BY firm""",
    "g5_calendar_counts": f"""SELECT firm, count(DISTINCT post_key) AS posts, count(*) FILTER (end_at > {NOW}) AS events_upcoming,
        count(*) FILTER (event_type = 'crypto_closure') AS events_deferred,
        (SELECT count(*) FROM acc a WHERE a.firm = w.firm AND reason IS NOT NULL AND NOT retryable AND NOT benign) AS rejected_lines FROM w GROUP BY firm""",
    "s12_calendar_rows": """SELECT event_key AS reconcile_key, summary, url || ' ' || evidence AS description, start_iso || ' Etc/GMT-3' AS start,
        end_iso || ' Etc/GMT-3' AS "end", false AS default_reminders, 'popup:30,popup:10' AS reminders FROM w""",
    "s13_payload_lines": """SELECT firm, CASE WHEN action = 'create' THEN 'created' ELSE 'removed' END AS kind, post_key,
          CASE WHEN action = 'create' THEN '➕ ' ELSE '➖ ' END || summary || ' — '
            || strftime(strptime(substr(start_iso, 1, 19), '%Y-%m-%dT%H:%M:%S'), '%a %d %b %H:%M') AS line FROM plan WHERE action IN ('create', 'delete')""",
    "f9_describe": """SELECT pos, summary || ' — ' || strftime(start_at + INTERVAL 3 HOUR, '%a %d %b %H:%M') || '–' || strftime(end_at + INTERVAL 3 HOUR, '%H:%M') AS event,
        CASE WHEN k < 50 THEN summary ELSE event_key END || ' — ' || CASE WHEN k >= 10 THEN strftime(start_at + INTERVAL 3 HOUR, '%a %d %b %H:%M')
          WHEN k >= 5 THEN strftime(end_at + INTERVAL 3 HOUR, '%a %d %b %H:%M') ELSE 'later' END AS tracked FROM w""",
    "g6_firm_health": f"""SELECT firm, {iso('last_success')} AS last_success, last_error, anomalies, runs_ok, runs_failed,
        CAST(floor(round(age_us / 1000000, 1)) AS BIGINT) AS age_seconds, stale, status FROM hfin""",
    "g7_overall_health": f"""WITH l AS (SELECT max(ts) AS lr, max(ts) FILTER (error IS NULL) AS ls, arg_max_null(error, run_id) AS le,
          arg_max(anomalies, run_id) FILTER (error IS NULL) AS an, count(*) FILTER (error IS NULL) AS ok, count(*) FILTER (error IS NOT NULL) AS bad FROM rlog)
        SELECT CASE WHEN le IS NOT NULL THEN 'error' WHEN epoch_us({HEALTH_NOW}) - epoch_us(ls) > 72000000000 THEN 'stale' WHEN an <> '' THEN 'anomaly'
          WHEN (SELECT count(*) FROM hfin WHERE status <> 'ok') > 0 THEN 'degraded' ELSE 'ok' END AS status,
          {iso('lr')} AS last_run, {iso('ls')} AS last_success, {iso('lr + INTERVAL 10 HOUR')} AS next_run, le AS last_error, an AS anomalies,
          ok AS runs_ok, bad AS runs_failed, (SELECT count(*) FROM hfin WHERE status <> 'ok') AS unhealthy FROM l""",
    "f11_humanize": f"""WITH s AS (SELECT event_id, greatest(floor(((epoch_us({NOW}) - epoch_us(tm)) / 1000000) * CASE WHEN k < 50 THEN 1.0 ELSE 0.001 END), 0) AS s FROM ev)
        SELECT event_id, CASE WHEN s < 90 THEN CAST(CAST(s AS BIGINT) AS VARCHAR) || ' s' WHEN s < 5400 THEN CAST(floor(s / 60) AS BIGINT) || ' min'
          WHEN s < 172800 THEN CAST(floor(s / 3600) AS BIGINT) || ' h' ELSE CAST(floor(s / 86400) AS BIGINT) || ' d' END AS age FROM s""",
    "w5_notify_once": """SELECT firm, run_id, error FROM (SELECT *, lag(error) OVER (PARTITION BY firm ORDER BY ts, run_id) AS p FROM rlog)
        WHERE error IS NOT NULL AND error IS DISTINCT FROM p""",
    "w6_heartbeat_due": f"""WITH RECURSIVE hb AS (SELECT 'u' || user_id AS firm, min(ts) AS ts FROM events GROUP BY 1
          UNION ALL SELECT h.firm, (SELECT min(e.ts) FROM events e WHERE 'u' || e.user_id = h.firm AND e.ts >= h.ts + INTERVAL 1 HOUR)
          FROM hb h WHERE h.ts IS NOT NULL)
        SELECT firm, {iso('ts')} AS sent_utc FROM hb WHERE ts IS NOT NULL""",
    "g8_usage_stats": """SELECT strftime(tm, '%Y-%m-%d') AS day, count(*) FILTER (event_type = 'view') AS views,
          count(DISTINCT user_id) FILTER (event_type = 'view') AS visitors,
          count(*) FILTER (event_type <> 'view' AND k <> 0) AS feed_hits,
          count(DISTINCT 'addr-' || user_id || props) FILTER (event_type <> 'view' AND k <> 0) AS feed_clients FROM ev GROUP BY 1""",
    "g8_usage_totals": """SELECT count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type <> 'view' AND k <> 0) AS feed_hits FROM ev""",
    "s7_classify_fetch": f"""SELECT outcome, attempt::BIGINT AS attempt, count(*) AS n, max({iso('next_at')}) AS latest_next FROM fnext GROUP BY ALL""",
    "s7_fetch_outcomes": f"""SELECT url, attempt::BIGINT AS attempts, outcome, {iso('next_at')} AS next_attempt FROM (SELECT *, row_number() OVER (
        PARTITION BY url ORDER BY attempt DESC, ts DESC) AS n FROM fnext) WHERE n = 1""",
    "s8_robots_allowed": """WITH u AS (SELECT url, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS h, regexp_extract(url, '^[a-z]+://[^/?#]*(.*)$', 1) AS p FROM pages)
        SELECT url, CASE WHEN h LIKE '%.net%' THEN true WHEN h LIKE '%blog.%' THEN NOT starts_with(p, '/en/')
          WHEN h LIKE '%www.%' THEN starts_with(p, '/fr') WHEN h LIKE '%//m.%' THEN NOT starts_with(p, '/es/5') ELSE true END AS allowed,
          CASE WHEN h LIKE '%.net%' THEN NULL WHEN h LIKE '%blog.%' THEN 30.0::DOUBLE WHEN h LIKE '%www.%' THEN NULL WHEN h LIKE '%//m.%' THEN 4.0::DOUBLE END AS crawl_delay FROM u""",
    "s9_plan_crawl": f"""WITH f AS (SELECT 'https://h' || (user_id // 50) AS host, event_id AS req_id, date_trunc('hour', tm) AS r,
          CASE WHEN user_id < 50 THEN 2 ELSE 30 END AS d FROM ev),
        n AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY r, req_id) AS i FROM f),
        m AS (SELECT *, max(epoch_us(r) - i * d * 1000000) OVER (PARTITION BY host ORDER BY i ROWS UNBOUNDED PRECEDING) + i * d * 1000000 AS us FROM n)
        SELECT host, req_id, {iso('make_timestamp(CAST(us AS BIGINT))')} AS slot_utc FROM m""",
    "s10_state_round_trip": """SELECT firm, post_key, sha256(post_key) AS content_hash, true AS deferred_known, count(*) AS tracked, max(event_key) AS last_key,
        nullif(count(*) FILTER (event_type = 'crypto_closure'), 0) AS held FROM w GROUP BY firm, post_key""",
    "g9_score": """SELECT case_id, run::BIGINT AS run, error, matched, missing, extra, offset_mismatches, affected_missing, evidence_verified, evidence_total FROM score""",
    "g10_norm_offset": """SELECT event_id, CASE WHEN k < 20 THEN '+' || lpad(CAST(k AS VARCHAR), 2, '0') || ':00' WHEN k < 40 THEN '-' || lpad(CAST(k AS VARCHAR), 2, '0') || ':05'
        WHEN k < 60 THEN '+' || CAST(CAST('3' || k AS BIGINT) AS VARCHAR) || ':00' WHEN k < 80 THEN 'local ' || k END AS "offset" FROM ev""",
    "g11_case_result": "SELECT case_id, runs, passed, stable, missing, extra, offset_mismatches, errors, evidence_verified, evidence_total FROM cases",
    "g11_report": """SELECT count(*) AS cases, bool_and(passed) AS passed, count(*) FILTER (passed) AS passed_cases, count(*) FILTER (stable) AS stable_cases FROM cases""",
    "g12_juror_scores": """SELECT case_id, voter, bool_and(alone) AS passed, CAST(sum(matched) AS BIGINT) AS matched, max(missing) AS missing, max(extra) AS extra,
        max(offset_mismatches) AS offset_mismatches, count(*) FILTER (error IS NOT NULL) AS errors FROM passed GROUP BY case_id, voter""",
    "g13_extraction_cost": """SELECT firm, count(*) FILTER (status <> 'unchanged') AS posts, count(*) FILTER (status <> 'unchanged') * 3 AS calls FROM doc_status GROUP BY firm""",
    "w9_key_sets": """SELECT case_id, run::BIGINT AS run, event_type, start_time, end_time, CASE WHEN in_e AND in_g THEN 'matched' WHEN in_e THEN 'missing' ELSE 'extra' END AS side FROM sides""",
    "f1_ics_escape": f"""SELECT doc_id, {_esc("(text || '; a,b \\ c' || chr(13) || chr(10) || url)")} AS escaped FROM docs""",
    "f2_ics_fold": f"""SELECT doc_id, sha256('DESCRIPTION:' || {_esc('text')}) AS unfolded_hash, true AS short, true AS filled,
        CASE WHEN n = o THEN CASE WHEN n <= 75 THEN 1 ELSE 1 + (n - 75 + 73) // 74 END END::BIGINT AS n_parts,
        CASE WHEN n = o THEN CASE WHEN n <= 75 THEN n ELSE 2 + (n - 76) % 74 END END::BIGINT AS last_octets
        FROM (SELECT *, length('DESCRIPTION:' || {_esc('text')}) AS n, octet_length(encode('DESCRIPTION:' || {_esc('text')})) AS o FROM documents)""",
    "f3_ics_stamp": """SELECT pos, CASE WHEN k >= 20 THEN 'DTSTART;TZID=Etc/GMT-3:' || strftime(start_at + INTERVAL 3 HOUR, '%Y%m%dT%H%M%S')
        ELSE 'DTSTART:' || strftime(start_at, '%Y%m%dT%H%M%SZ') END AS start,
        'DTEND;TZID=America/Chicago:' || strftime(end_at - INTERVAL 6 HOUR, '%Y%m%dT%H%M%S') AS "end" FROM w""",
    "f4_offset_transitions": """WITH s AS (SELECT firm, timezone, min(start_at) - INTERVAL 366 DAY AS lo, max(end_at) + INTERVAL 366 DAY AS hi FROM w JOIN firms USING (firm) GROUP BY ALL),
        t AS (SELECT * FROM (VALUES ('America/Chicago', TIMESTAMP '2023-03-12 08:00:00', -21600, -18000), ('America/Chicago', TIMESTAMP '2023-11-05 07:00:00', -18000, -21600),
          ('America/Chicago', TIMESTAMP '2024-03-10 08:00:00', -21600, -18000), ('America/Chicago', TIMESTAMP '2024-11-03 07:00:00', -18000, -21600),
          ('Europe/London', TIMESTAMP '2023-03-26 01:00:00', 0, 3600), ('Europe/London', TIMESTAMP '2023-10-29 01:00:00', 3600, 0),
          ('Europe/London', TIMESTAMP '2024-03-31 01:00:00', 0, 3600), ('Europe/London', TIMESTAMP '2024-10-27 01:00:00', 3600, 0)) v(tz, tm, b, a))
        SELECT firm AS id, strftime(tm, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS onset_utc, b::BIGINT AS before_s, a::BIGINT AS after_s FROM s JOIN t ON tz = timezone WHERE tm > lo AND tm <= hi""",
    "f6_calendar_name": """WITH n AS (SELECT feed_id, count(DISTINCT firm) AS c, min(firm) AS one_firm FROM feed GROUP BY 1),
        x AS (SELECT s.feed_id, s.types, CASE WHEN s.one IS NOT NULL THEN s.one WHEN n.c = 1 THEN n.one_firm END AS who FROM sel s LEFT JOIN n USING (feed_id))
        SELECT feed_id, CASE WHEN who IS NULL THEN 'All Trading Updates' ELSE coalesce(c.title, upper(who)) || ' Trading Updates' END
          || CASE WHEN types IS NULL THEN '' ELSE ' (' || array_to_string(list_sort(types), ', ') || ')' END AS name FROM x LEFT JOIN catalog c ON c.firm = who""",
    "f7_event_block": f"""WITH b AS (SELECT pos, list_filter(['BEGIN:VEVENT', 'UID:' || event_key || '@noticewindows', 'DTSTAMP:20240115T120000Z',
          CASE WHEN k >= 50 THEN 'DTSTART;TZID=Etc/GMT-3:' || strftime(start_at + INTERVAL 3 HOUR, '%Y%m%dT%H%M%S') ELSE 'DTSTART:' || strftime(start_at, '%Y%m%dT%H%M%SZ') END,
          CASE WHEN k >= 50 THEN 'DTEND;TZID=Etc/GMT-3:' || strftime(end_at + INTERVAL 3 HOUR, '%Y%m%dT%H%M%S') ELSE 'DTEND:' || strftime(end_at, '%Y%m%dT%H%M%SZ') END,
          'TRANSP:TRANSPARENT', 'SUMMARY:' || {_esc('summary')},
          CASE WHEN evidence <> '' OR url <> '' THEN 'DESCRIPTION:' || CASE WHEN evidence <> '' THEN '“' || {_esc('evidence')} || '”\\n' ELSE '' END
            || CASE WHEN url <> '' THEN 'Source: ' || {_esc('url')} || '\\n' ELSE '' END || '{fv.ATTRIBUTION}' END,
          'BEGIN:VALARM', 'ACTION:DISPLAY', 'DESCRIPTION:' || {_esc('summary')}, 'TRIGGER:-PT30M', 'END:VALARM', 'END:VEVENT'], lambda x: x IS NOT NULL) AS lines FROM w)
        SELECT pos, (i - 1)::BIGINT AS line_no, line FROM (SELECT pos, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM b)""",
    "t1_changed_posts_stream": """SELECT firm, post_key, snapshot_id, content_hash FROM (SELECT source AS firm, lang AS post_key, doc_id AS snapshot_id,
        sha256(text) AS content_hash, lag(text) OVER (PARTITION BY source, lang ORDER BY doc_id) AS p, text FROM documents) WHERE text IS DISTINCT FROM p""",
    "s11_export_feed_files": """WITH f AS (SELECT * FROM feed)
        SELECT feed_id, 18 + CAST(sum(13 + CASE WHEN evidence <> '' OR link <> '' THEN 1 ELSE 0 END) AS BIGINT) AS lines, count(*) AS events,
          1::BIGINT AS zone_lines, true AS folded FROM f GROUP BY feed_id""",
    "f8_feed_problems": f"""WITH f AS (SELECT *, right(feed_id, 1) AS c FROM feed),
        g AS (SELECT feed_id, c, count(*) AS n, count(DISTINCT event_key) AS keys, max(octet_length(encode('SUMMARY:' || {_esc('summary')}))) AS wide FROM f GROUP BY ALL),
        nums AS (SELECT feed_id, max('event ' || i || ' needs exactly one DTSTAMP') AS detail FROM (SELECT feed_id, unnest(range(1, n + 1)) AS i FROM g WHERE c = '2') GROUP BY 1)
        SELECT feed_id, 'event' AS code, 1::BIGINT AS n, 'duplicate UIDs' AS detail FROM g WHERE ((c = '1' AND n > 1) OR keys < n) AND c NOT IN ('2', '3', '7')
        UNION ALL SELECT feed_id, 'event', g.n + CASE WHEN keys < g.n THEN 1 ELSE 0 END, nums.detail FROM g JOIN nums USING (feed_id)
        UNION ALL SELECT feed_id, 'structure', 1, 'END:VTIME does not close what is open' FROM g WHERE c = '3'
        UNION ALL SELECT feed_id, 'folding', 1, 'a line of ' || (wide + 80) || ' octets (limit 75)' FROM g WHERE c = '4'
        UNION ALL SELECT feed_id, 'timezone', 1, 'TZID not defined: America/Chicago' FROM g WHERE c = '5'
        UNION ALL SELECT feed_id, 'structure', 1, 'calendar has no VERSION' FROM g WHERE c = '6'
        UNION ALL SELECT feed_id, 'structure', 1, 'not wrapped in BEGIN:VCALENDAR … END:VCALENDAR' FROM g WHERE c = '7'
        UNION ALL SELECT feed_id, 'line-endings', 1, 'does not end with CRLF' FROM g WHERE c = '8'""",
    "f5_vtimezone_lines": """SELECT * FROM (SELECT firm AS id, -(1::BIGINT << 60) AS block_ord, 'BEGIN:VTIMEZONE|TZID:' || timezone AS lines FROM firms
          UNION ALL SELECT firm, (1::BIGINT << 60), 'END:VTIMEZONE' FROM firms
          UNION ALL SELECT firm, 0, 'BEGIN:STANDARD|DTSTART:19700101T000000|TZOFFSETFROM:+0300|TZOFFSETTO:+0300|TZNAME:+03|END:STANDARD' FROM firms WHERE timezone = 'Etc/GMT-3'
          UNION ALL SELECT firm, 1678608000, 'BEGIN:DAYLIGHT|DTSTART:20230312T020000|TZOFFSETFROM:-0600|TZOFFSETTO:-0500|TZNAME:CDT|END:DAYLIGHT' FROM firms WHERE timezone = 'America/Chicago'
          UNION ALL SELECT firm, 1699167600, 'BEGIN:STANDARD|DTSTART:20231105T020000|TZOFFSETFROM:-0500|TZOFFSETTO:-0600|TZNAME:CST|END:STANDARD' FROM firms WHERE timezone = 'America/Chicago'
          UNION ALL SELECT firm, 1679792400, 'BEGIN:DAYLIGHT|DTSTART:20230326T010000|TZOFFSETFROM:+0000|TZOFFSETTO:+0100|TZNAME:BST|END:DAYLIGHT' FROM firms WHERE timezone = 'Europe/London'
          UNION ALL SELECT firm, 1698541200, 'BEGIN:STANDARD|DTSTART:20231029T020000|TZOFFSETFROM:+0100|TZOFFSETTO:+0000|TZNAME:GMT|END:STANDARD' FROM firms WHERE timezone = 'Europe/London')""",
}

# non-ASCII characters stand in the first 60 octets of these lines, so later parts count characters
_HEAD = "75 - (octet_length(encode(line)) - length(line))"
SQL_BODY["s11_export_feed"] = f"""WITH nm AS ({SQL_BODY["f6_calendar_name"]}), has AS (SELECT DISTINCT feed_id FROM feed),
    h AS (SELECT feed_id, 0 AS part, 0 AS arrival_seq, 0 AS pos, list_filter(['BEGIN:VCALENDAR', 'VERSION:2.0', 'PRODID:{fv.FEED_PRODID}', 'CALSCALE:GREGORIAN',
        'X-WR-CALNAME:' || {_esc('name')}, CASE WHEN feed_id IN (SELECT feed_id FROM has) THEN 'X-WR-TIMEZONE:Etc/GMT-3' END], lambda x: x IS NOT NULL) AS lines FROM nm
      UNION ALL SELECT feed_id, 1, -(1::BIGINT << 60), 0, ['BEGIN:VTIMEZONE', 'TZID:Etc/GMT-3'] FROM has
      UNION ALL SELECT feed_id, 1, 0, 0, ['BEGIN:STANDARD', 'DTSTART:19700101T000000', 'TZOFFSETFROM:+0300', 'TZOFFSETTO:+0300', 'TZNAME:+03', 'END:STANDARD'] FROM has
      UNION ALL SELECT feed_id, 1, 1::BIGINT << 60, 0, ['END:VTIMEZONE'] FROM has
      UNION ALL SELECT feed_id, 3, 0, 0, ['END:VCALENDAR'] FROM sel
      UNION ALL SELECT feed_id, 2, arrival_seq, pos, list_filter(['BEGIN:VEVENT', 'UID:' || event_key || '@noticewindows', 'DTSTAMP:20240115T120000Z',
        'DTSTART;TZID=Etc/GMT-3:' || strftime(start_at + INTERVAL 3 HOUR, '%Y%m%dT%H%M%S'), 'DTEND;TZID=Etc/GMT-3:' || strftime(end_at + INTERVAL 3 HOUR, '%Y%m%dT%H%M%S'),
        'TRANSP:TRANSPARENT', 'SUMMARY:' || {_esc('summary')},
        CASE WHEN evidence <> '' OR link <> '' THEN 'DESCRIPTION:' || CASE WHEN evidence <> '' THEN '“' || {_esc('evidence')} || '”\\n' ELSE '' END
          || CASE WHEN link <> '' THEN 'Source: ' || {_esc('link')} || '\\n' ELSE '' END || '{fv.ATTRIBUTION}' END, 'END:VEVENT'], lambda x: x IS NOT NULL) FROM feed),
    l AS (SELECT feed_id, part, arrival_seq, pos, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS line_in_block FROM h),
    p AS (SELECT *, CASE WHEN octet_length(encode(line)) <= 75 THEN [line] ELSE list_concat([substr(line, 1, {_HEAD})],
        list_transform(range(0, (length(line) - ({_HEAD}) + 73) // 74), lambda i: ' ' || substr(line, {_HEAD} + 1 + 74 * i, 74))) END AS parts FROM l)
    SELECT feed_id, part::BIGINT AS part, arrival_seq::BIGINT AS arrival_seq, pos::BIGINT AS pos, line_in_block::BIGINT AS line_in_block,
      (generate_subscripts(parts, 1) - 1)::BIGINT AS fold_no, unnest(parts) AS line FROM p"""
SQL_BODY["t2_reconcile_stream"] = f"""WITH after AS ({SQL_BODY["r7_apply_plan"]}),
    key_ends AS (SELECT DISTINCT event_key, end_iso, end_at FROM w),
    standing AS (SELECT firm, event_type, start_iso, end_iso, summary, arg_min(entry_id, (starts_with(entry_id, 'ics:'), arrival_seq)) AS survivor
      FROM after JOIN key_ends USING (event_key) WHERE end_at > {NOW} GROUP BY firm, event_type, start_iso, end_iso, summary)
    SELECT a.firm, a.post_key, a.arrival_seq, a.event_key, CASE WHEN e.end_at > {NOW} THEN l.survivor ELSE a.entry_id END AS entry_id,
      a.event_type, a.summary, a.start_iso
    FROM after a JOIN key_ends e USING (event_key) LEFT JOIN standing l ON l.firm = a.firm AND l.event_type = a.event_type
      AND l.start_iso = a.start_iso AND l.end_iso = e.end_iso AND l.summary = a.summary"""
SQL_BODY["s13_payload_lines"] += f""" UNION ALL SELECT firm, 'anomaly', post_key, '• ' || anomaly FROM ({SQL_BODY["g4_detect_anomalies"]})"""
SQL_BODY["t3_deferred_release_stream"] = f"""WITH h AS (SELECT *, start_at - INTERVAL 10 DAY AS release FROM judged0
      WHERE event_type = 'crypto_closure' AND s0 IS NOT NULL AND e0 > s0 AND e0 - s0 <= INTERVAL 48 HOUR
        AND NOT (require_stated_offset AND stated_min IS NULL AND own_min IS NULL)
        AND start_at > TIMESTAMP '2024-01-11 00:00:00'),
    c AS (SELECT *, CASE WHEN release <= TIMESTAMP '2024-01-08 06:00:00' THEN TIMESTAMP '2024-01-08 06:00:00' ELSE {NOW} END AS clock
      FROM h WHERE release <= {NOW})
    SELECT firm, post_key, event_ord, CASE WHEN end_at <= clock THEN 'rejected' ELSE 'publish' END AS outcome, {iso('clock')} AS clock FROM c"""
SQL_BODY["g7_unhealthy_firms"] = f"SELECT firm, status, {iso('last_success')} AS since FROM hfin WHERE status <> 'ok'"
SQL_BODY["t4_state_expiry"] = SQL_BODY["r6_prune"]
SQL_BODY["t5_stale_sources"] = f"""SELECT firm, {iso('last_success')} AS last_success FROM hstat WHERE stale
    UNION ALL SELECT 'n' || n_nationkey, NULL FROM nation"""
SQL_BODY["t6_usage_stats_stream"] = SQL_BODY["g8_usage_stats"]
SQL_BODY["t7_notify_once_stream"] = SQL_BODY["w5_notify_once"]

SQL: dict[str, str] = {name: _full(body) for name, body in SQL_BODY.items()}
