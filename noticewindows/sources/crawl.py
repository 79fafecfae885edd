"""Crawl tables: fetch outcomes, robots rules and start times per host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticewindows import fixed_values as fv
from noticewindows.functions import running, timecols

_HOST = r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)"


def host_of(url: Column) -> Column:
    """Scheme and network location, the unit that rate limits and robots rules apply to."""
    return F.regexp_extract(url, _HOST, 1)


def classify_fetch(fetch_log: DataFrame, attempts: int = fv.FETCH_ATTEMPTS) -> DataFrame:
    """Each attempt with its ``outcome`` (ok, retry, gone, error) and ``next_attempt_at``.

    ``fetch_log``: url, attempt, ts, status, network_error.  A retry on the last attempt is an error.
    """
    status = F.col("status")
    kind = (
        F.when(F.col("network_error") | (status == 429) | (status >= 500), "retry")
        .when(status.isin(404, 410), "gone")
        .when(status >= 400, "error")
        .otherwise("ok")
    )
    kind = F.when((kind == "retry") & (F.col("attempt") >= attempts), "error").otherwise(kind)
    wait = F.pow(F.lit(2), F.col("attempt")).cast("long")
    return fetch_log.withColumn("outcome", kind).withColumn(
        "next_attempt_at", F.when(F.col("outcome") == "retry", timecols.shift(F.col("ts"), wait))
    )


def fetch_outcomes(fetch_log: DataFrame, attempts: int = fv.FETCH_ATTEMPTS) -> DataFrame:
    """The last attempt per URL and what it means."""
    last = F.struct("attempt", "ts")
    return (
        classify_fetch(fetch_log, attempts)
        .groupBy("url")
        .agg(
            F.max("attempt").alias("attempts"),
            F.max_by("outcome", last).alias("outcome"),
            F.max_by("next_attempt_at", last).alias("next_attempt_at"),
        )
    )


def robots_rules(robots_txt: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(rules, agents)`` of robots texts: one row per rule with its group, one per group agent.

    A host whose file could not be read has no rules.  Lines are numbered per file, so the group of
    a rule is a running count inside one text, never across hosts.  An empty line ends a group;
    agents without a rule of their own are no group.
    """
    readable = robots_txt.filter("http_status < 400 and body is not null")
    cleaned = F.trim(F.regexp_replace("raw", "#.*$", ""))
    field = F.lower(F.trim(F.split_part(cleaned, F.lit(":"), F.lit(1))))
    lines = (
        readable.select("host", F.posexplode(F.split("body", r"\r\n|\r|\n")).alias("line_no", "raw"))
        .select(
            "host",
            "line_no",
            F.when(F.col("raw") == "", "end").when(cleaned.contains(":"), field).alias("field"),
            F.trim(F.regexp_extract(cleaned, r"^[^:]*:(.*)$", 1)).alias("value"),
        )
        .filter(F.col("field").isin("end", "user-agent", "allow", "disallow", "crawl-delay"))
    )
    order = Window.partitionBy("host").orderBy("line_no")
    starts = (F.col("field") == "user-agent") & (F.lag("field", 1, "").over(order) != "user-agent")
    marker = F.when(F.col("field").isin("end", "user-agent"), F.col("field"))
    grouped = (
        lines.withColumn("starts", starts.cast("int"))
        .withColumn("open", F.last(marker, ignorenulls=True).over(order) == "user-agent")
        .withColumn("group_no", F.sum("starts").over(order))
        .filter("open")
    )
    rules = grouped.filter("field <> 'user-agent'").select("host", "group_no", "line_no", "field", "value")
    agents = (
        grouped.filter("field = 'user-agent'")
        .select("host", "group_no", F.lower("value").alias("agent"))
        .join(rules.select("host", "group_no"), ["host", "group_no"], "left_semi")
    )
    return rules, agents


def _group_for(agents: DataFrame, name: str) -> DataFrame:
    """The group of each host that speaks to ``name``: the first by name, else the ``*`` group."""
    token = name.split("/")[0].lower()
    named = (F.col("agent") != "*") & F.lit(token).contains(F.col("agent"))
    return agents.groupBy("host").agg(
        F.coalesce(
            F.min(F.when(named, F.col("group_no"))), F.min(F.when(F.col("agent") == "*", F.col("group_no")))
        ).alias("group_no")
    )


def _plain(path: Column) -> Column:
    """Percent escapes resolved, so that rule and URL are compared on the same text."""
    return F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)


def _rules_for(rules: DataFrame, agents: DataFrame, name: str, column: str) -> DataFrame:
    """Per host the rules that bind ``name``, in file order (bounded by one robots file)."""
    mine = rules.join(_group_for(agents, name), ["host", "group_no"]).filter(
        "field in ('allow', 'disallow')"
    )
    rule = F.struct(
        "line_no",
        ((F.col("field") == "allow") | (F.col("value") == "")).alias("allow"),
        _plain(F.col("value")).alias("prefix"),
    )
    return mine.groupBy("host").agg(F.array_sort(F.collect_list(rule)).alias(column))


def _decides(rules: Column, path: Column) -> Column:
    hits = F.filter(rules, lambda r: (r["prefix"] == "*") | F.startswith(path, r["prefix"]))
    return F.coalesce(F.get(hits, 0)["allow"], F.lit(True))


def robots_allowed(
    urls: DataFrame,
    robots_txt: DataFrame,
    user_agent: str = fv.USER_AGENT,
    token: str = fv.BOT_TOKEN,
) -> DataFrame:
    """``(url, host, allowed, crawl_delay)``; both the full agent and the bare token must be allowed.

    ``urls``: url.  ``robots_txt``: host, http_status, body.  The first matching rule decides.  Rules
    meet URLs as one array per host, so no row is multiplied by the length of a robots file.
    """
    rules, agents = robots_rules(robots_txt)
    per_host = (
        robots_txt.select("host")
        .distinct()
        .join(_rules_for(rules, agents, user_agent, "by_agent"), "host", "left")
        .join(_rules_for(rules, agents, token, "by_token"), "host", "left")
        .join(crawl_delays(rules, agents, (user_agent, token, "*")), "host", "left")
    )
    rest = F.regexp_extract(F.col("url"), r"^[^:]+://[^/?#]*(.*)$", 1)
    path = _plain(F.when(rest == "", "/").otherwise(rest))
    return (
        urls.select("url", host_of(F.col("url")).alias("host"), path.alias("path"))
        .join(per_host, "host", "left")
        .select(
            "url",
            "host",
            (
                _decides(F.col("by_agent"), F.col("path")) & _decides(F.col("by_token"), F.col("path"))
            ).alias("allowed"),
            "crawl_delay",
        )
    )


def crawl_delays(rules: DataFrame, agents: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Seconds between requests per host: the first of ``names`` with a stated delay, capped."""
    stated = rules.filter("field = 'crawl-delay'").withColumn("seconds", F.when(F.col("value").rlike(r"^\d+$"), F.col("value").cast("double")))
    first = stated.groupBy("host", "group_no").agg(F.max_by("seconds", "line_no").alias("seconds"))
    found = None
    for n, name in enumerate(names):
        part = first.join(_group_for(agents, name), ["host", "group_no"]).select(
            "host", F.lit(n).alias("n"), "seconds"
        )
        found = part if found is None else found.unionByName(part)
    return (
        found.filter("seconds is not null")
        .groupBy("host")
        .agg(F.min_by("seconds", "n").alias("seconds"))
        .select("host", F.least("seconds", F.lit(fv.MAX_CRAWL_DELAY_SECONDS)).alias("crawl_delay"))
    )


def plan_crawl(
    frontier: DataFrame,
    delays: DataFrame,
    min_interval: float = fv.MIN_INTERVAL_SECONDS,
) -> DataFrame:
    """Start times per host that keep its interval: ``slot_at`` for every request.

    ``frontier``: host, req_id, requested_at.  ``delays``: host, crawl_delay.  With ``i`` the place of
    a request in its host's queue and ``d`` the interval, ``slot_i = max_{j<=i}(req_j - j d) + i d``,
    so both the place and the maximum are ordered scans over even ranges of the queue.
    """
    step = F.greatest(F.lit(min_interval), F.coalesce("crawl_delay", F.lit(0.0)))
    rows = (
        frontier.join(delays.select("host", "crawl_delay"), "host", "left")
        .withColumn("step_us", (step * 1_000_000).cast("long"))
        .withColumn("one", F.lit(1).cast("long"))
    )
    order = ["requested_at", "req_id"]
    rows = running.in_ranges(rows, ["host"], order, "bucket", "queue")
    rows = running.running_sum(rows, ["host"], "bucket", order, {"place": F.col("one")})
    free = F.unix_micros("requested_at") - F.col("place") * F.col("step_us")
    rows = running.running_max(rows, ["host"], "bucket", order, {"head": free})
    slot = F.timestamp_micros(F.col("head") + F.col("place") * F.col("step_us"))
    return rows.select("host", "req_id", "requested_at", slot.alias("slot_at"))
