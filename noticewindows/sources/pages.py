"""Pages to posts: content extraction, listing links and the choice of recent posts."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticewindows import fixed_values as fv
from noticewindows.functions import postkeys, textcols
from noticewindows.session import cut_lineage
from noticewindows.sources import htmltree

_POST_OUT = "page_id long, firm string, url string, title string, text string, message string"
_LISTING_OUT = _POST_OUT + ", link_ord int, href string"


def _joined(pages: DataFrame, profiles: DataFrame, columns: list[str]) -> DataFrame:
    """Pages with the settings of their firm, hot firms spread out before the Python step."""
    settings = profiles.select(F.col("name").alias("firm"), *columns)
    return pages.select("page_id", "firm", "url", "html").join(settings, "firm")


def _failure(url: str, selectors: list[str], short: list[str], label: str) -> str:
    detail = "; ".join(short) if short else "none of them matched"
    return f"no announcement content at {url}: tried {selectors} — {detail} ({label})"


def _read_details(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for r in batch.itertuples(index=False):
            root = htmltree.parse(r.html or "")
            tried = list(r.post_content_selectors)
            text, short = htmltree.content(root, tried, list(r.strip_selectors), r.min_content_chars)
            heading = htmltree.first(root, r.post_title_selector)
            title = heading.text() if heading is not None else r.url
            message = None if text is not None else _failure(r.url, tried, short, r.display_name)
            rows.append((r.page_id, r.firm, r.url, title if text is not None else None, text, message))
        yield pd.DataFrame(rows, columns=["page_id", "firm", "url", "title", "text", "message"])


def _read_listings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["page_id", "firm", "url", "title", "text", "message", "link_ord", "href"]
    for batch in batches:
        rows = []
        for r in batch.itertuples(index=False):
            root = htmltree.parse(r.html or "")
            embedded = list(r.listing_content_selectors)
            needle = r.listing_title_contains.lower()
            headings = root.select(r.listing_title_selector)
            heading = next(
                (h for h in headings if not needle or needle in "".join(h.strings(set())).lower()), None
            )
            if embedded and heading is not None:
                text, _ = htmltree.content(root, embedded, list(r.strip_selectors), r.min_content_chars)
                if text is not None:
                    rows.append((r.page_id, r.firm, r.url, heading.text(), text, None, None, None))
            hrefs: dict[str, None] = {}
            for selector in r.link_selectors:
                for card in root.select(selector):
                    anchor = card if card.tag == "a" else htmltree.first(card, "a[href]")
                    if anchor is not None and "href" in anchor.attrs:
                        href = urljoin(r.url, anchor.attrs["href"])
                        if r.link_url_contains in href:
                            hrefs.setdefault(href)
            rows += [
                (r.page_id, r.firm, r.url, None, None, None, n, href) for n, href in enumerate(hrefs)
            ]
        frame = pd.DataFrame(rows, columns=names)
        frame["link_ord"] = frame["link_ord"].astype("Int32")
        yield frame


def _as_posts(rows: DataFrame, profiles: DataFrame) -> DataFrame:
    prefixes = profiles.select(F.col("name").alias("firm"), "post_key_prefix")
    return (
        rows.join(prefixes, "firm")
        .withColumn("post_key", postkeys.post_key(F.col("title"), F.col("url"), F.col("post_key_prefix")))
        .withColumn("content_hash", textcols.content_hash(F.col("text")))
        .select("page_id", "firm", "post_key", "title", "text", "url", "content_hash")
    )


def read_detail_pages(pages: DataFrame, profiles: DataFrame) -> DataFrame:
    """One tagged row per detail page: title and text, or a ``message`` saying why there are none."""
    columns = [
        "display_name",
        "post_content_selectors",
        "post_title_selector",
        "strip_selectors",
        "min_content_chars",
    ]
    return _joined(pages, profiles, columns).mapInPandas(_read_details, _POST_OUT)


def extract_posts(pages: DataFrame, profiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(posts, scrape_errors)`` of detail pages."""
    rows = cut_lineage(read_detail_pages(pages, profiles), "detail-pages")  # every page is parsed once
    posts = _as_posts(rows.filter("message is null"), profiles)
    return posts, rows.filter("message is not null").select("page_id", "firm", "url", "message")


def extract_listing(pages: DataFrame, profiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(embedded_posts, links)`` of index pages; links keep their first place on the page."""
    columns = [
        "listing_content_selectors",
        "listing_title_selector",
        "listing_title_contains",
        "link_selectors",
        "link_url_contains",
        "strip_selectors",
        "min_content_chars",
    ]
    rows = _joined(pages, profiles, columns).mapInPandas(_read_listings, _LISTING_OUT)
    rows = cut_lineage(rows, "listing-pages")  # every page is parsed once
    embedded = _as_posts(rows.filter("href is null"), profiles)
    links = rows.filter("href is not null").select("page_id", "firm", "url", "link_ord", "href")
    return embedded, links


def select_recent(
    embedded: DataFrame,
    links: DataFrame,
    fetched: DataFrame,
    firms: DataFrame,
    today: Column,
) -> tuple[DataFrame, DataFrame]:
    """``(posts, errors)``: per firm the embedded post and then linked posts, up to ``max_posts``.

    ``embedded``: firm, post_key, url.  ``links``: firm, pos, url.  ``fetched``: url, post_key,
    outcome (``ok``, ``gone``, ``unreadable`` or ``failed``).  ``firms``: firm, max_posts,
    max_age_days.  A link dated too long ago is skipped before it is fetched; a page that is gone or
    unreadable takes no place; any other failed fetch fails its firm.
    """
    cutoff = F.date_sub(today, F.col("max_age_days"))
    dated = postkeys.date_in(postkeys.last_segment(F.col("url")))
    own = embedded.select("firm", F.col("post_key").alias("own_key")).distinct()
    first = embedded.select("firm", "post_key", "url", F.lit(-1).cast("long").alias("pos"))
    followed = (
        links.join(firms, "firm")
        .filter(dated.isNull() | (dated >= cutoff))
        .select("firm", "url", F.col("pos").cast("long"))
        .join(fetched.select("url", "post_key", "outcome"), "url")
        .join(own, "firm", "left")
    )
    usable = followed.filter((F.col("outcome") != "ok") | ~F.col("post_key").eqNullSafe(F.col("own_key")))
    usable = usable.filter(F.col("outcome").isin("ok", "failed"))
    order = Window.partitionBy("firm").orderBy("pos", "url")
    ranked = (
        first.withColumn("outcome", F.lit("ok"))
        .unionByName(usable.select("firm", "post_key", "url", "pos", "outcome"))
        .join(firms.select("firm", "max_posts"), "firm")
        .withColumn("rank", F.row_number().over(order))
    )
    # the constant bound lets Spark keep only the first rows per firm before it shuffles
    kept = ranked.filter(F.col("rank") <= _max_posts_bound(firms)).filter("rank <= max_posts")
    failed = kept.filter("outcome = 'failed'").groupBy("firm").agg(F.min_by("url", "pos").alias("url"))
    posts = kept.filter("outcome = 'ok'").join(failed.select("firm"), "firm", "left_anti")
    seen = posts.select("firm").distinct()
    errors = (
        firms.select("firm")
        .join(seen, "firm", "left_anti")
        .join(failed, "firm", "left")
        .select(
            "firm",
            F.when(F.col("url").isNotNull(), F.concat(F.lit("no page came from "), F.col("url")))
            .otherwise("no announcement posts found")
            .alias("message"),
        )
    )
    return posts.select("firm", "post_key", "url", F.col("rank").cast("long").alias("rank")), errors


def _max_posts_bound(firms: DataFrame) -> int:
    """The largest ``max_posts`` in use: one aggregate row over the configuration table."""
    row = firms.agg(F.max("max_posts").alias("m")).first()
    return int(row["m"] or fv.MAX_POSTS)
