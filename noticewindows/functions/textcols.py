"""Column functions for text: hashes, printable text, quoted words, calendar escaping."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticewindows import fixed_values as fv

_SEPARATORS = r"[\p{C}\p{Z}]+"  # whatever is not printable, and the blank
_NON_PRINTABLE = r"[\p{C}\p{Z}&&[^ ]]"
_BLANKS = r"[\s\p{Z}\x1c-\x1f\x85]+"
_ASCII = r"^[\x00-\x7f]*$"
_WORD = re.compile(r"\w+")


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def short_hash(*parts: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the parts joined by ``|``."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


def event_key(post_key: Column, event_type: Column, start_iso: Column, end_iso: Column) -> Column:
    """Identity of a window in a post.  Firm, confidence and evidence are not part of it."""
    return short_hash(post_key, event_type, start_iso, end_iso)


def client_hash(addr: Column, user_agent: Column) -> Column:
    return short_hash(F.coalesce(addr, F.lit("")), F.coalesce(user_agent, F.lit("")))


@F.pandas_udf(T.StringType())
def _unicode_words(text: pd.Series) -> pd.Series:
    drop = str.maketrans("", "", fv.INVISIBLE_CHARS)

    def fold(value: str | None) -> str | None:
        if value is None:
            return None
        plain = unicodedata.normalize("NFKC", value.translate(drop))
        return " ".join(word.casefold() for word in _WORD.findall(plain))

    return text.map(fold)


def words(text: Column) -> Column:
    """The case-folded words of ``text`` joined by one blank.

    Pure ASCII stays in the JVM; only other text goes to the Arrow worker for NFKC and case folding.
    """
    ascii_only = text.rlike(_ASCII)
    native = F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9_]+", " "))
    return F.when(ascii_only, native).otherwise(_unicode_words(F.when(~ascii_only, text)))


def word_count(joined: Column) -> Column:
    return F.when(joined == "", 0).otherwise(F.size(F.split(joined, " ")))


def evidence_verdict(quote: Column, quote_words: Column, text: Column, text_words: Column) -> Column:
    """``none``, ``short``, ``unfound`` or ``ok`` for a quote against its post."""
    return quote_verdict(quote, quote_words, quote_found(quote_words, text, text_words))


def quote_found(quote_words: Column, text: Column, text_words: Column) -> Column:
    """Whether the words of a quote stand in a text in one piece; a post without text accepts its quotes."""
    found = F.contains(
        F.concat(F.lit(" "), text_words, F.lit(" ")), F.concat(F.lit(" "), quote_words, F.lit(" "))
    )
    return text.isNull() | (text == "") | found


def quote_verdict(quote: Column, quote_words: Column, found: Column) -> Column:
    blank = quote.isNull() | (F.regexp_replace(quote, _BLANKS, "") == "")
    return (
        F.when(blank, "none")
        .when(word_count(quote_words) < fv.EVIDENCE_MIN_WORDS, "short")
        .when(found, "ok")
        .otherwise("unfound")
    )


def clean_evidence(quote: Column, limit: int = fv.EVIDENCE_CHARS) -> Column:
    """One printable line of at most ``limit`` characters."""
    line = F.trim(F.regexp_replace(F.coalesce(quote, F.lit("")), _SEPARATORS, " "))
    return F.concat(
        F.rtrim(F.substring(line, 1, limit)), F.when(F.length(line) > limit, "…").otherwise("")
    )


def build_summary(
    event_type: Column,
    affected: Column,
    low: Column,
    titles: dict[str, str] | None = None,
    marker: str = fv.LOW_CONFIDENCE_MARKER,
    affected_chars: int = fv.AFFECTED_CHARS,
) -> Column:
    """``title — affected (marker)``."""
    titles = titles or fv.SUMMARIES
    table = F.create_map(*[F.lit(x) for pair in titles.items() for x in pair])
    title = F.coalesce(F.try_element_at(table, event_type), F.lit(titles["other"]))
    what = F.trim(F.regexp_replace(F.coalesce(affected, F.lit("")), _NON_PRINTABLE, ""))
    # one pattern per step keeps the text itself from being repeated in the generated code
    long = rf"(?s)^(.{{{affected_chars}}}).+$"
    cut = F.regexp_replace(F.regexp_replace(what, long, "$1\u0000"), "[, ]*\u0000$", "…")
    text = F.concat(title, F.regexp_replace(cut, r"(?s)^(.+)$", " — $1"))
    if not marker:
        return text
    return F.concat(text, F.when(low, f" {marker}").otherwise(""))


def build_description(
    text: Column, url: Column, low: Column, evidence: Column, excerpt_chars: int = fv.EXCERPT_CHARS
) -> Column:
    """Excerpt, source link and attribution, with the quote and the low-confidence note in front."""
    excerpt = F.concat(
        F.substring(text, 1, excerpt_chars),
        F.when(F.length(text) > excerpt_chars, "…").otherwise(""),
    )
    note = F.when(low, F.lit(f"{fv.LOW_CONFIDENCE_NOTE}\n\n")).otherwise("")
    quote = F.when(
        evidence != "", F.concat(F.lit("Announcement: “"), evidence, F.lit("”\n\n"))
    ).otherwise("")
    return F.concat(
        note, quote, excerpt, F.lit("\n\nSource: "), url, F.lit(f"\n{fv.ATTRIBUTION}")
    )


def ics_escape(text: Column) -> Column:
    """Calendar text: carriage returns dropped, then ``\\ ; ,`` and line feeds escaped."""
    steps = (("\r", ""), ("\\", "\\\\"), (";", "\\;"), (",", "\\,"), ("\n", "\\n"))
    for old, new in steps:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


# a string of one character per octet, cut before octets that begin a character
_FOLDS = rf"(?s)(^.{{1,{fv.FOLD_OCTETS}}}|\G.{{1,{fv.FOLD_OCTETS - 1}}})(?![\x80-\xBF])"


def ics_fold(line: Column) -> Column:
    """The physical lines of one logical line: at most 75 octets, no character split.  Nothing leaves the JVM."""
    octets = F.decode(F.encode(line, "UTF-8"), "ISO-8859-1")
    pieces = F.transform(
        F.regexp_extract_all(octets, F.lit(_FOLDS), F.lit(1)),
        lambda piece, n: F.concat(F.when(n > 0, " ").otherwise(""), F.decode(F.encode(piece, "ISO-8859-1"), "UTF-8")),
    )
    return F.when(F.octet_length(line) > fv.FOLD_OCTETS, pieces).otherwise(F.array(line))
