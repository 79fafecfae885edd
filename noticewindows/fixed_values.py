"""Strings, limits and tables that results depend on.

Everything in this module is a value, not logic.  Callers that need other values pass their own.
"""

from __future__ import annotations

# --- Fixed values: event types -------------------------------------------------------------
EVENT_TYPES = (
    "maintenance",
    "crypto_closure",
    "holiday_closure",
    "early_close",
    "late_open",
    "symbol_event",
    "other",
)
LEGACY_EVENT_TYPES = ("holiday_hours",)

# --- Fixed values: titles per event type ---------------------------------------------------
SUMMARIES = {
    "maintenance": "⚠️ Platform Maintenance",
    "crypto_closure": "🚫 Crypto Closed",
    "holiday_closure": "🏖️ Closed All Day",
    "early_close": "⏳ Early Close",
    "late_open": "🕗 Late Open",
    "symbol_event": "📌 Forced Action",
    "other": "ℹ️ Trading Update",
    "holiday_hours": "🕒 Modified Trading Hours",
}

# --- Fixed values: gate and rule defaults --------------------------------------------------
DEFAULT_KEYWORDS = ("maintenance", "market is closed", "ctrader", "holiday", "crypto")
DEFAULT_ZONE = "Etc/GMT-3"
MAX_DURATION_HOURS = 48
MAX_DAYS_AHEAD = 120
LOW_CONFIDENCE_MARKER = "(unconfirmed)"
PRUNE_AFTER_DAYS = 45
MAX_POSTS = 4
MAX_AGE_DAYS = 14
MIN_CONTENT_CHARS = 200
POST_KEY_PREFIX = "trading-update"
TITLE_SELECTOR = "h1"
LINK_SELECTORS = ("article.post-card",)

# --- Fixed values: text limits -------------------------------------------------------------
EXCERPT_CHARS = 800
EVIDENCE_CHARS = 300
EVIDENCE_MIN_WORDS = 4
AFFECTED_CHARS = 70
FOLD_OCTETS = 75
INVISIBLE_CHARS = "\u00ad\u200c\u200d\u2060\ufeff"

# --- Fixed values: rejection reasons -------------------------------------------------------
REASON_UNPARSEABLE = "unparseable datetime: Invalid isoformat string: "
REASON_NO_OFFSET = (
    "no UTC offset stated in the announcement and this source has no "
    "timezone that can be assumed — refusing to guess the hour"
)
REASON_ORDER = "end is not after start"
REASON_TOO_FAR = "too far in the future"
REASON_ENDED = "already ended"
REASON_LOW = "low extraction confidence"
REASON_NO_EVIDENCE = "no evidence quoted from the announcement"
REASON_SHORT_EVIDENCE = "quoted evidence is under 4 words, too short to check"
REASON_UNFOUND_EVIDENCE = "quoted evidence does not appear in the announcement"

# --- Fixed values: month names (three-letter or full, nothing else) ------------------------
MONTHS = (
    ("jan", "january"),
    ("feb", "february"),
    ("mar", "march"),
    ("apr", "april"),
    ("may",),
    ("jun", "june"),
    ("jul", "july"),
    ("aug", "august"),
    ("sep", "september"),
    ("oct", "october"),
    ("nov", "november"),
    ("dec", "december"),
)

# --- Fixed values: patterns ----------------------------------------------------------------
DATE_DAY_FIRST = r"(\d{1,2})[\s-]+([A-Za-z]{3,9})[\s-]+(\d{4})"
DATE_MONTH_FIRST = r"([A-Za-z]{3,9})[\s-]+(\d{1,2})[\s-]+(\d{4})"
STATED_OFFSET = r"^(?:UTC|GMT)?([+-])(\d{1,2}):?(\d{2})?$"

# --- Fixed values: crawl policy ------------------------------------------------------------
FETCH_ATTEMPTS = 3
MIN_INTERVAL_SECONDS = 2.0
MAX_CRAWL_DELAY_SECONDS = 30.0
BOT_TOKEN = "NoticeWindowsBot"
USER_AGENT = "Mozilla/5.0 (compatible; NoticeWindowsBot/1.0)"

# --- Fixed values: health and usage --------------------------------------------------------
STALE_INTERVALS = 2
USAGE_DAYS = 30
USAGE_DISTINCT_CAP = 10_000
PAST_ROWS = 6

# --- Fixed values: feed --------------------------------------------------------------------
PLACEHOLDER_PREFIX = "ics:"
FEED_UID_DOMAIN = "noticewindows"
FEED_PRODID = "-//noticewindows//EN"
ATTRIBUTION = "Created by noticewindows"
FEED_NAME_SUFFIX = "Trading Updates"
FEED_NAME_GENERIC = "All Trading Updates"
LOW_CONFIDENCE_NOTE = (
    "Unconfirmed: the wording of the announcement leaves room for doubt. "
    "Please read the source first."
)
