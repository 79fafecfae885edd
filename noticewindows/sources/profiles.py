"""Source profiles and the firms resolved from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticewindows import fixed_values as fv

PROFILE_SCHEMA = """
    name string, display_name string, url string,
    post_content_selectors array<string>, listing_content_selectors array<string>,
    listing_title_selector string, listing_title_contains string,
    link_selectors array<string>, link_url_contains string, post_title_selector string,
    strip_selectors array<string>, min_content_chars int, post_key_prefix string,
    timezone string, require_stated_offset boolean, keywords array<string>,
    prompt_hints string, schedule_note string, notes string
"""
OVERRIDE_SCHEMA = """
    profile string, url string, timezone string, keywords array<string>,
    max_posts int, max_age_days int, enabled boolean
"""
_LISTS = (
    "post_content_selectors",
    "listing_content_selectors",
    "link_selectors",
    "strip_selectors",
    "keywords",
)


def _text_array(values: Sequence[str]) -> F.Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Profiles from JSON files, one document each, with every default filled in.

    List settings may be written as one string.  A document without its two required settings
    comes back with ``problem`` set, so that one bad profile stops nothing but itself.
    """
    as_text = PROFILE_SCHEMA.replace("array<string>", "string")
    raw = spark.read.schema(as_text).json(path, multiLine=True)
    raw = raw.withColumn("_stem", F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1))
    for column in _LISTS:
        listed = F.from_json(column, "array<string>")
        one = F.array(F.col(column))
        raw = raw.withColumn(
            column, F.when(F.ltrim(column).startswith("["), listed).when(F.col(column).isNotNull(), one)
        )
    return with_profile_defaults(raw, default_name=F.col("_stem")).drop("_stem")


def with_profile_defaults(profiles: DataFrame, default_name: F.Column | None = None) -> DataFrame:
    """Fill in defaults, and name what is missing in ``problem``."""
    name = F.col("name") if default_name is None else F.coalesce("name", default_name)
    filled = profiles.withColumn("name", name)
    defaults = {
        "display_name": F.upper("name"),
        "listing_content_selectors": _text_array(()),
        "listing_title_selector": F.lit(fv.TITLE_SELECTOR),
        "listing_title_contains": F.lit(""),
        "link_selectors": _text_array(fv.LINK_SELECTORS),
        "link_url_contains": F.lit(""),
        "post_title_selector": F.lit(fv.TITLE_SELECTOR),
        "strip_selectors": _text_array(()),
        "min_content_chars": F.lit(fv.MIN_CONTENT_CHARS),
        "post_key_prefix": F.lit(fv.POST_KEY_PREFIX),
        "timezone": F.lit(fv.DEFAULT_ZONE),
        "require_stated_offset": F.lit(False),
        "keywords": _text_array(()),
        "prompt_hints": F.lit(""),
        "schedule_note": F.lit(""),
        "notes": F.lit(""),
    }
    filled = filled.withColumns({c: F.coalesce(F.col(c), d) for c, d in defaults.items()})
    missing = F.array_compact(
        F.array(
            *[
                F.when(F.col(c).isNull(), F.lit(c))
                for c in ("url", "post_content_selectors")
            ]
        )
    )
    return filled.withColumn(
        "problem",
        F.when(F.size(missing) > 0, F.concat(F.lit("missing required: "), F.array_join(missing, ", "))),
    )


def broken_profiles(profiles: DataFrame, overrides: DataFrame) -> DataFrame:
    """``name, problem`` of the enabled profiles that cannot be used."""
    enabled = overrides.filter(F.coalesce("enabled", F.lit(True))).select(F.col("profile").alias("name")).distinct()
    return profiles.filter("problem is not null").join(enabled, "name", "left_semi").select("name", "problem")


def resolve_firms(
    profiles: DataFrame,
    overrides: DataFrame,
    default_zone: str = fv.DEFAULT_ZONE,
    default_keywords: Sequence[str] = fv.DEFAULT_KEYWORDS,
) -> DataFrame:
    """Enabled firms with their effective settings; an override that is not NULL wins.

    A profile whose required settings are missing (``problem``) is no firm; :func:`broken_profiles` reports it.

    An empty zone or URL falls through to the profile, an empty keyword list overrides the profile
    and then falls to the default gate.
    """
    o = overrides.select(
        F.col("profile").alias("name"),
        *[F.col(c).alias(f"o_{c}") for c in ("url", "timezone", "keywords")],
        F.coalesce("max_posts", F.lit(fv.MAX_POSTS)).alias("max_posts"),
        F.coalesce("max_age_days", F.lit(fv.MAX_AGE_DAYS)).alias("max_age_days"),
        F.coalesce("enabled", F.lit(True)).alias("enabled"),
    ).filter("enabled")
    keywords = F.coalesce("o_keywords", "keywords")
    empty = F.lit("")
    usable = profiles.filter("problem is null").drop("problem") if "problem" in profiles.columns else profiles
    return (
        usable.join(o, "name")
        .withColumn("url", F.coalesce(F.nullif("o_url", empty), "url"))
        .withColumn(
            "timezone",
            F.coalesce(
                F.nullif("o_timezone", empty), F.nullif("timezone", empty), F.lit(default_zone)
            ),
        )
        .withColumn(
            "keywords", F.when(F.size(keywords) > 0, keywords).otherwise(_text_array(default_keywords))
        )
        .drop("o_url", "o_timezone", "o_keywords", "enabled")
    )


def check_profiles(profiles: DataFrame, overrides: DataFrame, zones: DataFrame) -> DataFrame:
    """``(rule, subject)`` rows for every broken configuration rule; none when all is well.

    ``zones`` has one column ``zone`` with the known zone names.
    """
    def broken(rule: str, rows: DataFrame) -> DataFrame:
        return rows.select(F.lit(rule).alias("rule"), F.col("subject"))

    def repeated(df: DataFrame, column: str) -> DataFrame:
        return df.groupBy(F.col(column).alias("subject")).count().filter("count > 1")

    counts = overrides.agg(
        F.count("*").alias("n"), F.count_if(F.coalesce("enabled", F.lit(True))).alias("on")
    )
    named = profiles.select(F.col("timezone").alias("zone")).unionByName(
        overrides.select(F.col("timezone").alias("zone"))
    )
    used = named.filter("zone is not null and zone <> ''").distinct()
    rules = [
        broken("listed twice", repeated(overrides, "profile")),
        broken("shared post key prefix", repeated(profiles, "post_key_prefix")),
        broken("no firm listed", counts.filter("n = 0").select(F.lit("").alias("subject"))),
        broken("no firm enabled", counts.filter("n > 0 and on = 0").select(F.lit("").alias("subject"))),
        broken("unknown zone", used.join(zones, "zone", "left_anti").withColumnRenamed("zone", "subject")),
        broken(
            "unknown profile",
            overrides.select(F.col("profile").alias("subject"))
            .distinct()
            .join(profiles.select(F.col("name").alias("subject")), "subject", "left_anti"),
        ),
    ]
    out = rules[0]
    for rule in rules[1:]:
        out = out.unionByName(rule)
    return out
