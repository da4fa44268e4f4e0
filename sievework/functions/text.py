"""Text, date and key functions; all are built-in expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def collapse(text: Column) -> Column:
    """Runs of Unicode white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def case_folded(text: Column) -> Column:
    """Lower case, with sharp s as ss and final sigma as sigma."""
    return F.replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


def fold(text: Column) -> Column:
    """White space collapsed and letters case-folded."""
    return case_folded(collapse(text))


def slugify(text: Column) -> Column:
    """Folded, & as "and", everything else but a-z and 0-9 as single hyphens."""
    plain = F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))
    return F.regexp_replace(F.regexp_replace(F.replace(plain, F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def normal_title(title: Column) -> Column:
    """The form in which titles are compared: folded, & and / blanked, colons stripped from the ends."""
    return F.btrim(collapse(F.regexp_replace(fold(title), "[&/]", " ")), F.lit(":"))


def contains_any(text: Column, markers: Column | Sequence[str]) -> Column:
    """Whether the text holds one of the markers: an array column, or a short fixed list."""
    array = markers if isinstance(markers, Column) else F.array(*map(F.lit, markers)).cast("array<string>")
    return F.coalesce(F.exists(array, lambda m: F.contains(text, m)), F.lit(False))


# The forms in which a title states when it was published.
LEADING_DATE = r"^\s*\[(\d{2}[/.]\d{2}[/.]\d{4})\]\s*"
TRAILING_DATE = r"(?iu)\s*\((?:published (?:at|on)|veröffentlicht am)\s+(\d{2}[/.]\d{2}[/.]\d{4})\)\s*$"


def publication(title: Column) -> Column:
    """struct(title, published_at, invalid): the date taken out of a title. A leading form wins.

    A day that does not exist gives a null date with invalid true; the text is removed all the same.
    """
    leading = F.regexp_extract(title, LEADING_DATE, 1)
    trailing = F.regexp_extract(title, TRAILING_DATE, 1)
    stated = F.when(leading != "", leading).otherwise(F.nullif(trailing, F.lit("")))
    date = F.try_to_date(F.replace(stated, F.lit("."), F.lit("/")), "dd/MM/yyyy")
    rest = F.when(leading != "", F.regexp_replace(title, LEADING_DATE, "")).when(trailing != "", F.regexp_replace(title, TRAILING_DATE, "")).otherwise(title)
    return F.struct(rest.alias("title"), date.alias("published_at"), (stated.isNotNull() & date.isNull()).alias("invalid"))


OLD_AFTER_DAYS = 180


def freshness(published: Column, today: Column) -> Column:
    age = F.datediff(today, published)
    return F.when(published.isNull(), "undated").when(age > OLD_AFTER_DAYS, "old").otherwise("current")


# The days below which each age band lies, youngest first, and the band of the rest.
AGE_BANDS = (("lt3", 3), ("lt30", 30), ("lt60", 60), ("lt180", 180))
OLDEST_BAND = "gt180"


def age_band(published: Column, first_seen: Column, today: Column) -> Column:
    age = F.datediff(today, F.coalesce(published, F.to_date(first_seen)))
    band = F.when(age.isNull(), None)
    for name, days in AGE_BANDS:
        band = band.when(age < days, name)
    return band.otherwise(OLDEST_BAND)


def in_age_band(band: Column, chosen: str) -> Column:
    """A chosen band takes in all younger ones; the oldest only itself."""
    names = [n for n, _ in AGE_BANDS]
    return band == OLDEST_BAND if chosen == OLDEST_BAND else band.isin(*names[: names.index(chosen) + 1])


# How many code points of each text are kept.
LIMITS = {"summary": 3000, "evidence": 1000, "child_error": 1500, "run_error": 5000, "model_input": 120_000}


def limited(text: Column, kind: str) -> Column:
    return F.substring(text, 1, LIMITS[kind])


def stable_key(slug: Column, url: Column, title: Column) -> Column:
    """32 hex digits that name an offer across crawls."""
    return F.substring(F.sha2(F.concat_ws("|", slug, url, fold(title)), 256), 1, 32)


def listing_slug(slug: Column, key: Column) -> Column:
    return F.concat(slug, F.lit("-"), F.substring(key, 1, 10))


def reference_prefix(kind: Column) -> Column:
    return F.when(kind == "idp", "idp").otherwise("ps")


def reference_code(prefix: Column, number: Column) -> Column:
    """At least three digits; lpad would cut a fourth."""
    return F.format_string("%s-%03d", prefix, number)
