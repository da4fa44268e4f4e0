"""Keys, de-duplication and the reconciliation of a listings table with what a run observed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold, limited, listing_slug, normal_title

ARCHIVE_AFTER = 2


def _first(df: DataFrame, keys: list, order: list) -> DataFrame:
    return df.withColumn("__nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__nth = 1").drop("__nth")


def dedup_titles(candidates: DataFrame, page: str = "page_id") -> DataFrame:
    """One candidate for each page and normal title: with a link first, then the shorter text, then the earlier."""
    return _first(candidates, [page, normal_title(F.col("title"))], [F.col("application_url").isNull(), F.char_length("source_text"), "ordinal"])


def dedup_across_pages(candidates: DataFrame, source: str = "slug") -> DataFrame:
    """One candidate for each source, URL without its last slashes and title: the shorter text, then the earlier.

    `position` is the ordinal of the first of each group, which gives the order of the result.
    """
    keys = [source, F.lower(F.rtrim("source_url", F.lit("/"))), fold(F.col("title"))]
    return _first(candidates.withColumn("position", F.min("ordinal").over(Window.partitionBy(*keys))), keys, [F.char_length("source_text"), "ordinal"])


def new_artifacts(artifacts: DataFrame, stored: DataFrame) -> DataFrame:
    """The first artifact of each (source_id, content_hash) that is not stored yet."""
    return _first(artifacts, ["source_id", "content_hash"], ["ordinal"]).join(stored, ["source_id", "content_hash"], "left_anti")


def latest_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key: the last in order. Every other column comes from that row."""
    rest = F.struct(*(c for c in df.columns if c != key))
    return df.groupBy(key).agg(F.max_by(rest, order).alias("row")).select(key, "row.*")


def reconcile(current: DataFrame, observed: DataFrame, runs: DataFrame) -> DataFrame:
    """The listings after a run, each with `action`.

    current: chair_id, stable_source_key, title, summary, content_hash, status, consecutive_misses,
    published_at, first_seen_at, last_seen_at. observed: chair_id, stable_source_key, title,
    summary, content_hash, published_at. runs: chair_id, run_status, now; one row for each chair.

    A run that succeeded or was partial makes what it saw active with no misses. Only one that
    succeeded counts a miss against active listings it did not see, and archives at the second. A run
    without modification refreshes active listings; one that failed or was skipped changes nothing.
    Observations of a chair whose run did neither succeed nor was partial do not count.
    """
    o = observed.select("chair_id", "stable_source_key", *(F.col(c).alias(f"o_{c}") for c in ("title", "summary", "content_hash", "published_at")), F.lit(True).alias("seen"))
    both = current.withColumn("known", F.lit(True)).join(o, ["chair_id", "stable_source_key"], "full_outer").join(runs, "chair_id", "left")
    applies = F.coalesce(F.col("run_status").isin("success", "partial"), F.lit(False))
    seen = F.coalesce(F.col("seen") & applies, F.lit(False))
    known = F.coalesce("known", F.lit(False))
    fresh = F.coalesce((F.col("run_status") == "not_modified") & (F.col("status") == "active"), F.lit(False))
    missed = F.coalesce(~seen & known & (F.col("run_status") == "success") & (F.col("status") == "active"), F.lit(False))
    misses = F.when(seen | fresh, 0).when(missed, F.col("consecutive_misses") + 1).otherwise(F.col("consecutive_misses"))
    archived = missed & (F.col("consecutive_misses") + 1 >= ARCHIVE_AFTER)
    action = (
        F.when(seen & ~known, "created")
        .when(seen & ~F.col("content_hash").eqNullSafe(F.col("o_content_hash")), "updated")
        .when(seen, "unchanged")
        .when(archived, "archived")
        .when(missed, "missed")
        .when(fresh, "refreshed")
        .otherwise("kept")
    )
    take = lambda c: F.when(seen, F.col(f"o_{c}")).otherwise(F.col(c)).alias(c)
    return both.where(known | seen).select(
        "chair_id", "stable_source_key", take("title"), take("summary"), take("content_hash"), take("published_at"),
        F.when(seen, "active").when(archived, "archived").otherwise(F.col("status")).alias("status"), misses.cast("int").alias("consecutive_misses"),
        F.coalesce("first_seen_at", "now").alias("first_seen_at"), F.when(seen | fresh, F.col("now")).otherwise(F.col("last_seen_at")).alias("last_seen_at"), action.alias("action"),
    )


def lifecycle_step(status: Column, misses: Column, succeeded: Column, seen: Column) -> Column:
    """struct(status, consecutive_misses) after one crawl of any listing, whatever its status was."""
    return (
        F.when(~succeeded, F.struct(status.alias("status"), misses.alias("consecutive_misses")))
        .when(seen, F.struct(F.lit("active").alias("status"), F.lit(0).alias("consecutive_misses")))
        .otherwise(F.struct(F.when(misses + 1 >= ARCHIVE_AFTER, "archived").otherwise(status).alias("status"), (misses + 1).alias("consecutive_misses")))
    )


def replay_lifecycle(history: DataFrame, key: str = "key", order: list[str] | None = None) -> DataFrame:
    """(key, status, consecutive_misses) after a history of (key, outcome): seen, missed, not_modified or anything else.

    A listing starts when it is first seen. An island of misses ends when the listing is seen, or on
    a run without modification while it is active; two misses in an island archive it until it is seen.
    """
    by = Window.partitionBy(key).orderBy(*(order or ["ts"]))
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    seen, missed, same = (F.col("outcome") == x for x in ("seen", "missed", "not_modified"))
    h = history.withColumn("life", F.sum(seen.cast("int")).over(upto)).where("life > 0")
    h = h.withColumn("island", F.sum((seen | same).cast("int")).over(upto))
    h = h.groupBy(key, "life", "island").agg(F.sum(missed.cast("int")).alias("misses"))
    h = h.groupBy(key, "life").agg(F.min(F.when(F.col("misses") >= ARCHIVE_AFTER, F.struct("island", "misses"))).alias("first"), F.max(F.struct("island", "misses")).alias("last"))
    h = h.groupBy(key).agg(F.max_by(F.struct("first", "last"), "life").alias("now"))
    gone = F.col("now.first").isNotNull()
    return h.select(key, F.when(gone, "archived").otherwise("active").alias("status"), F.when(gone, ARCHIVE_AFTER).otherwise(F.col("now.last.misses")).cast("int").alias("consecutive_misses"))


def versions(reconciled: DataFrame, slug: str, details: Sequence[str] = ()) -> DataFrame:
    """(listing, content_hash, extracted, evidence) for each created or updated listing, from reconcile()'s rows with source_url and source_text.

    extracted: title, summary and the columns of `details` as JSON, null ones too. evidence: where the text stands, and its start.
    """
    kept = reconciled.where(F.col("action").isin("created", "updated"))
    evidence = F.to_json(F.struct(F.col("source_url"), limited(F.col("source_text"), "evidence").alias("excerpt")))
    extracted = F.to_json(F.struct("title", "summary", *details), {"ignoreNullFields": "false"})
    return kept.select(listing_slug(F.col(slug), F.col("stable_source_key")).alias("listing"), "content_hash", extracted.alias("extracted"), evidence.alias("evidence"))


def run_statistics(reconciled: DataFrame, key: str = "chair_id", runs: DataFrame | None = None, artifacts: DataFrame | None = None) -> DataFrame:
    """How many listings each run created, updated and left unchanged.

    With runs (key, run_status, failures) there is a row for each of them, with its status and list of failures, and zeros where it saw
    nothing; with artifacts (key, artifacts) also how many pages it brought.
    """
    names = ("created", "updated", "unchanged", "missed", "archived")
    counts = [F.count_if(F.col("action") == a).alias(a) for a in names]
    found = reconciled.groupBy(key).agg(F.count_if(F.col("action").isin("created", "updated", "unchanged")).alias("candidates"), *counts)
    if artifacts is not None:
        found = found.join(artifacts, key, "full_outer")
    if runs is not None:
        found = runs.select(key, "run_status", "failures").join(found, key, "left")
    return found.na.fill(0, [c for c in ("candidates", *names, "artifacts") if c in found.columns])


def overrides(log: DataFrame, listing: str = "listing_id") -> DataFrame:
    """(listing, title, summary): the newest valid override of each field, from (listing, field, value JSON, created_at, id).

    A value is valid if its member "value" is a string that is not blank. A newer invalid row hides nothing.
    """
    text = F.expr("try_variant_get(try_parse_json(value), '$.value', 'variant')")
    valid = log.where(F.col("field").isin("title", "summary")).withColumn("__text", F.when(F.schema_of_variant(text) == "STRING", F.trim(text.cast("string"))))
    valid = valid.where(F.col("__text") != "")
    latest = lambda f: F.max_by(F.when(F.col("field") == f, F.col("__text")), F.when(F.col("field") == f, F.struct("created_at", "id"))).alias(f)
    return valid.groupBy(listing).agg(latest("title"), latest("summary"))


def with_overrides(listings: DataFrame, folded: DataFrame, listing: str = "listing_id") -> DataFrame:
    o = folded.select(listing, F.col("title").alias("__title"), F.col("summary").alias("__summary"))
    return listings.join(o, listing, "left").withColumns({"title": F.coalesce("__title", "title"), "summary": F.coalesce("__summary", "summary")}).drop("__title", "__summary")


def normal_details(url: Column, artifact_url: Column) -> Column:
    """struct(source_url, artifact_url); an artifact that is the page itself is none."""
    return F.struct(url.alias("source_url"), F.when(~artifact_url.eqNullSafe(url), artifact_url).alias("artifact_url"))


def missing_dimensions(incoming: DataFrame, existing: DataFrame, key: str = "slug") -> DataFrame:
    """Rows to add to a dimension: one for each key it does not have, with an id made from the key."""
    new = incoming.dropDuplicates([key]).join(existing.select(key), key, "left_anti")
    return new.withColumn("id", F.sha2(key, 256))
