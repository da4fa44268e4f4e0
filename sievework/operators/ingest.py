"""A day's ingestion: from captured pages to listings, versions, artifacts and run statistics, all sources in one composition.

Sources are only a key. What the crawl of a source brought decides what its run may do to the listings; one
source's failure changes nothing of another's.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import limited, listing_slug, publication, reference_code, reference_prefix
from ..sources.storage import checkpointed
from .catalog import reference_codes
from .html import DROP_FOR_TEXT, discover, explode_nodes, page_text, texts_of
from .reconcile import dedup_across_pages, new_artifacts, normal_details, overrides, reconcile, run_statistics, versions, with_overrides

#: The columns of listings.
LISTINGS = (
    "chair_id string, stable_source_key string, title string, summary string, content_hash string, published_at date, status string, "
    "consecutive_misses int, first_seen_at timestamp, last_seen_at timestamp, reference_code string"
)


@dataclass(frozen=True)
class Ingested:
    """listings: all of them, with `action`; versions and artifacts: what is to be appended; statistics: a row for each crawl."""

    listings: DataFrame
    versions: DataFrame
    artifacts: DataFrame
    statistics: DataFrame


def observe(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """What pages (page_id, url, slug, position, html) offer: one row for each listing, as reconcile() takes it, with source_url and source_text.

    A date that the title states counts before one at the start or end of the text's first 3,000 characters; both are
    taken out of what is shown. `ordinal` is the order of the offers of a source: its pages by position, and on a page by rank.
    """
    found = discover(pages, rules).join(pages.select("page_id", "position", F.col("url").alias("page_url")), "page_id")
    by_source = Window.partitionBy("slug").orderBy("position", "page_id", "ordinal")
    offers = dedup_across_pages(found.withColumn("ordinal", F.row_number().over(by_source)))
    title, summary = publication(F.col("title")), publication(limited(F.col("source_text"), "summary"))
    shown = offers.withColumns({"shown_title": title, "shown_summary": summary})
    return shown.select(
        F.col("slug").alias("chair_id"), "stable_source_key", F.col("shown_title.title").alias("title"), F.col("shown_summary.title").alias("summary"),
        F.sha2("source_text", 256).alias("content_hash"), F.coalesce("shown_title.published_at", "shown_summary.published_at").alias("published_at"),
        normal_details(F.col("page_url"), F.col("source_url")).alias("details"), "source_text", F.col("position").alias("ordinal"),
    )


def ingest(pages: DataFrame, crawls: DataFrame, failures: DataFrame, rules: DataFrame, listings: DataFrame, artifacts: DataFrame, log: DataFrame) -> Ingested:
    """The state after a day's crawls.

    pages (page_id, url, slug, position, html): what was fetched; of a source's pages the one with the least position is its own.
    crawls (slug, outcome, now), one for each source: fetched, not_modified or failed. failures (slug, url, error): children that could
    not be fetched. listings: LISTINGS. artifacts (source_id, content_hash): what is stored. log (listing_id, field, value, created_at, id): overrides
    by listing slug; they stand whatever a crawl says. Pages of crawls that did not fetch do not count.
    A crawl with failed children updates what it saw and counts no misses.
    """
    failed = failures.groupBy("slug").agg(F.count("*").alias("failed"), F.sort_array(F.collect_list(F.struct("url", limited(F.col("error"), "child_error").alias("error")))).alias("failures"))
    status = F.when(F.col("outcome") != "fetched", F.col("outcome")).when(F.col("failed") > 0, "partial").otherwise("success")
    runs = crawls.join(failed, "slug", "left").select(F.col("slug").alias("chair_id"), status.alias("run_status"), "now", F.when(F.col("outcome") == "fetched", F.col("failures")).alias("failures"))
    runs = checkpointed(runs.withColumn("failures", F.coalesce("failures", F.array().cast("array<struct<url: string, error: string>>"))))
    fetched = pages.join(crawls.where("outcome = 'fetched'").select("slug"), "slug", "left_semi")

    seen = observe(fetched, rules)
    named = seen.withColumn("listing", listing_slug(F.col("chair_id"), F.col("stable_source_key")))
    seen = checkpointed(with_overrides(named, overrides(log, "listing_id").withColumnRenamed("listing_id", "listing"), "listing"))
    after = reconcile(listings, seen, runs.select("chair_id", "run_status", "now"))
    keys = ["chair_id", "stable_source_key"]
    after = checkpointed(after.join(listings.select(*keys, "reference_code"), keys, "left"))

    kind = rules.select(F.col("slug").alias("chair_id"), reference_prefix(F.col("opportunity_type")).alias("prefix"))
    fresh = after.where("action = 'created'").drop("reference_code").join(kind, "chair_id").join(seen.select(*keys, "ordinal"), keys)
    coded = reference_codes(fresh, "prefix", ["chair_id", "ordinal", "stable_source_key"], listings)
    codes = coded.select(*keys, reference_code(F.col("prefix"), F.col("number").cast("int")).alias("new_code"))
    after = checkpointed(after.join(codes, keys, "left").withColumn("reference_code", F.coalesce("reference_code", "new_code")).drop("new_code"))

    told = after.join(seen.select(*keys, "details", "source_text"), keys)
    told = told.withColumns({"source_url": F.coalesce("details.artifact_url", "details.source_url"), "page_url": F.col("details.source_url"), "artifact_url": F.col("details.artifact_url")})
    made = versions(told, "chair_id", ("page_url", "artifact_url"))

    texts = page_text(texts_of(explode_nodes(fetched, DROP_FOR_TEXT))).select("page_id", F.col("text").alias("extracted_text"))
    bodies = fetched.select("page_id", F.col("slug").alias("source_id"), F.sha2("html", 256).alias("content_hash"), F.struct("position", "page_id").alias("ordinal"))
    stored = new_artifacts(bodies, artifacts).drop("ordinal").join(texts, "page_id", "left").drop("page_id")
    counts = bodies.groupBy(F.col("source_id").alias("chair_id")).agg(F.count("*").alias("artifacts"))
    return Ingested(after, made, stored, run_statistics(after, runs=runs, artifacts=counts))
