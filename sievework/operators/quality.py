"""Checks of inventories, snapshots, documents and extracted records. Bad rows are set aside with reasons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

USEFUL_CHARS = 40
# The topics, and the fields that an extracted record may have.
TOPICS = ("ai_data", "marketing_sales", "strategy_entrepreneurship", "finance_accounting", "operations_supply_chain", "sustainability_energy", "law_governance", "health_sport", "other")
FIELDS = ("is_project_study", "title", "summary", "company", "language", "topics", "location", "remote_mode", "team_size_min", "team_size_max", "duration", "workload", "start_date", "deadline", "application_url", "application_email", "published_at", "confidence")
FREQUENCIES = ("immediate", "daily", "weekly")
EXTRACTED = "is_project_study boolean, title string, summary string, topics array<string>, team_size_min int, team_size_max int, application_url string, application_email string, confidence map<string, struct<value: double, evidence: string>>"


def inventory_report(df: DataFrame, slug: str, url: str, department: str, required: Sequence[str], departments: Sequence[str] | None = None) -> DataFrame:
    """One row of what an inventory must satisfy; departments_ok tells whether its departments are exactly the given ones."""
    extra, lacking = set(df.columns) - set(required), set(required) - set(df.columns)
    found = F.collect_set(department)  # an inventory has few
    wanted = F.array(*map(F.lit, departments or ())).cast("array<string>")
    same = F.lit(True) if departments is None else (F.size(F.array_except(found, wanted)) == 0) & (F.size(F.array_except(wanted, found)) == 0)
    return df.agg(
        F.count("*").alias("n_rows"), F.count_distinct(slug).alias("n_slugs"), F.count_distinct(url).alias("n_urls"), F.count_distinct(department).alias("n_departments"),
        F.lit(not extra and not lacking).alias("columns_ok"), same.alias("departments_ok"),
    )


def require_inventory(report: DataFrame, n_rows: int) -> None:
    r = report.first()
    if not r["columns_ok"] or not r["departments_ok"] or not r["n_rows"] == r["n_slugs"] == r["n_urls"] == n_rows:
        raise ValueError(f"the inventory is not as it should be: {r.asDict()}")


def snapshot_faults(pages: DataFrame, key: str, body: str, digest: str) -> DataFrame:
    """(key, fault): bodies that differ from their stated sha256, and keys that occur twice."""
    changed = pages.where(F.sha2(body, 256) != F.col(digest)).select(key, F.lit("hash").alias("fault"))
    return changed.unionByName(pages.groupBy(key).count().where("count > 1").select(key, F.lit("repeated").alias("fault")))


def document_class(pages: DataFrame, key: str = "content_hash", text: str = "text", error: str | None = None) -> DataFrame:
    """(key, page_count, usable_pages, classification) of documents from their page texts; a null text is a page without text."""
    usable = F.coalesce(F.length(F.btrim(F.col(text), F.lit(" \t\n\r\f\x0b"))) >= USEFUL_CHARS, F.lit(False))
    failed = F.col(error).isNotNull() if error else F.lit(False)
    counts = pages.groupBy(key).agg(F.count("*").alias("page_count"), F.count_if(usable).alias("usable_pages"), F.bool_or(failed).alias("__failed"))
    kind = F.when(F.col("__failed"), "unknown").when(F.col("usable_pages") == 0, "scanned").when(F.col("usable_pages") == F.col("page_count"), "digital_native").otherwise("mixed")
    return counts.withColumn("classification", kind).drop("__failed")


def needs_ocr(text: Column) -> Column:
    return F.coalesce(F.length(F.trim(text)) < USEFUL_CHARS, F.lit(True))


def pdf_intake(fetched: DataFrame, stored: DataFrame) -> DataFrame:
    """The artifact table after new bodies: (url, content_hash, byte_size, error).

    fetched: (url, ts, media_type, content binary). The latest row of a url counts, of several at one time the one with the larger digest. Success clears an error; failure keeps the file before.
    """
    good = F.coalesce((F.col("media_type") == "application/pdf") | F.startswith(F.col("content"), F.lit(b"%PDF-")), F.lit(False))
    # A body is told by its digest, size and kind where it is read, so that none is moved.
    told = fetched.select("url", "ts", F.struct(good.alias("good"), F.sha2("content", 256).alias("hash"), F.length("content").cast("long").alias("size")).alias("f"))
    latest = told.groupBy("url").agg(F.max_by("f", F.struct("ts", "f")).alias("f")).select("url", "f.*")
    new = latest.select("url", F.when(F.col("good"), F.col("hash")).alias("new_hash"), F.when(F.col("good"), F.col("size")).alias("new_size"), F.when(~F.col("good"), "not a PDF").alias("new_error"), F.lit(True).alias("fresh"))
    both = stored.join(new, "url", "full_outer")
    fresh = F.coalesce("fresh", F.lit(False))
    return both.select("url", F.coalesce("new_hash", "content_hash").alias("content_hash"), F.coalesce("new_size", "byte_size").alias("byte_size"), F.when(fresh, F.col("new_error")).otherwise(F.col("error")).alias("error"))


def backfill_progress(urls: DataFrame, artifacts: DataFrame) -> DataFrame:
    """One row: of the distinct PDF urls, how many are stored, failed and pending."""
    joined = urls.select("url").distinct().join(artifacts.select("url", "content_hash", "error"), "url", "left")
    stored = F.col("content_hash").isNotNull()
    failed = ~stored & F.col("error").isNotNull()
    return joined.agg(F.count("*").alias("total"), F.count_if(stored).alias("stored"), F.count_if(failed).alias("failed"), F.count_if(~stored & ~failed).alias("pending"))


def validate_extractions(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """rows with `reasons`, empty for a valid payload (JSON text)."""
    r = F.from_json(payload, EXTRACTED)
    keys = F.json_object_keys(payload)
    broken = keys.isNull()

    def fault(name: str, bad: Column) -> Column:
        return F.when(F.coalesce(bad, F.lit(False)), F.lit(name))

    checks = [
        fault("not an object", broken),
        fault("extra field", F.size(F.array_except(keys, F.array(*map(F.lit, FIELDS)))) > 0),
        fault("is_project_study", ~broken & r["is_project_study"].isNull()),
        fault("title", ~broken & (r["title"].isNull() | ~F.length(r["title"]).between(1, 300))),
        fault("summary", F.length(r["summary"]) > 3000),
        fault("team size", (r["team_size_min"] < 1) | (r["team_size_max"] < 1)),
        fault("topic", F.size(F.array_except(r["topics"], F.array(*map(F.lit, TOPICS)))) > 0),
        fault("confidence", ~broken & (r["confidence"].isNull() | F.exists(F.map_values(r["confidence"]), lambda c: ~F.coalesce(c["value"].between(0, 1), F.lit(False)) | F.coalesce(F.length(c["evidence"]) > 500, F.lit(True))))),
        fault("url", ~r["application_url"].rlike(r"^https?://[^\s/]+")),
        fault("email", ~r["application_email"].rlike(r"^[^@\s]+@[^@\s]+\.[^@\s.]+$")),
    ]
    return rows.withColumn("reasons", F.array_compact(F.array(*checks)))


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the valid rows, the rows set aside)."""
    good = F.size("reasons") == 0
    return checked.where(good).drop("reasons"), checked.where(~good)


def validate_searches(searches: DataFrame) -> DataFrame:
    """searches (name, frequency, query JSON) with `reasons`."""
    q = F.from_json("query", "page int, page_size int")
    checks = [
        F.when(~F.coalesce(F.length("name").between(1, 100), F.lit(False)), F.lit("name")),
        F.when(~F.coalesce(F.col("frequency").isin(*FREQUENCIES), F.lit(False)), F.lit("frequency")),
        F.when(F.coalesce(q["page"] < 1, F.lit(False)), F.lit("page")),
        F.when(F.coalesce(~q["page_size"].between(1, 100), F.lit(False)), F.lit("page_size")),
    ]
    return searches.withColumn("reasons", F.array_compact(F.array(*checks)))
