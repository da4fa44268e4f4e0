"""Reports over the run log: health, streaks, history, changes and pacing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CLEAN, FAULTY = ("success", "not_modified"), ("failed", "partial")
HISTORY_LIMITS = (1, 500)


def latest_runs(runs: DataFrame) -> DataFrame:
    """Each source's newest run; ties go to the larger run_id."""
    nth = F.row_number().over(Window.partitionBy("source_id").orderBy(F.col("started_at").desc(), F.col("run_id").desc()))
    return runs.withColumn("nth", nth).where("nth = 1").drop("nth")


def failure_streaks(runs: DataFrame) -> DataFrame:
    """(source_id, consecutive_failures): faulty runs since the last clean one; skipped runs count as nothing."""
    clean = F.max(F.when(F.col("status").isin(*CLEAN), F.struct("started_at", "run_id")))
    after = clean.over(Window.partitionBy("source_id"))
    faulty = F.col("status").isin(*FAULTY)
    since = runs.withColumn("__clean", after).withColumn("__counts", faulty & (F.col("__clean").isNull() | (F.struct("started_at", "run_id") > F.col("__clean"))))
    return since.groupBy("source_id").agg(F.count_if("__counts").alias("consecutive_failures"))


def source_health(sources: DataFrame, runs: DataFrame) -> DataFrame:
    """Every source with its latest run, its streak and whether it is healthy."""
    latest = latest_runs(runs).select("source_id", F.col("status").alias("last_status"), F.col("started_at").alias("last_started_at"))
    joined = sources.join(latest, "source_id", "left").join(failure_streaks(runs), "source_id", "left")
    failures = F.coalesce("consecutive_failures", F.lit(0))
    return joined.withColumns({"consecutive_failures": failures, "health": F.when(failures > 0, "failing").otherwise("healthy")})


def health_summary(health: DataFrame) -> DataFrame:
    return health.agg(F.count_if(F.col("health") == "healthy").alias("healthy"), F.count_if(F.col("health") == "failing").alias("failing"))


def history(runs: DataFrame, sources: DataFrame, limit: int = 100, status: str | None = None) -> DataFrame:
    """The newest runs with their sources' names; the limit is held between 1 and 500."""
    chosen = runs.where(F.col("status") == status) if status else runs
    newest = chosen.orderBy(F.col("started_at").desc(), F.col("run_id").desc()).limit(max(HISTORY_LIMITS[0], min(limit, HISTORY_LIMITS[1])))
    return newest.join(sources, "source_id").orderBy(F.col("started_at").desc(), F.col("run_id").desc())


def outcome_summary(runs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts of outcomes and the status of them all together."""
    counts = runs.groupBy(*by).agg(
        F.count_if(F.col("status").isin(*CLEAN)).alias("successful"), *(F.count_if(F.col("status") == s).alias(s) for s in ("partial", "failed", "skipped"))
    )
    return counts.withColumn("status", F.when(F.col("failed") + F.col("partial") > 0, "completed_with_failures").otherwise("completed"))


def refresh_plan(sources: DataFrame) -> DataFrame:
    """Which sources to fetch, and with which validators: none after a failure."""
    clean = F.col("consecutive_failures") == 0
    return sources.withColumns({"action": F.when(F.col("enabled"), "fetch").otherwise("skipped"), "if_none_match": F.when(clean, F.col("etag")), "if_modified_since": F.when(clean, F.col("last_modified"))})


def changes(versions: DataFrame, key: str, order: Sequence[str], content: str = "content_hash") -> DataFrame:
    """versions with `changed`: whether a version differs from the one before; the first one does."""
    before = F.lag(content).over(Window.partitionBy(key).orderBy(*order))
    return versions.withColumn("changed", ~F.col(content).eqNullSafe(before))


def request_gaps(requests: DataFrame, origin: str, ts: str, tie: str, least_s: float = 3.0) -> DataFrame:
    """requests with the seconds since the one before to the same origin, and whether that is too soon."""
    before = F.lag(ts).over(Window.partitionBy(origin).orderBy(ts, tie))
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(before.cast("timestamp"))
    return requests.withColumn("gap_us", gap).withColumn("too_soon", F.coalesce(F.col("gap_us") < int(least_s * 1_000_000), F.lit(False)))


# The answers worth another try, and how fetching is limited.
RETRYABLE = (429, 500, 502, 503, 504)
MOST_ATTEMPTS, MOST_REDIRECTS, MOST_WAIT_S, MOST_BYTES = 3, 5, 30, 25_000_000


def attempt_audit(attempts: DataFrame) -> DataFrame:
    """attempts (url, attempt, status_code, retry_after, bytes) with what should follow each and after how long."""
    final = F.when(F.col("status_code") == 304, "not_modified").when(F.col("status_code").isin(*RETRYABLE), F.when(F.col("attempt") < MOST_ATTEMPTS, "retry").otherwise("give_up"))
    final = final.when(F.col("bytes") > MOST_BYTES, "too_large").when(F.col("status_code").between(200, 299), "done").otherwise("failed")
    stated = F.when(F.col("retry_after").rlike(r"^\d+$"), F.least(F.col("retry_after").cast("long"), F.lit(MOST_WAIT_S)))
    return attempts.withColumn("outcome", final).withColumn("wait_s", F.when(F.col("outcome") == "retry", F.coalesce(stated, F.pow(2, F.col("attempt") - 1).cast("long"))))


def redirect_chains(hops: DataFrame, starts: DataFrame, most: int = MOST_REDIRECTS) -> DataFrame:
    """(start, url, hops, outcome) of each start URL followed through hops (url, target): final or too_many."""
    at = starts.toDF("start").withColumns({"url": F.col("start"), "hops": F.lit(0)})
    step = hops.select(F.col("url").alias("__from"), "target")
    for _ in range(most + 1):
        at = at.join(step, at["url"] == step["__from"], "left").select("start", F.coalesce("target", "url").alias("url"), (F.col("hops") + F.col("target").isNotNull().cast("int")).alias("hops"))
    return at.withColumn("outcome", F.when(F.col("hops") > most, "too_many").otherwise("final"))


def quantiles(rows: DataFrame, value: str, parts: Sequence[int], whole: int) -> list:
    """For each of the ascending parts the least value that part/whole of all values do not exceed, exactly; none without values.

    Approximate quantiles on both sides of it leave less than a thousandth of the values, of which the right one is taken by its place.
    """
    given = rows.where(F.col(value).isNotNull()).select(F.col(value).alias("v"))
    near = [min(max(p / whole + d, 0.0), 1.0) for p in parts for d in (-0.0003, 0.0003)]
    bounds, n = given.agg(F.percentile_approx("v", near), F.count("*")).first()
    if not n:
        return []
    sides = list(zip(bounds[::2], bounds[1::2], strict=True))
    below = given.agg(*(F.count_if(F.col("v") < low).alias(f"n{i}") for i, (low, _) in enumerate(sides))).first()
    found = []
    for part, (low, high), under in zip(parts, sides, below, strict=True):
        place = max(-(-n * part // whole), 1) - under
        counted = given.where(F.col("v").between(low, high)).groupBy("v").agg(F.count("*").alias("n"))
        upto = counted.select("v", F.sum("n").over(Window.orderBy("v")).alias("upto"))  # less than a thousandth of the values
        found.append(upto.where(F.col("upto") >= place).agg(F.min("v")).first()[0])
    return found
