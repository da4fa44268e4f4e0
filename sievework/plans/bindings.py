"""The driver's tables in the parts that the operators' tables play, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TODAY = "1998-08-02"
STATUS = {"O": "active", "P": "pending_review", "F": "archived"}
OUTCOME = {"error": "failed", "purchase": "partial", "signup": "not_modified", "view": "success", "click": "success"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    status = F.create_map(*(F.lit(x) for kv in STATUS.items() for x in kv))[F.col("o_orderstatus")]
    return table(spark, sf_dir, "orders").select(
        key.alias("id"), F.col("o_custkey").alias("chair_id"), F.concat(F.lit("o-"), key).alias("slug"), F.concat(F.when(key % 2 == 0, "ps-").otherwise("idp-"), key).alias("reference_code"),
        F.concat_ws(" ", "o_orderpriority", (key % 97).cast("string")).alias("title"), F.when(key % 4 != 0, F.concat(F.lit("Total "), F.floor("o_totalprice"))).alias("summary"),
        status.alias("status"), F.when(key % 10 != 0, day).alias("published_at"), F.col("o_orderdate").alias("first_seen_at"), F.date_add(day, 5).alias("last_seen_at"),
        F.when(key % 3 != 0, F.date_add(day, (key % 40).cast("int"))).alias("deadline"), F.array(F.col("o_orderpriority"), F.col("o_orderstatus")).alias("topics"),
    )


LISTINGS = """listings AS (SELECT o_orderkey AS id, o_custkey AS chair_id, 'o-' || o_orderkey AS slug, CASE WHEN o_orderkey % 2 = 0 THEN 'ps-' ELSE 'idp-' END || o_orderkey AS reference_code,
  o_orderpriority || ' ' || (o_orderkey % 97) AS title, CASE WHEN o_orderkey % 4 <> 0 THEN 'Total ' || floor(o_totalprice)::BIGINT END AS summary,
  CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'P' THEN 'pending_review' WHEN 'F' THEN 'archived' END AS status,
  CASE WHEN o_orderkey % 10 <> 0 THEN o_orderdate::DATE END AS published_at, o_orderdate AS first_seen_at, o_orderdate::DATE + 5 AS last_seen_at,
  CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate::DATE + (o_orderkey % 40)::INTEGER END AS deadline, [o_orderpriority, o_orderstatus] AS topics FROM orders)"""


def chairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("department_id"))


def departments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))


CATALOG = LISTINGS + f""", catalog AS (SELECT l.*, c_name AS chair, n_name AS department,
  CASE WHEN published_at IS NULL THEN 'undated' WHEN DATE '{TODAY}' - published_at > 180 THEN 'old' ELSE 'current' END AS freshness
  FROM listings l JOIN customer ON chair_id = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.create_map(*(F.lit(x) for kv in OUTCOME.items() for x in kv))[F.col("event_type")]
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("run_id"), F.col("user_id").alias("source_id"), status.alias("status"), F.col("ts").alias("started_at"))


_CASE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in OUTCOME.items())
RUNS = f"runs AS (SELECT event_id AS run_id, user_id AS source_id, CASE event_type {_CASE} END AS status, ts AS started_at FROM events)"


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source_id"), F.col("s_name").alias("name"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as candidates; their first line is the title."""
    key = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("slug"), (key % 50).alias("page_id"), key.alias("ordinal"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.concat(F.lit("https://x.example/"), F.lower("lang"), F.when(key % 2 == 0, "/").otherwise("")).alias("source_url"),
        F.when(key % 3 == 0, F.concat(F.lit("https://x.example/apply/"), key)).alias("application_url"), F.col("text").alias("source_text"),
    )


CANDIDATES = """candidates AS (SELECT source AS slug, doc_id % 50 AS page_id, doc_id AS ordinal, string_split(text, chr(10))[1] AS title,
  'https://x.example/' || lower(lang) || CASE WHEN doc_id % 2 = 0 THEN '/' ELSE '' END AS source_url, CASE WHEN doc_id % 3 = 0 THEN 'https://x.example/apply/' || doc_id END AS application_url, text AS source_text FROM documents)"""
#: SQL of text.fold() and text.normal_title(), for texts whose white space is ASCII.
FOLD = r"replace(replace(lower(trim(regexp_replace({}, '\s+', ' ', 'g'))), 'ß', 'ss'), 'ς', 'σ')"


def fold_sql(column: str) -> str:
    return FOLD.format(column)


def title_sql(column: str) -> str:
    return rf"trim(trim(regexp_replace(regexp_replace({fold_sql(column)}, '[&/]', ' ', 'g'), '\s+', ' ', 'g')), ':')"
