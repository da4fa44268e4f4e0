"""The registered queries over the driver's tables, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..operators import alerts, catalog, classify, html, ingest, policy, quality, reconcile, runs
from ..sources import inventory, storage, textindex
from ..sources.commits import CommittedTable
from ..sources.storage import checkpointed, remove, shared_folder
from ..streaming import runs as stream
from . import bindings as B
from .bindings import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _catalog(spark, d):
    return catalog.catalog(B.listings(spark, d), B.chairs(spark, d), B.departments(spark, d), F.lit(B.TODAY).cast("date"))


# ---- Catalogue.


@query(f"WITH {B.CATALOG} SELECT slug, title, chair, department, freshness, first_seen_at FROM catalog WHERE status = 'active' AND contains(lower(concat_ws(' ', reference_code, title, coalesce(summary, ''), chair)), 'urgent') ORDER BY first_seen_at DESC, slug LIMIT 20")
def e2_catalog_page(spark, d):
    found = catalog.search(catalog.filter_status(_catalog(spark, d), "active"), "URGENT")
    return catalog.page(found, "newest").select("slug", "title", "chair", "department", "freshness", "first_seen_at")


@query(f"WITH {B.CATALOG} SELECT id, chair, department, freshness FROM catalog")
def j1_catalog(spark, d):
    return _catalog(spark, d).select("id", "chair", "department", "freshness")


@query(f"WITH {B.LISTINGS} SELECT id, slug FROM listings WHERE status = 'active'")
def f2_status(spark, d):
    return catalog.filter_status(B.listings(spark, d), "active").select("id", "slug")


@query(f"WITH {B.CATALOG} SELECT id, title FROM catalog WHERE contains(lower(reference_code || ' ' || title || ' ' || coalesce(summary, '') || ' ' || chair), 'total 12')")
def f3_search(spark, d):
    return catalog.search(_catalog(spark, d), "Total 12").select("id", "title")


@query(f"WITH {B.CATALOG} SELECT id, department FROM catalog WHERE department IN ('NATION_1', 'NATION_7')")
def f4_membership(spark, d):
    return catalog.filter_in(_catalog(spark, d), "department", ["NATION_1", "NATION_7"]).select("id", "department")


@query(f"WITH {B.CATALOG} SELECT id, chair FROM catalog WHERE chair IN (SELECT c_name FROM customer WHERE c_acctbal < 0)")
def f4_selection(spark, d):
    chosen = table(spark, d, "customer").where("c_acctbal < 0").select("c_name")
    return catalog.filter_selected(_catalog(spark, d), "chair", chosen).select("id", "chair")


@query(f"WITH {B.LISTINGS} SELECT id FROM listings WHERE list_has_any(topics, ['1-URGENT', 'P'])")
def f5_topics(spark, d):
    return catalog.filter_topics(B.listings(spark, d), ["1-URGENT", "P"]).select("id")


@query("SELECT s_suppkey AS source_id, CASE WHEN s_suppkey % 5 <> 0 THEN 'fetch' ELSE 'skipped' END AS action, CASE WHEN s_suppkey % 3 = 0 THEN s_name END AS if_none_match FROM supplier")
def f8_f9_refresh_plan(spark, d):
    found = B.sources(spark, d).selectExpr("source_id", "source_id % 5 <> 0 as enabled", "source_id % 3 as consecutive_failures", "name as etag", "name as last_modified")
    return runs.refresh_plan(found).select("source_id", "action", "if_none_match")


@query("SELECT s_name AS unknown FROM supplier WHERE s_nationkey > 12")
def f10_x2_unknown_selection(spark, d):
    asked, known = (table(spark, d, "supplier").where(c).select(F.col("s_name").alias("unknown")) for c in ("true", "s_nationkey <= 12"))
    return asked.subtract(known)


@query(f"WITH {B.CATALOG} SELECT slug, title, chair FROM catalog WHERE slug = 'o-17'")
def f11_lookup(spark, d):
    return catalog.lookup(_catalog(spark, d), "o-17").select("slug", "title", "chair")


@query(f"WITH {B.CATALOG} SELECT slug, deadline::VARCHAR AS deadline FROM catalog ORDER BY catalog.deadline NULLS LAST, slug LIMIT 20 OFFSET 40")
def o1_deadline_page(spark, d):
    return catalog.page(_catalog(spark, d), "deadline", 3).select("slug", F.col("deadline").cast("string").alias("deadline"))


@query(f"WITH {B.CATALOG} SELECT slug, title FROM catalog ORDER BY lower(title), slug LIMIT 100")
def o1_title_page(spark, d):
    return catalog.page(_catalog(spark, d), "title", 1, 100).select("slug", "title")


@query(f"WITH {B.CATALOG} SELECT slug, published_at::VARCHAR AS published_at FROM catalog ORDER BY catalog.published_at DESC NULLS LAST, first_seen_at DESC, slug LIMIT 50 OFFSET 50")
def o2_published_page(spark, d):
    return catalog.page(_catalog(spark, d), "published", 2, 50).select("slug", F.col("published_at").cast("string").alias("published_at"))


@query(f"WITH {B.CATALOG} SELECT n_name AS value, 'department' AS facet, (SELECT count(*) FROM catalog WHERE department = n_name) AS n FROM nation UNION ALL SELECT o_orderpriority, 'topic', (SELECT count(*) FROM catalog WHERE list_contains(topics, o_orderpriority)) FROM (SELECT DISTINCT o_orderpriority FROM orders)")
def a1_facets(spark, d):
    return catalog.facets(_catalog(spark, d), B.departments(spark, d).select("name"), table(spark, d, "orders").select("o_orderpriority"))


@query(f"WITH {B.LISTINGS} SELECT count(*) FILTER (WHERE status = 'active') AS total, max(last_seen_at)::VARCHAR AS last_updated_at FROM listings")
def a2_totals(spark, d):
    rows = B.listings(spark, d)
    return catalog.totals(catalog.filter_status(rows, "active"), rows).withColumn("last_updated_at", F.col("last_updated_at").cast("string"))


@query("SELECT n_name AS department, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def a9_census(spark, d):
    dims = B.departments(spark, d).toDF("department_id", "department")
    return B.chairs(spark, d).join(dims, "department_id").groupBy("department").agg(F.count("*").alias("n"))


@query("SELECT n_name AS department, array_to_string(list_sort(list_distinct(list(c_name))), '|') AS chairs FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def a11_chairs(spark, d):
    dims = B.departments(spark, d).toDF("department_id", "department")
    found = catalog.chairs_of_departments(B.chairs(spark, d).withColumnRenamed("name", "chair").join(dims, "department_id"))
    return found.select("department", F.array_join("chairs", "|").alias("chairs"))


@query("SELECT n_name AS name FROM nation UNION SELECT r_name FROM region UNION SELECT c_mktsegment FROM customer")
def x1_union(spark, d):
    return table(spark, d, "nation").select("n_name").union(table(spark, d, "region").select("r_name")).union(table(spark, d, "customer").select("c_mktsegment")).distinct().toDF("name")


# ---- Functions.


@query(f"SELECT doc_id, sha256({B.fold_sql('text')}) AS folded FROM documents")
def c1_fold(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(T.fold(F.col("text")), 256).alias("folded"))


@query("SELECT p_partkey, trim(regexp_replace(replace(replace(lower(p_name || ' & ' || p_brand || '!'), 'ß', 'ss'), '&', ' and '), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def c2_slugify(spark, d):
    return table(spark, d, "part").select("p_partkey", T.slugify(F.concat("p_name", F.lit(" & "), "p_brand", F.lit("!"))).alias("slug"))


@query("""WITH u AS (SELECT page_id, url FROM pages) SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS host, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS origin, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#;]*)', 1) AS path,
  CASE page_id % 5 WHEN 0 THEN 'squarespace' WHEN 1 THEN 'legacy_html' ELSE 'typo3' END AS family, CASE WHEN regexp_matches(split_part(url, '?', 1), '(\\.html|\\.htm|/)$') THEN 'text/html' ELSE '' END AS media FROM u""")
def c3_c4_s5_urls(spark, d):
    url = F.col("url")
    return table(spark, d, "pages").select("page_id", U.host_of(url).alias("host"), U.origin_of(url).alias("origin"), U.path_of(url).alias("path"), U.parser_family(F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("https://www.TUMCSO.com/"), "page_id")).when(F.col("page_id") % 5 == 1, "http://www.bwl.wi.tum.de").otherwise(url)).alias("family"), U.media_type(F.lit(None), url).alias("media"))


_TITLED = "concat(case when o_orderkey % 3 = 0 then '[' || date_format(o_orderdate, 'dd.MM.yyyy') || '] ' when o_orderkey % 3 = 1 and o_orderkey % 7 <> 0 then '[45/13/1997] ' else '' end, o_orderpriority, case when o_orderkey % 2 = 0 then ' (Published on ' || date_format(o_orderdate, 'dd/MM/yyyy') || ')' else '' end)"


@query("""SELECT o_orderkey, o_orderpriority || CASE WHEN o_orderkey % 2 = 0 AND (o_orderkey % 3 = 0 OR (o_orderkey % 3 = 1 AND o_orderkey % 7 <> 0)) THEN ' (Published on ' || strftime(o_orderdate, '%d/%m/%Y') || ')' ELSE '' END AS title,
  CASE WHEN o_orderkey % 3 = 0 OR (o_orderkey % 2 = 0 AND NOT (o_orderkey % 3 = 1 AND o_orderkey % 7 <> 0)) THEN (o_orderdate::DATE)::VARCHAR END AS published_at, o_orderkey % 3 = 1 AND o_orderkey % 7 <> 0 AS invalid FROM orders""")
def c5_publication(spark, d):
    return table(spark, d, "orders").select("o_orderkey", T.publication(F.expr(_TITLED)).alias("p")).select("o_orderkey", "p.title", F.col("p.published_at").cast("string").alias("published_at"), "p.invalid")


@query(f"WITH {B.CATALOG}, bands AS (SELECT freshness, DATE '{B.TODAY}' - coalesce(published_at, first_seen_at::DATE) AS age FROM catalog) SELECT freshness, CASE WHEN age < 3 THEN 'lt3' WHEN age < 30 THEN 'lt30' WHEN age < 60 THEN 'lt60' WHEN age < 180 THEN 'lt180' ELSE 'gt180' END AS band, age < 60 AS chosen, count(*) AS n FROM bands GROUP BY ALL")
def c6_c7_ages(spark, d):
    found = _catalog(spark, d).select("freshness", T.age_band(F.col("published_at"), F.col("first_seen_at"), F.lit(B.TODAY).cast("date")).alias("band"))
    return found.select("freshness", "band", T.in_age_band(F.col("band"), "lt60").alias("chosen")).groupBy("freshness", "band", "chosen").agg(F.count("*").alias("n"))


@query("SELECT doc_id, sha256(substr(text, 1, 3000)) AS summary, length(substr(text, 1, 1000)) AS evidence FROM documents")
def c8_limits(spark, d):
    text = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.sha2(T.limited(text, "summary"), 256).alias("summary"), F.char_length(T.limited(text, "evidence")).cast("long").alias("evidence"))


@query("""SELECT event_id, (props->>'$.k')::BIGINT AS k, strftime((ts AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Berlin', '%Y-%m-%d %H:%M') AS local_time FROM events""")
def c10_c12_json_and_local_time(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"), F.date_format(F.from_utc_timestamp(F.col("ts").cast("timestamp"), "Europe/Berlin"), "yyyy-MM-dd HH:mm").alias("local_time"))


@query(f"WITH {B.CANDIDATES} SELECT ordinal, substr(sha256(concat_ws('|', slug, source_url, {B.fold_sql('title')})), 1, 32) AS stable_key, slug || '-' || substr(sha256(concat_ws('|', slug, source_url, {B.fold_sql('title')})), 1, 10) AS listing, sha256(source_text) AS digest FROM candidates")
def k1_k2_k3_keys(spark, d):
    keyed = B.candidates(spark, d).withColumn("stable_key", T.stable_key(F.col("slug"), F.col("source_url"), F.col("title")))
    return keyed.select("ordinal", "stable_key", T.listing_slug(F.col("slug"), F.col("stable_key")).alias("listing"), F.sha2("source_text", 256).alias("digest"))


@query("SELECT page_id, 'sha256/' || substr(h, 1, 2) || '/' || substr(h, 3, 2) || '/' || h || '.pdf' AS storage_key, regexp_matches(lower(regexp_replace(url || CASE WHEN page_id % 2 = 0 THEN '.PDF?x' ELSE '' END, '[?#;].*$', '')), '\\.pdf$') AS is_pdf FROM (SELECT *, sha256(html) AS h FROM pages)")
def s6_s7_pdf_keys(spark, d):
    url = F.concat("url", F.when(F.col("page_id") % 2 == 0, ".PDF?x").otherwise(""))
    return table(spark, d, "pages").select("page_id", U.storage_key(F.sha2("html", 256)).alias("storage_key"), U.is_pdf_url(url).alias("is_pdf"))


# ---- Classification, de-duplication, reconciliation.

_RULE = {"active_markers": ["the and", "le la", "tion"], "archive_markers": ["garbage", "ntst"], "excluded_markers": ["token", "idiot", " ñ"]}


@query(f"""WITH t AS (SELECT doc_id, {B.fold_sql('text')} AS f FROM documents), v AS (SELECT doc_id, CASE WHEN contains(f, 'garbage') OR contains(f, 'ntst') THEN 1 WHEN contains(f, 'token') OR contains(f, 'idiot') OR contains(f, ' ñ') THEN 2 WHEN contains(f, 'the and') OR contains(f, 'le la') OR contains(f, 'tion') THEN 3 ELSE 4 END AS k FROM t)
SELECT doc_id, k = 3 AS accepted, k < 4 AS certain, ['archive section', 'excluded opportunity type', 'explicit idp marker', 'opportunity type is uncertain'][k] AS reason FROM v""")
def f1_classify(spark, d):
    rules = {k: F.array(*map(F.lit, v)) for k, v in _RULE.items()} | {"source_implies_active_type": F.lit(False), "opportunity_type": F.lit("idp")}
    return classify.classify(table(spark, d, "documents").withColumns(rules), "text").select("doc_id", "classification.*")


@query(f"""WITH t AS (SELECT p_partkey, {B.title_sql("p_name || ': '")} AS n FROM part) SELECT p_partkey, n IN ('red widget', 'small ring') OR NOT (contains(n, 'ring') OR contains(n, 'widget')) AS noise FROM t""")
def f6_noise_titles(spark, d):
    title, active = F.concat("p_name", F.lit(": ")), F.array(F.lit("ring"), F.lit("widget"))
    noise = classify.is_noise_title(title, F.array(F.lit("red widget"), F.lit("small ring")), T.normal_title(title), active, F.lit(False))
    return table(spark, d, "part").select("p_partkey", noise.alias("noise"))


@query(f"WITH {B.CANDIDATES} SELECT page_id, ordinal FROM candidates QUALIFY row_number() OVER (PARTITION BY page_id, {B.title_sql('title')} ORDER BY application_url IS NULL, length(source_text), ordinal) = 1")
def d1_titles(spark, d):
    return reconcile.dedup_titles(B.candidates(spark, d)).select("page_id", "ordinal")


@query(f"WITH {B.CANDIDATES}, k AS (SELECT *, rtrim(lower(source_url), '/') AS u, {B.fold_sql('title')} AS t FROM candidates) SELECT slug, ordinal, min(ordinal) OVER (PARTITION BY slug, u, t) AS position FROM k QUALIFY row_number() OVER (PARTITION BY slug, u, t ORDER BY length(source_text), ordinal) = 1")
def d2_across_pages(spark, d):
    return reconcile.dedup_across_pages(B.candidates(spark, d)).select("slug", "ordinal", "position")


@query("WITH a AS (SELECT source AS source_id, sha256(text) AS content_hash, doc_id AS ordinal FROM documents) SELECT source_id, content_hash, min(ordinal) AS ordinal FROM a WHERE (source_id, content_hash) NOT IN (SELECT source_id, content_hash FROM a WHERE ordinal % 5 = 0) GROUP BY ALL")
def d3_j5_new_artifacts(spark, d):
    rows = table(spark, d, "documents").select(F.col("source").alias("source_id"), F.sha2("text", 256).alias("content_hash"), F.col("doc_id").alias("ordinal"))
    return reconcile.new_artifacts(rows, rows.where("ordinal % 5 = 0").select("source_id", "content_hash"))


@query("SELECT text_hash AS content_hash, max(doc_id) AS doc_id, arg_max(source, doc_id) AS source FROM (SELECT sha256(text) AS text_hash, * FROM documents) GROUP BY ALL")
def d4_latest(spark, d):
    return reconcile.latest_by(table(spark, d, "documents").select(F.sha2("text", 256).alias("content_hash"), "doc_id", "source"), "content_hash", "doc_id")


def _reconciled(spark, d):
    one = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("chair_id"), F.col("l_partkey").alias("key")).agg(F.min("l_orderkey").alias("low"), F.max("l_orderkey").alias("high"), F.min("l_shipdate").alias("ts"))
    named = one.select("chair_id", F.col("key").cast("string").alias("stable_source_key"), "low", "high", "ts", "key")
    current = named.where("low % 3 <> 0").selectExpr("chair_id", "stable_source_key", "concat('t', low) as title", "cast(null as string) as summary", "cast(low as string) as content_hash", "case low % 5 when 0 then 'archived' when 1 then 'pending_review' else 'active' end as status", "cast(case when low % 5 = 0 then 2 when low % 2 = 0 then 1 else 0 end as int) as consecutive_misses", "cast(null as date) as published_at", "ts as first_seen_at", "ts as last_seen_at")
    observed = named.where("high % 4 <> 0").selectExpr("chair_id", "stable_source_key", "concat('n', high) as title", "'s' as summary", "cast(high as string) as content_hash", "date'1999-01-01' as published_at")
    statuses = F.element_at(F.array(*map(F.lit, ("success", "partial", "not_modified", "failed", "success"))), (F.col("chair_id") % 5 + 1).cast("int"))
    status = table(spark, d, "supplier").select(F.col("s_suppkey").alias("chair_id")).select("chair_id", statuses.alias("run_status"), F.expr("timestamp_ntz'2000-01-01 00:00:00'").alias("now"))
    return reconcile.reconcile(current, observed, status)


_M1 = """WITH one AS (SELECT l_suppkey AS chair_id, l_partkey::VARCHAR AS stable_source_key, min(l_orderkey) AS low, max(l_orderkey) AS high, min(l_shipdate) AS ts FROM lineitem GROUP BY ALL),
c AS (SELECT *, 't' || low AS title, CASE low % 5 WHEN 0 THEN 'archived' WHEN 1 THEN 'pending_review' ELSE 'active' END AS status, CASE WHEN low % 5 = 0 THEN 2 WHEN low % 2 = 0 THEN 1 ELSE 0 END AS misses FROM one WHERE low % 3 <> 0),
o AS (SELECT * FROM one WHERE high % 4 <> 0),
b AS (SELECT coalesce(c.chair_id, o.chair_id) AS chair_id, coalesce(c.stable_source_key, o.stable_source_key) AS stable_source_key, c.low, o.high, c.title, c.status, c.misses, c.ts, c.low IS NOT NULL AS known, o.high IS NOT NULL AS observed FROM c FULL JOIN o ON c.chair_id = o.chair_id AND c.stable_source_key = o.stable_source_key),
r AS (SELECT b.*, ['success', 'partial', 'not_modified', 'failed', 'success'][b.chair_id % 5 + 1] AS run FROM b),
s AS (SELECT *, observed AND run IN ('success', 'partial') AS seen FROM r),
a AS (SELECT *, NOT seen AND known AND run = 'success' AND status = 'active' AS missed, known AND run = 'not_modified' AND status = 'active' AS fresh FROM s WHERE known OR seen),
m1 AS (SELECT chair_id, stable_source_key, CASE WHEN seen THEN 'n' || high ELSE title END AS title, CASE WHEN seen THEN 'active' WHEN missed AND misses + 1 >= 2 THEN 'archived' ELSE status END AS status,
  (CASE WHEN seen OR fresh THEN 0 WHEN missed THEN misses + 1 ELSE misses END)::INTEGER AS consecutive_misses, CASE WHEN seen THEN '1999-01-01' END AS published_at,
  coalesce(ts, TIMESTAMP '2000-01-01') AS first_seen_at, CASE WHEN seen OR fresh THEN TIMESTAMP '2000-01-01' ELSE ts END AS last_seen_at,
  CASE WHEN seen AND NOT known THEN 'created' WHEN seen AND low <> high THEN 'updated' WHEN seen THEN 'unchanged' WHEN missed AND misses + 1 >= 2 THEN 'archived' WHEN missed THEN 'missed' WHEN fresh THEN 'refreshed' ELSE 'kept' END AS action FROM a)"""


@query(_M1 + " SELECT * FROM m1")
def m1_j6_reconcile(spark, d):
    return _reconciled(spark, d).drop("summary", "content_hash").withColumn("published_at", F.col("published_at").cast("string"))


@query(_M1 + " SELECT chair_id, count(*) FILTER (WHERE action IN ('created', 'updated', 'unchanged')) AS candidates, " + ", ".join(f"count(*) FILTER (WHERE action = '{a}') AS {a}" for a in ("created", "updated", "unchanged", "missed", "archived")) + " FROM m1 GROUP BY chair_id")
def a5_a7_run_statistics(spark, d):
    return reconcile.run_statistics(_reconciled(spark, d))


@query(_M1 + """ SELECT chair_id || '-' || substr(stable_source_key, 1, 10) AS listing, '{"source_url":"u","excerpt":"' || title || '"}' AS evidence, '{"title":"' || title || '","summary":"s","last_seen_at":null}' AS extracted FROM m1 WHERE action IN ('created', 'updated')""")
def m2_versions(spark, d):
    rows = _reconciled(spark, d).withColumns({"source_url": F.lit("u"), "source_text": F.col("title"), "chair": F.col("chair_id").cast("string"), "last_seen_at": F.lit(None).cast("string")})
    return reconcile.versions(rows, "chair", ("last_seen_at",)).drop("content_hash")


@query("WITH c AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'idp' ELSE 'ps' END AS prefix, o_orderdate FROM orders) SELECT o_orderkey, prefix || '-' || CASE WHEN n < 1000 THEN lpad(n::VARCHAR, 3, '0') ELSE n::VARCHAR END AS reference_code FROM (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY o_orderdate, o_orderkey) + CASE prefix WHEN 'ps' THEN (SELECT max(c_custkey) FROM customer) ELSE 0 END AS n FROM c)")
def m3_m3b_w2_reference_codes(spark, d):
    rows = table(spark, d, "orders").withColumn("prefix", T.reference_prefix(F.when(F.col("o_orderstatus") == "O", "idp")))
    stored = table(spark, d, "customer").select(F.concat(F.lit("ps-"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("reference_code")).union(table(spark, d, "nation").select(F.concat(F.lit("idp-x"), "n_nationkey")))
    coded = catalog.reference_codes(rows, "prefix", ["o_orderdate", "o_orderkey"], stored)
    return coded.select("o_orderkey", T.reference_code(F.col("prefix"), F.col("number").cast("int")).alias("reference_code"))


@query("""WITH v AS (SELECT conv_id AS listing_id, CASE role WHEN 'user' THEN 'title' ELSE 'summary' END AS field, turn, CASE turn % 4 WHEN 0 THEN NULL WHEN 2 THEN '  ' ELSE text END AS value FROM conversations),
g AS (SELECT listing_id, field, arg_max(trim(value), turn) AS value FROM v WHERE trim(value) <> '' GROUP BY ALL)
SELECT listing_id, max(value) FILTER (WHERE field = 'title') AS title, max(value) FILTER (WHERE field = 'summary') AS summary FROM g GROUP BY listing_id""")
def m4_overrides(spark, d):
    text = F.expr("case turn % 4 when 2 then '  ' else text end")
    value = F.when(F.col("turn") % 4 == 0, '{"value": 5}').otherwise(F.to_json(F.struct(text.alias("value"))))
    log = table(spark, d, "conversations").select(F.col("conv_id").alias("listing_id"), F.when(F.col("role") == "user", "title").otherwise("summary").alias("field"), value.alias("value"), F.col("turn").alias("created_at"), F.col("turn").alias("id"))
    return reconcile.overrides(log)


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url || 'x' END AS artifact_url FROM pages")
def m7_details(spark, d):
    rows = table(spark, d, "pages").select("page_id", reconcile.normal_details(F.col("url"), F.when(F.col("page_id") % 2 == 0, F.concat("url", F.lit("x"))).otherwise(F.col("url"))).alias("n"))
    return rows.select("page_id", "n.artifact_url")


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'active' WHEN event_type = 'view' THEN 'active' WHEN user_id % 3 >= 1 THEN 'archived' ELSE 'active' END AS status, (CASE WHEN event_type = 'error' THEN user_id % 3 WHEN event_type = 'view' THEN 0 ELSE user_id % 3 + 1 END)::INTEGER AS consecutive_misses FROM events")
def m8_lifecycle_step(spark, d):
    step = reconcile.lifecycle_step(F.lit("active"), (F.col("user_id") % 3).cast("int"), F.col("event_type") != "error", F.col("event_type") == "view")
    return table(spark, d, "events").select("event_id", step.alias("s")).select("event_id", "s.*")


_OUTCOMES = "case event_type when 'view' then 'seen' when 'click' then 'missed' when 'signup' then 'not_modified' else 'other' end"
_L1 = """WITH RECURSIVE e AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'view' THEN 'seen' WHEN 'click' THEN 'missed' WHEN 'signup' THEN 'not_modified' ELSE 'other' END AS o, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
w AS (SELECT user_id, i, CASE WHEN o = 'seen' THEN 'active' END AS status, 0 AS m FROM e WHERE i = 1 UNION ALL
SELECT e.user_id, e.i, CASE WHEN o = 'seen' THEN 'active' WHEN status = 'active' AND o = 'missed' AND m >= 1 THEN 'archived' ELSE status END,
  CASE WHEN o = 'seen' THEN 0 WHEN status = 'active' AND o = 'not_modified' THEN 0 WHEN status = 'active' AND o = 'missed' THEN m + 1 ELSE m END FROM w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1)
SELECT user_id, status, m::INTEGER AS consecutive_misses FROM w WHERE status IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1"""


@query(_L1)
def l1_replay(spark, d):
    return reconcile.replay_lifecycle(table(spark, d, "events").withColumn("outcome", F.expr(_OUTCOMES)), "user_id", ["ts", "event_id"])


@query("SELECT DISTINCT p_brand AS slug, sha256(p_brand) AS id FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_partkey < 10)")
def j12_missing_dimensions(spark, d):
    brands = table(spark, d, "part").select(F.col("p_brand").alias("slug"), "p_partkey")
    return reconcile.missing_dimensions(brands.select("slug"), brands.where("p_partkey < 10").select("slug")).select("slug", "id")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def j13_purge(spark, d):
    deleted = table(spark, d, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    return alerts.without_users(table(spark, d, "orders"), deleted, "o_custkey").select("o_orderkey")


# ---- Reports over the run log.

_STREAK = "streaks AS (SELECT source_id, count(*) FILTER (WHERE status IN ('failed', 'partial') AND n > coalesce(clean, 0)) AS consecutive_failures FROM (SELECT *, max(CASE WHEN status IN ('success', 'not_modified') THEN n END) OVER (PARTITION BY source_id) AS clean FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY started_at, run_id) AS n FROM runs)) GROUP BY source_id)"
_HEALTH = f"WITH {B.RUNS}, {_STREAK}, latest AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, run_id DESC) = 1), health AS (SELECT s_suppkey AS source_id, s_name AS name, status AS last_status, started_at AS last_started_at, coalesce(consecutive_failures, 0) AS consecutive_failures, CASE WHEN coalesce(consecutive_failures, 0) > 0 THEN 'failing' ELSE 'healthy' END AS health FROM supplier LEFT JOIN latest ON s_suppkey = latest.source_id LEFT JOIN streaks ON s_suppkey = streaks.source_id)"


@query(f"{_HEALTH} SELECT * FROM health")
def r1_j2_j3_w1_health(spark, d):
    return runs.source_health(B.sources(spark, d), B.runs(spark, d))


@query(f"{_HEALTH} SELECT count(*) FILTER (WHERE health = 'healthy') AS healthy, count(*) FILTER (WHERE health = 'failing') AS failing FROM health")
def a6_health_summary(spark, d):
    return runs.health_summary(runs.source_health(B.sources(spark, d), B.runs(spark, d)))


@query(f"WITH {B.RUNS}, newest AS (SELECT * FROM runs WHERE status = 'failed' ORDER BY started_at DESC, run_id DESC LIMIT 500) SELECT run_id, source_id, started_at, s_name AS name FROM newest JOIN supplier ON source_id = s_suppkey")
def r2_o5_history(spark, d):
    return runs.history(B.runs(spark, d), B.sources(spark, d), 900, "failed").select("run_id", "source_id", "started_at", "name")


@query(f"WITH {B.RUNS}, {_STREAK} SELECT * FROM streaks")
def r3_w3_streaks(spark, d):
    return runs.failure_streaks(B.runs(spark, d))


@query(f"WITH {B.RUNS} SELECT source_id, count(*) FILTER (WHERE status IN ('success', 'not_modified')) AS successful, count(*) FILTER (WHERE status = 'partial') AS partial, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'skipped') AS skipped, CASE WHEN count(*) FILTER (WHERE status IN ('failed', 'partial')) > 0 THEN 'completed_with_failures' ELSE 'completed' END AS status FROM runs GROUP BY source_id")
def a4_outcomes(spark, d):
    return runs.outcome_summary(B.runs(spark, d), ["source_id"])


@query("WITH g AS (SELECT event_id, user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap_us FROM events) SELECT event_id, coalesce(gap_us, -1) AS gap_us, coalesce(gap_us < 3000000000, false) AS too_soon FROM g")
def w5_gaps(spark, d):
    return runs.request_gaps(table(spark, d, "events"), "user_id", "ts", "event_id", 3000).select("event_id", F.coalesce("gap_us", F.lit(-1)).alias("gap_us"), "too_soon")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate, l_returnflag IS DISTINCT FROM lag(l_returnflag) OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS changed FROM lineitem")
def w6_changes(spark, d):
    found = runs.changes(table(spark, d, "lineitem"), "l_orderkey", ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "l_returnflag")
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "changed")


# ---- Policies, quality, alerts.


@query("SELECT l_linenumber AS attempt, l_orderkey, l_partkey, code AS status_code, CASE WHEN code = 304 THEN 'not_modified' WHEN code IN (429, 500, 502, 503, 504) AND l_linenumber < 3 THEN 'retry' WHEN code IN (429, 500, 502, 503, 504) THEN 'give_up' WHEN size > 25000000 THEN 'too_large' WHEN code BETWEEN 200 AND 299 THEN 'done' ELSE 'failed' END AS outcome, CASE WHEN code IN (429, 500, 502, 503, 504) AND l_linenumber < 3 THEN CASE WHEN l_suppkey % 2 = 0 THEN least(l_suppkey, 30) ELSE (2 ** (l_linenumber - 1))::BIGINT END END AS wait_s FROM (SELECT *, [200, 304, 404, 429, 500, 503, 206][l_partkey % 7 + 1] AS code, (l_quantity * 600000)::BIGINT AS size FROM lineitem)")
def r7_attempts(spark, d):
    code = F.element_at(F.array(*map(F.lit, (200, 304, 404, 429, 500, 503, 206))), (F.col("l_partkey") % 7 + 1).cast("int"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", F.col("l_linenumber").alias("attempt"), code.alias("status_code"), F.when(F.col("l_suppkey") % 2 == 0, F.col("l_suppkey").cast("string")).alias("retry_after"), (F.col("l_quantity") * 600_000).cast("long").alias("bytes"))
    return runs.attempt_audit(rows).drop("retry_after", "bytes")


@query("WITH RECURSIVE hop AS (SELECT p_partkey AS url, p_partkey - 7 AS target FROM part WHERE p_partkey % 7 <> 3 AND p_partkey >= 7), w AS (SELECT p_partkey AS start, p_partkey AS url, 0 AS hops FROM part UNION ALL SELECT start, target, hops + 1 FROM w JOIN hop USING (url) WHERE hops < 6) SELECT start, url, max_hops::INTEGER AS hops, CASE WHEN max_hops > 5 THEN 'too_many' ELSE 'final' END AS outcome FROM (SELECT start, arg_max(url, hops) AS url, max(hops) AS max_hops FROM w GROUP BY start)")
def r7_redirects(spark, d):
    part = table(spark, d, "part").select("p_partkey")
    hops = part.where("p_partkey % 7 <> 3 and p_partkey >= 7").select(F.col("p_partkey").alias("url"), (F.col("p_partkey") - 7).alias("target"))
    return runs.redirect_chains(hops, part)


def _policies(spark, d):
    urls = table(spark, d, "pages").select("page_id", "url")
    origins = urls.select(U.origin_of(F.col("url")).alias("origin")).distinct()
    status = F.element_at(F.array(*map(F.lit, (200, 200, 404, 403, 503))), (F.length("origin") % 5 + 1).cast("int"))
    known = origins.where("length(origin) % 7 <> 0").select("origin", status.alias("status"), policy.origin_policy(status).alias("policy"), (F.length("origin") % 11 != 0).alias("has_body"))
    bodies = known.select("origin", F.lit("User-agent: other\nDisallow: /\n\nUser-agent: *\nAllow: /en/1\nDisallow: /en # no\nDisallow: /de/*\nDisallow:").alias("body"))
    return policy.admit(urls, known, policy.parse_rules(bodies), "crawler"), known


def _admitted(spark, d):
    return _policies(spark, d)[0]


_R6 = """WITH u AS (SELECT page_id, url, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS origin, regexp_extract(url, '^[a-z]+://[^/?#]*([^#]*)', 1) AS path FROM pages),
r6 AS (SELECT *, [200, 200, 404, 403, 503][length(origin) % 5 + 1] AS status FROM u),
admitted AS (SELECT page_id, origin, CASE WHEN length(origin) % 7 = 0 THEN 'unavailable' WHEN status = 404 THEN 'allowed' WHEN status <> 200 THEN 'disallowed' WHEN length(origin) % 11 = 0 THEN 'unavailable' WHEN starts_with(path, '/en/1') THEN 'allowed' WHEN starts_with(path, '/en') OR starts_with(path, '/de/*') THEN 'disallowed' ELSE 'allowed' END AS admission FROM r6)"""


@query(_R6 + " SELECT page_id, admission FROM admitted")
def r5_r6_j10_admission(spark, d):
    return _admitted(spark, d).select("page_id", "admission")


@query(_R6 + " SELECT origin, count(*) AS checked, count(*) FILTER (WHERE admission = 'allowed') AS allowed, bool_and(admission = 'allowed') AS compliant FROM admitted GROUP BY origin")
def a10_s9_robots_audit(spark, d):
    return policy.audit(_admitted(spark, d))


@query(_R6 + """, o AS (SELECT DISTINCT origin, CASE WHEN length(origin) % 7 <> 0 THEN status END AS status FROM r6) SELECT 'exception' AS kind, url AS subject, admission AS reason, 1 AS n FROM (SELECT DISTINCT url, admission FROM admitted JOIN pages USING (page_id)) WHERE admission <> 'allowed'
  UNION ALL SELECT 'deferred', origin, CASE WHEN status = 503 THEN 'temporarily_unavailable_defer_crawl' ELSE 'unknown' END, (SELECT count(DISTINCT url) FROM u WHERE u.origin = o.origin) FROM o WHERE status IS NULL OR status = 503
  UNION ALL SELECT 'origin', origin, coalesce(status, 0)::VARCHAR, (SELECT count(*) FROM u WHERE u.origin = o.origin) FROM o""")
def s9_exceptions(spark, d):
    """The lists of an audit: URLs that must not be fetched, origins that wait, and each origin's answer."""
    admitted, known = _policies(spark, d)
    refused = policy.exceptions(admitted).select(F.lit("exception").alias("kind"), F.col("url").alias("subject"), F.col("admission").alias("reason"), F.lit(1).cast("long").alias("n"))
    waiting = policy.deferred(admitted, known).select(F.lit("deferred"), "origin", F.coalesce("policy", F.lit("unknown")), "urls")
    return refused.union(waiting).union(policy.audit(admitted, known).select(F.lit("origin"), "origin", F.coalesce("status", F.lit(0)).cast("string"), "checked"))


@query("SELECT count(DISTINCT url) AS total, count(DISTINCT url) FILTER (WHERE least_id % 3 = 0) AS stored, count(DISTINCT url) FILTER (WHERE least_id % 3 = 1) AS failed, count(DISTINCT url) FILTER (WHERE least_id % 3 = 2) AS pending FROM (SELECT url, min(page_id) OVER (PARTITION BY url) AS least_id FROM pages)")
def r4_a3_a12_j4_backfill(spark, d):
    urls = table(spark, d, "pages").select("page_id", "url")
    stored = urls.groupBy("url").agg(F.min("page_id").alias("k")).where("k % 3 <> 2").select("url", F.when(F.col("k") % 3 == 0, "h").alias("content_hash"), F.when(F.col("k") % 3 == 1, "e").alias("error"))
    return quality.backfill_progress(urls, stored)


@query("SELECT source, page_count, usable_pages, CASE WHEN usable_pages = 0 THEN 'scanned' WHEN usable_pages = page_count THEN 'digital_native' ELSE 'mixed' END AS classification, sha FROM (SELECT min(source) AS source, sha256(text) AS sha, max(len(string_split(text, chr(10)))) AS page_count, max(len(list_filter(string_split(text, chr(10)), lambda x: length(trim(x, chr(32) || chr(9) || chr(10) || chr(13) || chr(12) || chr(11))) >= 40))) AS usable_pages FROM documents GROUP BY sha256(text))")
def p2_a8_document_class(spark, d):
    docs = table(spark, d, "documents").select(F.sha2("text", 256).alias("content_hash"), "source", "text")
    # Equal documents are counted apart by their pages' numbers, so that no text is moved: only hashes and verdicts are.
    lines = docs.select("content_hash", F.posexplode(F.split("text", "\n")).alias("page", "text"))
    usable = lines.select("content_hash", "page", F.when(~quality.needs_ocr(F.btrim("text", F.lit(" \t\n\r\f\x0b"))), "x" * 40).alias("text")).distinct()
    sources = docs.groupBy("content_hash").agg(F.min("source").alias("source"))
    return sources.join(quality.document_class(usable), "content_hash").withColumnRenamed("content_hash", "sha")


@query("SELECT doc_id, length(trim(text)) < 40 AS needs_ocr FROM documents")
def p3_needs_ocr(spark, d):
    return table(spark, d, "documents").select("doc_id", quality.needs_ocr(F.col("text")).alias("needs_ocr"))


@query("WITH f AS (SELECT url, sha256(arg_max(html, page_id)) AS h, strlen(arg_max(html, page_id)) AS n, max(page_id) % 2 = 0 AS good FROM pages GROUP BY url) SELECT url, CASE WHEN good THEN h ELSE 'old' END AS content_hash, CASE WHEN good THEN n ELSE 1 END AS byte_size, CASE WHEN NOT good THEN 'not a PDF' END AS error FROM f")
def p1_pdf_intake(spark, d):
    rows = table(spark, d, "pages")
    fetched = rows.select("url", F.col("page_id").alias("ts"), F.when(F.col("page_id") % 2 == 0, "application/pdf").otherwise("text/html").alias("media_type"), F.col("html").cast("binary").alias("content"))
    stored = rows.select("url").distinct().select("url", F.lit("old").alias("content_hash"), F.lit(1).cast("long").alias("byte_size"), F.lit("before").alias("error"))
    return quality.pdf_intake(fetched, stored)


@query("SELECT count(*) AS n_rows, count(DISTINCT c_name) AS n_slugs, count(DISTINCT c_mktsegment) AS n_urls, count(DISTINCT c_nationkey) AS n_departments, true AS columns_ok, count(DISTINCT c_nationkey) = (SELECT count(*) FROM nation) AND bool_and(c_nationkey IN (SELECT n_nationkey FROM nation)) AS departments_ok FROM customer")
def q1_inventory(spark, d):
    rows = table(spark, d, "customer").select("c_name", "c_mktsegment", F.col("c_nationkey").cast("string").alias("c_nationkey"))
    nations = [str(r[0]) for r in table(spark, d, "nation").select("n_nationkey").collect()]  # 25, of which all are departments
    return quality.inventory_report(rows, "c_name", "c_mktsegment", "c_nationkey", ("c_name", "c_mktsegment", "c_nationkey"), nations)


@query("SELECT doc_id, 'hash' AS fault FROM documents WHERE doc_id % 9 = 0")
def q2_s4_snapshot_faults(spark, d):
    pages = table(spark, d, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 9 == 0, F.lit("0")).otherwise(F.sha2("text", 256)).alias("digest"))
    return quality.snapshot_faults(pages, "doc_id", "text", "digest")


@query("""SELECT doc_id, array_to_string(list_filter([CASE WHEN doc_id % 11 = 0 THEN 'not an object' END, CASE WHEN doc_id % 11 <> 0 AND doc_id % 7 = 0 THEN 'extra field' END, CASE WHEN doc_id % 11 <> 0 AND length(text) > 300 AND doc_id % 2 = 0 THEN 'title' END, CASE WHEN doc_id % 11 <> 0 AND length(text) > 3000 THEN 'summary' END, CASE WHEN doc_id % 11 <> 0 AND doc_id % 5 = 0 THEN 'team size' END, CASE WHEN doc_id % 11 <> 0 AND doc_id % 3 = 0 THEN 'topic' END, CASE WHEN doc_id % 11 <> 0 AND doc_id % 13 > 10 THEN 'confidence' END], lambda x: x IS NOT NULL), ',') AS reasons FROM documents""")
def q3_extractions(spark, d):
    key = F.col("doc_id")
    confidence = F.create_map(F.lit("title"), F.struct((key % 13 / 10).alias("value"), F.lit("e").alias("evidence")))
    whole = F.struct(F.lit(True).alias("is_project_study"), F.when(key % 2 == 0, F.col("text")).otherwise("t").alias("title"), F.col("text").alias("summary"), F.array(F.when(key % 3 == 0, "sport").otherwise("ai_data")).alias("topics"), F.when(key % 5 == 0, 0).otherwise(1).alias("team_size_min"), confidence.alias("confidence"), F.when(key % 7 == 0, 1).alias("mood"))
    payload = F.when(key % 11 == 0, "[1]").otherwise(F.to_json(whole))
    return quality.validate_extractions(table(spark, d, "documents").select("doc_id", payload.alias("payload"))).select("doc_id", F.array_join("reasons", ",").alias("reasons"))


@query("SELECT c_custkey, array_to_string(list_filter([CASE WHEN c_custkey % 3 = 0 THEN 'name' END, CASE WHEN c_mktsegment <> 'MACHINERY' THEN 'frequency' END, CASE WHEN c_nationkey = 0 THEN 'page' END, CASE WHEN c_nationkey * 10 NOT BETWEEN 1 AND 100 THEN 'page_size' END], lambda x: x IS NOT NULL), ',') AS reasons FROM customer")
def q4_searches(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).otherwise("").alias("name"), F.when(F.col("c_mktsegment") == "MACHINERY", "daily").otherwise("hourly").alias("frequency"), F.to_json(F.struct(F.col("c_nationkey").alias("page"), (F.col("c_nationkey") * 10).alias("page_size"))).alias("query"))
    return quality.validate_searches(rows).select("c_custkey", F.array_join("reasons", ",").alias("reasons"))


_NEEDLES = ("tion", "Ung", "the and", "ción", "é la", "PASSWORD", "http")


@query(f"WITH s AS (SELECT c_custkey AS search_id, c_nationkey AS user_id, 'SOURCE ' || (c_custkey % 20) AS source, {list(_NEEDLES)}[c_custkey % {len(_NEEDLES)} + 1] AS needle FROM customer) SELECT DISTINCT search_id, user_id::BIGINT AS user_id, 'd' || doc_id AS slug FROM documents JOIN s ON 'SOURCE ' || replace(documents.source, 'src', '') = s.source WHERE contains(lower(text), lower(needle)) AND (search_id % 2 = 0 OR lang = 'en') AND doc_id % 4 <> 0")
def g1_alerts(spark, d):
    docs = table(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("slug"), F.concat(F.lit("SOURCE "), F.replace("source", F.lit("src"), F.lit(""))).alias("department"), F.col("lang").alias("language"), "text", "doc_id")
    key = F.col("c_custkey")
    searches = table(spark, d, "customer").select(key.alias("search_id"), F.col("c_nationkey").cast("long").alias("user_id"), F.element_at(F.array(*map(F.lit, _NEEDLES)), (key % len(_NEEDLES) + 1).cast("int")).alias("needle"), F.array(F.concat(F.lit("SOURCE "), (key % 20))).alias("departments"), F.when(key % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("en"))).alias("languages"), F.lit(False).alias("paused"))
    sent = alerts.alert_classes(docs.where("doc_id % 4 = 0"), searches)
    return alerts.alert_classes(docs, searches, sent).rows().select("search_id", "user_id", "slug")


@query("SELECT user_id, array_to_string(list_sort(list(item)), ',') AS items FROM (SELECT user_id, props AS item, arg_max(event_type, event_id) AS last FROM events GROUP BY ALL) WHERE last IN ('view', 'signup', 'click') GROUP BY user_id")
def g2_bookmarks(spark, d):
    log = table(spark, d, "events").select("user_id", F.col("props").alias("item"), F.when(F.col("event_type").isin("view", "signup", "click"), "add").otherwise("remove").alias("action"), F.col("event_id").alias("ts"))
    return alerts.bookmarks(log).select("user_id", F.array_join("items", ",").alias("items"))


# ---- Pages as tables.


_DECODE = "replace(replace(replace(replace(replace(replace({}, '&quot;', chr(34)), '&lt;', '<'), '&gt;', '>'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"
# A page's reference may be cut off before its semicolon and is decoded then, too, as in a browser.
_READ = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '&quot;?', chr(34), 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&copy;?', '©', 'g'), '&middot;?', '·', 'g'), '&amp;?', '&', 'g')"
_PIECES = "list_filter(list_transform(string_split_regex(regexp_replace({}, '<(script|style)>.*?</(script|style)>', '<x>', 'gs'), '<[^>]*>'), lambda x: trim(" + _READ.format("x") + ", ' ' || chr(10))), lambda x: x <> '')"
_ANCHORS = f"""a AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS origin, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href, unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)<', 1)) AS said FROM pages),
anchors AS (SELECT page_id, origin || {_DECODE.format('href')} AS url, trim({_DECODE.format('said')}) AS label FROM a)"""


def _items(spark, d, drop=()):
    return checkpointed(html.explode_nodes(table(spark, d, "pages"), drop))


@query("SELECT page_id, array_to_string(list_transform(regexp_extract_all(html, '<([a-z][a-z0-9]*)[^>]*>', 1), lambda x: x), ' ') AS tags, len(regexp_extract_all(html, '<a href')) AS links, len(regexp_extract_all(html, '<p>')) AS paragraphs FROM (SELECT page_id, regexp_replace(html, '<(script|style)>.*?</(script|style)>', '<\\1>', 'gs') AS html FROM pages)")
def h1_nodes(spark, d):
    tags = F.transform(F.sort_array(F.collect_list(F.struct("start", "tag"))), lambda x: x["tag"])
    return html.nodes_of(_items(spark, d)).groupBy("page_id").agg(F.array_join(tags, " ").alias("tags"), *(F.count_if(F.col("tag") == t).alias(n) for t, n in (("a", "links"), ("p", "paragraphs"))))


@query("WITH bodies AS (SELECT html, min(page_id) % 2 AS first, len(regexp_extract_all(regexp_replace(html, '<(script|style)>.*?</(script|style)>', '<\\1>', 'gs'), '<[a-z][a-z0-9]*[^>]*>')) AS nodes FROM pages GROUP BY html) SELECT page_id, nodes, (SELECT count(DISTINCT html) FROM pages WHERE page_id % 2 = 0) AS parsed_first, (SELECT count(DISTINCT html) FROM pages WHERE html NOT IN (SELECT html FROM pages WHERE page_id % 2 = 0)) AS parsed_then, 0 AS parsed_again FROM pages JOIN bodies USING (html)")
def s4_h1_node_table(spark, d):
    """A captured snapshot of pages, read and parsed in two crawls; a third one parses nothing."""
    home = f"{shared_folder(spark)}/nodes-{uuid.uuid4().hex}"
    table(spark, d, "pages").write.parquet(f"{home}/captured")
    pages, held = storage.read_pages(spark, f"{home}/captured"), html.NodeTable(spark, f"{home}/nodes")
    counts = [held.add(p) for p in (pages.where("page_id % 2 = 0"), pages, pages)]
    found = html.nodes_of(held.items(pages)).groupBy("page_id").agg(F.count("*").alias("nodes"))
    return found.select("page_id", "nodes", *(F.lit(n).cast("long").alias(name) for n, name in zip(counts, ("parsed_first", "parsed_then", "parsed_again"), strict=True)))


@query(f"SELECT page_id, array_to_string(list_transform(regexp_extract_all(html, '<li><a href=\"[^\"]*\">([^<]*)<', 1), lambda x: trim({_DECODE.format('x')})), '|') AS said, len(regexp_extract_all(html, '<li><a href')) AS n FROM pages WHERE contains(html, '<li><a href')")
def h2_j7_selectors(spark, d):
    items = _items(spark, d)
    found = html.select_blocks(html.nodes_of(items), ["nav li a", "article .none", "li a"]).where("rank = 0")
    said = F.transform(F.sort_array(F.collect_list(F.struct("start", "said"))), lambda x: x["said"])
    return html.with_text(found, html.texts_of(items), "said").groupBy("page_id").agg(F.array_join(said, "|").alias("said"), F.count("*").alias("n"))


@query(f"SELECT page_id, array_to_string({_PIECES.format('html')}, chr(10)) AS page_text, array_to_string({_PIECES.format("regexp_extract(html, '<article>(.*)</article>', 1, 's')")}, ' ') AS article_text FROM pages")
def h3_h4_texts(spark, d):
    items = _items(spark, d, html.DROP_FOR_TEXT)
    nodes, texts = html.nodes_of(items), html.texts_of(items)
    blocks = html.block_text(html.select_blocks(nodes, ["article"]), texts)
    return html.page_text(texts).select("page_id", F.col("text").alias("page_text")).join(blocks.select("page_id", F.col("text").alias("article_text")), "page_id", "left")


@query(f"SELECT page_id, trim({_READ.format("regexp_extract(html, '<h1>([^<]*)<', 1)")}) AS heading, count(*) AS n FROM (SELECT page_id, html, unnest(regexp_extract_all(html[strpos(html, '<h1>'):], '<p>')) FROM pages) GROUP BY page_id, html")
def h5_j8_w4_headings(spark, d):
    items = _items(spark, d)
    nodes, texts = html.nodes_of(items), html.texts_of(items)
    found = html.previous_heading(html.select_blocks(nodes, ["article p"]).select("page_id", "start", "end"), nodes, texts)
    return found.groupBy("page_id", "heading").agg(F.count("*").alias("n"))


@query(f"SELECT page_id, trim({_READ.format("regexp_extract(html, '<h1>([^<]*)<', 1)")}) AS title, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || {_READ.format("regexp_extract(html, '<a href=\"([^\"]*)\"', 1)")} AS offer_url FROM pages")
def h6_h7_titles_and_links(spark, d):
    items = _items(spark, d)
    nodes, texts = html.nodes_of(items), html.texts_of(items)
    blocks = html.select_blocks(nodes, ["body"]).select("page_id", "start", "end")
    said = nodes.where("tag = 'h1'").join(html.block_text(nodes.where("tag = 'h1'"), texts), ["page_id", "start"])
    titled = html.first_inside(blocks, said, F.lit(True), "text", "title")
    return html.first_inside(titled, html.anchors(nodes, texts, table(spark, d, "pages")), F.lit(True), "url", "offer_url").select("page_id", "title", "offer_url")


@query(f"WITH {_ANCHORS} SELECT * FROM anchors")
def h8_u2_anchors(spark, d):
    items = _items(spark, d)
    return html.anchors(html.nodes_of(items), html.texts_of(items), table(spark, d, "pages")).select("page_id", "url", "label")


@query(f"WITH {_ANCHORS}, s AS (SELECT *, {B.fold_sql("label || ' ' || url")} AS said FROM anchors) SELECT DISTINCT page_id, url FROM s WHERE (contains(said, 'the') OR contains(said, 'que') OR contains(said, 'der')) AND NOT ({' OR '.join(f"contains(said, '{m}')" for m in classify.DEFAULTS['excluded_markers'])})")
def f7_o6_child_links(spark, d):
    items = _items(spark, d)
    found = html.anchors(html.nodes_of(items), html.texts_of(items), table(spark, d, "pages"))
    rule = {c: classify.default_rule(c) for c in ("child_url_patterns", "excluded_markers")} | {"child_link_markers": F.array(F.lit("the"), F.lit("que"), F.lit("der"))}
    return classify.child_links(found.withColumns(rule))


def _rules(pages: DataFrame, **stated) -> DataFrame:
    """A rule for each slug of the pages: the defaults, but for what is stated."""
    values = classify.DEFAULTS | {"opportunity_type": "idp", "source_implies_active_type": False, "classify_link_targets": True, "title_selector": None, "offer_link_selector": None} | stated
    column = lambda v: F.array(*map(F.lit, v)).cast("array<string>") if isinstance(v, (tuple, list)) else v if isinstance(v, Column) else F.lit(v)
    return pages.select("slug").distinct().select("slug", *(column(v).alias(k) for k, v in values.items())).withColumns({c: F.col(c).cast("string") for c in ("title_selector", "offer_link_selector")})


def _hosts(spark, d):
    return table(spark, d, "pages").withColumn("slug", U.host_of(F.col("url")))


_NOISY = " OR ".join(f"contains(t, '{x}')" for x in classify.NOISE)
# The given pages' one block outside the menu is the article; its heading is h1, and it has no links.
_H9 = f"""p AS (SELECT page_id, url, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS slug, trim({_READ.format("regexp_extract(html, '<h1>([^<]*)<', 1)")}) AS title, array_to_string({_PIECES.format("regexp_extract(html, '<article>(.*)</article>', 1, 's')")}, ' ') AS source_text FROM pages),
f AS (SELECT *, {B.fold_sql('source_text')} AS said, {B.title_sql('title')} AS t FROM p),
found AS (SELECT page_id, slug, title, url AS source_url, source_text, substr(sha256(concat_ws('|', slug, url, {B.fold_sql('title')})), 1, 32) AS stable_source_key FROM f
  WHERE NOT contains(said, 'garbage') AND NOT contains(said, 'disgusting') AND (contains(said, 'the') OR contains(said, 'de') OR contains(said, 'und'))
  AND (contains(t, 'the') OR contains(t, 'de') OR contains(t, 'und')) AND NOT ({_NOISY}) AND t NOT IN {classify.GENERIC_TITLES})"""


@query(f"WITH {_H9} SELECT page_id, 1 AS ordinal, title, source_url, NULL::VARCHAR AS application_url, stable_source_key FROM found")
def h9_discover(spark, d):
    pages = _hosts(spark, d)
    rules = _rules(pages, candidate_selectors=["article", "li"], active_markers=["the", "de", "und"], archive_markers=["garbage"], excluded_markers=["disgusting"], excluded_titles=[])
    return html.discover(pages, rules).select("page_id", "ordinal", "title", "source_url", "application_url", "stable_source_key")


# Two days of crawls of all hosts. The first brings two thirds of the pages; on the second some have changed, some are gone, some are new,
# and the host's name decides how its crawl went. Titles of every seventh page state a date. Some listings have overridden titles.
# Of a source's offers with the same address and title the one with the shortest text counts, then the first; the first one's page gives the place.
_OUTCOME_OF_HOST = ("fetched", "fetched", "not_modified", "failed")
_E1 = f"""{_H9.replace("FROM pages)", "FROM dated)")},
offers AS (SELECT slug AS chair_id, stable_source_key, page_id, rtrim(source_url, '/') AS same_url, {B.fold_sql('title')} AS same_title, regexp_replace(title, '^\\[[0-9.]*\\] ', '') AS title, CASE WHEN starts_with(title, '[03.02.2024]') THEN '2024-02-03' END AS published_at, source_text FROM found),
days AS (SELECT 1 AS day, * FROM offers WHERE page_id % 3 <> 0 UNION ALL SELECT 2, * REPLACE (CASE WHEN page_id % 10 = 1 THEN source_text || ' zz' ELSE source_text END AS source_text) FROM offers WHERE page_id % 4 <> 0),
met AS (SELECT * REPLACE (min(page_id) OVER same AS page_id) FROM days WINDOW same AS (PARTITION BY day, chair_id, lower(same_url), same_title)
  QUALIFY row_number() OVER (PARTITION BY day, chair_id, lower(same_url), same_title ORDER BY length(source_text), days.page_id) = 1),
one AS (SELECT *, row_number() OVER (ORDER BY chair_id, page_id, stable_source_key) AS number FROM met WHERE day = 1),
two AS (SELECT * FROM met WHERE day = 2),
joined AS (SELECT coalesce(one.chair_id, two.chair_id) AS chair_id, coalesce(one.stable_source_key, two.stable_source_key) AS stable_source_key, coalesce(one.page_id, two.page_id) AS page_id, one.number, one.title AS old, two.title AS new,
  one.published_at AS old_date, two.published_at AS new_date, one.source_text AS old_text, two.source_text AS new_text, one.number IS NOT NULL AS known, two.page_id IS NOT NULL AS observed, one.source_text IS DISTINCT FROM two.source_text AS changed
  FROM one FULL JOIN two ON one.chair_id = two.chair_id AND one.stable_source_key = two.stable_source_key),
run AS (SELECT *, ['success', 'partial', 'not_modified', 'failed'][length(chair_id) % 4 + 1] AS status FROM joined),
seen AS (SELECT *, observed AND status IN ('success', 'partial') AS taken FROM run),
e1 AS (SELECT *, CASE WHEN taken AND NOT known THEN 'created' WHEN taken AND changed THEN 'updated' WHEN taken THEN 'unchanged' WHEN status = 'success' THEN 'missed' WHEN status = 'not_modified' THEN 'refreshed' ELSE 'kept' END AS action,
  (SELECT count(*) FROM one) + row_number() OVER (PARTITION BY taken AND NOT known ORDER BY chair_id, page_id, stable_source_key) AS next FROM seen WHERE known OR taken)"""
_DATED = f"dated AS (SELECT page_id, url, CASE WHEN page_id % 7 = 0 THEN replace(html, '<h1>', '<h1>[03.02.2024] ') ELSE html END AS html FROM pages)"


def _two_days(spark, d) -> ingest.Ingested:
    dated = F.when(F.col("page_id") % 7 == 0, F.replace("html", F.lit("<h1>"), F.lit("<h1>[03.02.2024] "))).otherwise(F.col("html"))
    pages = _hosts(spark, d).select("page_id", "url", "slug", F.col("page_id").alias("position"), dated.alias("html"))
    rules = _rules(pages, candidate_selectors=["article", "li"], active_markers=["the", "de", "und"], archive_markers=["garbage"], excluded_markers=["disgusting"], excluded_titles=[])
    hosts = pages.select("slug").distinct()
    nothing = lambda schema: spark.createDataFrame([], schema)
    day = lambda n: F.lit(f"2024-03-0{n} 03:00:00").cast("timestamp").alias("now")
    failures, artifacts, log = "slug string, url string, error string", "source_id string, content_hash string", "listing_id string, field string, value string, created_at long, id long"
    first = ingest.ingest(pages.where("page_id % 3 <> 0"), hosts.select("slug", F.lit("fetched").alias("outcome"), day(1)), nothing(failures), rules, nothing(ingest.LISTINGS), nothing(artifacts), nothing(log))
    changed = F.when(F.col("page_id") % 10 == 1, F.replace("html", F.lit("</article>"), F.lit(" zz</article>"))).otherwise(F.col("html"))
    outcome = F.element_at(F.array(*map(F.lit, _OUTCOME_OF_HOST)), (F.length("slug") % 4 + 1).cast("int"))
    broken = hosts.where("length(slug) % 4 = 1").select("slug", F.concat(F.lit("http://"), "slug", F.lit("/x")).alias("url"), F.lit("gone").alias("error"))
    key = F.col("stable_source_key")
    kept = first.listings.where(F.substring(key, 1, 1) < "4").select(T.listing_slug(F.col("chair_id"), key).alias("listing_id"), F.lit("title").alias("field"), F.to_json(F.struct(F.concat(F.lit("Kept "), F.substring(key, 1, 4)).alias("value"))).alias("value"), F.lit(1).cast("long").alias("created_at"), F.lit(1).cast("long").alias("id"))
    stored = first.artifacts.select("source_id", "content_hash")
    return ingest.ingest(pages.where("page_id % 4 <> 0").withColumn("html", changed), hosts.select("slug", outcome.alias("outcome"), day(2)), broken, rules, first.listings.drop("action"), stored, kept)


@query(f"""WITH {_DATED}, {_E1} SELECT chair_id, stable_source_key, CASE WHEN taken AND known AND substr(stable_source_key, 1, 1) < '4' THEN 'Kept ' || substr(stable_source_key, 1, 4) WHEN taken THEN new ELSE old END AS title,
  sha256(regexp_replace(substr(CASE WHEN taken THEN new_text ELSE old_text END, 1, 3000), '^\\[03[.]02[.]2024\\] ', '')) AS summary, CASE WHEN taken THEN new_date ELSE old_date END AS published_at, 'active' AS status, (CASE WHEN action = 'missed' THEN 1 ELSE 0 END)::INTEGER AS consecutive_misses,
  'idp-' || CASE WHEN coalesce(number, next) < 1000 THEN lpad(coalesce(number, next)::VARCHAR, 3, '0') ELSE coalesce(number, next)::VARCHAR END AS reference_code, action FROM e1""")
def e1_ingestion(spark, d):
    found = _two_days(spark, d).listings
    return found.select("chair_id", "stable_source_key", "title", F.sha2("summary", 256).alias("summary"), F.col("published_at").cast("string").alias("published_at"), "status", "consecutive_misses", "reference_code", "action")


@query(f"""WITH {_DATED}, {_E1}, hosts AS (SELECT DISTINCT lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS chair_id FROM pages), bodies AS (SELECT lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS chair_id, count(*) AS n FROM pages WHERE page_id % 4 <> 0 GROUP BY 1),
counts AS (SELECT chair_id, {", ".join(f"count(*) FILTER (WHERE action = '{a}') AS {a}" for a in ("created", "updated", "unchanged", "missed", "archived"))} FROM e1 GROUP BY chair_id)
SELECT chair_id, ['success', 'partial', 'not_modified', 'failed'][length(chair_id) % 4 + 1] AS run_status, coalesce(created + updated + unchanged, 0) AS candidates, {", ".join(f"coalesce({a}, 0) AS {a}" for a in ("created", "updated", "unchanged", "missed", "archived"))},
  CASE WHEN length(chair_id) % 4 < 2 THEN coalesce(n, 0) ELSE 0 END AS artifacts, CASE WHEN length(chair_id) % 4 = 1 THEN '[{{"url":"http://' || chair_id || '/x","error":"gone"}}]' ELSE '[]' END AS failures FROM hosts LEFT JOIN counts USING (chair_id) LEFT JOIN bodies USING (chair_id)""")
def e1_a5_statistics(spark, d):
    return _two_days(spark, d).statistics.withColumn("failures", F.to_json("failures"))


# Odd hosts name selectors, of which the title is all of the first bold text and the link the first one of the menu; even ones do not.
_ODD = "length(slug) % 2 = 1"


@query(f"""WITH p AS (SELECT page_id, url, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS slug, html, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS origin FROM pages),
f AS (SELECT *, {_READ.format("regexp_extract(html, '<h1>([^<]*)<', 1)")} AS h1, origin || {_READ.format("regexp_extract(html, '<li><a href=\"([^\"]*)\"', 1)")} AS first_link, trim({_READ.format("regexp_extract(html, '<li><a href=\"[^\"]*\">([^<]*)<', 1)")}) AS first_label FROM p)
SELECT page_id, CASE WHEN {_ODD} THEN first_label ELSE trim(h1) END AS title, first_link AS application_url FROM f""")
def h6_h7_h9_selectors(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url", U.host_of(F.col("url")).alias("slug"), F.replace(F.replace("html", F.lit("<nav>"), F.lit("<section>")), F.lit("</nav>"), F.lit("</section>")).alias("html"))
    chosen = lambda selector: F.when(F.expr(_ODD), selector)
    rules = _rules(pages, candidate_selectors=["body"], active_markers=[], archive_markers=[], excluded_markers=[], source_implies_active_type=True, title_selector=chosen("section li a"), offer_link_selector=chosen("li a"))
    return html.discover(pages, rules).select("page_id", "title", "application_url")


@query(f"SELECT page_id, ['text/html', 'text/plain', 'image/png'][page_id % 3 + 1] AS media, CASE page_id % 3 WHEN 0 THEN array_to_string({_PIECES.format('html')}, chr(10)) WHEN 1 THEN html END AS text, CASE WHEN page_id % 3 = 2 THEN 'unsupported media type: image/png' END AS error FROM pages")
def h10_extract_text(spark, d):
    pages = table(spark, d, "pages").withColumn("media_type", F.element_at(F.array(*map(F.lit, ("text/html; charset=utf-8", "text/plain", "image/png"))), (F.col("page_id") % 3 + 1).cast("int")))
    return html.extract_text(pages)


@query("WITH l AS (SELECT DISTINCT l_partkey AS a, l_suppkey + 50 AS b FROM lineitem), s AS (SELECT p_partkey AS k FROM part WHERE p_partkey % 3 <> 0), zero AS (SELECT p_partkey AS start, p_partkey AS url FROM part), one AS (SELECT DISTINCT start, b AS url FROM zero JOIN s ON url = k JOIN l ON a = url WHERE b <> start), two AS (SELECT DISTINCT start, b AS url FROM one JOIN s ON url = k JOIN l ON a = url WHERE b <> start EXCEPT SELECT * FROM one), every AS (SELECT *, 0 AS depth FROM zero UNION ALL SELECT *, 1 FROM one UNION ALL SELECT *, 2 FROM two) SELECT start, url, depth, url IN (SELECT k FROM s) AS found FROM every")
def h11_j11_expand(spark, d):
    part = table(spark, d, "part").select(F.col("p_partkey").alias("url"))
    links = table(spark, d, "lineitem").select(F.col("l_partkey").alias("from_url"), (F.col("l_suppkey") + 50).alias("url"))
    return html.expand_links(part, links, part.where("url % 3 <> 0"))


# ---- Streams: the log in several bounded batches, then what the last of them left.


def _stream(spark, d, make=None, each=None, mixed=False) -> DataFrame:
    """Runs a stream over the events, a third of them in each batch, and returns all rows that it wrote.

    The thirds follow each other in time, or else times are mixed, and a last event far behind the others (user -1) lets time go on.
    """
    home = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    log = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    cuts = runs.quantiles(log, "ts", (1, 2), 3)
    third = F.pmod("event_id", F.lit(3)) if mixed else sum((F.when(F.col("ts") > c, 1).otherwise(0) for c in cuts), F.lit(0))
    own = spark.newSession()  # stateful processors need a state store that other queries need not have
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(name, spark.conf.get(name))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    log.limit(0).write.parquet(f"{home}/in")  # a stream's folder must be there
    events = own.readStream.schema(log.schema).parquet(f"{home}/in")
    if each:
        stream_of, mode, keep = events, "append", each(f"{home}/out")
    else:
        stream_of, mode = make(events)
        keep = lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{home}/out/version={n:012d}")
    for n in range(len(cuts) + 1):  # a batch takes up what has arrived since the one before
        rows = log.where(third == n)
        if mixed and n == len(cuts):
            end = log.agg((F.max("ts") + F.expr("interval 3000 days")).alias("ts"), F.lit(-1).cast("long").alias("user_id"))
            rows = rows.unionByName(end.select(*((F.col(c) if c in end.columns else F.lit(None).cast(kind)).alias(c) for c, kind in log.dtypes)))
        rows.write.mode("append").parquet(f"{home}/in")
        stream_of.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start().awaitTermination()
    for part in ("in", "state"):
        remove(spark, f"{home}/{part}")
    return CommittedTable(spark, f"{home}/out").read() if each else spark.read.parquet(f"{home}/out")


@query(_L1.replace("SELECT user_id, status, m::INTEGER", "SELECT user_id::VARCHAR AS source_id, 'k' AS key, status, m::INTEGER"))
def t1_t4_lifecycle_stream(spark, d):
    rows = _stream(spark, d, lambda e: (stream.lifecycle(e.select(F.col("user_id").cast("string").alias("source_id"), F.lit("k").alias("key"), "event_id", "ts", F.expr(_OUTCOMES).alias("outcome"))), "update"))
    return reconcile.latest_by(rows.withColumn("id", F.concat_ws("|", "source_id", "key")), "id", "batch").select("source_id", "key", "status", "consecutive_misses")


# Each batch is a run of every user whose events it holds: an error fails it, and any other event's kind is a listing that it saw.
_T4 = """WITH RECURSIVE c AS (SELECT event_id, user_id, event_type, ts, ntile(1) OVER () AS one, quantile_disc(ts, 1/3.0) OVER () AS low, quantile_disc(ts, 2/3.0) OVER () AS high FROM events),
e AS (SELECT user_id, event_type, (ts > low)::INTEGER + (ts > high)::INTEGER AS batch FROM c),
run AS (SELECT user_id, batch, bool_or(event_type = 'error') AS failed FROM e GROUP BY ALL),
saw AS (SELECT DISTINCT user_id, batch, event_type AS key FROM e WHERE event_type <> 'error'),
keys AS (SELECT DISTINCT user_id, key FROM saw),
w AS (SELECT user_id, key, -1 AS batch, NULL::VARCHAR AS status, 0 AS m FROM keys UNION ALL
SELECT w.user_id, w.key, w.batch + 1, CASE WHEN r.failed IS DISTINCT FROM false THEN status WHEN s.key IS NOT NULL THEN 'active' WHEN status = 'active' AND m + 1 >= 2 THEN 'archived' ELSE status END,
  CASE WHEN r.failed IS DISTINCT FROM false THEN m WHEN s.key IS NOT NULL THEN 0 WHEN status = 'active' THEN m + 1 ELSE m END
FROM w LEFT JOIN run r ON r.user_id = w.user_id AND r.batch = w.batch + 1 LEFT JOIN saw s ON s.user_id = w.user_id AND s.key = w.key AND s.batch = w.batch + 1 WHERE w.batch < 2)
SELECT user_id AS chair_id, key AS stable_source_key, status, m::INTEGER AS consecutive_misses FROM w WHERE batch = 2 AND status IS NOT NULL"""
_LISTED = "chair_id long, stable_source_key string, title string, summary string, content_hash string, published_at date, status string, consecutive_misses int, first_seen_at timestamp, last_seen_at timestamp"


@query(_T4)
def t4_reconcile_stream(spark, d):
    observed = lambda batch: batch.where("event_type <> 'error'").select(F.col("user_id").alias("chair_id"), F.col("event_type").alias("stable_source_key"), *(F.lit(x).cast("string").alias(c) for c, x in (("title", "t"), ("summary", None), ("content_hash", "h"))), F.lit(None).cast("date").alias("published_at")).distinct()
    runs_of = lambda batch: batch.groupBy(F.col("user_id").alias("chair_id")).agg(F.when(F.bool_or(F.col("event_type") == "error"), "failed").otherwise("success").alias("run_status"), F.max("ts").alias("now"))
    rows = _stream(spark, d, each=lambda root: stream.reconcile_onto(observed, runs_of, root, _LISTED))
    return rows.select("chair_id", "stable_source_key", "status", "consecutive_misses")


@query(f"WITH {B.RUNS}, {_STREAK} SELECT source_id::VARCHAR AS source_id, consecutive_failures FROM streaks")
def t2_streak_stream(spark, d):
    status = F.create_map(*(F.lit(x) for kv in B.OUTCOME.items() for x in kv))[F.col("event_type")]
    rows = _stream(spark, d, lambda e: (stream.streaks(e.select(F.col("user_id").cast("string").alias("source_id"), "event_id", "ts", status.alias("status"))), "update"))
    return reconcile.latest_by(rows, "source_id", "batch").select("source_id", "consecutive_failures")


@query(_L1.replace("SELECT user_id, status, m::INTEGER", "SELECT user_id::VARCHAR AS source_id, 'k' AS key, status, m::INTEGER"))
def t1_lifecycle_in_time(spark, d):
    """Events arrive in any order; what they come to is the replay in the order of their times."""
    events = lambda e: e.select(F.col("user_id").cast("string").alias("source_id"), F.lit("k").alias("key"), "event_id", "ts", F.expr(_OUTCOMES).alias("outcome"))
    rows = _stream(spark, d, lambda e: (stream.lifecycle_in_time(events(e), "2000 days"), "update"), mixed=True)
    kept = rows.where("late_event_id is null and source_id <> '-1'").withColumn("id", F.concat_ws("|", "source_id", "key"))
    return reconcile.latest_by(kept, "id", "batch").select("source_id", "key", "status", "consecutive_misses")


@query(f"WITH {B.RUNS}, {_STREAK} SELECT source_id::VARCHAR AS source_id, consecutive_failures FROM streaks")
def t2_streaks_in_time(spark, d):
    status = F.create_map(*(F.lit(x) for kv in B.OUTCOME.items() for x in kv))[F.col("event_type")]
    rows = _stream(spark, d, lambda e: (stream.streaks_in_time(e.select(F.col("user_id").cast("string").alias("source_id"), "event_id", "ts", status.alias("status")), "2000 days"), "update"), mixed=True)
    return reconcile.latest_by(rows.where("late_event_id is null and source_id <> '-1'"), "source_id", "batch").select("source_id", "consecutive_failures")


@query("SELECT DISTINCT user_id AS source_id, props AS content_hash FROM events")
def t3_artifact_stream(spark, d):
    return _stream(spark, d, lambda e: (stream.new_artifacts(e.select(F.col("user_id").alias("source_id"), F.col("props").alias("content_hash"), "ts")), "append")).select("source_id", "content_hash")


@query("SELECT (ts::DATE)::VARCHAR AS day, event_type AS status, count(*) AS n FROM events GROUP BY ALL")
def t5_daily_stream(spark, d):
    rows = _stream(spark, d, lambda e: (stream.daily_outcomes(e.withColumnRenamed("event_type", "status")), "update"))
    return rows.groupBy(F.col("day").cast("string").alias("day"), "status").agg(F.max_by("n", "batch").alias("n"))


@query("SELECT (date_trunc('week', ts)::DATE)::VARCHAR AS week, event_type AS status, count(*) AS n FROM events GROUP BY ALL")
def t5_weekly_stream(spark, d):
    rows = _stream(spark, d, lambda e: (stream.weekly_outcomes(e.withColumnRenamed("event_type", "status"), "60 days"), "update"))
    return rows.groupBy(F.col("week").cast("string").alias("week"), "status").agg(F.max_by("n", "batch").alias("n"))


# ---- Sources and sinks: tables written in the forms that are read, and read again.


@query("SELECT s_name AS chair_name, 'https://s' || s_suppkey || '.example/' AS project_study_url, s_nationkey::VARCHAR AS department FROM supplier")
def s1_inventory(spark, d):
    home = f"{shared_folder(spark)}/inventory-{uuid.uuid4().hex}"
    records = F.struct(F.col("s_name").alias("chair_name"), F.concat(F.lit("https://s"), "s_suppkey", F.lit(".example/")).alias("project_study_url"), F.col("s_nationkey").cast("string").alias("department"))
    table(spark, d, "supplier").agg(F.to_json(F.collect_list(records)).alias("value")).write.text(home)  # an inventory is one JSON array
    return inventory.read_inventory(spark, home, ("chair_name", "project_study_url", "department"), table(spark, d, "supplier").count())


@query(f"SELECT trim(regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug, CASE s_suppkey % 3 WHEN 0 THEN '.x|li' ELSE '{'|'.join(classify.DEFAULTS['candidate_selectors'])}' END AS selectors, s_suppkey % 3 <> 0 AS excludes_idp, CASE s_suppkey % 3 WHEN 0 THEN 'h2 a' END AS title_selector, 'typo3' AS family FROM supplier")
def s2_rules(spark, d):
    suppliers = table(spark, d, "supplier")
    rows = suppliers.select(F.col("s_name").alias("chair_name"), F.concat(F.lit("https://s"), "s_suppkey", F.lit(".example/")).alias("project_study_url"))
    overrides = suppliers.where("s_suppkey % 3 = 0").select(F.col("s_name").alias("chair_name"), F.array(F.lit("idp")).alias("drop_excluded"), F.array(F.lit(".x"), F.lit("li")).alias("candidate_selectors"), F.lit("h2 a").alias("title_selector"))
    rules = inventory.build_rules(rows, overrides)
    return rules.select("slug", F.array_join("candidate_selectors", "|").alias("selectors"), F.array_contains("excluded_markers", "idp").alias("excludes_idp"), "title_selector", "family")


@query("SELECT 'u' || p_partkey AS source_url, 'school' AS school_slug, CASE WHEN p_partkey % 2 = 0 THEN p_name || ', ' || p_brand ELSE p_name END AS school, 'd-' || p_partkey AS department_slug, array_to_string(list_transform(range(p_size), lambda i: 'Part ' || i), ', ') AS department FROM part WHERE p_size > 0")
def s3_hierarchy(spark, d):
    home = f"{shared_folder(spark)}/hierarchy-{uuid.uuid4().hex}"
    name = F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", F.lit(", "), "p_brand")).otherwise(F.col("p_name"))
    named = F.array_join(F.transform(F.sequence(F.lit(0), F.col("p_size") - 1), lambda i: F.concat(F.lit("Part "), i)), ", ")
    line = F.concat_ws(",", F.lit("school"), F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit('"'), name, F.lit('"'))).otherwise(name), F.concat(F.lit("d-"), "p_partkey"), named, F.concat(F.lit("u"), "p_partkey"))
    table(spark, d, "part").where("p_size > 0").select(line.alias("value")).write.text(home)
    return inventory.read_hierarchy(spark, home)[0]


@query("WITH k AS (SELECT DISTINCT source AS source_id, sha256(text) AS content_hash FROM documents) SELECT *, (SELECT count(*) FROM k) AS stored FROM k")
def s8_appended(spark, d):
    home = f"{shared_folder(spark)}/appended-{uuid.uuid4().hex}"
    rows = table(spark, d, "documents").select("doc_id", F.col("source").alias("source_id"), F.sha2("text", 256).alias("content_hash"))
    keys = ["source_id", "content_hash"]
    for n, part in enumerate(("doc_id % 2 = 0", "true", "true")):
        storage.append_new(rows.where(part).select(*keys), f"{home}/log", keys, ("query", min(n, 1)))  # the last batch is a repeated one
    found = CommittedTable(spark, f"{home}/log").read()
    storage.write_snapshot(found.withColumn("stored", F.lit(found.count()).cast("long")), f"{home}/snapshots")
    return CommittedTable(spark, f"{home}/snapshots").read()


@query("WITH k AS (SELECT source AS source_id, sha256(text) AS content_hash, min(doc_id % 3) AS version FROM documents GROUP BY ALL) SELECT source_id, content_hash, version, (SELECT count(*) FROM k) AS newest, (SELECT count(*) FROM k WHERE version = 0) AS oldest FROM k WHERE version < 2")
def s8_versions(spark, d):
    """Three batches, each repeated; the version before the newest is read, with the other versions' sizes."""
    rows = table(spark, d, "documents").select((F.col("doc_id") % 3).alias("version"), F.col("source").alias("source_id"), F.sha2("text", 256).alias("content_hash"))
    made = CommittedTable(spark, f"{shared_folder(spark)}/versions-{uuid.uuid4().hex}")
    for n in (0, 0, 1, 1, 2):
        made.append_new(rows.where(F.col("version") == n), ["source_id", "content_hash"], ("query", n))
    oldest, before, newest = made.versions()
    sizes = [F.lit(made.read(v).count()).cast("long").alias(name) for v, name in ((newest, "newest"), (oldest, "oldest"))]
    return made.read(before).select("source_id", "content_hash", "version", *sizes)


_STORED = ("reference_code", "title", "summary", "chair")


@query(f"WITH {B.CATALOG}, q AS (SELECT unnest(['total 12', 'ps-1002', 'customer#000000007']) AS query) SELECT query, id, title FROM catalog, q WHERE contains(lower(reference_code || ' ' || title || ' ' || coalesce(summary, '') || ' ' || chair), query)")
def f3_stored_search(spark, d):
    """The catalogue stored with its index, and what three searches find in it."""
    made = CommittedTable(spark, f"{shared_folder(spark)}/catalog-{uuid.uuid4().hex}")
    textindex.write_searchable(made, _catalog(spark, d).select("id", "slug", *_STORED), "slug", _STORED)
    found = [textindex.search_stored(made, q, _STORED).select(F.lit(q.lower()).alias("query"), "id", "title") for q in ("Total 12", "PS-1002", "Customer#000000007")]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query(f"WITH {B.CATALOG}, n AS (SELECT count(*) AS total FROM catalog) SELECT slug, title FROM catalog ORDER BY lower(title), slug LIMIT 100 OFFSET (SELECT (greatest(1, (total + 99) // 100) - 1) * 100 FROM n)")
def o4_page_beyond_the_last(spark, d):
    return catalog.page_or_last(_catalog(spark, d), "title", 1 << 40, 100).select("slug", "title")


@query("SELECT DISTINCT c_nationkey AS department FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 0)")
def x3_shared_departments(spark, d):
    with_chairs, with_offers = table(spark, d, "customer").select(F.col("c_nationkey").alias("department")), table(spark, d, "supplier").where("s_acctbal > 0").select("s_nationkey")
    return with_chairs.intersect(with_offers)


@query("WITH t AS (SELECT DISTINCT lower(w) AS term FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) WHERE length(w) > 3) SELECT doc_id, array_to_string(list_sort(list_filter((SELECT list(term) FROM t), lambda x: contains(lower(text), x))), ',') AS terms FROM documents")
def j9_terms(spark, d):
    words = table(spark, d, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("term")).where(F.length("term") > 3).distinct()
    docs = table(spark, d, "documents").select("doc_id", F.lower("text").alias("said"))
    return classify.with_terms(docs, "said", words).select("doc_id", F.array_join("terms", ",").alias("terms"))


# A term stands in a document if it stands in one of its words, whose parts are looked up.
@query("""WITH said AS (SELECT DISTINCT doc_id, w FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents)), words AS (SELECT DISTINCT w FROM said WHERE length(w) > 2),
parts AS (SELECT DISTINCT w, substr(w, i, n) AS term FROM (SELECT w, i, unnest(range(3, length(w) - i + 2)) AS n FROM (SELECT w, unnest(range(1, length(w) - 1)) AS i FROM words))),
inside AS (SELECT p.w, term FROM parts p JOIN words ON term = words.w), found AS (SELECT doc_id, list_sort(list(DISTINCT term)) AS terms FROM said JOIN inside USING (w) GROUP BY doc_id)
SELECT doc_id, coalesce(len(terms), 0) AS n_terms, sha256(coalesce(array_to_string(terms, ','), '')) AS terms FROM documents LEFT JOIN found USING (doc_id)""")
def j9_every_word(spark, d):
    """Which of all words of all documents each document holds, also inside other words."""
    docs = table(spark, d, "documents").select("doc_id", F.lower("text").alias("said"))
    words = docs.select(F.explode(F.regexp_extract_all("said", F.lit("[a-z]+"), F.lit(0))).alias("term")).where(F.length("term") > 2)
    return classify.with_terms(docs, "said", words).select("doc_id", F.size("terms").cast("long").alias("n_terms"), F.sha2(F.array_join("terms", ","), 256).alias("terms"))


@query(f"WITH {B.CATALOG}, n AS (SELECT (count(*) // 200) * 100 AS half FROM catalog), numbered AS (SELECT slug, title, row_number() OVER (ORDER BY lower(title), slug) AS place FROM catalog) SELECT slug, title, place - half AS place FROM numbered, n WHERE place > half AND place <= half + 200")
def o3_deep_pages(spark, d):
    """A page in the middle of all, and the page behind its last row."""
    pages = catalog.Pages(_catalog(spark, d), "title")
    middle = pages.page(pages.total // 200 + 1, 100)
    first = [r["slug"] for r in middle.collect()]
    both = middle.unionByName(pages.after(first[-1], 100))
    return both.select("slug", "title", F.row_number().over(Window.orderBy(F.lower("title"), "slug")).cast("long").alias("place"))  # 200 rows


@query(f"WITH {B.CATALOG} SELECT id, chair FROM catalog WHERE department IN (SELECT n_name FROM nation)")
def f10_known_selection(spark, d):
    names = [r[0] for r in B.departments(spark, d).select("name").collect()]  # 25; an unknown one would be an error
    return catalog.select_named(_catalog(spark, d), "department", names).select("id", "chair")
