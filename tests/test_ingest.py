"""A day's ingestion: what a crawl may do to the listings, and what stays whatever it says."""

import datetime as dt

from sievework.operators import html, ingest
from sievework.sources import inventory

PAGE = "<article><h3>[03/02/2024] Project study {n}</h3><p>{text}</p><a href='/offer/{n}'>Project study</a></article>"
PAGES, CRAWLS = "page_id long, url string, slug string, position long, html string", "slug string, outcome string, now timestamp"
FAILURES, ARTIFACTS, LOG = "slug string, url string, error string", "source_id string, content_hash string", "listing_id string, field string, value string, created_at long, id long"


def day(spark, state, offers, outcome="fetched", failures=(), log=(), n=1, held=None):
    body = "<html>" + "".join(PAGE.format(n=k, text=t) for k, t in offers) + "</html>"
    pages = spark.createDataFrame([(n, "https://a.example/", "s", 0, body), (100 + n, "https://a.example/child", "s", 1, "<p>nothing</p>")], PAGES)
    rules = inventory.build_rules(spark.createDataFrame([("s", "https://a.example/")], "chair_name string, project_study_url string"), spark.createDataFrame([("s", ["x"])], "chair_name string, drop_excluded array<string>"))
    crawls = spark.createDataFrame([("s", outcome, dt.datetime(2024, 3, n)), ("other", "failed", dt.datetime(2024, 3, n))], CRAWLS)
    listings, artifacts = state or (spark.createDataFrame([], ingest.LISTINGS), spark.createDataFrame([], ARTIFACTS))
    out = ingest.ingest(pages, crawls, spark.createDataFrame(list(failures), FAILURES), rules, listings, artifacts, spark.createDataFrame(list(log), LOG))
    after = out.listings.drop("action").cache()
    stored = artifacts.unionByName(out.artifacts.select("source_id", "content_hash")).cache()
    return (after, stored), out


def shown(out):
    return sorted((r["title"], r["status"], r["consecutive_misses"], r["action"], r["reference_code"]) for r in out.listings.collect())


def test_days_of_a_source(spark):
    state, out = day(spark, None, [(1, "one"), (2, "two")])
    assert shown(out) == [("Project study 1", "active", 0, "created", "ps-001"), ("Project study 2", "active", 0, "created", "ps-002")]
    first = out.listings.where("title = 'Project study 1'").first()
    assert str(first["published_at"]) == "2024-02-03" and first["summary"].startswith("Project study 1 one")
    made = sorted(out.versions.select("extracted", "evidence").collect())
    assert len(made) == 2 and '"page_url":"https://a.example/"' in made[0][0] and '"source_url":"https://a.example/offer/1"' in made[0][1]
    stats = {r["chair_id"]: r.asDict() for r in out.statistics.collect()}
    assert (stats["s"]["run_status"], stats["s"]["created"], stats["s"]["artifacts"], stats["other"]["run_status"], stats["other"]["candidates"]) == ("success", 2, 2, "failed", 0)

    slug = f"s-{first['stable_source_key'][:10]}"
    log = [(slug, "title", '{"value": "Ours"}', 1, 1), (slug, "title", '{"value": 7}', 2, 2)]
    state, out = day(spark, state, [(1, "one more"), (3, "three")], log=log, n=2)
    assert shown(out) == [("Ours", "active", 0, "updated", "ps-001"), ("Project study 2", "active", 1, "missed", "ps-002"), ("Project study 3", "active", 0, "created", "ps-003")]
    assert out.artifacts.count() == 1  # the child has not changed

    state, out = day(spark, state, [(3, "three")], failures=[("s", "https://a.example/b", "e" * 2000)], n=4)
    assert {x[3] for x in shown(out)} == {"kept", "unchanged"}  # a partial crawl counts no misses
    run = out.statistics.where("chair_id = 's'").first()
    assert run["run_status"] == "partial" and [len(f["error"]) for f in run["failures"]] == [1500]
    state, out = day(spark, state, [(3, "three")], n=5)
    assert [(x[1], x[2], x[3]) for x in shown(out)] == [("active", 1, "missed"), ("archived", 2, "archived"), ("active", 0, "unchanged")]


def test_bodies_are_parsed_once(spark, tmp_path):
    pages = spark.createDataFrame([(1, "<p class='x' id='y'>a</p>"), (2, "<p class='x' id='y'>a</p>"), (3, ""), (4, None), (5, "<li>b")], "page_id long, html string")
    held = html.NodeTable(spark, f"{tmp_path}/n")
    assert held.add(pages.where("page_id < 4")) == 2 and held.add(pages) == 1 and held.add(pages) == 0 and held.table.versions() == [0, 1]
    plain = html.explode_nodes(pages)
    rows = lambda df: sorted(map(str, df.select(*plain.columns).collect()))
    assert rows(held.items(pages)) == rows(plain)


def test_discovery_from_held_nodes(spark, tmp_path):
    pages = spark.createDataFrame([(1, "https://a.example/", "s", 0, PAGE.format(n=1, text="t"))], PAGES)
    rules = inventory.build_rules(spark.createDataFrame([("s", "https://a.example/")], "chair_name string, project_study_url string"), spark.createDataFrame([("s", ["x"])], "chair_name string, drop_excluded array<string>"))
    held = html.NodeTable(spark, f"{tmp_path}/n", html.DROP_FOR_DISCOVERY)
    a, b = html.discover(pages, rules).collect(), html.discover(pages, rules, held=held).collect()
    assert a == b and len(a) == 1 and held.table.versions() == [0]
    assert html.discover(pages, rules, held=held).collect() == a and held.table.versions() == [0]
