"""Relational operators against folds over their rows, and pages against trees read by hand."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from sievework.functions import urls
from sievework.operators import alerts, catalog, classify, html, policy, quality, reconcile, runs
from sievework.sources import inventory, storage
from sievework.sources.commits import CommittedTable
from sievework.streaming import runs as stream


def normal(title):
    return " ".join(title.lower().replace("&", " ").replace("/", " ").split()).strip(":")


def test_dedup_is_the_sequential_fold(spark):
    rng = random.Random(1)
    rows = [(rng.randint(0, 2), "s", i, rng.choice(["A & B", "a b", "C:", "c"]), rng.choice(["http://x/", "http://X", "http://y"]), rng.choice([None, "u"]), "t" * rng.randint(1, 4)) for i in range(120)]
    frame = spark.createDataFrame(rows, "page_id int, slug string, ordinal int, title string, source_url string, application_url string, source_text string")
    kept, across = {}, {}
    for page, slug, i, title, url, link, text in rows:
        old = kept.get((page, normal(title)))
        if old is None or (link and not old[1]) or (bool(link) == bool(old[1]) and len(text) < len(old[2])):
            kept[page, normal(title)] = (i, link, text)
        key = (slug, url.rstrip("/").lower(), " ".join(title.lower().split()))
        if key not in across or len(text) < len(across[key][1]):
            across[key] = (i, text)
    assert {r["ordinal"] for r in reconcile.dedup_titles(frame).collect()} == {k[0] for k in kept.values()}
    assert {r["ordinal"] for r in reconcile.dedup_across_pages(frame).collect()} == {k[0] for k in across.values()}


CURRENT = "chair_id int, stable_source_key string, title string, summary string, content_hash string, status string, consecutive_misses int, published_at date, first_seen_at timestamp, last_seen_at timestamp"
T0, NOW = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)


@pytest.mark.parametrize(
    ("run", "seen", "status", "misses", "want"),
    [
        ("success", True, "archived", 2, ("active", 0, "updated")),
        ("partial", True, None, 0, ("active", 0, "created")),
        ("success", False, "active", 0, ("active", 1, "missed")),
        ("success", False, "active", 1, ("archived", 2, "archived")),
        ("success", False, "archived", 2, ("archived", 2, "kept")),
        ("success", False, "pending_review", 0, ("pending_review", 0, "kept")),
        ("partial", False, "active", 1, ("active", 1, "kept")),
        ("not_modified", False, "active", 1, ("active", 0, "refreshed")),
        ("not_modified", False, "archived", 2, ("archived", 2, "kept")),
        ("failed", True, "active", 1, ("active", 1, "kept")),
        ("skipped", False, "active", 1, ("active", 1, "kept")),
    ],
)
def test_reconcile_truth_table(spark, run, seen, status, misses, want):
    current = spark.createDataFrame([(1, "k", "t", None, "h", status, misses, None, T0, T0)] if status else [], CURRENT)
    observed = spark.createDataFrame([(1, "k", "new", None, "h2", None)] if seen else [], "chair_id int, stable_source_key string, title string, summary string, content_hash string, published_at date")
    log = spark.createDataFrame([(1, run, NOW)], "chair_id int, run_status string, now timestamp")
    rows = reconcile.reconcile(current, observed, log).collect()
    assert [(r["status"], r["consecutive_misses"], r["action"]) for r in rows] == [want]
    assert rows[0]["last_seen_at"] == (NOW if want[2] in ("created", "updated", "refreshed") else T0)


def test_a_failed_run_creates_nothing(spark):
    observed = spark.createDataFrame([(1, "k", "new", None, "h2", None)], "chair_id int, stable_source_key string, title string, summary string, content_hash string, published_at date")
    log = spark.createDataFrame([(1, "failed", NOW)], "chair_id int, run_status string, now timestamp")
    assert reconcile.reconcile(spark.createDataFrame([], CURRENT), observed, log).count() == 0


def test_replay_is_the_step_by_step_fold(spark):
    rng = random.Random(2)
    events = [(k, t, rng.choice(["seen", "missed", "missed", "not_modified", "other"])) for k in range(60) for t in range(rng.randint(1, 12))]
    want = {}
    for k, _, outcome in events:
        if k in want or outcome == "seen":
            want[k] = stream.step(*want.get(k, ("", 0)), outcome)
    got = reconcile.replay_lifecycle(spark.createDataFrame(events, "key int, ts int, outcome string")).collect()
    assert {r["key"]: (r["status"], r["consecutive_misses"]) for r in got} == want


def test_overrides_keep_the_newest_valid_value(spark):
    log = [("1", "L", "title", '{"value": " Old "}', 1), ("2", "L", "title", '{"value": "  "}', 2), ("3", "L", "title", '{"value": 5}', 3), ("4", "L", "title", "broken", 4), ("5", "L", "summary", '{"value": "S"}', 1), ("6", "L", "other", '{"value": "x"}', 9)]
    rows = spark.createDataFrame(log, "id string, listing_id string, field string, value string, created_at int")
    found = reconcile.overrides(rows)
    assert [tuple(r) for r in found.collect()] == [("L", "Old", "S")]
    base = spark.createDataFrame([("L", "t", "s"), ("M", "t", None)], "listing_id string, title string, summary string")
    assert sorted(map(tuple, reconcile.with_overrides(base, found).collect())) == [("L", "Old", "S"), ("M", "t", None)]


def test_reference_codes_go_on_after_the_largest(spark):
    stored = spark.createDataFrame([("ps-041",), ("ps-x9",), ("idp-002",), (None,)], "reference_code string")
    rows = spark.createDataFrame([("ps", 2), ("ps", 1), ("idp", 1), ("new", 5)], "prefix string, n int")
    got = {(r["prefix"], r["n"]): r["number"] for r in catalog.reference_codes(rows, "prefix", ["n"], stored).collect()}
    assert got == {("ps", 1): 42, ("ps", 2): 43, ("idp", 1): 3, ("new", 5): 1}


def test_numbers_of_a_prefix_that_holds_most_rows(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randint(0, 9), i) for i in range(500)]
    df = spark.createDataFrame(rows, "prefix string, day int, id int").repartition(7)
    got = {r["id"]: r["number"] for r in catalog.numbered(df, "prefix", ["day", "id"]).collect()}
    want = {}
    for prefix in ("a", "b", None):
        want |= {i: n for n, (_, i) in enumerate(sorted((d, i) for p, d, i in rows if p == prefix), 1)}
    assert got == want
    assert catalog.numbered(df.where("false"), "prefix", ["id"]).count() == 0


def test_pages_beyond_the_last_and_unknown_names(spark):
    df = spark.createDataFrame([(f"s{i:02}", f"t{i}") for i in range(45)], "slug string, title string")
    assert [r["slug"] for r in catalog.page_or_last(df, "none", 9).collect()] == [f"s{i}" for i in range(40, 45)]
    assert [r["slug"] for r in catalog.page_or_last(df, "none", 2).collect()] == [f"s{i}" for i in range(20, 40)]
    assert catalog.page_or_last(df.where("false"), "none", 3).count() == 0
    assert catalog.select_named(df, "slug", ["s01", "s02"]).count() == 2
    with pytest.raises(ValueError, match="x, y"):
        catalog.select_named(df, "slug", ["y", "s01", "x"])


def test_terms_of_a_table(spark):
    docs = spark.createDataFrame([(1, "g", "a red ring"), (2, "h", "a red ring"), (3, None, "red"), (4, "g", None)], "id int, kind string, text string")
    terms = spark.createDataFrame([("g", "ring"), ("g", "red"), ("g", "red"), ("h", "blue"), (None, "red")], "kind string, term string")
    assert {r["id"]: r["terms"] for r in classify.with_terms(docs, "text", terms, group="kind").collect()} == {1: ["red", "ring"], 2: [], 3: ["red"], 4: []}  # null is a group
    assert {r["id"]: r["terms"] for r in classify.with_terms(docs, "text", terms.select("term")).collect()} == {1: ["red", "ring"], 2: ["red", "ring"], 3: ["red"], 4: []}


def test_listings_are_reconciled_batch_by_batch(spark, tmp_path):
    """Each file is a batch; its state is what the batch before has written, also when a batch is repeated."""
    schema = "key string, status string, at timestamp"
    batches = [[("a", "success"), ("b", "success")], [("a", "success")], [("a", "success")], [(None, "failed")], [("b", "success")]]
    for rows in batches:
        spark.createDataFrame([(k, st, NOW) for k, st in rows], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    observed = lambda b: b.where("key is not null").select(F.lit(1).alias("chair_id"), F.col("key").alias("stable_source_key"), F.lit("t").alias("title"), F.lit("s").alias("summary"), F.lit("h").alias("content_hash"), F.lit(None).cast("date").alias("published_at"))
    log = lambda b: b.groupBy(F.lit(1).alias("chair_id")).agg(F.max("status").alias("run_status"), F.max("at").alias("now"))
    apply = stream.reconcile_onto(observed, log, f"{tmp_path}/out", CURRENT)
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    events.writeStream.foreachBatch(lambda b, n: (apply(b, n), apply(b, n))[0]).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    state = lambda n: {r["stable_source_key"]: (r["status"], r["consecutive_misses"]) for r in CommittedTable(spark, f"{tmp_path}/out").read(n).collect()}
    assert CommittedTable(spark, f"{tmp_path}/out").versions() == [0, 1, 2, 3, 4]
    assert state(1) == {"a": ("active", 0), "b": ("active", 1)} and state(2) == state(3) == {"a": ("active", 0), "b": ("archived", 2)}
    assert state(4) == {"a": ("active", 1), "b": ("active", 0)}


def test_weeks_start_on_monday(spark, tmp_path):
    rows = spark.createDataFrame([("ok", dt.datetime(2024, 1, 7, 23)), ("ok", dt.datetime(2024, 1, 8)), ("ok", dt.datetime(2024, 1, 14))], "status string, ts timestamp")
    assert {str(r["week"]): r["n"] for r in stream.weekly_outcomes(rows).collect()} == {"2024-01-01": 1, "2024-01-08": 2}


def test_streaks_and_health(spark):
    rows = [(1, 1, "failed"), (2, 1, "success"), (3, 1, "failed"), (4, 1, "skipped"), (5, 1, "partial"), (6, 2, "not_modified"), (7, 3, "failed")]
    log = spark.createDataFrame([(i, s, st, i) for i, s, st in rows], "run_id int, source_id int, status string, started_at int")
    assert {r[0]: r[1] for r in runs.failure_streaks(log).collect()} == {1: 2, 2: 0, 3: 1}
    sources = spark.createDataFrame([(i, f"n{i}") for i in range(1, 5)], "source_id int, name string")
    assert runs.health_summary(runs.source_health(sources, log)).first() == (2, 2)
    assert runs.history(log, sources, 0).count() == 1 and runs.outcome_summary(log).first()["status"] == "completed_with_failures"


ROBOTS = "User-Agent: Crawler\nUser-agent: second\nDisallow: /a\nAllow: /a/b\n\nUser-agent: *\nDisallow: /\n"


@pytest.mark.parametrize(
    ("agent", "url", "want"),
    [("MyCrawler/1", "https://x/a/b", "disallowed"), ("second", "https://x/c?q", "allowed"), ("third", "https://x/", "disallowed"), ("third", "https://none/", "unavailable"), ("third", "https://free/x", "allowed"), ("third", "https://closed/", "disallowed"), ("third", "https://bodiless/", "unavailable")],
)
def test_admission_fails_closed(spark, agent, url, want):
    origins = spark.createDataFrame([("https://x", "rules_applied", True), ("https://free", "allow_all_no_policy", False), ("https://closed", "disallow_all", True), ("https://bodiless", "rules_applied", False)], "origin string, policy string, has_body boolean")
    rules = policy.parse_rules(spark.createDataFrame([("https://x", ROBOTS)], "origin string, body string"))
    assert policy.admit(spark.createDataFrame([(url,)], "url string"), origins, rules, agent).first()["admission"] == want


def test_an_empty_disallow_ends_the_search(spark):
    rules = policy.parse_rules(spark.createDataFrame([("https://x", "User-agent: *\nDisallow:\nDisallow: /api")], "origin string, body string"))
    origins = spark.createDataFrame([("https://x", "rules_applied", True)], "origin string, policy string, has_body boolean")
    assert policy.admit(spark.createDataFrame([("https://x/api",)], "url string"), origins, rules, "c").first()["admission"] == "allowed"


def test_document_classes(spark):
    pages = [("a", "x" * 40), ("a", " " * 50), ("b", "y" * 39), ("c", "z" * 41), ("d", None)]
    got = {r["content_hash"]: r["classification"] for r in quality.document_class(spark.createDataFrame(pages, "content_hash string, text string")).collect()}
    assert got == {"a": "mixed", "b": "scanned", "c": "digital_native", "d": "scanned"}


def test_extractions_are_set_aside_with_reasons(spark):
    good = {"is_project_study": True, "title": "t", "topics": ["ai_data"], "confidence": {"title": {"value": 0.5, "evidence": "e"}}, "application_url": "https://a.example/x", "application_email": "a@b.example"}
    cases = [good, good | {"mood": 1}, good | {"title": ""}, good | {"topics": ["x"]}, good | {"confidence": {"t": {"value": 1.2, "evidence": "e"}}}, good | {"team_size_min": 0}, good | {"application_url": "ftp:x"}, good | {"application_email": "a@b"}]
    rows = spark.createDataFrame([(json.dumps(c),) for c in cases] + [("nonsense",), (None,)], "payload string")
    valid, aside = quality.split_valid(quality.validate_extractions(rows))
    assert valid.count() == 1 and [r["reasons"] for r in aside.collect()][:7] == [["extra field"], ["title"], ["topic"], ["confidence"], ["team size"], ["url"], ["email"]]


def test_pdf_intake_keeps_the_file_before_a_failure(spark):
    fetched = spark.createDataFrame([("a", 1, "x", b"%PDF-1"), ("a", 2, "x", b"no"), ("b", 1, "application/pdf", b"z"), ("c", 1, None, b"%PDF-2")], "url string, ts int, media_type string, content binary")
    stored = spark.createDataFrame([("a", "h", 3, None), ("b", None, None, "e"), ("d", "k", 1, None)], "url string, content_hash string, byte_size long, error string")
    got = {r["url"]: (r["content_hash"] and len(r["content_hash"]), r["error"]) for r in quality.pdf_intake(fetched, stored).collect()}
    assert got == {"a": (1, "not a PDF"), "b": (64, None), "c": (64, None), "d": (1, None)}


def test_alerts_and_bookmarks(spark):
    listings = spark.createDataFrame([("l1", "D", "en", "About AI"), ("l2", "E", "de", "about ai")], "slug string, department string, language string, text string")
    searches = spark.createDataFrame([("s1", "u", "ai", ["D"], [], False), ("s2", "u", "AI", [], ["de"], False), ("s3", "u", "ai", [], [], True)], "search_id string, user_id string, needle string, departments array<string>, languages array<string>, paused boolean")
    none = spark.createDataFrame([], "uniqueness_key string")
    first = alerts.fan_out(listings, searches, none)
    assert sorted((r["search_id"], r["slug"]) for r in first.collect()) == [("s1", "l1"), ("s2", "l2")]
    assert alerts.fan_out(listings, searches, first).count() == 0
    log = spark.createDataFrame([("u", "b", "add", 1), ("u", "a", "add", 2), ("u", "b", "remove", 3), ("u", "b", "add", 4), ("v", "a", "add", 1), ("v", "a", "remove", 2)], "user_id string, item string, action string, ts int")
    assert [tuple(r) for r in alerts.bookmarks(log).collect()] == [("u", ["a", "b"])]


# ---- Pages.

BODY = """<h2>Current</h2><ul><li><h3>First project study</h3> text <a href='/x.pdf'>see</a></li><li>A project study without heading <a href='y'>Project study two</a></li></ul>
<script>no</script><nav><a href='n'>project study</a></nav><h2>Archive</h2><article class='frame big'><h3>Old project study</h3><a href='z'>z</a></article><p><b>open<br><p>last<img src=i></div></p>"""


def pages(spark, body=BODY):
    return spark.createDataFrame([(1, "https://a.example/d/", "s", body), (2, "https://b.example/", "s", None)], "page_id int, url string, slug string, html string")


def test_nodes_and_selectors(spark):
    nodes = html.nodes_of(html.explode_nodes(pages(spark), html.DROP_FOR_DISCOVERY)).cache()
    count = lambda s: html.select(nodes, s).count()
    assert (count("li"), count("ul li a"), count(".frame.big"), count("article.big h3"), count("nav"), count("img"), count("a[href='z']"), count("p b p")) == (2, 2, 1, 1, 0, 1, 1, 1)
    with pytest.raises(ValueError):
        html.simple_match("li > a")
    ranked = html.select_blocks(nodes, ["ul li", "li", "article"]).collect()
    assert sorted(r["rank"] for r in ranked) == [0, 0, 2]


def test_page_text_and_links(spark):
    items = html.explode_nodes(pages(spark), html.DROP_FOR_TEXT)
    text = html.page_text(html.texts_of(items)).first()["text"]
    assert text.startswith("Current\nFirst project study\ntext\nsee\n") and "no" not in text.split("\n")
    links = html.anchors(html.nodes_of(items), html.texts_of(items), pages(spark)).orderBy("start").collect()
    assert [(r["url"], r["label"]) for r in links][:2] == [("https://a.example/x.pdf", "see"), ("https://a.example/d/y", "Project study two")]


def rules(spark, slug="s", **stated):
    inventory_rows = spark.createDataFrame([(slug, "https://a.example/d/")], "chair_name string, project_study_url string")
    kinds = {"candidate_selectors": "array<string>", "active_markers": "array<string>", "archive_markers": "array<string>", "excluded_markers": "array<string>", "excluded_titles": "array<string>", "title_selector": "string", "offer_link_selector": "string", "source_implies_active_type": "boolean", "classify_link_targets": "boolean"}
    overrides = spark.createDataFrame([(slug, *stated.values())], ", ".join(["chair_name string", *(f"{k} {kinds[k]}" for k in stated)]))
    return inventory.build_rules(inventory_rows, overrides)


NEWS = """<h2>Archive</h2><h3></h3><div class='article' data-testid='news-item'><h4>Other</h4><a href='/plain'>project study</a><span class='head'><a href='one'>Robots</a> at work</span> a project study</div>
<div class='article' data-testid='news-item'><span class='head'>No link</span> Project Study about things <a href='/projects/7'>more</a></div>
<div class='article' data-testid='news-item'><span class='head'><a>Bare</a></span> nothing of the kind</div><h2>Archive</h2><div class='article' data-testid='news-item'><span class='head'>Old</span>project study</div>"""


def test_discovery_with_selectors_of_the_rule_table(spark):
    two = pages(spark, NEWS).unionByName(spark.createDataFrame([(3, "https://c.example/", "other", NEWS)], pages(spark).schema)).unionByName(spark.createDataFrame([(4, "https://d.example/", "ruleless", NEWS)], pages(spark).schema))
    table = rules(spark, candidate_selectors=["div.article[data-testid='news-item']"], title_selector=".head", offer_link_selector=".head a").unionByName(rules(spark, "other", candidate_selectors=["h2", "div.article"], source_implies_active_type=True, archive_markers=["never"]))
    got = html.discover(two, table).orderBy("page_id", "ordinal").collect()
    # The nearest heading counts, also an empty one. The marker is looked for in the whole block, and a selected link without a target is the page.
    assert [(r["title"], r["application_url"]) for r in got if r["page_id"] == 1] == [("Robots at work", "https://a.example/d/one"), ("No link", "https://a.example/projects/7")]
    assert [(r["title"], r["application_url"]) for r in got if r["page_id"] == 3] == [("Other", "https://c.example/plain"), ("more", "https://c.example/projects/7")]
    assert not [r for r in got if r["page_id"] == 4]
    implied = rules(spark, candidate_selectors=["div.article"], title_selector=".head", offer_link_selector=".head a", source_implies_active_type=True)
    found = html.discover(pages(spark, NEWS), implied).where("title = 'Bare'").first()
    assert (found["source_url"], found["application_url"]) == ("https://a.example/d/", "https://a.example/d/")


def test_headings_without_text_count(spark):
    items = html.explode_nodes(pages(spark, "<h2>Archive</h2><h3></h3><article>x</article><h1>A</h1><p>y</p>"))
    nodes, texts = html.nodes_of(items), html.texts_of(items)
    found = html.previous_heading(html.select_blocks(nodes, ["article", "p"]).select("page_id", "start", "end"), nodes, texts)
    assert [r["heading"] for r in found.orderBy("start").collect()] == ["", "A"]


def test_discovery_takes_offers_and_leaves_the_archive(spark):
    got = html.discover(pages(spark), rules(spark)).orderBy("ordinal").collect()
    assert [(r["title"], r["source_url"]) for r in got] == [("First project study", "https://a.example/x.pdf"), ("Project study two", "https://a.example/d/y")]


def test_expansion_stops_at_depth_two(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("b", "a"), ("a", "gone")], "from_url string, url string")
    held = spark.createDataFrame([(x,) for x in "abcd"], "url string")
    got = {(r["url"], r["depth"], r["found"]) for r in html.expand_links(held.where("url = 'a'"), links, held).collect()}
    assert got == {("a", 0, True), ("b", 1, True), ("gone", 1, False), ("c", 2, True)}


def test_extraction_by_media_type(spark):
    rows = spark.createDataFrame([(1, "u", "text/html", "<p>a</p><style>b</style>"), (2, "u", "text/plain", "x"), (3, "u", "image/png", "y")], "page_id int, url string, media_type string, html string")
    assert {r["page_id"]: (r["text"], r["error"]) for r in html.extract_text(rows).collect()} == {1: ("a", None), 2: ("x", None), 3: (None, "unsupported media type: image/png")}


# ---- Sources and sinks.


def test_inventory_rules_and_hierarchy(spark, tmp_path):
    (tmp_path / "i.json").write_text(json.dumps([{"department": "D", "chair_name": "Law & Co", "project_study_url": "https://a.example/"}, {"department": "D", "chair_name": "B", "project_study_url": "https://b.example/"}]))
    keys = ("department", "chair_name", "project_study_url")
    rows = inventory.read_inventory(spark, f"{tmp_path}/i.json", keys, 2)
    with pytest.raises(ValueError):
        inventory.read_inventory(spark, f"{tmp_path}/i.json", keys, 3)
    assert inventory.read_inventory(spark, f"{tmp_path}/i.json", keys, 2, departments=["D"]).count() == 2
    for departments in (["D", "E"], ["E"], []):
        with pytest.raises(ValueError):
            inventory.read_inventory(spark, f"{tmp_path}/i.json", keys, 2, departments=departments)
    hosts = spark.createDataFrame([("https://www.tumcso.com/x",), ("http://WWW.bwl.wi.tum.de",), ("https://a.example/",)], "url string")
    assert [r[0] for r in hosts.select(urls.parser_family(F.col("url"))).collect()] == ["squarespace", "legacy_html", "typo3"]
    overrides = spark.createDataFrame([("B", ["idp"], [".x"])], "chair_name string, drop_excluded array<string>, candidate_selectors array<string>")
    rules = {r["slug"]: r for r in inventory.build_rules(rows, overrides).collect()}
    assert set(rules) == {"law-and-co", "b"} and rules["b"]["candidate_selectors"] == [".x"] and "idp" not in rules["b"]["excluded_markers"] and "idp" in rules["law-and-co"]["excluded_markers"]
    (tmp_path / "h.csv").write_text('school_slug,school,department_slug,department,source_url\na,"S, one",d-1,D,u\na,S, two,d-2,Department of X,u2\na,S,x,y,z,u3\nb,T,d-3,,u4\n')
    good, aside = inventory.read_hierarchy(spark, f"{tmp_path}/h.csv")
    wide = ", ".join(f"Part {i}" for i in range(40))
    (tmp_path / "w.csv").write_text(f'a,S,d-9,{wide},u5\n"a ""b""",S,d-8,,u6\n,,,,\n')
    got = {r["department_slug"]: (r["school_slug"], r["department"], r["source_url"]) for r in inventory.read_hierarchy(spark, f"{tmp_path}/w.csv")[0].collect()}
    assert got == {"d-9": ("a", wide, "u5"), "d-8": ('a "b"', None, "u6"), None: (None, None, None)}
    assert {r["department_slug"]: (r["school"], r["department"]) for r in good.collect()} == {"d-1": ("S, one", "D"), "d-2": ("S, two", "Department of X"), "d-3": ("T", None)} and aside.count() == 1


def test_storage(spark, tmp_path):
    df = spark.createDataFrame([(1, "h"), (1, "h"), (2, "h")], "source_id int, content_hash string")
    storage.append_new(df, f"{tmp_path}/a", ["source_id", "content_hash"])
    storage.append_new(df.union(spark.createDataFrame([(3, "h")], df.schema)), f"{tmp_path}/a", ["source_id", "content_hash"])
    assert CommittedTable(spark, f"{tmp_path}/a").read().count() == 3
    assert storage.write_snapshot(df, f"{tmp_path}/s") == 0 and CommittedTable(spark, f"{tmp_path}/s").read().count() == 3
    storage.write_bodies(spark.createDataFrame([(b"x",), (b"x",), (b"y",)], "content binary"), f"{tmp_path}/b")
    assert spark.read.parquet(f"{tmp_path}/b").count() == 2
    report = spark.createDataFrame([("https://b", 2, 1, False), ("https://a", 3, 3, True)], "origin string, checked long, allowed long, compliant boolean")
    storage.write_summary(report, f"{tmp_path}/summary")
    text = "\n".join(r[0] for r in spark.read.text(f"{tmp_path}/summary", wholetext=True).collect())
    assert text.startswith("# Robots policy audit") and text.index("| https://a | 3 | 3/3 |") < text.index("| https://b | 2 | 1/2 |") < text.index("must not run")
    storage.write_summary(report.where("compliant"), f"{tmp_path}/summary")
    assert "are allowed" in spark.read.text(f"{tmp_path}/summary", wholetext=True).first()[0]
    (tmp_path / "captured").mkdir()
    (tmp_path / "captured" / "p.html").write_text("<p>x</p>")
    manifest = spark.createDataFrame([("p.html", "https://a/p"), ("gone.html", "https://a/g")], "file string, url string")
    page = storage.read_pages(spark, f"{tmp_path}/captured", manifest).collect()
    assert [(r["url"], bytes(r["content"])) for r in page] == [("https://a/p", b"<p>x</p>")]
    (tmp_path / "u.csv").write_text("name,n\n a ,1\n,2\n")
    assert [tuple(r) for r in inventory.read_units(spark, f"{tmp_path}/u.csv", "name string, n int").collect()] == [("a", 1), (None, 2)]
    storage.write_manifest(df, f"{tmp_path}/m")
    assert spark.read.json(f"{tmp_path}/m").count() == 3


def test_attempts_and_redirects(spark):
    rows = spark.createDataFrame([("u", 1, 503, "99", 1), ("u", 2, 429, None, 1), ("u", 3, 500, "5", 1), ("v", 1, 304, None, 0), ("v", 1, 200, None, 26_000_000), ("v", 1, 404, None, 1), ("v", 1, 200, None, 9)], "url string, attempt int, status_code int, retry_after string, bytes long")
    assert [(r["outcome"], r["wait_s"]) for r in runs.attempt_audit(rows).collect()] == [("retry", 30), ("retry", 2), ("give_up", None), ("not_modified", None), ("too_large", None), ("failed", None), ("done", None)]
    hops = spark.createDataFrame([(i, i + 1) for i in range(20)], "url int, target int")
    got = {r["start"]: (r["url"], r["outcome"]) for r in runs.redirect_chains(hops, spark.createDataFrame([(1,), (15,)], "x int")).collect()}
    assert got == {1: (7, "too_many"), 15: (20, "final")}


def test_bounded_streaming_dedup(spark, tmp_path):
    rows = spark.createDataFrame([(1, "h", T0), (1, "h", T0), (2, "h", T0)], "source_id int, content_hash string, ts timestamp")
    rows.write.parquet(f"{tmp_path}/in")
    made = stream.new_artifacts(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), "1 hour")
    made.writeStream.foreachBatch(stream.reconcile_each(lambda b: b.withColumn("n", F.lit(1)), f"{tmp_path}/out")).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert CommittedTable(spark, f"{tmp_path}/out").read(0).count() == 2
