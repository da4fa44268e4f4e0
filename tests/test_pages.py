"""Structural joins against a tree that is walked by hand, pages of a sorted table, hops and prefix rules."""

import random
import re
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievework.operators import catalog, html, policy
from sievework.operators.sweep import compounds, gathered, matches, point


def random_page(rng, depth=0):
    out = ""
    for _ in range(rng.randint(1, 4)):
        tag = rng.choice(["ul", "li", "div", "p"])
        attrs = rng.choice(["", " class='x'", " class='y x'", " data-k='v w'", " class='x' data-k='v w'"])
        out += f"<{tag}{attrs}>{rng.choice(['', 'a ', 'b'])}{random_page(rng, depth + 1) if depth < 5 else ''}{rng.choice(['', ' c'])}</{tag}>"
    return out


SELECTORS = ["li", ".x", "li.x", "ul li", "ul ul li", "div .x li", "[data-k='v w']", "li[data-k='v w'].x", "div p div p", "none", "ul.y [data-k='v w']"]


def plainly(nodes, selector):
    """(page, start) of nodes that a selector matches, by looking at every chain of ancestors."""

    def fits(node, part):
        wanted = {"li.x": ("li", {"x"}, {}), "[data-k='v w']": (None, set(), {"data-k": "v w"}), "li[data-k='v w'].x": ("li", {"x"}, {"data-k": "v w"}), ".x": (None, {"x"}, {}), "ul.y": ("ul", {"y"}, {})}.get(part, (part, set(), {}))
        return wanted[0] in (None, node["tag"]) and wanted[1] <= set(node["classes"]) and all(node["attrs"].get(k) == v for k, v in wanted[2].items())

    def holds(node, parts):
        if not fits(node, parts[-1]):
            return False
        if len(parts) == 1:
            return True
        around = [n for n in nodes if n["page_id"] == node["page_id"] and n["start"] < node["start"] < n["end"]]
        return any(holds(n, parts[:-1]) for n in around)

    parts = selector.replace("v w", "v\0w").split(" ")
    return {(n["page_id"], n["start"]) for n in nodes if holds(n, [p.replace("\0", " ") for p in parts])}


def test_matches_and_texts_of_random_pages(spark):
    rng = random.Random(8)
    pages = spark.createDataFrame([(i, random_page(rng)) for i in range(12)] + [(None, "<li>n</li>")], "page_id long, html string")
    items = html.explode_nodes(pages).cache()
    nodes, texts = html.nodes_of(items), html.texts_of(items)
    rows, said = [r.asDict() for r in nodes.collect()], [r.asDict() for r in texts.collect()]
    found = matches(nodes, spark.createDataFrame([(s,) for s in [*SELECTORS, "li", None]], "selector string")).collect()
    assert len(found) == len({(r["page_id"], r["start"], r["selector"]) for r in found})
    for s in SELECTORS:
        assert {(r["page_id"], r["start"]) for r in found if r["selector"] == s} == plainly(rows, s), s
    got = {(r["page_id"], r["start"]): r["text"] for r in html.block_text(nodes, texts).collect()}
    want = {}
    for n in rows:
        pieces = [t["text"] for t in sorted(said, key=lambda t: t["pos"]) if t["page_id"] == n["page_id"] and n["start"] < t["pos"] < n["end"]]
        if pieces:
            want[n["page_id"], n["start"]] = " ".join(pieces)
    assert got == want


def test_points_before_first_and_joined(spark):
    blocks = spark.createDataFrame([(1, 10, 50), (1, 20, 30), (1, 60, 70), (2, 5, 9), (1, 20, 30)], "page_id long, start long, end long")
    given = spark.createDataFrame([(1, 5, "h", "one"), (1, 10, "h", "two"), (1, 21, "v", "a"), (1, 25, "v", None), (1, 26, "v", "b"), (1, 40, "v", "c"), (1, 55, "v", "out")], "page_id long, pos long, kind string, v string")
    points = given.where("kind = 'h'").select("page_id", *point("heading", "pos", F.col("v"), "before"))
    points = points.unionByName(given.where("kind = 'v'").select("page_id", *point("first", "pos", F.col("v"), "first"))).unionByName(given.where("kind = 'v'").select("page_id", *point("all", "pos", F.col("v"), "join")))
    got = {(r["page_id"], r["start"]): r["values"] for r in gathered(blocks, points, "+").collect()}
    # A heading where the block starts is before it.
    assert got == {(1, 10): {"heading": "two", "first": "a", "all": "a+b+c"}, (1, 20): {"heading": "two", "first": "a", "all": "a+b"}, (1, 60): {"heading": "two"}, (2, 5): {}}


def test_a_page_of_many_items_takes_linear_time(spark):
    took = {}
    for n in (5_000, 50_000):
        page = "<ul>" + "".join(f"<li class='i'>item {i} <a href='/{i}'>go</a></li>" for i in range(n)) + "</ul>"
        items = html.explode_nodes(spark.createDataFrame([(1, page)], "page_id long, html string")).cache()
        items.count()
        nodes, texts = html.nodes_of(items), html.texts_of(items)
        began = time.time()
        blocks = html.select_blocks(nodes, ["ul li.i"])
        assert html.block_text(blocks, texts).where("text like 'item % go'").count() == n
        took[n] = time.time() - began
    assert took[50_000] < 20 * took[5_000] + 10  # a hundred times as long by comparing pairs


def test_the_plan_does_not_grow_with_the_rules(spark):
    nodes = html.nodes_of(html.explode_nodes(spark.createDataFrame([(1, "<p>x</p>")], "page_id long, html string")))
    size = lambda n: matches(nodes, spark.createDataFrame([(f".c{i} p",) for i in range(n)], "selector string"))._jdf.queryExecution().optimizedPlan().toString().count("\n")
    assert size(2) == size(500)


def test_selectors_that_are_none_are_an_error(spark):
    for bad in ("li > a", "a:hover", "#id", "a,b"):
        with pytest.raises(Exception, match="selector"):
            compounds(spark.createDataFrame([(bad,)], "selector string")).collect()


# ---- Pages of a sorted table.


@pytest.mark.parametrize("sort", ["title", "deadline", "published", "none"])
def test_pages_are_slices_of_the_sorted_table(spark, sort):
    rng = random.Random(sort)
    rows = [(f"s{i:04d}", rng.choice(["A", "b", "C", None]), rng.choice([None, rng.randint(0, 50)]), rng.choice([None, rng.randint(0, 50)]), rng.randint(0, 9), i) for i in range(503)]
    frame = spark.createDataFrame(rows, "slug string, title string, deadline int, published_at int, first_seen_at int, page_range int").repartition(6)
    whole = [tuple(r) for r in catalog.sorted_by(frame, sort).collect()]
    pages = catalog.Pages(frame, sort)
    assert pages.total == 503
    for number, size in ((1, 20), (3, 100), (6, 100), (11, 47), (7, 100), (1 << 40, 7)):
        assert [tuple(r) for r in pages.page(number, size).collect()] == whole[(number - 1) * size : number * size]
    assert [tuple(r) for r in pages.page_or_last(1 << 40, 100).collect()] == whole[500:]
    for i in (0, 249, 502):
        assert [tuple(r) for r in pages.after(whole[i][0], 30).collect()] == whole[i + 1 : i + 31]
    with pytest.raises(ValueError, match="unknown slug"):
        pages.after("nobody")
    with pytest.raises(ValueError, match="pages count"):
        pages.page(0)


def test_pages_of_nothing(spark):
    empty = catalog.Pages(spark.createDataFrame([], "slug string, title string"), "title")
    assert empty.total == 0 and empty.page(1).collect() == empty.page_or_last(5).collect() == []


def test_deep_pages_send_no_more_than_themselves(spark):
    """A page deep in a range of many rows comes without the rows of the range before it."""
    frame = spark.range(60_000).select(F.format_string("s%06d", F.pmod(F.col("id") * 7919, F.lit(60_000))).alias("slug"), F.lit("same").alias("title")).coalesce(3)
    pages = catalog.Pages(frame, "title")
    for page, first in ((pages.page(555, 100), 55_400), (pages.after("s031399", 100), 31_400)):
        assert [r["slug"] for r in page.collect()] == [f"s{i:06d}" for i in range(first, first + 100)]
        assert "limit=100," in page._jdf.queryExecution().executedPlan().toString() and "offset" not in page._jdf.queryExecution().optimizedPlan().toString().lower()


# ---- Hops and prefix rules.


def test_hops_to_any_depth(spark):
    rng = random.Random(4)
    links = sorted({(rng.randint(0, 40), rng.randint(0, 40)) for _ in range(70)})
    held = [n for n in range(41) if n % 5]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    for depth in (1, 2, 6):
        got = {(r["start"], r["url"], r["depth"], r["found"]) for r in html.expand_links(frame([(0,), (1,), (2,), (2,)], "url int"), frame(links * 2, "from_url int, url int"), frame([(n,) for n in held], "url int"), depth).collect()}
        want = set()
        for start in (0, 1, 2):
            at, edge = {start: 0}, [start]
            for d in range(1, depth + 1):
                edge = sorted({b for a in edge if a in held for x, b in links if x == a} - at.keys())
                at |= dict.fromkeys(edge, d)
            want |= {(start, u, d, u in held) for u, d in at.items()}
        assert got == want


def test_prefix_rules_are_met_by_equality(spark):
    rng = random.Random(6)
    paths = ["", "/", "/a", "/a/b", "/a/bc", "/ä", "/a?x", "/abc"]
    rows = [(o, agent, n, rng.random() < 0.5, rng.choice(paths)) for o in ("https://x", "https://y") for agent in ("*", "bot") for n in range(6)]
    origins = [("https://x", "rules_applied", True), ("https://y", "rules_applied", True)]
    urls = [(f"{o}{p}{q}",) for o in ("https://x", "https://y") for p in paths for q in ("", "c", "/d#f") if p or q != "c"]
    frame = policy.admit(spark.createDataFrame(urls, "url string"), spark.createDataFrame(origins, "origin string, policy string, has_body boolean"), spark.createDataFrame(rows, "origin string, agent string, line_no int, allow boolean, prefix string"), "Bot/1")
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert "StartsWith(__path" not in plan
    for url, admission in frame.collect():
        origin = url[:9]
        rest = url[9:].split("#")[0]
        path = rest if rest.startswith("/") else "/" + rest
        first = next((allow for o, agent, _, allow, prefix in rows if o == origin and agent == "bot" and path.startswith(prefix)), True)
        assert admission == ("allowed" if first else "disallowed"), url


def test_pages_are_taken_apart_one_at_a_time():
    pages = pa.RecordBatch.from_pydict({"page_id": list(range(3000)), "html": ["<p class='a b'>x</p>" * 10] * 3000})
    found = list(html._parsed(iter([pages]), frozenset()))
    assert sum(b.num_rows for b in found) == 60_000 and max(b.num_rows for b in found) <= html.ITEMS_A_BATCH
    read = []
    html_of = type("Read", (), {"columns": [pages.column(0), pages.column(1)], "schema": pages.schema})
    lazy = html._parsed((read.append(1) or html_of for _ in range(2)), frozenset())
    next(lazy)
    assert len(read) == 1  # the first items come before the next pages are asked for


@pytest.mark.parametrize("lot, heavy, row", [(40, 8, 5), (40, 0, 2), (10**6, 8, 10**6)])
def test_hops_tell_their_pairs_apart_by_lots(spark, monkeypatch, lot, heavy, row):
    """Many lots, lots told by pairs, and lists of links in several rows: the same pages at the same depths; and no exchange of a lot's pairs."""
    for name, value in (("ROW_LINKS", row), ("LOT_PAIRS", lot), ("HEAVY", heavy)):
        monkeypatch.setattr(html, name, value)
    links = [(a, b) for a in range(30) for b in range(30, 60) if (a * b) % 4] + [(b, (b * 7) % 90) for b in range(30, 60)] + [(3, None), (None, 4)]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    held = [n for n in range(90) if n % 3]
    made = html.expand_links(frame([(n,) for n in range(30)], "url int"), frame(links, "from_url int, url int"), frame([(n,) for n in held], "url int"))
    got = sorted((r["start"], r["url"], r["depth"], r["found"]) for r in made.collect())
    want = []
    for start in range(30):
        at, edge = {start: 0}, [start]
        for d in (1, 2):
            edge = sorted({b for a in edge if a in held for x, b in links if x == a and b is not None} - at.keys())
            at |= dict.fromkeys(edge, d)
        want += [(start, u, d, u in held) for u, d in at.items()]
    assert got == sorted(want)
    plan = made._jdf.queryExecution().executedPlan().toString().partition("Final Plan")[2].partition("Initial Plan")[0]
    assert any("start" in x for x in re.findall(r"Exchange (?:hash|range)partitioning\((.*)", plan)) == (not heavy)
