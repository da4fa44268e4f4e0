"""Pages as tables of nodes and texts, and discovery of offers as joins over them.

A page is parsed once into nodes (page_id, start, end, depth, tag, classes, attrs) and texts
(page_id, pos, text) on one line of positions: a text or node lies in a node if its position is
between start and end. Everything after that is relational.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator, Sequence
from functools import reduce
from html.parser import HTMLParser
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import case_folded, contains_any, normal_title, stable_key
from ..functions.urls import media_type, resolve
from ..sources.commits import CommittedTable
from ..sources.storage import checkpointed, shared_folder
from .classify import DETAIL_MARKERS, classification, is_noise_title
from .reconcile import dedup_titles
from .sweep import gathered, matches, point

# Elements that have no content, and those whose texts a use leaves out.
VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"})
DROP_FOR_DISCOVERY = ("script", "style", "nav", "footer", "noscript")
DROP_FOR_TEXT = ("script", "style", "noscript")
HEADINGS = ("h1", "h2", "h3", "h4")

_ITEMS = "start long, end long, depth int, tag string, classes array<string>, attrs map<string, string>, text string"
_NAMES = ["start", "end", "depth", "tag", "classes", "attrs", "text"]
_ARROW = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.map_(pa.string(), pa.string()), pa.string()]
#: Nodes and texts that are Python objects at a time, whatever the number of pages in a batch that is read.
ITEMS_A_BATCH = 4096


class _Reader(HTMLParser):
    """Rows of one page. A void tag never opens; an end tag closes up to its nearest open match, or is ignored."""

    def __init__(self, dropped: frozenset[str]):
        super().__init__(convert_charrefs=True)
        self.dropped, self.rows, self.open, self.at, self.hidden = dropped, [], [], 0, 0

    def _place(self) -> int:
        self.at += 1
        return self.at

    def handle_starttag(self, tag, attrs):
        pairs = {k: v or "" for k, v in attrs}
        row = [self._place(), 0, len(self.open), tag, pairs.get("class", "").split(), list(pairs.items()), None]
        if tag in VOID:
            row[1] = self._place()
            if not self.hidden:
                self.rows.append(row)
            return
        self.open.append((tag, row))
        self.hidden += tag in self.dropped
        if not self.hidden:
            self.rows.append(row)

    def handle_endtag(self, tag):
        if any(t == tag for t, _ in self.open):
            while self._close() != tag:
                pass

    def _close(self) -> str:
        tag, row = self.open.pop()
        row[1] = self._place()
        self.hidden -= tag in self.dropped
        return tag

    def handle_data(self, data):
        place = self._place()
        if not self.hidden and data.strip():
            self.rows.append([place, place, len(self.open), None, None, None, data.strip()])

    def read(self, page: str) -> list:
        self.feed(page)
        self.close()
        while self.open:
            self._close()
        return self.rows


def _parsed(parts: Iterator[pa.RecordBatch], dropped: frozenset[str]) -> Iterator[pa.RecordBatch]:
    """Items of batches (page_id, html), in batches of their own: one page is taken apart at a time, however many a batch holds."""
    page_type = pa.null()

    def read():
        nonlocal page_type
        for batch in parts:
            page_type = batch.schema.field("page_id").type
            for key, page in zip(*batch.columns, strict=True):
                if page := page.as_py():
                    of = key.as_py()
                    yield from ((of, *r) for r in _Reader(dropped).read(page))

    rows = read()
    while out := list(islice(rows, ITEMS_A_BATCH)):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), [page_type, *_ARROW], strict=True)], ["page_id", *_NAMES])


def explode_nodes(pages: DataFrame, drop: Sequence[str] = (), page_id: str = "page_id", html: str = "html") -> DataFrame:
    """(page_id, start, end, depth, tag, classes, attrs, text): nodes, and texts, whose tag is null.

    Subtrees of dropped tags are left out; comments and doctypes are no text. Null pages have no rows.
    """
    dropped = frozenset(drop)

    named = pages.select(F.col(page_id).alias("page_id"), F.col(html).alias("html"))
    return named.mapInArrow(lambda parts: _parsed(parts, dropped), f"page_id {named.schema['page_id'].dataType.simpleString()}, {_ITEMS}")


class NodeTable:
    """The nodes and texts of page bodies, parsed once for each body, however many pages and crawls hold it.

    The table is kept by the digests of bodies; a page's items are found by its body's. Two writers that meet the same new body leave it once.
    """

    def __init__(self, spark: SparkSession, root: str, drop: Sequence[str] = ()):
        self.table, self.drop = CommittedTable(spark, root), tuple(drop)

    def add(self, pages: DataFrame, html: str = "html") -> int:
        """Parses the bodies that are not held yet, and returns how many they were. Null bodies are none."""
        bodies = pages.where(F.col(html).isNotNull()).select(F.sha2(html, 256).alias("body"), F.col(html).alias("html"))
        held = self.table.read(empty=f"body string, {_ITEMS}")
        known = held.where("start = 0").select("body")
        new = bodies.join(known, "body", "left_anti").dropDuplicates(["body"])
        # A row at 0, where no node stands, says that a body has been parsed, also one without nodes.
        items = explode_nodes(new, self.drop, "body").withColumnRenamed("page_id", "body")
        marks = new.select("body", F.lit(0).cast("long").alias("start"), *(F.lit(None).cast(kind).alias(name) for name, kind in (x.split(" ", 1) for x in _ITEMS.replace("<string, string>", "<string,string>").split(", ")[1:])))
        folder = checkpointed(items.unionByName(marks).repartition("body").sortWithinPartitions("body", "start"))
        count = folder.where("start = 0").count()
        if count:
            self.table.append_new(folder, ["body"], together=True)
        return count

    def items(self, pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
        """explode_nodes() of pages, from the table; bodies that it does not hold are added."""
        self.add(pages, html)
        named = pages.select(F.col(page_id).alias("page_id"), F.sha2(html, 256).alias("body"))
        return named.join(self.table.read(empty=f"body string, {_ITEMS}").where("start > 0"), "body").drop("body")


def nodes_of(items: DataFrame) -> DataFrame:
    return items.where("tag is not null").drop("text")


def texts_of(items: DataFrame) -> DataFrame:
    return items.where("tag is null").select("page_id", F.col("start").alias("pos"), "text")


_PART = re.compile(r"(?P<tag>[a-z][a-z0-9]*)|\.(?P<cls>[\w-]+)|\[(?P<attr>[\w-]+)='(?P<value>[^']*)'\]")


def simple_match(selector: str) -> Column:
    """The condition of one compound selector: a tag, classes and attribute values."""
    parts = list(_PART.finditer(selector))
    if "".join(m[0] for m in parts) != selector or not parts:
        raise ValueError(f"a selector of tag, .class and [attr='value'] is needed: {selector}")
    out = F.lit(True)
    for m in parts:
        if m["tag"]:
            out &= F.col("tag") == m["tag"]
        elif m["cls"]:
            out &= F.array_contains("classes", m["cls"])
        else:
            out &= F.coalesce(F.col("attrs")[m["attr"]] == m["value"], F.lit(False))
    return out


def select(nodes: DataFrame, selector: str) -> DataFrame:
    """Nodes that a selector of compounds, each a descendant of the one before, matches."""
    for compound in selector.split():
        simple_match(compound)
    asked = nodes.sparkSession.createDataFrame([(selector,)], "selector string")
    return nodes.join(matches(nodes, asked).select("page_id", "start"), ["page_id", "start"], "left_semi")


def select_blocks(nodes: DataFrame, selectors: Sequence[str]) -> DataFrame:
    """Nodes that any selector matches, each once, with the index of the first such selector as `rank`."""
    asked = nodes.sparkSession.createDataFrame(list(enumerate(selectors)), "rank int, selector string")
    found = matches(nodes, asked).join(asked, "selector").groupBy("page_id", "start").agg(F.min("rank").alias("rank"))
    return nodes.join(found, ["page_id", "start"])


def block_text(blocks: DataFrame, texts: DataFrame, separator: str = " ") -> DataFrame:
    """(page_id, start, text) of blocks that hold text: their pieces in order."""
    found = gathered(blocks, texts.select("page_id", *point("text", "pos", F.col("text"), "join")), separator)
    return found.select("page_id", "start", F.col("values")["text"].alias("text")).where("text is not null")


def with_text(blocks: DataFrame, texts: DataFrame, name: str) -> DataFrame:
    """blocks with their text as a column, empty for those without any."""
    said = block_text(blocks, texts).withColumnRenamed("text", name)
    return blocks.join(said, ["page_id", "start"], "left").withColumn(name, F.coalesce(name, F.lit("")))


def page_text(texts: DataFrame) -> DataFrame:
    """(page_id, text): a page's pieces, a line each."""
    pieces = F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"])
    return texts.groupBy("page_id").agg(F.array_join(pieces, "\n").alias("text"))


def previous_heading(blocks: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """blocks with `heading`: the text of the nearest h1 to h4 that starts before the block, empty if it has none; null without one."""
    said = with_text(nodes.where(F.col("tag").isin(*HEADINGS)), texts, "heading").select("page_id", "start", "heading")
    marks = said.withColumn("block", F.lit(False)).unionByName(blocks.select("page_id", "start", F.lit(None).cast("string").alias("heading"), F.lit(True).alias("block")))
    before = Window.partitionBy("page_id").orderBy("start", "block").rowsBetween(Window.unboundedPreceding, -1)
    known = marks.withColumn("heading", F.last("heading", ignorenulls=True).over(before)).where("block").select("page_id", "start", "heading")
    return blocks.join(known, ["page_id", "start"], "left")


def first_inside(blocks: DataFrame, nodes: DataFrame, condition: Column, value: str, name: str) -> DataFrame:
    """blocks with the value of the first node inside that meets the condition, or null; nodes whose value is null are passed over."""
    found = gathered(blocks, nodes.where(condition).select("page_id", *point(name, "start", F.col(value), "first")))
    return blocks.join(found.select("page_id", "start", F.col("values")[name].alias(name)), ["page_id", "start"], "left")


def anchors(nodes: DataFrame, texts: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, start, href, url, label) of links; url is absolute, from the page's url."""
    links = nodes.where((F.col("tag") == "a") & F.map_contains_key("attrs", "href")).select("page_id", "start", "end", F.col("attrs")["href"].alias("href"))
    labels = block_text(links, texts).withColumnRenamed("text", "label")
    named = links.join(labels, ["page_id", "start"], "left").join(pages.select("page_id", F.col("url").alias("__base")), "page_id")
    return named.select("page_id", "start", "href", resolve("__base", "href").alias("url"), F.coalesce("label", F.lit("")).alias("label"))


def rank_blocks(matched: DataFrame, of_page: DataFrame, wanted: str) -> DataFrame:
    """Nodes (page_id, start, end, rank) of matches() by a selector which their page asks for.

    of_page holds page_id and the array column `wanted`; rank is the least index of such a selector in it.
    """
    ranked = matched.join(of_page.select("page_id", wanted), "page_id").withColumn("rank", F.array_position(wanted, F.col("selector")) - 1)
    return ranked.where("rank >= 0").groupBy("page_id", "start", "end").agg(F.min("rank").alias("rank"))


_RULE = ("candidate_selectors", "active_markers", "archive_markers", "excluded_markers", "excluded_titles", "opportunity_type", "source_implies_active_type", "classify_link_targets", "title_selector", "offer_link_selector")


def discover(pages: DataFrame, rules: DataFrame, slug: str = "slug", held: NodeTable | None = None) -> DataFrame:
    """Candidates of pages (page_id, url, slug, html) by the rule of each page's source; rules: as build_rules() makes them, one for each slug.

    The heading of a block is the first node of its title selector, or its first h1 to h5; with a title selector the
    markers are looked for in the whole block instead of the title. The offer's link is the first node of its link
    selector, or the first link with an active marker, or any if the source implies them. Pages without a rule have no candidate.
    held: a table of nodes, from which bodies that were parsed before are taken.
    """
    asked = rules.select(F.col(slug).alias("__slug"), *_RULE)
    known = asked.select(F.explode(F.concat("candidate_selectors", F.array_compact(F.array("title_selector", "offer_link_selector")))).alias("selector"))
    ruled = pages.select("page_id", "url", F.col(slug).alias("slug"), "html").join(asked, F.col("slug") == F.col("__slug")).drop("__slug")
    of_page = ruled.select("page_id", "url", "slug", *_RULE, F.array_compact(F.array("title_selector")).alias("__title"), F.array_compact(F.array("offer_link_selector")).alias("__link"))
    if held is not None and set(held.drop) != set(DROP_FOR_DISCOVERY):
        raise ValueError("a table of nodes without DROP_FOR_DISCOVERY is needed")
    items = checkpointed(explode_nodes(ruled, DROP_FOR_DISCOVERY) if held is None else held.items(ruled))  # pages are parsed once
    nodes, texts = nodes_of(items), texts_of(items)
    # What a page's rule makes of each node that it matches: a block of some rank, a chosen title, a chosen link.
    index = lambda wanted: F.array_position(wanted, F.col("selector"))
    roles = matches(nodes, known).join(of_page.select("page_id", "candidate_selectors", "__title", "__link"), "page_id")
    roles = roles.select("page_id", "start", "end", F.nullif(index("candidate_selectors"), F.lit(0)).alias("rank"), (index("__title") > 0).alias("titles"), (index("__link") > 0).alias("links"))
    plain = nodes.where(F.col("tag").isin("a", "h1", "h2", "h3", "h4", "h5")).select("page_id", "start", "end", "tag", F.col("attrs")["href"].alias("href"))
    parts = roles.groupBy("page_id", "start", "end").agg(F.min("rank").alias("rank"), F.bool_or("titles").alias("titles"), F.bool_or("links").alias("links"))
    parts = parts.where("rank is not null or titles or links").join(plain, ["page_id", "start", "end"], "full_outer")
    # A chosen link may be any node with an address.
    chosen = parts.where("links and href is null").select("page_id", "start").join(nodes.select("page_id", "start", F.col("attrs")["href"].alias("own_href")), ["page_id", "start"])
    parts = parts.join(chosen, ["page_id", "start"], "left").withColumn("href", F.coalesce("href", "own_href")).drop("own_href")
    said = gathered(parts.select("page_id", "start", "end"), texts.select("page_id", *point("text", "pos", F.col("text"), "join")))
    said = said.select("page_id", "start", F.coalesce(F.col("values")["text"], F.lit("")).alias("text"))
    parts = parts.join(said, ["page_id", "start"]).join(of_page, "page_id")
    has_title, has_link = F.col("title_selector").isNotNull(), F.col("offer_link_selector").isNotNull()
    parts = checkpointed(parts.withColumn("target", F.coalesce(resolve("url", "href"), F.when(F.col("links"), F.col("url")))))  # every kind of point comes from it

    anchor, heading = F.col("tag") == "a", F.coalesce(F.col("tag") != "a", F.lit(False))
    linked = parts.where(anchor & F.col("href").isNotNull())
    marked = ~has_link & (F.col("source_implies_active_type") | contains_any(case_folded(F.concat_ws(" ", "text", "href")), F.col("active_markers")))
    offer = F.to_json(F.struct(F.col("target").alias("url"), F.col("text").alias("label")))
    points = [
        linked.where(marked).select("page_id", *point("offer", "start", offer, "first")),
        parts.where(has_link & F.col("links")).select("page_id", *point("offer", "start", offer, "first")),
        linked.where(contains_any(case_folded(F.col("target")), DETAIL_MARKERS)).select("page_id", *point("detail", "start", F.col("target"), "first")),
        linked.where("classify_link_targets").select("page_id", *point("targets", "start", F.col("href"), "join")),
        parts.where(heading & ~has_title | has_title & F.col("titles")).select("page_id", *point("own_heading", "start", F.col("text"), "first")),
        parts.where(heading & F.col("tag").isin(*HEADINGS)).select("page_id", *point("heading", "start", F.col("text"), "before")),
    ]
    blocks = parts.where("rank is not null").withColumn("rank", F.col("rank") - 1)
    values = gathered(blocks.select("page_id", "start", "end"), reduce(DataFrame.unionByName, points)).select("page_id", "start", "values")
    blocks = blocks.select("page_id", "start", "url", "slug", "rank", "text", *_RULE).join(values, ["page_id", "start"])
    value = lambda name: F.col("values")[name].alias(name)
    blocks = blocks.select("*", *map(value, ("detail", "targets", "own_heading", "heading")), F.from_json(F.col("values")["offer"], "url string, label string").alias("offer"))

    whole = F.when(F.col("classify_link_targets"), F.concat_ws(" ", "text", F.coalesce("targets", F.lit("")))).otherwise(F.col("text"))
    in_archive = contains_any(case_folded(F.col("heading")), F.col("archive_markers"))
    accepted = classification(whole, in_archive, F.col("active_markers"), F.col("archive_markers"), F.col("excluded_markers"), F.col("source_implies_active_type"), F.col("opportunity_type"))["accepted"]
    title = F.coalesce("own_heading", "offer.label")
    marker_text = F.when(has_title, case_folded(whole)).otherwise(normal_title(title))
    noise = is_noise_title(title, F.col("excluded_titles"), marker_text, F.col("active_markers"), F.col("source_implies_active_type"))
    blocks = blocks.where(accepted & title.isNotNull() & ~noise)
    target = F.coalesce("offer.url", "detail")
    ordinal = F.row_number().over(Window.partitionBy("page_id").orderBy("rank", "start"))
    found = blocks.select("page_id", "slug", ordinal.alias("ordinal"), title.alias("title"), F.coalesce(target, "url").alias("source_url"), target.alias("application_url"), F.col("text").alias("source_text"))
    return dedup_titles(found).withColumn("stable_source_key", stable_key(F.col("slug"), F.col("source_url"), F.col("title")))


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, media, text, error) of pages (page_id, url, media_type, html) by their media type."""
    typed = pages.withColumn("media", media_type(F.col("media_type"), F.col("url")))
    as_html = page_text(texts_of(explode_nodes(typed.where("media = 'text/html'"), DROP_FOR_TEXT)))
    joined = typed.join(as_html, "page_id", "left")
    html = F.col("media") == "text/html"
    text = F.when(html, F.coalesce("text", F.lit(""))).when(F.col("media") == "text/plain", F.col("html"))
    return joined.select("page_id", "media", text.alias("text"), F.when(text.isNull(), F.concat(F.lit("unsupported media type: "), F.col("media"))).alias("error"))


#: Links of a page that stand in one row, about; pairs of a start and a page that one task tells apart, about; lots so many times larger are told by pairs.
ROW_LINKS, LOT_PAIRS, HEAVY = 65_536, 1_000_000, 8


def expand_links(starts: DataFrame, links: DataFrame, snapshot: DataFrame, max_depth: int = 2) -> DataFrame:
    """(start, url, depth, found): pages reached from each start within max_depth links (from_url, url).

    A page is reached once, at its least depth. found tells whether snapshot (url) holds it; only
    pages that it holds are gone through; a link without an address is none. Each hop reads what the ones before have
    written and adds its own to one folder, by depth, so that its plan is the same at any depth.

    Starts are dealt into lots by ranges. A lot gets the list of links of each page that its starts have reached once, and
    makes and tells apart its pairs of starts and pages where they are: what a hop moves is lists, not the pairs that it makes.
    """
    spark = starts.sparkSession
    home = f"{shared_folder(spark)}/reached-{uuid.uuid4().hex}"
    held = snapshot.select(F.col("url").alias("held")).distinct()

    def with_found(df: DataFrame) -> DataFrame:
        return df.join(held, df["url"] == held["held"], "left").withColumn("found", F.col("held").isNotNull()).drop("held")

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{home}-{name}")
        return spark.read.parquet(f"{home}-{name}")

    with_found(starts.toDF("url").distinct()).select(F.col("url").alias("start"), "url", "found").write.parquet(f"{home}/depth=0")
    given = links.select("from_url", "url").where("from_url IS NOT NULL AND url IS NOT NULL")
    hubs = given.groupBy(F.col("from_url").alias("hub")).agg(F.ceil(F.count("*") / ROW_LINKS).alias("rows")).where("rows > 1")
    row = F.pmod(F.xxhash64("url"), F.coalesce("rows", F.lit(1))).alias("row")
    listed = with_found(given).join(F.broadcast(hubs), F.col("from_url") == F.col("hub"), "left")  # a hub for each ROW_LINKS links at most
    lists = stored(listed.groupBy("from_url", F.col("found").alias("to_found"), row).agg(F.collect_set("url").alias("to")), "links")
    of_page = 2 * (lists.agg(F.avg(F.size("to"))).first()[0] or 0)  # those that the snapshot holds and the others are rows of their own

    def hop(depth: int) -> DataFrame:
        """What this hop adds."""
        seen = spark.read.parquet(home)
        edge = F.col("found") & (F.col("depth") == depth - 1)
        every, edges = seen.agg(F.count("*"), F.count_if(edge)).first()
        lots = max(1, math.ceil((every + edges * of_page) / LOT_PAIRS))
        ranged = seen.repartitionByRange(lots, "start").withColumn("lot", F.spark_partition_id())
        groups = stored(ranged.groupBy("lot", "url", "found", "depth").agg(F.collect_list("start").alias("starts")), f"groups-{depth}")
        before = groups.select("lot", "starts", F.array("url").alias("urls"), "found", "depth")
        after = groups.where(edge).join(lists, F.col("url") == F.col("from_url"))
        dealt = stored(before.unionByName(after.select("lot", "starts", F.col("to").alias("urls"), F.col("to_found").alias("found"), F.lit(depth).alias("depth"))), f"lots-{depth}")
        size = F.sum(F.size("starts").cast("long") * F.size("urls"))
        heavy = F.broadcast(dealt.groupBy("lot").agg(size.alias("pairs")).where(F.col("pairs") > HEAVY * LOT_PAIRS).select("lot"))  # a row for each lot at most

        def told(lists: DataFrame, *lot: str) -> DataFrame:
            rows = lists.select(*lot, F.explode("starts").alias("start"), "urls", "found", "depth")
            rows = rows.select(*lot, "start", F.explode("urls").alias("url"), "found", "depth")
            return rows.groupBy(*lot, "start", "url", "found").agg(F.min("depth").alias("least")).where(F.col("least") == depth).select("start", "url", "found")

        # A lot's rows meet in one task, and its pairs stay there. A start that reaches so many pages that its lot is heavy spreads over tasks.
        own = told(dealt.join(heavy, "lot", "left_anti").repartitionById(lots, F.col("lot")), "lot")
        return own.unionByName(told(dealt.join(heavy, "lot", "left_semi")))

    for depth in range(1, max_depth):
        hop(depth).write.parquet(f"{home}/depth={depth}")
    seen = spark.read.parquet(home)
    if max_depth > 0:  # nothing goes on from the last hop, so it need not be written
        seen = seen.unionByName(hop(max_depth).withColumn("depth", F.lit(max_depth)))
    return seen.select("start", "url", F.col("depth").cast("int").alias("depth"), "found")
