"""Structural joins over pages: one walk along a page's positions with the stack of what is open.

Nodes are intervals on a page's line of positions which nest or are apart. Whatever lies in an interval is met
while the interval is on the stack, so that a walk takes time in proportion to the page and to what it finds, however many
blocks a page has. Pages are dealt out by their ids and sorted by position; a page has a bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_VALUES = pa.map_(pa.string(), pa.string())


class _Open:
    """A block that is open, and what has been found in it."""

    __slots__ = ("end", "joined", "start", "values")

    def __init__(self, start: int, end: int, values: dict[str, str]):
        self.start, self.end, self.values, self.joined = start, end, values, {}

    def row(self, page, separator: str) -> tuple:
        joined = {name: separator.join(pieces) for name, pieces in self.joined.items()}
        return page, self.start, self.end, list((self.values | joined).items())


def _walk(rows: Iterator[tuple], separator: str) -> Iterator[tuple]:
    """(page, start, end, values) of blocks from rows (page, at, end, name, value, how) in order; a block's row has an end."""
    page, stack, before = object(), [], {}
    for of, at, end, name, value, how in rows:
        if of != page:
            while stack:
                yield stack.pop().row(page, separator)
            page, before = of, {}
        while stack and stack[-1].end < at:
            yield stack.pop().row(page, separator)
        if end is not None:
            if not (stack and stack[-1].start == at):  # a block that is given twice is one
                stack.append(_Open(at, end, dict(before)))
        elif how == "before":
            before[name] = value
        elif how == "first":
            for block in stack:
                block.values.setdefault(name, value)
        else:
            for block in stack:
                block.joined.setdefault(name, []).append(value)
    while stack:
        yield stack.pop().row(page, separator)


def _batches(parts, columns: list[str], walk, names: list[str], kinds: list):
    """Record batches of what a walk makes of the rows of sorted batches; the first column keeps the pages' type."""
    page_type = pa.null()

    def rows():
        nonlocal page_type
        for batch in parts:
            page_type = batch.schema.field("page_id").type
            yield from zip(*(batch.column(c).to_pylist() for c in columns), strict=True)

    found = walk(rows())
    while out := list(islice(found, 4096)):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), [page_type, *kinds], strict=True)], names)


def point(name: str, at: str, value: Column, how: str) -> list[Column]:
    """The columns of gathered()'s points beside page_id."""
    return [F.col(at).alias("at"), F.lit(name).alias("name"), value.cast("string").alias("value"), F.lit(how).alias("how")]


def gathered(blocks: DataFrame, points: DataFrame, separator: str = " ") -> DataFrame:
    """(page_id, start, end, values): what the points (page_id, at, name, value, how) say of each block (page_id, start, end), by their names.

    `join` puts together the values of all points in the block in their order, `first` takes the first one's, and `before` the last
    one's that does not start after the block. A point is in a block if it lies between its start and end. Points with null values
    are left out; blocks of one page that start together are one.
    """
    kind = blocks.schema["page_id"].dataType.simpleString()
    marks = blocks.select("page_id", F.col("start").alias("at"), F.col("end"), *(F.lit(None).cast("string").alias(c) for c in ("name", "value", "how")))
    given = points.where("value is not null").select("page_id", "at", F.lit(None).cast("long").alias("end"), "name", "value", "how")
    # A point comes before a block that starts where it stands.
    ordered = marks.unionByName(given).repartition("page_id").sortWithinPartitions("page_id", "at", F.col("end").isNotNull())

    def batches(parts):
        yield from _batches(parts, ["page_id", "at", "end", "name", "value", "how"], lambda rows: _walk(rows, separator), ["page_id", "start", "end", "values"], [pa.int64(), pa.int64(), _VALUES])

    return ordered.mapInArrow(batches, f"page_id {kind}, start long, end long, values map<string, string>")


# ---- Selectors.


def compounds(selectors: DataFrame, selector: str = "selector") -> DataFrame:
    """(selector, nth, last, key, tag, classes, names, values): the compounds of each distinct selector of a table.

    A compound is a tag, classes and attribute values, and a descendant of the one before. Any other selector is an
    error. key is what a node must have at least: a class, else the tag, else an attribute.
    """
    part = r"[a-z][a-z0-9]*|\.[\w-]+|\[[\w-]+='[^']*'\]"
    split = selectors.select(F.col(selector).alias("selector")).where("selector is not null").distinct()
    # Blanks within an attribute's value part nothing.
    listed = split.withColumn("compounds", F.regexp_extract_all("selector", F.lit(rf"(?:\[[^\]]*\]|[^\s\[])+"), F.lit(0)))
    each = listed.select("selector", F.size("compounds").alias("size"), F.posexplode("compounds").alias("nth", "compound"))
    well = F.regexp_like("compound", F.lit(rf"^(?:[a-z][a-z0-9]*)?(?:\.[\w-]+|\[[\w-]+='[^']*'\])*$"))
    error = F.raise_error(F.concat(F.lit("a selector of tag, .class and [attr='value'] is needed: "), "selector"))
    bare = F.regexp_replace("compound", r"\[[^\]]*\]", "")
    read = each.select(
        "selector", "nth", (F.col("nth") == F.col("size") - 1).alias("last"), F.when(well, F.regexp_extract("compound", "^([a-z][a-z0-9]*)?", 1)).otherwise(error.cast("string")).alias("tag"),
        F.regexp_extract_all(bare, F.lit(r"\.([\w-]+)"), F.lit(1)).alias("classes"),
        F.regexp_extract_all("compound", F.lit(r"\[([\w-]+)='[^']*'\]"), F.lit(1)).alias("names"), F.regexp_extract_all("compound", F.lit(r"\[[\w-]+='([^']*)'\]"), F.lit(1)).alias("values"),
    )
    key = F.when(F.size("classes") > 0, F.concat(F.lit("."), F.get("classes", F.lit(0)))).when(F.col("tag") != "", F.col("tag")).otherwise(F.concat(F.lit("["), F.get("names", F.lit(0))))
    return read.withColumn("key", key)


def _chained(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(page, start, end, selector) from rows (page, start, end, selector, nth, last) in order of position."""
    page, stack, reached, at, waiting = object(), [], {}, None, []

    def opened():
        # What a node adds counts for what is inside it, not for itself.
        for end, selector, n in waiting:
            if n > reached.get(selector, 0):
                stack.append((end, selector, reached.get(selector, 0)))
                reached[selector] = n
        waiting.clear()

    for of, start, end, selector, nth, last in rows:
        if (of, start) != (page, at):
            opened()
        if of != page:
            page, stack, reached = of, [], {}
        at = start
        while stack and stack[-1][0] < start:
            _, name, n = stack.pop()
            reached[name] = n
        if nth <= reached.get(selector, 0):
            if last:
                yield of, start, end, selector
            else:
                waiting.append((end, selector, nth + 1))


def matches(nodes: DataFrame, selectors: DataFrame, selector: str = "selector") -> DataFrame:
    """(page_id, start, end, selector): the nodes that each selector of a table matches, each once.

    Nodes meet compounds by a tag, class or attribute that they have, and are then compared whole; chains of compounds are
    followed along each page. The plan is the same for any number of selectors.
    """
    wanted = compounds(selectors, selector)
    keys = F.concat(F.array("tag"), F.transform("classes", lambda c: F.concat(F.lit("."), c)), F.transform(F.map_keys("attrs"), lambda k: F.concat(F.lit("["), k)))
    has = nodes.select("page_id", "start", "end", F.col("tag").alias("own_tag"), F.col("classes").alias("own_classes"), "attrs", F.explode(F.array_distinct(keys)).alias("key"))
    met = has.join(wanted, "key").where(
        ((F.col("tag") == "") | (F.col("tag") == F.col("own_tag")))
        & (F.size(F.array_except("classes", "own_classes")) == 0)
        & F.forall(F.arrays_zip("names", "values"), lambda x: F.coalesce(F.col("attrs")[x["names"]] == x["values"], F.lit(False)))
    )
    ordered = met.select("page_id", "start", "end", "selector", "nth", "last").repartition("page_id").sortWithinPartitions("page_id", "start")
    kind = nodes.schema["page_id"].dataType.simpleString()

    def batches(parts):
        yield from _batches(parts, ["page_id", "start", "end", "selector", "nth", "last"], _chained, ["page_id", "start", "end", "selector"], [pa.int64(), pa.int64(), pa.string()])

    return ordered.mapInArrow(batches, f"page_id {kind}, start long, end long, selector string")
