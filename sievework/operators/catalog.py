"""The catalogue: a view over listings and its dimensions, filters, sorts, pages and facets."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import freshness
from ..sources.storage import checkpointed, shared_folder, unused

PAGE_SIZES = (1, 100)


def catalog(listings: DataFrame, chairs: DataFrame, departments: DataFrame, today: Column) -> DataFrame:
    """listings (chair_id, published_at, ...) with the names of chair and department, and freshness."""
    named = listings.join(chairs.select(F.col("id").alias("chair_id"), F.col("name").alias("chair"), "department_id"), "chair_id")
    named = named.join(departments.select(F.col("id").alias("department_id"), F.col("name").alias("department")), "department_id")
    return named.withColumn("freshness", freshness(F.col("published_at"), today))


def filter_status(df: DataFrame, status: str) -> DataFrame:
    return df.where(F.col("status") == status)


def search(df: DataFrame, query: str | None, columns: Sequence[str] = ("reference_code", "title", "summary", "chair")) -> DataFrame:
    """Rows whose columns, joined by spaces, hold the query, whatever its case. Null columns count as empty."""
    if not query:
        return df
    joined = F.concat_ws(" ", *(F.coalesce(F.col(c), F.lit("")) for c in columns))
    return df.where(F.contains(F.lower(joined), F.lower(F.lit(query))))


def filter_in(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Rows whose column is one of a few values; no value means no filter. For many, use filter_selected()."""
    return df.where(F.col(column).isin(*values)) if values else df


def filter_selected(df: DataFrame, column: str, selected: DataFrame) -> DataFrame:
    """Rows whose column is in the first column of a selection table."""
    return df.join(selected.toDF(column), column, "left_semi")


def unknown_names(asked: DataFrame, known: DataFrame) -> DataFrame:
    """The distinct names of the first that the second lacks; both have one column."""
    return asked.subtract(known.toDF(*asked.columns))


def select_named(df: DataFrame, column: str, names: Sequence[str]) -> DataFrame:
    """Rows whose column is one of the names; a name that no row has is an error."""
    asked = df.sparkSession.createDataFrame([(n,) for n in names], f"{column} string")
    unknown = sorted(r[0] for r in unknown_names(asked, df.select(F.col(column).cast("string"))).collect())  # of the few names given
    if unknown:
        raise ValueError(f"unknown {column}: {', '.join(unknown)}")
    return filter_selected(df, column, asked)


def filter_topics(df: DataFrame, topics: Sequence[str]) -> DataFrame:
    return df.where(F.arrays_overlap("topics", F.array(*map(F.lit, topics)))) if topics else df


SORTS = {
    "title": lambda: [F.lower("title").asc()],
    "chair": lambda: [F.lower("chair").asc()],
    "deadline": lambda: [F.col("deadline").asc_nulls_last()],
    "newest": lambda: [F.col("first_seen_at").desc()],
    "published": lambda: [F.col("published_at").desc_nulls_last(), F.col("first_seen_at").desc()],
}


def sorted_by(df: DataFrame, sort: str) -> DataFrame:
    """Ties, and sorts of no known name, go by the slug, which is unique."""
    return df.orderBy(*SORTS.get(sort, list)(), "slug")


def _checked(number: int, size: int) -> None:
    if number < 1 or not PAGE_SIZES[0] <= size <= PAGE_SIZES[1]:
        raise ValueError("pages count from 1 and hold 1 to 100 rows")


def page(df: DataFrame, sort: str, number: int = 1, size: int = 20) -> DataFrame:
    """One page. For pages far behind the first, and for many of one table, see Pages."""
    _checked(number, size)
    return sorted_by(df, sort).offset((number - 1) * size).limit(size)


class Pages:
    """A sorted table of which any page is read from the one or two ranges that hold it.

    Rows are dealt out once by ranges of the sort's keys and stored range by range, sorted, each with its place in its
    range; how many each holds tells where a page is. To read one, only its rows are taken from its ranges, wherever it
    stands. after() reads the page behind a row that was seen, by the same ranges, and is not moved by rows that came or
    went before it.
    """

    def __init__(self, df: DataFrame, sort: str):
        spark = df.sparkSession
        self.sort, self._part, self._place = sort, unused(df, "page_range"), unused(df, "page_place")
        home = f"{shared_folder(spark)}/pages-{uuid.uuid4().hex}"
        order = (*SORTS.get(sort, list)(), "slug")
        ranged = df.repartitionByRange(*order).withColumn(self._part, F.spark_partition_id()).sortWithinPartitions(self._part, *order)
        placed = ranged.withColumn(self._place, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))  # counted from 0 in each partition
        placed.write.partitionBy(self._part).parquet(home)
        self._stored = spark.read.schema(placed.schema).parquet(home)
        sizes = dict(self._stored.groupBy(self._part).count().collect())  # a row for each range
        self._starts, self.total = {}, 0
        for part in sorted(sizes):
            self._starts[part] = self.total
            self.total += sizes[part]
        self._ends = {part: start + sizes[part] for part, start in self._starts.items()}

    def rows(self, start: int, count: int) -> DataFrame:
        """So many rows from a place on, counted from 0."""
        within = [p for p in self._starts if self._starts[p] < start + count and self._ends[p] > start]
        if not within:
            return self._stored.drop(self._part, self._place).limit(0)
        found = self._stored.where(F.col(self._part).isin(*within))
        # Rows are told by their places, so that a task gives away no more than the asked ones.
        asked = reduce(or_, ((F.col(self._part) == p) & F.col(self._place).between(start - self._starts[p], start + count - 1 - self._starts[p]) for p in within))
        return sorted_by(found.where(asked), self.sort).limit(count).drop(self._part, self._place)

    def page(self, number: int = 1, size: int = 20) -> DataFrame:
        _checked(number, size)
        return self.rows((number - 1) * size, size)

    def page_or_last(self, number: int = 1, size: int = 20) -> DataFrame:
        """page(), or the last page where the asked one lies beyond it."""
        return self.page(clamped_page(number, self.total, size), size)

    def after(self, slug: str, size: int = 20) -> DataFrame:
        """The page behind the row of a slug; an unknown slug is an error."""
        _checked(1, size)
        place = self._stored.where(F.col("slug") == slug).select(self._part, self._place).first()
        if place is None:
            raise ValueError(f"unknown slug: {slug}")
        return self.rows(self._starts[place[0]] + place[1] + 1, size)


def page_or_last(df: DataFrame, sort: str, number: int = 1, size: int = 20) -> DataFrame:
    """page(), or the last page where the asked one lies beyond it; both are found by ranges."""
    return Pages(df, sort).page_or_last(number, size)


def clamped_page(number: int, total: int, size: int) -> int:
    """A page beyond the last one is the last one; there is always a first."""
    return max(1, min(number, -(-total // size)))


def totals(filtered: DataFrame, stored: DataFrame) -> DataFrame:
    """One row: how many rows a filter kept, and when any stored row was last seen."""
    return filtered.agg(F.count("*").alias("total")).join(F.broadcast(stored.agg(F.max("last_seen_at").alias("last_updated_at"))))  # a row each


def facets(df: DataFrame, departments: DataFrame, topics: DataFrame) -> DataFrame:
    """(facet, value, n) over all rows, with a zero for each known department and topic that has none."""

    def counted(kind: str, values: DataFrame, rows: DataFrame) -> DataFrame:
        known, found = values.toDF("value").distinct(), rows.toDF("value").groupBy("value").agg(F.count("*").alias("n"))
        return known.join(found, "value", "left").select(F.lit(kind).alias("facet"), "value", F.coalesce("n", F.lit(0)).alias("n"))

    topic_rows = df.select(F.explode(F.array_distinct("topics")))
    return counted("department", departments, df.select("department")).unionByName(counted("topic", topics, topic_rows))


def chairs_of_departments(chairs: DataFrame) -> DataFrame:
    """(department, chairs): names in order."""
    return chairs.groupBy("department").agg(F.sort_array(F.collect_set("chair")).alias("chairs"))


def lookup(df: DataFrame, slug: str) -> DataFrame:
    return df.where(F.col("slug") == slug)


def numbered(df: DataFrame, prefix: str, order: Sequence[str], name: str = "number") -> DataFrame:
    """df with each row's number, from 1, among those of its prefix in the given order, which must be total.

    Rows are range-partitioned by prefix and order, so that a prefix with most of the rows spreads over many
    partitions; a row's number is its place in its partition after the prefix's rows in the partitions before.
    """
    part, of, own, n, behind = (unused(df, c) for c in ("part", "of_part", "own_prefix", "size_of_part", "rows_before"))
    placed = checkpointed(df.repartitionByRange(prefix, *order).withColumn(part, F.spark_partition_id()))
    before = Window.partitionBy(prefix).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # a row for each prefix and partition
    sizes = placed.groupBy(prefix, part).agg(F.count("*").alias(n))
    starts = sizes.select(F.col(prefix).alias(own), F.col(part).alias(of), F.coalesce(F.sum(n).over(before), F.lit(0)).alias(behind))
    within = F.row_number().over(Window.partitionBy(prefix, part).orderBy(*order))
    local = placed.withColumn(name, within)
    known = local.join(starts, F.col(prefix).eqNullSafe(F.col(own)) & (F.col(part) == F.col(of)))
    return known.withColumn(name, (F.col(name) + F.col(behind)).cast("long")).drop(part, own, of, behind)


def reference_codes(df: DataFrame, prefix: str, order: Sequence[str], existing: DataFrame | None = None) -> DataFrame:
    """df with a `number` in its prefix's series: after the largest existing code whose tail is digits, in the given order."""
    found = numbered(df, prefix, order)
    if existing is None:
        return found
    tail = F.regexp_extract("reference_code", r"-([0-9]+)$", 1)
    most = existing.where(tail != "").groupBy(F.regexp_extract("reference_code", r"^(.*)-[0-9]+$", 1).alias(prefix)).agg(F.max(tail.cast("int")).alias("__most"))
    return found.join(most, prefix, "left").withColumn("number", F.col("number") + F.coalesce("__most", F.lit(0))).drop("__most")
