"""Contiguous shards of near-equal bytes from global prefix sums.

Rows are range-partitioned in document order; a running sum within each partition and the totals of
the partitions before it give every row its place in the whole. The sum is cut at equal targets.
Only ids, sizes and checksums move, never texts, and what is summed in one place is one row for
each partition. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

OVERHEAD = 8


def shard_by_bytes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = 24) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of each row of docs.

    size is the UTF-8 bytes of the text plus OVERHEAD. Order is by doc_id, nulls first, then by
    checksum and size; rows equal in all three are alike, so their order says nothing. A row
    belongs to the shard that holds the middle of its bytes: a shard's bytes differ from the target by
    a row's size at most. slot counts from 0 in each shard. A null text has no bytes; an empty table
    gives an empty one; with fewer rows than shards some shards stay empty.
    """
    bytes_ = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    rows = docs.select(F.col(doc_id).alias("doc_id"), (bytes_ + OVERHEAD).alias("size"), F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"))
    order = ["doc_id", "text_crc32", "size"]
    placed = checkpointed(rows.repartitionByRange(*order).select("*", F.spark_partition_id().alias("part")))
    totals = placed.groupBy("part").agg(F.sum("size").alias("part_size"), F.count("*").alias("part_rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    starts = totals.select("part", F.coalesce(F.sum("part_size").over(before), F.lit(0)).alias("size_before"), F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("rows_before"), F.sum("part_size").over(Window.partitionBy()).alias("total"))
    within = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = placed.select("*", F.sum("size").over(within).alias("upto"), F.row_number().over(Window.partitionBy("part").orderBy(*order)).alias("nth"))
    known = local.join(F.broadcast(starts), "part")  # one row for each partition
    middle = 2 * (F.col("size_before") + F.col("upto")) - F.col("size")
    shard = F.expr(f"least({shards - 1}, (middle * {shards}) div (2 * total))").cast("int")
    cut = known.select("doc_id", "size", "text_crc32", (F.col("rows_before") + F.col("nth") - 1).alias("row"), middle.cast("decimal(38,0)").alias("middle"), "total")
    cut = cut.select("doc_id", "size", "text_crc32", "row", shard.alias("shard"))
    first = cut.groupBy("shard").agg(F.min("row").alias("first"))
    return cut.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("first")).alias("slot"))  # one row for each shard
