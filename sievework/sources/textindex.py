"""A catalogue snapshot with an index of its texts, so that a search reads the blocks that may hold the query.

Rows are stored in the order of their key, in blocks of `BLOCK_ROWS` neighbours. The index holds a row for each
run of three letters and block in which it stands, in order of the runs: to look up a query's runs reads a few row
groups of it. Blocks that hold all runs of the query may hold the query, and no others: they are read, by a filter on
the block that the files' statistics answer, and searched. Snapshot and index are committed together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grams import SIZE, grams, grams_of
from ..operators.catalog import search
from .commits import CommittedTable

BLOCK_ROWS = 4096
#: Blocks that are named in a filter; more are met by a join.
MOST_NAMED = 2000
INDEX = "grams"
BLOCK = "search_block"


def _searched(columns: Sequence[str]) -> Column:
    return F.lower(F.concat_ws(" ", *(F.coalesce(F.col(c), F.lit("")) for c in columns)))


def write_searchable(table: CommittedTable, rows: DataFrame, key: str, columns: Sequence[str], batch: tuple[str, int] | None = None, block_rows: int = BLOCK_ROWS) -> int:
    """Commits rows as the table's next version, with column `search_block` and the index of these columns; returns the version.

    Null columns count as empty; rows without any text are in no run's list. Null keys come first.
    """
    at = F.monotonically_increasing_id()  # the partition and, in the lower 33 bits, the row in it
    block = F.shiftleft(F.shiftright(at, 33), 31) + (at.bitwiseAND((1 << 33) - 1) / block_rows).cast("long")
    ordered = rows.repartitionByRange(key).sortWithinPartitions(key).withColumn(BLOCK, block)

    def index(made: DataFrame) -> DataFrame:
        found = made.select(F.explode(grams(_searched(columns))).alias("gram"), BLOCK).distinct()
        return found.repartitionByRange("gram", BLOCK).sortWithinPartitions("gram", BLOCK)

    # Readers pass over pages by their statistics, so a page is a block.
    return table.replace(ordered, batch, {INDEX: index}, {"parquet.page.row.count.limit": block_rows})


def search_stored(table: CommittedTable, query: str | None, columns: Sequence[str], version: int | None = None) -> DataFrame:
    """catalog.search() over a version that write_searchable() has made; queries under three letters read all rows."""
    record = table.record(version)
    rows = table.read(version)
    index = table.index(INDEX, record)
    wanted = grams_of((query or "").lower(), SIZE)
    if index is not None and wanted:
        blocks = index.where(F.col("gram").isin(*wanted)).groupBy(BLOCK).agg(F.count("*").alias("n")).where(F.col("n") == len(wanted)).select(BLOCK)
        named = [r[0] for r in blocks.limit(MOST_NAMED + 1).collect()]
        rows = rows.where(F.col(BLOCK).isin(*named)) if len(named) <= MOST_NAMED else rows.join(blocks, BLOCK, "left_semi")
    return search(rows, query, columns).drop(BLOCK)
