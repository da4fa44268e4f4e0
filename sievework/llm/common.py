"""Small helpers that the operators share."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.storage import checkpointed, shared_folder

__all__ = ["ascii_lower", "checkpointed", "column_texts", "columns_of", "map_whole_rows", "run_starts", "shared_folder", "stored", "suffix_order", "table", "unused"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The characters [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z and leaves every other letter as it is."""
    return F.translate(col, UPPER, LOWER)


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder as Parquet, which is smaller than a checkpoint, and read again, so that its lineage is cut."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def columns_of(df: DataFrame) -> list[Column]:
    """All columns of df, whatever their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def map_whole_rows(df: DataFrame, batches, schema: StructType) -> DataFrame:
    """df.mapInArrow() of all columns, also of those whose names are no plain words, which it cannot name itself."""
    names = df.columns

    def renamed(parts):
        return batches(pa.RecordBatch.from_arrays(x.columns, names) for x in parts)

    return df.toDF(*(f"c{i}" for i in range(len(names)))).mapInArrow(renamed, schema)


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have, made from the given one."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def column_texts(batch, name: str) -> list[str]:
    """The strings of a record batch's column, null as empty."""
    return ["" if x is None else x for x in batch.column(name).to_pylist()]


def run_starts(values: np.ndarray) -> np.ndarray:
    """For each of some sorted values the place at which its run of equal ones starts."""
    new = np.concatenate([[True], values[1:] != values[:-1]])
    return np.maximum.accumulate(np.where(new, np.arange(len(values)), 0))


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """The suffix array of a sequence of whole numbers, by prefix doubling.

    A suffix's rank is the first place of those that agree with it so far. The first sort takes several
    symbols at once, and each later one only the suffixes that still agree with another.
    """
    n = len(symbols)
    key = np.unique(symbols, return_inverse=True)[1].astype(np.int64) + 1
    base, step = int(key.max()) + 1, 1
    while base ** (2 * step) < 1 << 62 and step < n:
        after = np.zeros(n, np.int64)
        after[: n - step] = key[step:]
        key = key * base**step + after
        step *= 2
    order = np.argsort(key)
    part, slots, first = order, np.arange(n), run_starts(key[order])
    rank = np.empty(n, np.int64)
    while True:
        order[slots], rank[part] = part, first
        tied = np.concatenate([first[1:] == first[:-1], [False]]) | (first != slots)
        part = part[tied]
        if not len(part):
            return order
        after = np.zeros(len(part), np.int64)
        inside = part + step < n
        after[inside] = rank[part[inside] + step] + 1
        key = rank[part] * (n + 1) + after
        by = np.argsort(key)
        part, key = part[by], key[by]
        slots = rank[part] + np.arange(len(part)) - run_starts(rank[part])
        first = slots[run_starts(key)]
        step *= 2
