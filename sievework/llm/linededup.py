"""Exact line de-duplication across documents with levelled sorted runs of line hashes.

Documents are taken in batches of ascending doc_id. A run is a table of line hashes without repeats,
bucketed and sorted by the hash; all runs have the same number of buckets. Each batch merge-anti-joins
all runs so far, which are neither shuffled nor sorted for it: a line that a run holds has an owner in
an earlier batch; the rest are new, and the new lines, each with the smallest doc_id that holds it,
become a run of level 0. When `fan_in` runs of a level have come together, they are merged into
one run of the next level, bucket by bucket, so that a batch meets few runs however many batches came before.

All of it is DataFrame operations. Hashes alone are compared; a document's verdicts come back to it as
one array of flags, for which each text is shuffled once.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import remove
from .common import BLANKS, ascii_lower, columns_of, shared_folder, unused

LEAST_CHARS = 10
_LAST = (1 << 63) - 1


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _two_hashes(value: Column) -> tuple[Column, Column]:
    """128 bits in all: XXH64 under the default seed and under another."""
    return F.xxhash64(value), F.xxhash64(F.lit("line"), value)


def _document(doc_id: str, text: str) -> tuple[Column, Column]:
    """What tells documents apart: the id, null as the largest, and the text's hash for rows that share it."""
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(_LAST)), F.xxhash64(F.coalesce(F.col(text), F.lit("")))


class Runs:
    """The sorted runs (k1, k2, owner), by level: names of tables."""

    def __init__(self, spark: SparkSession, fan_in: int = 4):
        self.spark, self.fan_in, self.levels = spark, fan_in, []
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def add(self, run: DataFrame, level: int = 0) -> None:
        if level == len(self.levels):
            self.levels.append([])
        name = f"line_run_{uuid.uuid4().hex}"
        ordered = run.select("k1", "k2", "owner").write.bucketBy(self.buckets, "k1", "k2").sortBy("k1", "k2")
        ordered.option("path", self._path(name)).saveAsTable(name)
        self.levels[level].append(name)
        if len(self.levels[level]) == self.fan_in:
            full, self.levels[level] = self.levels[level], []
            self.add(reduce(self._merged, map(self.spark.table, full)), level + 1)
            for old in full:
                self.spark.sql(f"DROP TABLE {old}")
                remove(self.spark, self._path(old))

    def all(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in reversed(self.levels) for name in level]

    def close(self) -> list[str]:
        """Takes the runs out of the catalogue; their folders, which stay."""
        names = [name for level in reversed(self.levels) for name in level]
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.levels = []
        return [self._path(name) for name in names]

    def _path(self, name: str) -> str:
        return f"{shared_folder(self.spark)}/{name}"

    @staticmethod
    def _merged(a: DataFrame, b: DataFrame) -> DataFrame:
        """Both have no hash in common, so each row of the merge is one side's."""
        return a.join(b.withColumnRenamed("owner", "other"), ["k1", "k2"], "full_outer").select("k1", "k2", F.coalesce("owner", "other").alias("owner"))


def _own_session(spark: SparkSession) -> SparkSession:
    """A session with the same settings in which a bucket counts as sorted, since it is one sorted file; others' queries do not see that."""
    own = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if name.startswith("spark.sql.") and own.conf.isModifiable(name):
            own.conf.set(name, value)
    own.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
    return own


def owners(spark: SparkSession, path: str, n_batches: int = 3, fan_in: int = 2) -> list[DataFrame]:
    """Runs (k1, k2, owner) that hold every hash of the stored lines (k1, k2, id) once, with the smallest id that holds it.

    Lines without a second hash are left out. The catalogue holds the runs only while they are made; their files stay, as they are read for the result.
    """
    own = _own_session(spark)
    lines = own.read.parquet(path).where(F.col("k2").isNotNull())
    cuts = lines.select(F.percentile_approx("id", [i / n_batches for i in range(1, n_batches)], 1000)).first()[0] or []
    edges = [None, *sorted(set(cuts)), None]
    runs = Runs(own, fan_in)
    try:
        for low, high in zip(edges, edges[1:], strict=False):
            batch = lines
            if low is not None:
                batch = batch.where(F.col("id") > low)
            if high is not None:
                batch = batch.where(F.col("id") <= high)
            new = batch.groupBy("k1", "k2").agg(F.min("id").alias("owner"))
            for run in runs.all():
                new = new.join(run, ["k1", "k2"], "left_anti")
            runs.add(new)
    finally:
        paths = runs.close()
    return [spark.read.schema("k1 long, k2 long, owner long").parquet(p) for p in paths]


def drop_repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_batches: int = 3, fan_in: int = 2, kept: str = "kept", n_lines: str = "n_lines", n_dropped: str = "n_dropped") -> DataFrame:
    """docs with the text without repeated lines, the number of its lines and of those dropped, under the given names.

    A line's key is the line without blanks at its ends, A-Z lower-cased. A key of `LEAST_CHARS` or
    more code points that several documents hold stays only in the one with the smallest id, there
    with all its lines. A null text counts as one empty line. A null id counts as the largest; rows
    that share an id are one document's, and each row keeps its own text. An empty table stays empty.
    docs must have no column of the given names.
    """
    if taken := {kept, n_lines, n_dropped} & set(docs.columns):
        raise ValueError(f"docs has a column of that name: {', '.join(sorted(taken))}")
    own_id, own_of, flag = (unused(docs, c) for c in ("__id", "__of", "__flags"))
    ident, of = _document(doc_id, text)
    split = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)
    lines = docs.select(ident.alias("id"), of.alias("of"), F.posexplode(split).alias("at", "line"))
    keyed = lines.select("id", "of", "at", line_key(F.col("line")).alias("key"))
    long = F.char_length("key") >= LEAST_CHARS
    k1, k2 = _two_hashes(F.col("key"))
    # Short lines have no second hash and so no owner; their first one only spreads them.
    keyed = keyed.select("id", "of", "at", F.when(long, k1).otherwise(F.xxhash64("id", "at")).alias("k1"), F.when(long, k2).alias("k2"))
    spark = docs.sparkSession
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    keyed.write.parquet(path)
    keyed = spark.read.schema(keyed.schema).parquet(path)
    first = reduce(DataFrame.unionByName, owners(spark, path, n_batches, fan_in))
    judged = keyed.join(first, ["k1", "k2"], "left").select("id", "of", "at", F.coalesce(F.col("owner") < F.col("id"), F.lit(False)).alias("drop"))
    flags = judged.groupBy(F.col("id").alias(own_id), F.col("of").alias(own_of)).agg(F.transform(F.sort_array(F.collect_set(F.struct("at", "drop"))), lambda x: x["drop"]).alias(flag))
    named = docs.select("*", ident.alias(own_id), of.alias(own_of))
    rest = F.filter(split, lambda x, i: ~F.col(flag)[i])
    return named.join(flags, [own_id, own_of]).select(*columns_of(docs), F.array_join(rest, "\n").alias(kept), F.size(flag).cast("long").alias(n_lines), F.size(F.filter(flag, lambda x: x)).cast("long").alias(n_dropped))
