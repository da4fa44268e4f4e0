"""Page snapshots in; snapshots, appended tables, stored bodies and audit manifests out."""

from __future__ import annotations

import re
import tempfile
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import storage_key
from .commits import CommittedTable


def read_pages(spark: SparkSession, path: str, manifest: DataFrame | None = None) -> DataFrame:
    """A table of pages, or with a manifest (file, url, ...) the captured files of a folder."""
    if manifest is None:
        return spark.read.parquet(path)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content", F.sha2("content", 256).alias("content_hash")).join(manifest, "file")


def write_snapshot(df: DataFrame, root: str, batch: tuple[str, int] | None = None) -> int:
    """Commits a whole table as the next version of a CommittedTable; readers keep theirs. A repeated (writer, batch) changes nothing."""
    return CommittedTable(df.sparkSession, root).replace(df, batch)


def append_new(df: DataFrame, root: str, keys: list[str], batch: tuple[str, int] | None = None) -> int:
    """Commits the rows whose keys are not stored yet, one for each, whoever else writes or has written this batch before."""
    return CommittedTable(df.sparkSession, root).append_new(df, keys, batch)


def write_bodies(df: DataFrame, path: str) -> None:
    """Bodies (content binary) once each under their digest, in folders by its first two digits."""
    keyed = df.withColumn("content_hash", F.sha2("content", 256)).dropDuplicates(["content_hash"])
    keyed = keyed.withColumns({"storage_key": storage_key(F.col("content_hash")), "prefix": F.substring("content_hash", 1, 2)})
    keyed.select("content_hash", "storage_key", "content", "prefix").write.mode("append").partitionBy("prefix").parquet(path)


def write_manifest(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def write_summary(report: DataFrame, path: str) -> None:
    """audit()'s rows as Markdown: a table of the origins and the result, in one text file, as an audit has a row for each origin."""
    line = F.format_string("| %s | %d | %d/%d |", "origin", "checked", "allowed", "checked")
    rows = report.select(F.lit(1).alias("part"), "origin", line.alias("value"))
    head = report.sparkSession.createDataFrame([(0, "", "# Robots policy audit\n\n| Origin | URLs checked | Allowed |\n|---|---:|---:|")], rows.schema)
    good = "All configured crawl targets are allowed by the retrieved policies."
    bad = "The crawler must not run against every configured target until the exceptions are resolved."
    verdict = F.when(F.coalesce(F.bool_and("compliant"), F.lit(True)), good).otherwise(bad)
    result = report.agg(F.concat(F.lit("\n## Result\n\n"), verdict).alias("value")).select(F.lit(2).alias("part"), F.lit("").alias("origin"), "value")
    lines = head.unionByName(rows).unionByName(result).coalesce(1).sortWithinPartitions("part", "origin")
    lines.select("value").write.mode("overwrite").text(path)


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have, made from the given one."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which driver and executors share.

    Only a session that runs in this one process may leave it unset, as tests do, and gets a temporary folder.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir")
    if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (folder or _own_folder()).rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="checkpoint-")


def checkpointed(df: DataFrame) -> DataFrame:
    """df from the cluster's shared checkpoint folder, so that what is costly to make is made once."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
