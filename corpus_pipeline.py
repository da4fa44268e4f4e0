"""A corpus pipeline of five operators: what a stage keeps is written and read by the next one.

The last stage returns the packed pieces; all others return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import decontam, linededup, packing, quality, simhash
from sievework.llm.common import columns_of, shared_folder, table, unused
from sievework.sources.storage import remove


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go.

    Null and empty texts have no words and are rejected. Repeated rows are judged each, null languages and
    sources are groups of their own, other columns are carried under any name. No document gives none.
    """
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, but in the document with the smallest doc_id; n_chars follows the text. Documents stay.

    A null text becomes an empty one; a null doc_id counts as the largest, and rows that share one are one
    document's. Other columns are carried under any name. No document gives none.
    """
    kept, n_lines, n_dropped = (unused(docs, c) for c in ("kept", "n_lines", "n_dropped"))
    found = linededup.drop_repeated_lines(docs, kept=kept, n_lines=n_lines, n_dropped=n_dropped)
    changed = {"text": F.col(kept), "n_chars": F.char_length(kept).cast("long")}
    return found.select(*(changed[c].alias(c) if c in changed else own for c, own in zip(docs.columns, columns_of(docs), strict=True)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the smallest doc_id, and of rows that share it the least one.

    Texts without words are near-duplicates of each other, null ones among them; null ids count as the
    largest. Other columns are carried under any name and type. No document gives none.
    """
    return simhash.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark contaminates go.

    Null and empty texts have no words and stay. Repeated rows are judged each; other columns are carried
    under any name. No document gives none, and an empty benchmark leaves all.
    """
    n_words, spans, items = (unused(docs, c) for c in ("n_words", "spans", "items"))
    found = decontam.with_hits(docs, table(spark, sf_dir, "benchmark"), n_words=n_words, spans=spans, items=items)
    return found.where(~decontam.contaminated(n_words, spans)).select(*columns_of(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of the documents' pieces in training sequences, without the documents' other columns.

    A null or empty text is an end token alone; null and repeated ids are carried. No document gives no piece.
    """
    return packing.pack_documents(docs)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("pack", pack)]

#: SQL has no tokenizer and no best fit.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet to the shared folder and read again; what no later stage reads is removed."""
    home = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for n, (name, stage) in enumerate(STAGES):
        path = f"{home}/{n}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
