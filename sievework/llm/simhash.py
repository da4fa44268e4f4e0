"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints differ in at most `radius` bits exactly if the balls of half that radius round
them share a value. Each distinct fingerprint therefore emits its ball, one shuffle brings equal
values together, and those that meet in a value are paired with the least of them. All members of
a value's ball are within the radius of each other, so such a star loses no link; its size is at
most the ball's, whatever the number of documents. Pairs are made distinct and verified.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import checkpointed, column_texts, columns_of, unused
from .components import connected_components

SEED = 42
_CHUNK = 1 << 15
_LAST = (1 << 63) - 1


def fingerprint(text: str | None, width: int = 3) -> int:
    """The SimHash of a text's word shingles as an unsigned 64-bit number; 0 if it has no word."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        part = words[at : min(at + _CHUNK, n) + width - 1]
        grams = map(b" ".join, zip(*(part[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
        hashes = np.array([xxhash.xxh64_intdigest(g, SEED) for g in grams], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, text: str = "text", out: str = "fp", width: int = 3) -> DataFrame:
    """docs and a column `out`, its fingerprint as a signed long; that column replaces one of its name."""
    docs = docs.drop(out)

    def batches(parts):
        for batch in parts:
            got = np.array([fingerprint(t, width) for t in column_texts(batch, text)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.int64())], [*batch.schema.names, out])

    return docs.mapInArrow(batches, StructType([*docs.schema.fields, StructField(out, LongType())]))


def links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b) pairs that link the distinct fingerprints of column fp within the radius, which must be even."""
    if radius % 2 or not 0 <= radius < 64:
        raise ValueError("ball hashing meets in the middle only for an even radius below 64")
    masks = [sum(1 << i for i in c) for k in range(radius // 2 + 1) for c in combinations(range(64), k)]
    ball = F.array(*(F.lit(m - (1 << 64) if m >> 63 else m) for m in masks))
    variants = prints.select("fp").distinct().select("fp", F.explode(ball).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    pairs = variants.select("fp", F.min("fp").over(Window.partitionBy("variant")).alias("a")).where("fp != a")
    pairs = pairs.select("a", F.col("fp").alias("b")).distinct()
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = 2, width: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs.

    component_id is the smallest doc_id among the documents whose fingerprints are reachable.
    Null and empty texts have fingerprint 0 and link like others. Rows with a null doc_id stay and
    link, but name no component; a component of such rows alone has a null component_id. Repeated
    rows stay, and an empty table gives an empty one.
    """
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    prints = checkpointed(with_fingerprints(source, width=width).select("doc_id", "fp"))
    return prints.join(components_of(prints, radius), "fp").select("doc_id", "fp", "component_id")


def components_of(prints: DataFrame, radius: int = 2) -> DataFrame:
    """(fp, root, component_id) for each distinct fp of prints (doc_id, fp); root is the component's least fp."""
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = connected_components(links(classes, radius)).withColumnRenamed("node", "fp")
    rooted = checkpointed(classes.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    firsts = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rooted.join(firsts, "root").select("fp", "root", "component_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = 2) -> DataFrame:
    """The rows of docs that stay when each near-duplicate component keeps one: the smallest doc_id.

    Null ids count as the largest. Where several rows of the component bear that id, the least of
    them by fingerprint, by a hash of the text and then by its other columns stays. Null and empty texts are
    near-duplicates of each other. Columns may have any type and name; an empty table stays empty.
    """
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("of"), F.col(text).alias("text"))
    prints = checkpointed(with_fingerprints(source).select("doc_id", "of", "fp"))
    best = prints.join(components_of(prints, radius), "fp").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp", "of")).alias("best"))
    # Rows are found again by id and text, and moved once for both the join and the choice among equals.
    own_id, own_of = unused(docs, "own_id"), unused(docs, "own_of")
    best = best.select(F.coalesce("best.doc_id", F.lit(_LAST)).alias(own_id), F.col("best.of").alias(own_of))
    named = docs.select("*", F.coalesce(F.col(doc_id).cast("long"), F.lit(_LAST)).alias(own_id), F.xxhash64(text).alias(own_of))
    sortable = [F.to_json(F.struct(c)) if "map<" in f.dataType.simpleString() else c for c, f in zip(columns_of(docs), docs.schema.fields, strict=True)]
    row = F.min_by(F.struct(*columns_of(docs)), F.struct(*sortable))
    return named.join(best, [own_id, own_of]).groupBy(own_id, own_of).agg(row.alias("row")).select("row.*")
