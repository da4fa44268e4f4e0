"""Quality rules whose thresholds come from mergeable quantile sketches per language and source.

A sketch is a count per bucket of whole numbers; a bucket holds the numbers that share their leading
bits, so that a quantile is known to one part in 32. Two sketches merge by adding counts: that is a
grouped sum, which Spark combines before its shuffle, so a hot source costs no more than another,
and the same sums over fewer keys are the sketches of a language and of everything. A small
(language, source) group has its sketch merged with its language's, and a small language with all.

A document is compared with its group's fences: the upper decile plus `SPREAD` times its distance
from the median, and for letters per word the lower decile likewise. Where most documents of a
group have the same value, as with repeated lines, that distance is zero; a single symbol or line
then is the least that can be told apart, and what it makes up of the group's median document, a
quantile of the same sketches, is the distance; or two buckets' width at the median, if that is more.
So every fence comes from the group's own documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import checkpointed, column_texts, columns_of, map_whole_rows, unused

WINDOW = 8
#: Groups below so many documents borrow the sketch of the next level.
LEAST_GROUP = 100
SPREAD = 3
#: Groups whose fences are sent to all tasks at most, some hundred bytes each; more are joined by a shuffle.
MOST_BROADCAST = 20_000
#: The measures: what is counted, in proportion to what, the scale, and the scale times what one event adds (a repeated window covers all its words).
MEASURES = {
    "word_len": ("word_chars", "n_words", 100, 100),
    "symbols": ("n_symbols", "n_words", 10_000, 10_000),
    "dup_lines": ("n_dup_lines", "n_lines", 10_000, 10_000),
    "repeats": ("n_repeat_words", "n_words", 10_000, 10_000 * WINDOW),
}
SIZES = ("n_words", "n_lines")
_KEPT_BITS = 6
_MIX = np.uint64(0x9E3779B97F4A7C15)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """How many words lie in windows that occur twice or more in the list, first occurrences included.

    Windows are compared by a hash of all their words first; those that share one are compared as they are.
    """
    n = len(words) - window + 1
    if n < 2:
        return 0
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    rolled = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(window):
            rolled = rolled * _MIX + hashes[i : i + n]
    order = np.argsort(rolled, kind="stable")
    same = rolled[order[1:]] == rolled[order[:-1]]
    if not same.any():
        return 0
    alike = np.zeros(n, bool)
    alike[order[1:][same]] = alike[order[:-1][same]] = True
    seen: dict[tuple, int] = {}
    covered = np.zeros(len(words) + 1, np.int64)
    for i in np.flatnonzero(alike).tolist():
        first = seen.setdefault(tuple(words[i : i + window]), i)
        if first != i:
            for at in (first, i):
                covered[at] += 1
                covered[at + window] -= 1
    return int((np.cumsum(covered) > 0).sum())


def measure(text: str | None) -> tuple[int, int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_lines with a word, n_dup_lines, n_repeat_words) of a text."""
    text = text or ""
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    return (
        len(words),
        len(text) - sum(map(text.count, " \t\n\x0b\x0c\r")),
        sum(map(text.count, "#*$%&|<>")),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def with_counts(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """docs with the counts of measure() as long columns; a column of such a name is replaced."""
    names = [prefix + c for c in COUNTS]
    docs = docs.drop(*names)

    def batches(parts):
        for batch in parts:
            rows = np.array([measure(t) for t in column_texts(batch, text)], np.int64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(rows[:, i]) for i in range(len(names)))], [*batch.schema.names, *names])

    return map_whole_rows(docs, batches, StructType([*docs.schema.fields, *(StructField(c, LongType()) for c in names)]))


def base_failed(prefix: str = "") -> Column:
    words, repeats = F.col(prefix + "n_words"), F.col(prefix + "n_repeat_words")
    return (words < 20) | (100 * repeats > 30 * words)


def _measures(prefix: str) -> dict[str, Column]:
    return {m: F.expr(f"({scale} * `{prefix}{top}`) div greatest(`{prefix}{below}`, 1)") for m, (top, below, scale, _) in MEASURES.items()}


def bucket(value: Column) -> Column:
    """The lower bound of a whole number's bucket: its leading bits, the others zero."""
    drop = F.greatest(F.length(F.bin(value)) - _KEPT_BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)


def sketches(docs: DataFrame, lang: str, source: str, prefix: str = "") -> DataFrame:
    """(lang, source, measure, bucket, n): the sketch of each group and measure, and of the documents' sizes."""
    values = _measures(prefix) | {c: F.col(prefix + c) for c in SIZES}
    pairs = F.explode(F.map_from_arrays(F.array(*map(F.lit, values)), F.array(*values.values()))).alias("measure", "value")
    rows = docs.select(F.col(lang).alias("lang"), F.col(source).alias("source"), pairs)
    return rows.groupBy("lang", "source", "measure", bucket(F.col("value")).alias("bucket")).agg(F.count("*").alias("n"))


def _fence(measure: str) -> Column:
    """struct(low, high) from column q, a map of measures and sizes to their quantiles."""
    _, below, _, event = MEASURES[measure]
    q = F.col("q")[measure]
    least = F.expr(f"greatest({event} div greatest(q['{below}'].mid, 1L), q['{measure}'].mid div 16)")
    high = q["top"] + SPREAD * F.greatest(q["top"] - q["mid"], least)
    low = q["bottom"] - SPREAD * F.greatest(q["mid"] - q["bottom"], least) if measure == "word_len" else F.lit(0).cast("long")
    return F.struct(low.alias("low"), high.alias("high"))


def fences(found: DataFrame) -> DataFrame:
    """(lang, source, fence) of each group, from sketches(); fence maps a measure to struct(low, high).

    Null languages and sources are groups of their own. No sketch gives no fence.
    """
    level = F.explode(F.array(*map(F.lit, (2, 1, 0)))).alias("level")
    found = checkpointed(found)  # it is read for each level
    merged = found.select("*", level).select("level", F.expr("if(level > 0, lang, null)").alias("lang"), F.expr("if(level > 1, source, null)").alias("source"), "measure", "bucket", "n")
    merged = merged.groupBy("level", "lang", "source", "measure", "bucket").agg(F.sum("n").alias("n"))
    listed = merged.groupBy("level", "lang", "source", "measure").agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("sketch"), F.sum("n").alias("size"))
    # The bucket in which the running count first reaches so many tenths of all.
    walk = "aggregate(sketch, struct(0L as n, -1L as q), (s, b) -> struct(s.n + b.n as n, if(s.q < 0 and 10 * (s.n + b.n) >= {} * size, b.bucket, s.q) as q)).q"
    quantiles = F.struct(*(F.expr(walk.format(tenths)).alias(name) for name, tenths in (("bottom", 1), ("mid", 5), ("top", 9))))
    whole = listed.groupBy("level", "lang", "source").agg(F.max("size").alias("size"), F.map_from_entries(F.collect_list(F.struct("measure", quantiles))).alias("q"))
    whole = whole.select("level", "lang", "source", "size", F.create_map(*(x for m in MEASURES for x in (F.lit(m), _fence(m)))).alias("fence"))
    own = whole.where("level = 2").drop("level").toDF("lang", "source", "size", "own")
    by_lang = whole.where("level = 1").drop("level", "source").toDF("of_lang", "lang_size", "by_lang")
    of_all = whole.where("level = 0").select(F.col("fence").alias("of_all"))
    chosen = F.when(F.col("size") >= LEAST_GROUP, F.col("own")).when(F.col("lang_size") >= LEAST_GROUP, F.col("by_lang")).otherwise(F.col("of_all"))
    # of_all is one row.
    return own.join(by_lang, F.col("lang").eqNullSafe(F.col("of_lang"))).join(F.broadcast(of_all)).select("lang", "source", chosen.alias("fence"))


def with_verdicts(docs: DataFrame, limits: DataFrame, lang: str = "lang", source: str = "source", prefix: str = "") -> DataFrame:
    """docs, which hold with_counts(), with base_failed and kept (both with the prefix); limits: fences().

    kept is false if base_failed, or if a measure lies outside its group's fence. Null languages
    and sources are groups of their own. Documents without a word fail; repeated rows count each.
    An empty table stays empty.
    """
    of_lang, of_source, fence = (unused(docs, c) for c in ("__of_lang", "__of_source", "__fence"))
    limits = checkpointed(limits.toDF(of_lang, of_source, fence))
    if limits.count() <= MOST_BROADCAST:
        limits = F.broadcast(limits)
    inside = F.lit(True)
    for name, value in _measures(prefix).items():
        inside &= value.between(F.col(fence)[name]["low"], F.col(fence)[name]["high"])
    joined = docs.join(limits, F.col(lang).eqNullSafe(F.col(of_lang)) & F.col(source).eqNullSafe(F.col(of_source)), "left")
    failed = base_failed(prefix)
    return joined.select(*columns_of(docs), failed.alias(prefix + "base_failed"), (~failed & inside).alias(prefix + "kept"))


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(doc_id, lang, source, the counts, base_failed, kept) of each row of docs.

    Null and empty texts have no words and fail. Null ids are carried; null languages and sources
    are groups of their own; repeated rows are judged each. An empty table gives an empty one.
    """
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(source).alias("source"))
    counted = checkpointed(with_counts(narrow).drop("text"))
    return with_verdicts(counted, fences(sketches(counted, "lang", "source")))


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of docs that the rules keep, with their columns as they were.

    Texts are counted once for the sketches and once more where they are filtered, so that they are neither stored nor moved.
    """
    narrow = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(source).alias("source"))
    limits = fences(sketches(with_counts(narrow), "lang", "source"))
    mark = "__"
    while any(c.lower().startswith(mark) for c in docs.columns):
        mark += "_"
    return with_verdicts(with_counts(docs, text, mark), limits, lang, source, mark).where(F.col(mark + "kept")).select(*columns_of(docs))
