"""Vector codes: each part of a vector becomes the number of its nearest codebook entry, found exactly in whole numbers.

Components are scaled and rounded down to whole numbers, and a vector is cut into equal parts. Parts
and entries are continued with zeros to a power of two and taken through the Walsh-Hadamard transform,
which multiplies every squared distance by the size of the part and gathers what changes slowly in the first
coefficients. Squared differences are then added up coefficient by coefficient, in order of sequency. An
entry whose sum so far is beyond a whole distance already known is out: sums only grow. What is left at
the end is divided by the size again, without remainder.

Training reads the vectors once a round. A task sums its own parts by entry, so that only counts and
sums of the codebooks' size leave it; the codebooks are all that the driver holds.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Vectors that are compared with all entries at once; what they need then stays in the processor's cache.
CHUNK = 128
#: Labels whose sums are sent to all tasks at most; more are joined by a shuffle.
MOST_BROADCAST = 20_000


def sequency_order(size: int) -> np.ndarray:
    """The rows of the Hadamard matrix of a power of two in the order of their sign changes."""
    bits = size.bit_length() - 1
    gray = np.arange(size) ^ (np.arange(size) >> 1)
    return sum(((gray >> i) & 1) << (bits - 1 - i) for i in range(bits)) if bits else np.zeros(1, np.int64)


def transformed(parts: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of rows of whole numbers, continued with zeros to a power of two, in sequency order."""
    n, width = parts.shape
    size = 1 << max(width - 1, 0).bit_length()
    out = np.zeros((n, size), np.int64)
    out[:, :width] = parts
    step = 1
    while step < size:
        pairs = out.reshape(n, size // (2 * step), 2, step)
        a, b = pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]
        pairs[:, :, 0], pairs[:, :, 1] = a, b
        step *= 2
    return out[:, sequency_order(size)]


def limit(width: int) -> int:
    """The largest magnitude of a component with which the scaled distances of parts of so many components fit 62 bits."""
    size = 1 << max(width - 1, 0).bit_length()
    return (1 << 30) // size


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each part's nearest entry, of equal ones the first; both are rows of whole numbers."""
    x, c = transformed(parts), transformed(entries)
    n, size = x.shape
    # Differences are at most twice the largest coefficient; narrow numbers are faster.
    most = 2 * int(max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)))
    kind = np.int32 if size * most * most < 1 << 31 else np.int64
    x, c = np.ascontiguousarray(x.T, kind), np.ascontiguousarray(c.T, kind)
    best, least = np.empty(n, np.int64), np.empty(n, np.int64)
    head = size - size // 4
    for at in range(0, n, CHUNK):
        rows = slice(at, min(at + CHUNK, n))
        mine = x[:, rows]
        sums = np.zeros((mine.shape[1], c.shape[1]), kind)
        step = np.empty_like(sums)
        for j in range(head):
            np.subtract(mine[j][:, None], c[j][None, :], out=step)
            np.multiply(step, step, out=step)
            sums += step
        guess = sums.argmin(1)
        here = np.arange(len(guess))
        rest = mine[head:] - c[head:, guess]
        known = sums[here, guess] + (rest * rest).sum(0, dtype=kind)
        row, entry = np.nonzero(sums <= known[:, None])  # all others are out; the guess is not
        have = sums[row, entry]
        for j in range(head, size):
            have += (mine[j][row] - c[j][entry]) ** 2
            if j + 1 < size:
                stays = have <= known[row]
                row, entry, have = row[stays], entry[stays], have[stays]
        first = np.searchsorted(row, here)
        least[rows] = np.minimum.reduceat(have, first)
        hits = np.flatnonzero(have == least[rows][row])
        best[rows] = entry[hits[np.searchsorted(row[hits], here)]]
    return best, least // size


@dataclass(frozen=True)
class Codebooks:
    """The entries of each part as rows of whole numbers: an array of (part, entry, position)."""

    entries: np.ndarray

    def digest(self) -> str:
        """The SHA-256 of all components in decimal, by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def is_kept(vector: str) -> Column:
    """Whether a vector and all its components are there and finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & ~bad


def _whole(column: pa.Array, width: int) -> np.ndarray:
    """The vectors as whole numbers cut into parts: (vector, part, position)."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    most = limit(width)
    flat = np.clip(flat, -most, most).astype(np.int64)
    out = np.zeros((len(sizes), PARTS * width), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out.reshape(len(sizes), PARTS, width)


def _named(vectors: DataFrame, vec_id: str, vector: str, label: str | None) -> DataFrame:
    labels = F.lit(None).cast("int") if label is None else F.col(label)
    named = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"), labels.alias("label"))
    return named.where(is_kept("vector"))


def _width(kept: DataFrame) -> int:
    """Components of a part."""
    return -(-(kept.agg(F.max(F.size("vector"))).first()[0] or 0) // PARTS)


def _sums(kept: DataFrame, books: Codebooks) -> dict[tuple[int, int], tuple[int, np.ndarray]]:
    """(part, entry) -> (count, sum of the parts) over all vectors, by their nearest entries."""
    entries, width = books.entries, books.entries.shape[2]

    def batches(parts):
        counts = np.zeros(entries.shape[:2], np.int64)
        sums = np.zeros(entries.shape, np.int64)
        for batch in parts:
            whole = _whole(batch.column("vector"), width)
            for p in range(PARTS):
                code, _ = nearest(whole[:, p], entries[p])
                counts[p] += np.bincount(code, minlength=entries.shape[1])
                np.add.at(sums[p], code, whole[:, p])
        part, entry = np.nonzero(counts)
        listed = pa.ListArray.from_arrays(np.arange(len(part) + 1, dtype=np.int32) * width, sums[part, entry].ravel())
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(counts[part, entry]), listed], ["part", "entry", "n", "sums"])

    found = kept.select("vector").mapInArrow(batches, "part long, entry long, n long, sums array<long>")
    counted = found.select("part", "entry", F.posexplode(F.concat(F.array("n"), "sums")).alias("at", "value"))
    out: dict[tuple[int, int], list] = {}
    # As many rows as the codebooks have numbers.
    for part, entry, at, value in counted.groupBy("part", "entry", "at").agg(F.sum("value").alias("value")).collect():
        out.setdefault((part, entry), [0] * (width + 1))[at] = value
    return {k: (v[0], np.array(v[1:], np.int64)) for k, v in out.items()}


def train(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks that start as the parts of the vectors with the least ids and follow the means of what is nearest to them.

    Means are rounded down, entries without parts stay. Null ids are the largest; of vectors with
    one id the smaller comes first. Vectors that are null or hold null or non-finite components
    do not count; fewer vectors than entries give as many entries. No vector gives no entry.
    """
    kept = _named(vectors, vec_id, vector, None)
    width = _width(kept)
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").toArrow()
    start = _whole(first.column("vector").combine_chunks(), width)
    books = Codebooks(np.ascontiguousarray(start.transpose(1, 0, 2)))
    for _ in range(rounds if start.size else 0):
        new = books.entries.copy()
        for (part, entry), (n, total) in _sums(kept, books).items():
            new[part, entry] = total // n
        books = Codebooks(new)
    return books


def encode(vectors: DataFrame, books: Codebooks, vec_id: str = "vec_id", vector: str = "embedding", label: str | None = None) -> DataFrame:
    """(vec_id, label, code, error) of each vector that counts: its parts' entries as two hexadecimal digits each, and its squared distance from them."""
    entries, width = books.entries, books.entries.shape[2]
    kept = _named(vectors, vec_id, vector, label)
    source = kept.schema

    def batches(parts):
        digits = np.array([f"{i:02x}" for i in range(max(entries.shape[1], 1))])
        for batch in parts:
            whole = _whole(batch.column("vector"), width)
            codes, errors = zip(*(nearest(whole[:, p], entries[p]) for p in range(PARTS)), strict=True)
            code = digits[codes[0]]
            for c in codes[1:]:
                code = np.char.add(code, digits[c])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(code.astype(object), pa.string()), pa.array(sum(errors))], ["vec_id", "label", "code", "error"])

    if not entries.size:  # without components all parts are alike
        return kept.select("vec_id", "label", F.lit("00" * PARTS).alias("code"), F.lit(0).cast("long").alias("error"))
    return kept.mapInArrow(batches, f"vec_id {source['vec_id'].dataType.simpleString()}, label {source['label'].dataType.simpleString()}, code string, error long")


def decode(code: str, books: Codebooks) -> np.ndarray:
    """The vector that a code stands for, in whole numbers."""
    return np.concatenate([books.entries[p][int(code[2 * p : 2 * p + 2], 16)] for p in range(PARTS)])


def compress(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks]:
    """(vec_id, label, code, error, label_error) of each vector that counts, and the codebooks; label_error is the error summed over equal labels.

    Vectors that are null or hold null or non-finite components are left out. Null labels are one
    group; null and repeated ids are carried. Shorter vectors, and a number of components that the parts
    do not divide, are continued with zeros. Components beyond limit() of the part's width are set
    to it (65,536 at sixteen components a part); a sum of errors beyond a long is null. An empty table gives an empty one.
    """
    books = train(vectors, vec_id, vector, entries, rounds)
    coded = stored(encode(vectors, books, vec_id, vector, label))  # it is read for the sums and for the rows
    sums = coded.groupBy(F.col("label").alias("of_label")).agg(F.try_sum("error").alias("label_error"))
    sums = stored(sums)
    if sums.count() <= MOST_BROADCAST:
        sums = F.broadcast(sums)
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of_label"))).drop("of_label"), books
