"""Best-fit packing with bounds that certify it.

Pieces are dealt out evenly over partitions and packed there by best-fit decreasing. Dual-feasible
functions turn a partition's lengths into a number of bins that no packing can go below. A
partition that meets its bound is certified, and gives up the pieces of its emptiest bin alone, since
a bound is rounded up. The others have a gap: they keep the bins that are full and give up the rest.
The pieces given up are dealt out anew over fewer partitions, so that pieces from different partitions
meet, and packed again. This is repeated until one partition is left. certificate() holds the whole
against the bound of all pieces. Only pieces that do not fit one task may end
otherwise, when an exchange over the fewest partitions settles none of them.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, column_texts

END = 2
CAPACITY = 1024
#: Pieces that a task packs at once, about; its memory is bounded by them.
PER_PARTITION = 25_000
#: Pieces that a task packs at most, where exchanges settle few.
MOST_PER_PARTITION = 1_000_000
_CACHE = 300_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def default_vocabulary() -> str:
    """Where the merge ranks of the public byte_bpe_50k vocabulary are."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def added_tokens() -> dict[str, int]:
    """The added tokens of the vocabulary's tokenizer file, which are ids of their own wherever they stand in a text."""
    import json

    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        return {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}


class Encoder:
    """The ids of texts as little-endian unsigned 32-bit numbers. Added tokens are plain text unless they are given.

    The vocabulary splits a text before it merges, and never joins what a lone space or line break
    parts. So words are encoded on their own and remembered; a text with any other white space,
    or two in a row, is encoded whole.
    """

    _unusual = re.compile(r"\s\s|[^\S \n]")

    def __init__(self, path: str, added: dict[str, int] | None = None):
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._whole = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._known: dict[str, bytes] = {}
        self._added = {k: v.to_bytes(4, "little") for k, v in (added or {}).items()}
        self._split = re.compile("|".join(f"({re.escape(k)})" for k in sorted(self._added, key=len, reverse=True))) if self._added else None

    def _encode(self, text: str) -> bytes:
        return np.array(self._whole.encode_ordinary(text), "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if self._split is None:
            return self._plain(text)
        out, at = [], 0
        for m in self._split.finditer(text):
            out += [self._plain(text[at : m.start()]), self._added[m[0]]]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])]) if out else self._plain(text)

    def _plain(self, text: str) -> bytes:
        if self._unusual.search(text):
            return self._encode(text)
        if len(self._known) > _CACHE:
            self._known.clear()
        known, out = self._known, []
        for n, line in enumerate(text.split("\n")):
            words = line.split(" ")
            if n:
                words[0] = "\n" + words[0]
            for i, word in enumerate(words):
                word = " " + word if i else word
                got = known.get(word)
                if got is None:
                    parts = ["\n", word[1:]] if word[:1] == "\n" else [word]
                    got = known[word] = b"".join(self._encode(p) for p in parts if p)
                out.append(got)
        return b"".join(out)


@cache
def _encoder(path: str) -> Encoder:
    return Encoder(path, added_tokens())


def cut(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all but the first are as long as the capacity."""
    head = length - (-(-length // capacity) - 1) * capacity
    return [(0, head), *((at, capacity) for at in range(head, length, capacity))]


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each document's ids and the end id after them."""
    path = vocabulary or default_vocabulary()

    def batches(parts):
        encode = _encoder(path)
        for batch in parts:
            rows = []
            for key, body in zip(batch.column("doc_id").to_pylist(), column_texts(batch, "text"), strict=True):
                ids = encode(body) + END.to_bytes(4, "little")
                rows += [(key, n, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)])) for n, (at, size) in enumerate(cut(len(ids) // 4, capacity))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)], names)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(batches, PIECES)


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """The best of two families of dual-feasible functions: bins that the lengths need at least."""
    return bound_of_counts(np.bincount(lengths, minlength=capacity + 1), capacity)


def bound_of_counts(counts: np.ndarray, capacity: int = CAPACITY) -> int:
    """lower_bound() from how many pieces there are of each length."""
    sizes = np.flatnonzero(counts)
    n = counts[sizes].astype(np.int64)
    best = -(-int((sizes * n).sum()) // capacity)
    # A threshold t: lengths above capacity - t fill a bin, those below t need nothing.
    for t in np.unique(np.minimum(sizes, capacity - sizes + 1)):
        if 1 <= t <= capacity // 2:
            value = np.where(sizes > capacity - t, capacity, np.where(sizes < t, 0, sizes))
            best = max(best, -(-int((value * n).sum()) // capacity))
    # A number of parts k: (k + 1) x / capacity is rounded down to a whole number unless it is one.
    for k in range(1, 20):
        scaled = (k + 1) * sizes
        value = np.where(scaled % capacity == 0, sizes * k, scaled // capacity * capacity)
        best = max(best, -(-int((value * n).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each length, and what each bin has left."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    left: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms: list[int] = []  # those that some bin has, in order
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        at = bisect_left(rooms, size)
        if at == len(rooms):
            b, room = len(left), capacity
            left.append(capacity)
        else:
            room = rooms[at]
            b = by_room[room].pop()
            if not by_room[room]:
                del rooms[at]
        bins[i], offsets[i] = b, capacity - room
        left[b] = rest = room - size
        if rest:
            if not by_room[rest]:
                insort(rooms, rest)
            by_room[rest].append(b)
    return bins, offsets, np.array(left, np.int64)


def _pack(capacity: int, base: int, last: bool):
    """Packs one partition's pieces; those of bins that a gap opens get a null sequence, unless it is the last round."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "start", "ids_crc32"], ascending=[False, True, True, True, True], kind="stable")
        lengths = pdf["length"].to_numpy()
        bins, offsets, left = best_fit_decreasing(lengths, capacity)
        opened = left > 0
        if last or not opened.any():
            opened[:] = False
        elif len(left) <= lower_bound(lengths, capacity):
            opened = np.arange(len(left)) == left.argmax()
        sequence = pd.array(base + (int(pdf["part"].iloc[0]) << 24) + bins, "Int64")
        sequence[opened[bins]] = pd.NA
        return pdf.drop(columns="part").assign(sequence_id=sequence, offset=offsets)

    return run


def pack(cut_up: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with sequence_id and offset.

    Any order of the rows gives a packing of the same kind; repeated rows are packed each. An
    empty table gives an empty one.
    """
    out = f"{PIECES}, sequence_id long, offset long"
    todo, done = checkpointed(cut_up), []
    before, turn = None, 0
    while True:
        count = todo.count()
        parts = max(1, -(-count // PER_PARTITION))
        if before:  # fewer partitions each time, as long as they fit their tasks
            parts = max(-(-count // MOST_PER_PARTITION), min(parts, before[1] // 2), 1)
        last = parts == 1 or (count, parts) == before
        # Rows of a checkpoint have a fixed order, so this deals them out evenly and the same way again.
        dealt = todo.select("*", F.pmod(F.monotonically_increasing_id(), F.lit(parts)).alias("part"))
        packed = checkpointed(dealt.groupBy("part").applyInPandas(_pack(capacity, turn << 48, last), out))
        done.append(packed.where("sequence_id is not null"))
        if last:
            break
        todo = checkpointed(packed.where("sequence_id is null").drop("sequence_id", "offset"))
        before, turn = (count, parts), turn + 1
    first, *more = done
    for x in more:
        first = first.unionByName(x)
    return first


def certificate(packed: DataFrame, capacity: int = CAPACITY) -> tuple[int, int]:
    """(sequences, the least number of them that any packing needs) of pack()'s rows."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in packed.groupBy("length").count().collect():  # as many rows as there are lengths
        counts[length] = n
    return packed.agg(F.count_distinct("sequence_id")).first()[0], bound_of_counts(counts, capacity)


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Each document's pieces with their places in sequences of at most `capacity` tokens.

    A null or empty text is the end id alone. Only documents longer than a sequence are cut. Null
    and repeated ids are carried as they are.
    """
    return pack(pieces(docs, doc_id, text, vocabulary, capacity), capacity)
