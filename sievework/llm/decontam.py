"""Benchmark decontamination with an FM-index over each training shard.

A task gathers the documents it reads into shards of bounded size. Each shard becomes one sequence of
word numbers in which everything the benchmark does not say is a break, since no phrase can reach
over it. The sequence's Burrows-Wheeler transform, held as a wavelet tree, is searched backwards
for all phrases at once; occurrences are located by walking to the nearest sampled suffix position,
and the spans they cover in a document are merged. Nothing is shuffled.

The phrases travel to every task, so the benchmark is taken in blocks of bounded size, as arrays of
word numbers: a stated query set that all shards are searched for, block by block.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import map_whole_rows, suffix_order

WINDOW = 13
#: UTF-8 bytes of benchmark text that are sent out at once.
BLOCK_BYTES = 4 << 20
#: UTF-8 bytes of documents that an index covers, about; a longer document has one of its own.
SHARD_BYTES = 16 << 20
SAMPLE_EVERY = 8

# A-Z are lower-cased; what stands between words is [\x00-\x2F\x3A-\x60\x7B-\x7F] after that.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


class WaveletTree:
    """Counts of a symbol before a position, for arrays of both; one level for each bit."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels = []
        for shift in range(bits - 1, -1, -1):
            bit = symbols >> shift & 1
            ones = np.concatenate([[0], np.cumsum(bit)])
            zeros = len(symbols) - int(ones[-1])
            self.levels.append((shift, ones, zeros))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        start = np.zeros_like(at)
        for shift, ones, zeros in self.levels:
            one = (symbol >> shift & 1).astype(bool)
            start = np.where(one, zeros + ones[start], start - ones[start])
            at = np.where(one, zeros + ones[at], at - ones[at])
        return at - start


class FMIndex:
    """An index of a sequence in which 0 is a break and phrases are made of 1 up to `top`."""

    def __init__(self, symbols: np.ndarray, top: int):
        n = len(symbols)
        breaks = symbols == 0
        # Every break sorts as a symbol of its own, so that nothing matches across one.
        order = suffix_order(np.where(breaks, np.cumsum(breaks) - 1, symbols + int(breaks.sum())))
        self.last = symbols[order - 1]
        self.tree = WaveletTree(self.last, max(1, int(top).bit_length()))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=top + 1))])
        # A walk to the left ends at a sample; the place after a break is one.
        sampled = (order % SAMPLE_EVERY == 0) | (symbols[order - 1] == 0)
        self.sampled, self.nth, self.samples = sampled, np.cumsum(sampled) - 1, order[sampled]
        self.n = n

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows [low, high) of each phrase; phrases: a row each, of one length."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for column in phrases.T[::-1]:
            live = high > low
            start = self.first[column]
            low = np.where(live, start + self.tree.rank(column, low), 0)
            high = np.where(live, start + self.tree.rank(column, high), 0)
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The positions in the sequence at which the rows' suffixes start."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        going = np.flatnonzero(~self.sampled[rows])
        while len(going):
            symbol = self.last[rows[going]]
            rows[going] = self.first[symbol] + self.tree.rank(symbol, rows[going])
            steps[going] += 1
            going = going[~self.sampled[rows[going]]]
        return self.samples[self.nth[rows]] + steps


class Phrases:
    """The distinct windows of benchmark items, as rows of word numbers by length, and the items that hold each."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        self.names = sorted({name for name, _ in items}, key=lambda x: (x is None, x))
        number = {name: i for i, name in enumerate(self.names)}
        self.numbers: dict[bytes, int] = {}
        found: dict[int, list[tuple[np.ndarray, int]]] = defaultdict(list)
        for name, text in items:
            ids = np.array([self.numbers.setdefault(w, len(self.numbers) + 1) for w in words_of(text)], np.int32)
            if len(ids):
                n = min(window, len(ids))
                found[n].append((np.lib.stride_tricks.sliding_window_view(ids, n), number[name]))
        self.groups = []
        for n, parts in sorted(found.items()):
            rows = np.concatenate([w for w, _ in parts])
            holder = np.repeat([i for _, i in parts], [len(w) for w, _ in parts])
            whole = np.ascontiguousarray(rows).view(np.dtype((np.void, 4 * n))).ravel()
            _, first, of = np.unique(whole, return_index=True, return_inverse=True)
            pairs = np.unique(of * len(self.names) + holder)
            starts = np.searchsorted(pairs, np.arange(len(first) + 1) * len(self.names))
            self.groups.append((n, rows[first], starts, (pairs % len(self.names)).astype(np.int32)))
        self.shortest = min(found, default=0)

    def hits(self, documents: list[list[bytes]]) -> list[tuple[list[tuple[int, int]], set]]:
        """For each document the merged spans of its words that phrases cover, and the items found."""
        out: list = [([], set()) for _ in documents]  # items by their number
        if not self.groups:
            return out
        get = self.numbers.get
        lengths = np.array([len(d) for d in documents], np.int64)
        ids = np.zeros(int(lengths.sum()) + len(documents), np.int64)  # a break after each document
        ends = np.cumsum(lengths + 1)
        for words, end in zip(documents, ends, strict=True):
            ids[end - 1 - len(words) : end - 1] = [get(w, 0) for w in words]
        # Only stretches of known words that a phrase fits in are indexed, each with the break after it.
        breaks = np.flatnonzero(ids == 0)
        sizes = np.diff(breaks, prepend=-1) - 1
        fits = sizes >= self.shortest
        if not fits.any():
            return out
        keep = np.repeat(fits, sizes + 1)
        places = np.flatnonzero(keep)
        index = FMIndex(ids[places], len(self.numbers))
        found: dict[int, list] = defaultdict(list)
        for n, phrases, starts, holders in self.groups:
            low, high = index.search(phrases.astype(np.int64))
            count = np.maximum(high - low, 0)
            which = np.repeat(np.arange(len(phrases)), count)
            if not len(which):
                continue
            rows = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
            at = places[index.locate(rows)]
            of = np.searchsorted(ends, at, side="right")
            for d, word, p in zip(of.tolist(), (at - (ends[of] - 1 - lengths[of])).tolist(), which.tolist(), strict=True):
                found[d].append((word, word + n))
                out[d][1].update(holders[starts[p] : starts[p + 1]].tolist())
        for d, spans in found.items():
            for a, b in sorted(spans):
                if out[d][0] and a <= out[d][0][-1][1]:
                    out[d][0][-1] = (out[d][0][-1][0], max(b, out[d][0][-1][1]))
                else:
                    out[d][0].append((a, b))
        return out


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _spans(rows: list) -> pa.Array:
    """A list of spans for each row; twice as compact on the way as a list of dictionaries."""
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    flat = np.array([x for r in rows for x in r], np.int64).reshape(-1, 2)
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["start", "end"]))


def _merged(a: list, b: list) -> list:
    out: list = []
    for x, y in sorted(a + b):
        if out and x <= out[-1][1]:
            out[-1] = (out[-1][0], max(y, out[-1][1]))
        else:
            out.append((x, y))
    return out


def with_hits(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, without_text: bool = False, n_words: str = "n_words", spans: str = "spans", items: str = "items"
) -> DataFrame:
    """docs with the number of words, the hit spans (merged, in words) and the names of the items found, under the given names.

    Null and empty texts have no words; null and wordless items have no window; a null item id is an item of its own
    that is written as null's name. Repeated rows are judged each, and repeated items count once. An empty table of documents
    stays empty, and an empty benchmark hits nothing. without_text leaves the texts out of the result. docs must have no column of the given names.
    """
    if taken := {n_words, spans, items} & set(docs.columns):
        raise ValueError(f"docs has a column of that name: {', '.join(sorted(taken))}")
    total = benchmark.agg(F.sum(F.octet_length(item_text))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    place = F.pmod(F.xxhash64(item_id, item_text), F.lit(blocks))
    context = docs.sparkSession.sparkContext
    out, names = docs, (n_words, spans, items)
    for block in range(blocks):
        rows = benchmark.where(place == block).select(F.col(item_id).cast("string"), item_text).collect()  # BLOCK_BYTES, about
        sent = context.broadcast(Phrases([tuple(r) for r in rows], window))
        out = _searched(out, sent, text, names, first=block == 0, without=text if without_text and block == blocks - 1 else None)
    return out


def _searched(docs: DataFrame, sent, text: str, names: tuple[str, str, str], first: bool, without: str | None) -> DataFrame:
    carried = [f for f in docs.schema.fields if f.name != without and f.name not in names]

    def judged(batches: list, words: list):
        phrases = sent.value
        found = phrases.hits(words)
        at = 0
        for batch in batches:
            part = found[at : at + batch.num_rows]
            spans, items = [s for s, _ in part], [["null" if phrases.names[i] is None else phrases.names[i] for i in sorted(x)] for _, x in part]
            if not first:
                before = [[(x["start"], x["end"]) for x in r] for r in batch.column(names[1]).to_pylist()]
                spans = [_merged(a, b) for a, b in zip(before, spans, strict=True)]
                items = [_joined(b, i) for i, b in zip(items, batch.column(names[2]).to_pylist(), strict=True)]
            sizes = pa.array([len(w) for w in words[at : at + batch.num_rows]], pa.int64())
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in carried), sizes, _spans(spans), pa.array(items, pa.list_(pa.string()))], [*(f.name for f in carried), *names])

    def batches(parts):
        held, words, size = [], [], 0
        for whole in parts:
            at = 0
            while at < whole.num_rows:
                start = at
                column = whole.column(text)
                while at < whole.num_rows and size < SHARD_BYTES:
                    body = column[at].as_py()
                    words.append(words_of(body))
                    size += len((body or "").encode())
                    at += 1
                held.append(whole.slice(start, at - start))
                if size >= SHARD_BYTES:
                    yield from judged(held, words)
                    held, words, size = [], [], 0
        if held:
            yield from judged(held, words)

    span = ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))
    return map_whole_rows(docs, batches, StructType([*carried, StructField(names[0], LongType()), StructField(names[1], span), StructField(names[2], ArrayType(StringType()))]))


def _joined(a: list[str], b: list[str]) -> list[str]:
    """The names of either; "null" twice, if there is an item of that name and one without any."""
    return [x for x in sorted({*a, *b}) for _ in range(max(a.count(x), b.count(x)) if x == "null" else 1)]


def n_hit(spans: str = "spans"):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])


def contaminated(n_words: str = "n_words", spans: str = "spans"):
    return (n_hit(spans) > 0) & (20 * n_hit(spans) >= F.col(n_words))
