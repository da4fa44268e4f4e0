"""Removal of long repeated passages with run-length indexes.

Every window of `length` bytes is assigned to its least k-byte hash, so that equal windows meet
under equal hashes wherever they stand. A text's windows fall into stretches of neighbours with one
hash. Stretches that share their hash with another go to an index, in two steps: first with those
of the documents that a task reads together, so that the copies of a hot text leave one stretch for
each such lot; then, after a shuffle by hash, with those of all lots. A hash that stands in one lot
only, once, is dropped before any bytes move. Every mark is made by an index:

the pieces' Burrows-Wheeler transform is kept as runs, with the suffix positions at the runs' ends
as samples. Equal pieces are one phrase of the index, as copies only lengthen its runs. Between two
samples the longest match with the lexicographic neighbour falls by one a byte, so the matching
statistics of all pieces stream from the samples. Windows matched over their whole length are
chained with their neighbours, and all but the first place of a chain are marked.

An index covers `SHARD_BYTES` of pieces, about. A hash that has more is indexed part by part, each
together with the windows that the parts before have brought. A hash that more than `MANY` stretches
share is split by content first: `BLOCK` neighbouring windows have 101 - BLOCK bytes in common, and
are keyed by these.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column_texts, run_starts, stored

LENGTH = 100
GRAM = 32
#: Stretches of a hash above which its windows are keyed by more of their content; the marks are the same.
MANY = 1 << 14
BLOCK = 9
#: Bytes of pieces that one index covers, about.
SHARD_BYTES = 1 << 19
#: Bytes of texts that a task looks at together before the shuffle; a longer text is looked at alone.
LOT_BYTES = 32 << 20
#: Windows that are hashed at once.
CHUNK = 1 << 20
_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xC2B2AE3D27D4EB4F)


def gram_hashes(data: np.ndarray, size: int = GRAM) -> np.ndarray:
    """A mixed 64-bit hash of every `size` bytes (a power of two), by doubling."""
    with np.errstate(over="ignore"):
        h = (data.astype(np.uint64) + np.uint64(1)) * _B
        step = 1
        while step < size:
            left = h[:-step] * _A
            left ^= left >> np.uint64(29)
            h = left + h[step:]
            step *= 2
        h *= _B
        h ^= h >> np.uint64(32)
        h *= _A
    return h


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` neighbours."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def stretches(data: bytes, length: int = LENGTH) -> np.ndarray:
    """Rows (window hash, first start, last start, flag) of the runs of windows that share a hash.

    flag is 1 where windows of the run may be equal. Two of them are equal only if all their grams are,
    at one distance, so it is enough to compare one gram in `width` with those that follow it.
    """
    width = length - GRAM + 1
    parts = [np.zeros((0, 4), np.int64)]
    for base in range(0, len(data) - length + 1, CHUNK):  # windows of one hash may stand in several runs
        grams = gram_hashes(np.frombuffer(data, np.uint8, min(CHUNK + length - 1, len(data) - base), base))
        least = window_minima(grams, width).view(np.int64)
        cuts = np.flatnonzero(least[1:] != least[:-1]) + 1
        first = np.concatenate([[0], cuts])
        last = np.concatenate([cuts, [len(least)]]) - 1
        flags = np.zeros(len(first), np.int64)
        near = np.lib.stride_tricks.sliding_window_view(np.concatenate([grams, np.zeros(width, np.uint64)]), width)[: len(grams) : width]
        for at in np.flatnonzero((near[:, 1:] == near[:, :1]).any(1)).tolist():
            at *= width
            flags[np.searchsorted(last, at - width + 1) : np.searchsorted(first, at, side="right")] = 1
        parts.append(np.column_stack([least[first], first + base, last + base, flags]))
    return np.concatenate(parts)


def _piece_order(words: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The suffix array of pieces that each end in a symbol of their own, smaller than any byte and in the order of the pieces.

    words holds the eight bytes from each position on, left how many are before its piece's end. The
    first sort takes seven symbols; later ones double the length, and take only suffixes that still
    agree with another.
    Suffixes that agree up to their ends are in order of their positions.
    """
    n, step = len(left), 7
    short = np.minimum(left, step)
    # Seven bytes, zero beyond the end, and then how many they are.
    kept = np.array([(1 << 56) - (1 << 8 * (step - k)) for k in range(step + 1)], np.uint64)
    key = ((words.byteswap() >> np.uint64(8)) & kept[short]).view(np.int64) << 3 | short
    order = np.argsort(key)
    part, slots, first = order, np.arange(n), run_starts(key[order])
    rank = np.empty(n, np.int64)
    while True:
        order[slots], rank[part] = part, first
        tied = np.concatenate([first[1:] == first[:-1], [False]]) | (first != slots)
        part = part[tied]
        if not len(part):
            return order
        inside = left[part] >= step
        after = np.where(inside, rank[np.where(inside, part + step, 0)], part)
        key = rank[part] * (n + 1) + after
        by = np.argsort(key)
        part, key = part[by], key[by]
        slots = rank[part] + np.arange(len(part)) - run_starts(rank[part])
        first = slots[run_starts(key)]
        step *= 2


class RunIndex:
    """The run-compressed transform of some pieces, with the suffix positions at the runs' starts and ends."""

    def __init__(self, pieces: list[bytes]):
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) + 1
        ends = np.cumsum(sizes) - 1
        self.n, self.starts = int(sizes.sum()), np.concatenate([[0], ends[:-1] + 1])
        data = np.frombuffer(b"\0".join(pieces) + bytes(9), np.uint8)
        left = np.repeat(ends, sizes) - np.arange(self.n)
        words = np.lib.stride_tricks.as_strided(data, (self.n, 8), (1, 1)).copy().view("<u8").ravel()
        order = _piece_order(words, left)
        last = np.where(left[order - 1] > 0, data[order - 1].astype(np.int64), -1 - order)  # ends differ from each other
        heads = np.concatenate([[0], np.flatnonzero(last[1:] != last[:-1]) + 1])
        self.symbols, self.heads = last[heads], heads
        self.at_head = order[heads]
        self.before = order[heads - 1]  # the sampled end of the run above; the first has none
        # How far the suffixes at these samples agree, eight bytes at a time, and not beyond an end.
        least = np.minimum(left[self.at_head], left[self.before])
        least[0] = 0
        agree = np.zeros(len(heads), np.int64)
        going = np.flatnonzero(least)
        while len(going):
            a, b = self.at_head[going] + agree[going], self.before[going] + agree[going]
            other = words[a] ^ words[b]
            same = np.bitwise_count((other - (other != 0)) & ~other).astype(np.int64) // 8
            agree[going] += np.where(other == 0, 8, same)
            going = going[(other == 0) & (agree[going] < least[going])]
        self.agree = np.minimum(agree, least)

    def matching_statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """For every position the longest match with its lexicographic neighbour above, and that neighbour."""
        order = np.argsort(self.at_head)
        at, agree, before = self.at_head[order], self.agree[order], self.before[order]
        # The sample at or before a position: a match shortens by one for each byte that follows it.
        sizes = np.diff(at, append=self.n)
        past = np.arange(self.n) - np.repeat(at, sizes)
        return np.maximum(np.repeat(agree, sizes) - past, 0), np.repeat(before, sizes) + past


def repeated_windows(pieces: list[bytes], places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Which windows of the pieces start at an earlier place as well, one piece after another, and how many each piece has.

    places: where the pieces start. A window given twice with one place is no repeat of itself.
    """
    phrases: dict[bytes, int] = {}
    of = np.array([phrases.setdefault(p, len(phrases)) for p in pieces], np.int64)
    index = RunIndex(list(phrases))
    match, neighbour = index.matching_statistics()
    head = np.where(match >= length, neighbour, np.arange(index.n))
    chained = np.flatnonzero(match >= length)
    while len(chained):  # to the head of each chain of neighbours, by doubling
        further = head[head[chained]]
        moved = further != head[chained]
        head[chained] = further
        chained = chained[moved]
    none = np.iinfo(np.int64).max
    least = np.full(len(phrases), none)
    np.minimum.at(least, of, places)
    sizes = np.diff(index.starts, append=index.n) - 1
    first = np.arange(index.n) - np.repeat(index.starts - least, sizes + 1)  # the first place of each position of the phrases
    tail = np.flatnonzero(head != np.arange(index.n))
    np.minimum.at(first, head[tail], first[tail])
    first = first[head]
    counts = np.maximum(sizes[of] - length + 1, 0)
    before = np.cumsum(counts) - counts
    inside = np.arange(int(counts.sum())) - np.repeat(before, counts)
    return first[np.repeat(index.starts[of], counts) + inside] < np.repeat(places, counts) + inside, counts


def _runs(flags: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Rows (piece, first, last, flag) of the runs of windows with one flag within a piece."""
    piece = np.repeat(np.arange(len(counts)), counts)
    if not len(piece):
        return np.zeros((0, 4), np.int64)
    cuts = np.flatnonzero((flags[1:] != flags[:-1]) | (piece[1:] != piece[:-1])) + 1
    a, b = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(flags)]]) - 1
    base = (np.cumsum(counts) - counts)[piece[a]]
    return np.column_stack([piece[a], a - base, b - base, flags[a]])


class Marker:
    """Marks the windows of pieces that come key by key, in order of their places within a key."""

    def __init__(self, length: int):
        self.length = length
        self.key, self.size = None, 0
        self.waiting: list[tuple] = []  # (key, document, low, data), not yet indexed
        self.before: list[list[tuple]] = []  # parts of one key that are indexed, as far as they have a window of their own

    def add(self, key, document, low: int, data: bytes):
        """Takes a piece; gives (key, document, first, last, marked) of the windows that an index has been made for."""
        out = ()
        if self.size >= SHARD_BYTES:
            if key != self.key:
                out = self.finish()
            elif self.waiting[0][0] == key:  # the key alone fills an index
                out = self._part(keep=True)
            else:
                at = next(i for i, r in enumerate(self.waiting) if r[0] == key)
                rest = self.waiting[at:]
                self.waiting = self.waiting[:at]
                out = self._part(keep=False)
                self.waiting, self.size = rest, sum(len(r[3]) for r in rest)
        elif key != self.key and self.before:
            out = self.finish()
        self.key = key
        self.waiting.append((key, document, low, data))
        self.size += len(data)
        return out

    def finish(self):
        out = self._part(keep=False)
        self.before = []
        return out

    def _part(self, keep: bool) -> list[tuple]:
        rows, self.waiting, self.size = self.waiting, [], 0
        if not rows:
            return []
        flags = None
        for part in self.before or [[]]:
            both = part + rows
            number = {d: i for i, d in enumerate(sorted({r[1] for r in both}))}
            places = np.array([(number[r[1]] << 32) + r[2] for r in both], np.int64)
            found, counts = repeated_windows([r[3] for r in both], places, self.length)
            found, counts = found[counts[: len(part)].sum() :], counts[len(part) :]
            flags = found if flags is None else flags | found
        out = [(*rows[i][:2], rows[i][2] + a, rows[i][2] + b, f) for i, a, b, f in _runs(flags, counts).tolist()]
        if keep:
            of = np.repeat(np.arange(len(rows)), counts)
            new = [rows[i] for i in np.unique(of[~flags]).tolist()]
            if self.before and sum(len(r[3]) for r in self.before[-1] + new) < SHARD_BYTES:
                self.before[-1] += new
            else:
                self.before.append(new)
        return out


def _one_lot(lot: list[tuple], length: int) -> np.ndarray:
    """Rows (hash, doc, of, low, high, marked) of the windows of some documents (doc, of, data): what an index of these marks, and the others."""
    lot = sorted({(doc, of): data for doc, of, data in lot}.items())
    found = [stretches(data, length) for _, data in lot]
    which = np.repeat(np.arange(len(lot)), [len(f) for f in found])
    rows = np.concatenate([np.zeros((0, 4), np.int64), *found])
    order = np.argsort(rows[:, 0], kind="stable")
    same = np.zeros(len(rows), bool)
    equal = rows[order[1:], 0] == rows[order[:-1], 0]
    same[order[1:][equal]] = same[order[:-1][equal]] = True
    look = same | (rows[:, 3] == 1)
    marker, judged = Marker(length), []
    order = order[look[order]]
    for (h, low, high, _), i in zip(rows[order].tolist(), which[order].tolist(), strict=True):
        judged += marker.add(h, i, low, lot[i][1][low : high + length])
    judged = np.array([*judged, *marker.finish()], np.int64).reshape(-1, 5)
    names = np.array([d for d, _ in lot], np.int64).reshape(-1, 2)
    rest = np.column_stack([rows[~look, 0], which[~look], rows[~look, 1:3], np.zeros(int((~look).sum()), np.int64)])
    rows = np.concatenate([rest, judged])
    return np.column_stack([rows[:, 0], names[rows[:, 1]], rows[:, 2:]])


def _cut_up(docs: DataFrame, length: int) -> DataFrame:
    """(hash, doc, of, low, high, marked) of the windows of docs (doc, of, text), lot by lot.

    Marked rows have a hash that only spreads them.
    """

    def written(lot):
        rows = _one_lot(lot, length)
        marked = rows[:, 5] == 1
        with np.errstate(over="ignore"):
            rows[marked, 0] = ((rows[marked, 1] + rows[marked, 3]).astype(np.uint64) * _A).view(np.int64)
        columns = [pa.array(rows[:, i]) for i in range(3)] + [pa.array(rows[:, i].astype(np.int32)) for i in (3, 4)] + [pa.array(marked)]
        return pa.RecordBatch.from_arrays(columns, ["hash", "doc", "of", "low", "high", "marked"])

    def batches(parts):
        lot, size = [], 0
        for batch in parts:
            for doc, of, text in zip(batch.column("doc").to_pylist(), batch.column("of").to_pylist(), batch.column("text"), strict=True):
                data = text.as_py().encode()
                if lot and size + len(data) > LOT_BYTES:
                    yield written(lot)
                    lot, size = [], 0
                lot.append((doc, of, data))
                size += len(data)
        if lot:
            yield written(lot)

    return docs.select("doc", "of", "text").mapInArrow(batches, "hash long, doc long, of long, low int, high int, marked boolean")


def _blocks(data: bytes, low: int, high: int, length: int):
    """(key, first start, last start) of blocks of windows low to high, which share their least gram; see BLOCK."""
    grams = gram_hashes(np.frombuffer(data, np.uint8, high + length - low, low))
    least = grams[: length - GRAM + 1].min()
    at = np.flatnonzero(grams == least)
    starts = np.arange(high - low + 1)
    holder = at[np.searchsorted(at, starts)]  # the first place of the gram in each window
    block = (holder - starts) // BLOCK
    cuts = np.flatnonzero((holder[1:] != holder[:-1]) | (block[1:] != block[:-1])) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(starts)], strict=True):
        common = low + int(holder[a]) - BLOCK * int(block[a])
        yield xxhash.xxh3_64_intdigest(data[common : common + length - BLOCK + 1], int(block[a])), low + a, low + b - 1


def _pieces(docs: DataFrame, length: int) -> DataFrame:
    """(key, doc, of, low, data) of the stretches in column rows of docs (doc, of, text, rows)."""

    def batches(parts):
        for batch in parts:
            out = []
            for doc, of, text, own in zip(*(batch.column(c).to_pylist() for c in ("doc", "of", "text", "rows")), strict=True):
                data = text.encode()
                for r in own:
                    if r["many"]:
                        out += [(key - (1 << 63), doc, of, a, data[a : b + length]) for key, a, b in _blocks(data, r["low"], r["high"], length)]
                    else:
                        out.append((r["hash"], doc, of, r["low"], data[r["low"] : r["high"] + length]))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["key", "doc", "of", "low", "data"])

    return docs.mapInArrow(batches, "key long, doc long, of long, low int, data binary")


def _marks(pieces: DataFrame, length: int) -> DataFrame:
    """(doc, of, low, high) of the windows that start earlier as well, from pieces in order of (key, doc, of, low)."""

    def written(done):
        out = [(*document, a, b) for _, document, a, b, marked in done if marked]
        columns = list(zip(*out, strict=True)) if out else [[]] * 4
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc", "of", "low", "high"])

    def batches(parts):
        marker = Marker(length)
        for batch in parts:
            rows = zip(*(batch.column(c).to_pylist() for c in ("key", "doc", "of", "low", "data")), strict=True)
            yield written([x for key, doc, of, low, data in rows for x in marker.add(key, (doc, of), low, data)])
        yield written(marker.finish())

    ordered = pieces.repartition("key").sortWithinPartitions("key", "doc", "of", "low")
    return ordered.mapInArrow(batches, "doc long, of long, low int, high int")


def _merged(ranges) -> list[tuple[int, int]]:
    out: list = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def mark_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(doc_id, text, ranges) of each row of docs; ranges: byte ranges that cover what also starts earlier, or null.

    Order is by doc_id, a null id being the largest, and among rows that share one by a 64-bit hash
    of their texts. Rows equal in both are one document, and each gets that document's result. Null
    texts are empty; texts below `length` bytes have no range. An empty table gives an empty one.
    """
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    named = source.select("doc_id", "text", F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc"), F.xxhash64("text").alias("of"))
    counted = _cut_up(named, length).withColumn("n", F.count("*").over(Window.partitionBy("hash")))
    found = stored(counted.where("marked or n > 1").select("hash", "doc", "of", "low", "high", "marked", (F.col("n") > MANY).alias("many")))
    shared = found.where("not marked").groupBy("doc", "of").agg(F.collect_list(F.struct("hash", "low", "high", "many")).alias("rows"))
    # The texts are dealt out by document once: this join and the last one have the same exchange, which Spark reuses.
    pieces = _pieces(named.join(shared, ["doc", "of"]).select("doc_id", "doc", "of", "text", "rows"), length)
    marks = found.where("marked").select("doc", "of", "low", "high").unionByName(_marks(pieces, length))
    ranges = marks.groupBy("doc", "of").agg(F.collect_list(F.struct("low", (F.col("high") + length).alias("high"))).alias("ranges"))
    return named.join(ranges, ["doc", "of"], "left").select("doc_id", "text", "ranges")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary, kept_sha256) of each row of docs, after mark_repeats()."""
    marked = mark_repeats(docs, doc_id, text, length)

    def batches(parts):
        for batch in parts:
            out = []
            for body, ranges in zip(column_texts(batch, "text"), batch.column("ranges").to_pylist(), strict=True):
                data, at, kept = body.encode(), 0, []
                spans = _merged((r["low"], r["high"]) for r in ranges or ())
                for a, b in spans:
                    kept.append(data[at:a])
                    at = b
                rest = b"".join([*kept, data[at:]])
                out.append((len(data), len(data) - len(rest), len(spans), rest, hashlib.sha256(rest).hexdigest()))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    return marked.mapInArrow(batches, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
