"""Alignment of two tokenizers' tokens over the same bytes, by divide and conquer at shared cuts.

Two tokenizers cut one text at different bytes. Where both end a token, the text falls into parts that can be
looked at on their own. An interval is split at a common end near its middle: the middle token's end of the
one side is looked up among the other side's ends by bisection, and if it is none, its neighbours' are,
further and further away. Both halves are split again; an interval without a common end inside is a leaf, a
group of tokens. All intervals of many texts are split side by side.

Tokens of a group are linked with each other. How many documents hold a pair of ids linked is
counted over all: a task hands in the distinct pairs of a block of documents with their numbers, so that a pair
that stands everywhere makes one row a block. The counts go back to the blocks that asked, and
meet the blocks' documents there.
"""

from __future__ import annotations

import hashlib
import re
from functools import cache
from itertools import chain, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column_texts, stored
from .packing import default_vocabulary

#: Characters of texts that a task aligns side by side; a longer text is aligned alone.
LOT = 1 << 21
#: Characters of texts whose pairs are handed in together.
BLOCK = 32 << 20
#: Chunks of texts whose tokens a task remembers.
_CACHE = 400_000
#: How far the ends beside the middle are looked up one by one, before an interval's are all at once.
NEAR = 4
#: Links of a group that are listed one by one; of larger groups only the distinct pairs are.
LISTED = 64


def default_pieces() -> str:
    """Where the public piece_bpe_32k model is."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class TwoTokenizers:
    """The ids of texts by a byte-level vocabulary (A) and a piece model (B), both of a space and the text.

    Special tokens' strings are plain text. A piece with a space after another letter or with a line
    break would let B's merges cross from one word to the next; without such pieces words are
    encoded on their own and remembered, as A's are. A reads a text with white space that is no lone space or line break whole.
    """

    _chunks = re.compile(r"\n| *[^ \n]+| +")
    _odd = re.compile(r"[^\S \n]")

    def __init__(self, ranks: str, model: str):
        import base64

        import sentencepiece
        import tiktoken
        from public_tokenizers import PATTERN

        with open(ranks, "rb") as lines:
            by_bytes = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._a = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=by_bytes, special_tokens={})
        by_rank = {i: token for token, i in by_bytes.items()}
        self.bytes_a = [by_rank.get(i, b"") for i in range(max(by_rank) + 1)]
        self._b = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [self._b.id_to_piece(i) for i in range(self._b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self._b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self._by_word = not any("\n" in p or re.search("[^▁]▁", p) for p in pieces)
        self._forget()

    def _forget(self) -> None:
        self._known_a: dict[str, bytes] = {}
        self._known_b: dict[str, bytes] = {}
        self._lossy: set[str] = set()  # chunks that do not come back
        self._odd_seen: set[str] = set()  # white space in chunks

    def _learn(self, chunks: list[str]) -> None:
        data = [c.encode() for c in chunks]
        # After a line break, which is a byte of its own, B reads a chunk as it stands.
        of_b = [x[2:] for x in self._b.encode(["\n" + c for c in chunks], num_threads=1)]
        for known, names, found in ((self._known_a, self.bytes_a, list(map(self._a.encode_ordinary, chunks))), (self._known_b, self.bytes_b, of_b)):
            back = [b"".join(map(names.__getitem__, x)) for x in found]
            if back != data:
                self._lossy.update(c for c, x, y in zip(chunks, back, data, strict=True) if x != y)
            ends = np.cumsum([0, *map(len, found)]) * 4
            flat = np.fromiter(chain.from_iterable(found), "<u4").tobytes()
            known.update(zip(chunks, (flat[a:b] for a, b in pairwise(ends.tolist())), strict=True))
        self._odd_seen.update(self._odd.findall("".join(chunks)))

    def _is_unusual(self, text: str) -> bool:
        return "  " in text or "\n\n" in text or " \n" in text or "\n " in text or any(c in text for c in self._odd_seen)

    def _comes_back(self, text: str, a: bytes, b: bytes) -> bool:
        data = text.encode()
        return all(b"".join(map(names.__getitem__, np.frombuffer(ids, "<u4").tolist())) == data for names, ids in ((self.bytes_a, a), (self.bytes_b, b)))

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of A, how many each text has, ids of B, how many each text has); texts that are empty or do not come back have none."""
        if len(self._known_b) > _CACHE:
            self._forget()
        whole = [" " + t for t in texts]
        cut = [[] if not t else self._chunks.findall(w) if self._by_word else [w] for t, w in zip(texts, whole, strict=True)]
        new = [c for c in set().union(*cut) if c not in self._known_b]
        if new:
            self._learn(new)
        out_a, out_b = [], []
        for text, chunks in zip(whole, cut, strict=True):
            a, b = b"".join(map(self._known_a.__getitem__, chunks)), b"".join(map(self._known_b.__getitem__, chunks))
            if len(chunks) > 1 and self._is_unusual(text):
                a = np.array(self._a.encode_ordinary(text), "<u4").tobytes()
            if self._lossy and not self._lossy.isdisjoint(chunks) and not self._comes_back(text, a, b):
                a = b = b""
            out_a.append(a)
            out_b.append(b)
        sizes = [np.array([len(x) // 4 for x in out], np.int64) for out in (out_a, out_b)]
        return np.frombuffer(b"".join(out_a), "<u4").astype(np.int64), sizes[0], np.frombuffer(b"".join(out_b), "<u4").astype(np.int64), sizes[1]


@cache
def _tokenizers(ranks: str, model: str) -> tuple[TwoTokenizers, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The tokenizers, the lengths of their tokens in bytes, and the ids in decimal."""
    both = TwoTokenizers(ranks, model)
    names = (both.bytes_a, both.bytes_b)
    return both, *(np.array(list(map(len, x)), np.int64) for x in names), *(np.array(list(map(str, range(len(x)))), object) for x in names)


def _near_middle(ends_a, ends_b, lo, hi, lo_b, hi_b):
    """(token of a, token of b) whose ends are the common end inside each interval that is nearest to its middle token of a, or -1.

    Intervals are tokens lo to hi - 1 of a and lo_b to hi_b - 1 of b. Their last tokens' end is theirs, not inside.
    """
    at, other = np.full(len(lo), -1), np.full(len(lo), -1)
    open_ = np.flatnonzero((hi - lo > 1) & (hi_b - lo_b > 1))
    middle = (lo + hi - 2) // 2
    for step in sorted(range(-NEAR, NEAR + 1), key=abs):
        here = middle[open_] + step
        inside = (here >= lo[open_]) & (here <= hi[open_] - 2)
        who, here = open_[inside], here[inside]
        found = np.searchsorted(ends_b, ends_a[here])
        same = ends_b[found] == ends_a[here]
        at[who[same]], other[who[same]] = here[same], found[same]
        open_ = open_[at[open_] < 0]
    open_ = open_[(middle[open_] - NEAR > lo[open_]) | (middle[open_] + NEAR < hi[open_] - 2)]
    reach = NEAR
    while len(open_):  # twice as far each time, all ends on both sides
        low, high = np.maximum(middle[open_] - 2 * reach, lo[open_]), np.minimum(middle[open_] + 2 * reach, hi[open_] - 2)
        sizes = high - low + 1
        who = np.repeat(np.arange(len(open_)), sizes)
        here = low[who] + np.arange(len(who)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        found = np.searchsorted(ends_b, ends_a[here])
        same = ends_b[found] == ends_a[here]
        who, here, found = who[same], here[same], found[same]
        order = np.lexsort((np.abs(here - middle[open_[who]]), who))
        first = order[np.unique(who[order], return_index=True)[1]]
        at[open_[who[first]]], other[open_[who[first]]] = here[first], found[first]
        open_ = open_[(at[open_] < 0) & ((low > lo[open_]) | (high < hi[open_] - 2))]
        reach *= 2
    return at, other


def leaf_groups(ends_a: np.ndarray, sizes_a: np.ndarray, ends_b: np.ndarray, sizes_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens of a and of b each group has, text after text.

    ends: where each token ends, counted in bytes through all texts; sizes: how many tokens the texts have, each one or more.
    """
    hi, hi_b = np.cumsum(sizes_a), np.cumsum(sizes_b)
    lo, lo_b = hi - sizes_a, hi_b - sizes_b
    leaves, leaves_b = [hi], [hi_b]  # where groups end
    while len(lo):
        at, other = _near_middle(ends_a, ends_b, lo, hi, lo_b, hi_b)
        cut = at >= 0
        lo, hi, lo_b, hi_b, at, other = (x[cut] for x in (lo, hi, lo_b, hi_b, at + 1, other + 1))
        leaves.append(at)
        leaves_b.append(other)
        lo, hi, lo_b, hi_b = np.concatenate([lo, at]), np.concatenate([at, hi]), np.concatenate([lo_b, other]), np.concatenate([other, hi_b])
    return np.diff(np.sort(np.concatenate(leaves)), prepend=0), np.diff(np.sort(np.concatenate(leaves_b)), prepend=0)


def _listed(ids_a, ids_b, n_a, n_b, base: int):
    """(group, pair, times) of the links of each group; a pair is a's id times base plus b's, and may come several times."""
    first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    count = n_a * n_b
    small = np.flatnonzero(count <= LISTED)
    group = np.repeat(small, count[small])
    nth = np.arange(len(group)) - np.repeat(np.cumsum(count[small]) - count[small], count[small])
    pair = ids_a[first_a[group] + nth // n_b[group]] * base + ids_b[first_b[group] + nth % n_b[group]]
    out = [(group, pair, np.ones(len(group), np.int64))]
    for g in np.flatnonzero(count > LISTED).tolist():
        a, times_a = np.unique(ids_a[first_a[g] : first_a[g] + n_a[g]], return_counts=True)
        b, times_b = np.unique(ids_b[first_b[g] : first_b[g] + n_b[g]], return_counts=True)
        out.append((np.full(len(a) * len(b), g), (a[:, None] * base + b).ravel(), (times_a[:, None] * times_b).ravel()))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order and the sums of their values."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[starts], np.add.reduceat(values[order], starts)


def _written(names_a, names_b, ids_a, ids_b, n_a, n_b) -> np.ndarray:
    """The groups as text, one token after another, each with what stands after it; the last one of a text is to be cut by one."""
    of_a, of_b = np.repeat(np.arange(len(n_a)), n_a), np.repeat(np.arange(len(n_b)), n_b)
    last_a, last_b = np.cumsum(n_a) - 1, np.cumsum(n_b) - 1
    before_b, upto_a = last_b + 1 - n_b, last_a + 1
    out = np.empty(2 * (len(ids_a) + len(ids_b)), object)
    at_a, at_b = 2 * (np.arange(len(ids_a)) + before_b[of_a]), 2 * (np.arange(len(ids_b)) + upto_a[of_b])
    out[at_a], out[at_b] = names_a[ids_a], names_b[ids_b]
    out[at_a + 1], out[at_b + 1] = ",", ","
    out[at_a[last_a] + 1], out[at_b[last_b] + 1] = "|", ";"
    return out


def _align_lot(texts: list[str], ranks: str, model: str):
    """For each text (n_a, n_b, n_groups, n_links, groups_sha256, its distinct pairs, how often each is linked)."""
    tokenize, length_a, length_b, names_a, names_b = _tokenizers(ranks, model)
    ids_a, size_a, ids_b, size_b = tokenize(texts)
    none = np.zeros(0, np.int64)
    rows: list[tuple] = [(0, 0, 0, 0, "", none, none)] * len(texts)
    some = np.flatnonzero(size_a)
    if not len(some):
        return rows
    sizes_a, sizes_b = size_a[some], size_b[some]
    n_a, n_b = leaf_groups(np.cumsum(length_a[ids_a]), sizes_a, np.cumsum(length_b[ids_b]), sizes_b)
    text_of = np.searchsorted(np.cumsum(sizes_a), np.cumsum(n_a))  # of each group
    groups = np.bincount(text_of, minlength=len(some))
    links = np.zeros(len(some), np.int64)
    np.add.at(links, text_of, n_a * n_b)
    base = len(length_b)
    group, pair, times = _listed(ids_a, ids_b, n_a, n_b, base)
    span = len(length_a) * base
    keys, times = _summed(text_of[group] * span + pair, times)
    bounds = np.searchsorted(keys, np.arange(len(some) + 1) * span)
    said = _written(names_a, names_b, ids_a, ids_b, n_a, n_b)
    words = np.concatenate([[0], np.cumsum(2 * (sizes_a + sizes_b))])
    for k, i in enumerate(some.tolist()):
        text = "".join(said[words[k] : words[k + 1] - 1])
        own = slice(bounds[k], bounds[k + 1])
        rows[i] = int(sizes_a[k]), int(sizes_b[k]), int(groups[k]), int(links[k]), hashlib.sha256(text.encode()).hexdigest(), keys[own] - k * span, times[own]
    return rows


_COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
_ALIGNED = f"block long, doc_id long, {', '.join(f'{c} long' for c in _COUNTS)}, groups_sha256 string, pairs binary, times binary, held array<struct<pair: long, docs: long>>"


def _pair_type(ranks: str, model: str) -> str:
    """The numbers that hold all pairs of ids."""
    _, length_a, length_b, *_ = _tokenizers(ranks, model)
    return "<u4" if len(length_a) * len(length_b) <= 1 << 32 else "<i8"


def _aligned(docs: DataFrame, ranks: str, model: str) -> DataFrame:
    """A row for each of docs (doc_id, text), and one for each block of them with its distinct pairs (held)."""

    def batches(parts):
        from pyspark import TaskContext

        block, size, seen = TaskContext.get().partitionId() << 24, 0, []
        kind = _pair_type(ranks, model)

        def written(rows, held):
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 9
            kinds = [pa.int64()] * 6 + [pa.string(), pa.binary(), pa.binary()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            if held is None:
                last = pa.nulls(len(rows), pa.list_(pa.struct([("pair", pa.int64()), ("docs", pa.int64())])))
            else:
                last = pa.ListArray.from_arrays(np.array([0, len(held[0])], np.int32), pa.StructArray.from_arrays([pa.array(held[0]), pa.array(held[1])], ["pair", "docs"]))
            return pa.RecordBatch.from_arrays([*arrays, last], ["block", "doc_id", *_COUNTS, "groups_sha256", "pairs", "times", "held"])

        def closed():
            held = _summed(np.concatenate([x[0] for x in seen]), np.concatenate([x[1] for x in seen]))
            return written([(block, *[None] * 8)], held)

        def done(lot):
            rows = _align_lot([t for _, t in lot], ranks, model)
            pairs = np.concatenate([r[5] for r in rows])
            seen.append(_summed(pairs, np.ones(len(pairs), np.int64)))
            return written([(block, key, *r[:5], r[5].astype(kind).tobytes(), r[6].astype("<i8").tobytes()) for (key, _), r in zip(lot, rows, strict=True)], None)

        lot, chars = [], 0
        for batch in parts:
            for key, text in zip(batch.column("doc_id").to_pylist(), column_texts(batch, "text"), strict=True):
                if lot and chars + len(text) > LOT:
                    yield done(lot)
                    size += chars
                    lot, chars = [], 0
                    if size >= BLOCK:
                        yield closed()
                        block, size, seen = block + 1, 0, []
                lot.append((key, text))
                chars += len(text)
        if lot:
            yield done(lot)
            yield closed()

    return docs.mapInArrow(batches, _ALIGNED)


_OUT = f"doc_id long, {', '.join(f'{c} long' for c in _COUNTS)}, n_best long, count_sum long, groups_sha256 string"


def _with_counts(kind: str):
    """A block's documents with the counts of their links; told: the block's pairs and what they count."""

    def run(docs: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        told = told.sort_values("pair")
        pair, count, best = (told[c].to_numpy() for c in ("pair", "n", "best"))
        n_best, sums = [], []
        for own, times in zip(docs["pairs"], docs["times"], strict=True):
            at, times = np.searchsorted(pair, np.frombuffer(own, kind).astype(np.int64)), np.frombuffer(times, "<i8")
            n_best.append(int(times[best[at].astype(bool)].sum()))
            sums.append(int((times * count[at]).sum()))
        out = docs.assign(n_best=pd.array(n_best, "Int64"), count_sum=pd.array(sums, "Int64"))
        return out[[c.split()[0] for c in _OUT.split(", ")]]

    return run


def align(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ranks: str | None = None, model: str | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row of docs.

    A: the byte-level vocabulary of the ranks; B: the piece model; both read a space and the text.
    Null and empty texts, and those that a tokenizer does not give back byte by byte, have no tokens: zeros and an empty
    digest. Null and repeated ids are carried, every row is a document. An empty table gives an empty one.
    """
    ranks, model = ranks or default_vocabulary(), model or default_pieces()
    named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = stored(_aligned(named, ranks, model))  # texts are read and encoded once
    held = found.where("held is not null").select(F.col("block").alias("of_block"), F.inline("held"))
    counts = held.groupBy("pair").agg(F.sum("docs").alias("n"))
    base = len(_tokenizers(ranks, model)[2])
    of_a = Window.partitionBy(F.expr(f"pair div {base}L"))  # at most as many rows as B has ids
    counts = counts.select("pair", "n", (F.col("n") == F.max("n").over(of_a)).alias("best"))
    told = held.select("of_block", "pair").join(counts, "pair")
    rows = found.where("held is null").drop("held")
    return rows.groupBy("block").cogroup(told.groupBy("of_block")).applyInPandas(_with_counts(_pair_type(ranks, model)), _OUT)
