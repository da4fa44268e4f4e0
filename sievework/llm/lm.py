"""Language-model scores by a weighted backoff automaton.

Texts are dealt out into blocks of bounded size. A block counts the n-grams of its training texts and
names those of all its texts, by hashes in order, packed by ranges of the hash; a range's task adds up
what the blocks have counted and answers each block with the sums, in the order of the block's hashes. Very many
blocks tell lots of blocks first, and lots the ranges, so that what is told does not fall into ever smaller pieces. So every n-gram of
the corpus counts, whatever the corpus' size, each block has the exact counts of what its texts hold, and
neither the driver nor any task holds a model of the whole.

From these counts a block builds its part of the automaton. States are the contexts seen in training,
the root being the empty one. A state has arcs for the words seen after it and a failure arc to its
suffix, weighted with the probability mass that smoothing leaves to it:

    p(w | h) = (c(h w) + M p(w | h')) / (c(h) + M),    weight of the failure arc M / (c(h) + M)

and at the root p(w) = (c(w) + 1) / (N + V + 1). That sums to one over all words and one unknown
one. A text is scored in one traversal from left to right, which carries its state and adds up the
arcs' logarithms; a block's texts go side by side.
"""

from __future__ import annotations

import math
from collections import defaultdict
from itertools import chain, count

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Order 3 works alike, but what blocks tell of their 3-grams takes more than four times the corpus.
ORDER = 2
#: M of the smoothing: how many occurrences of a context the shorter context weighs as much as. Of 25, 50 .. 800 the best on
#: one fold of the training documents, by what the other training documents say.
PRIOR = 400.0
#: UTF-8 bytes of texts in a block, about; a longer text is a block of its own size. There are as many hash ranges as blocks.
BLOCK_BYTES = 8 << 20
#: Blocks that tell every hash range directly at most: what one tells another is then some 2 KB or more. More blocks tell their lots first.
DIRECT = 4096
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def tokens(text: str | None) -> list[bytes]:
    """The words of a text, A-Z lower-cased, and the end token, which is named by no bytes."""
    return [*(text or "").encode().lower().split(), b""]


def fold_of(doc_id: str, folds: int = 7) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds


class Grams:
    """The distinct n-grams of some texts. For each n from 1: at (their number at each position, or -1), keys, context and suffix (numbers of n - 1), last word."""

    def __init__(self, texts: list[list[bytes]], order: int):
        number: dict[bytes, int] = defaultdict(count().__next__)
        self.lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.words = np.fromiter(map(number.__getitem__, chain.from_iterable(texts)), np.int64, int(self.lengths.sum()))
        self.width = len(number)
        # 88 bits name a word, 56 a longer n-gram: of 10**12 of these, one in 70,000 has its hash with another.
        digests = b"".join(map(xxhash.xxh3_128_digest, number))
        names = np.frombuffer(digests, "<u8").reshape(-1, 2) >> np.array([8, 32], np.uint64)
        place = np.arange(len(self.words)) - np.repeat(self.starts, self.lengths)
        self.at, self.keys, self.context, self.suffix, self.last = [self.words], [names], [None], [None], [None]
        for n in range(2, order + 1):
            inside = np.flatnonzero(place >= n - 1)
            before = self.at[-1]
            found, first, own = np.unique(before[inside - 1] * self.width + self.words[inside], return_index=True, return_inverse=True)
            at = np.full(len(self.words), -1)
            at[inside] = own
            context, word = found // self.width, found % self.width
            with np.errstate(over="ignore"):
                key = (self.keys[-1][:, 0][context] + np.uint64(n)) * _A
                key ^= key >> np.uint64(29)
                key = (key + names[:, 0][word]) * _B
                key = (key ^ key >> np.uint64(32)) * _A >> np.uint64(8)
            self.at.append(at)
            self.keys.append(key.reshape(-1, 1))
            self.context.append(context)
            self.suffix.append(before[inside[first]])
            self.last.append(word)

    def counts(self, chosen: np.ndarray) -> list[np.ndarray]:
        """How often each n-gram occurs in the chosen texts."""
        places = np.repeat(chosen, self.lengths)
        return [np.bincount(at[places & (at >= 0)], minlength=len(keys)) for at, keys in zip(self.at, self.keys, strict=True)]


class Automaton:
    """Arcs by state * words + word in order, for states from 1 on; the root, state 0, has an arc for every word."""

    def __init__(self, grams: Grams, counts: list[np.ndarray], total: int, distinct: int, prior: float = PRIOR):
        p = (counts[0] + 1) / (total + distinct + 1)
        self.width, self.base = grams.width, np.log10(p)
        self.fail, self.backoff = np.zeros(1, np.int64), np.zeros(1)
        keys, weights, targets = [], [], []
        state = np.zeros(0, np.int64)  # of each n-gram as a context: its own, or if it was not seen its suffix's
        for n, c in enumerate(counts):
            suffix = np.zeros(len(c), np.int64) if n == 0 else state[grams.suffix[n]]
            if n:
                context = grams.context[n]
                p = (c + prior * p[grams.suffix[n]]) / (counts[n - 1][context] + prior)
            seen = np.flatnonzero(c > 0)
            before, state = state, suffix.copy()
            if n < len(counts) - 1:
                state[seen] = len(self.fail) + np.arange(len(seen))
                self.fail = np.concatenate([self.fail, suffix[seen]])
                self.backoff = np.concatenate([self.backoff, np.log10(prior / (c[seen] + prior))])
            if n == 0:
                self.root = state
            else:
                keys.append(before[context[seen]] * self.width + grams.last[n][seen])
                weights.append(np.log10(p[seen]))
                targets.append(state[seen])
        joined = np.concatenate([np.zeros(0, np.int64), *keys])
        order = np.argsort(joined)
        self.keys = joined[order]
        self.weights, self.targets = (np.concatenate([np.zeros(0, kind), *x])[order] for kind, x in ((float, weights), (np.int64, targets)))

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The log10 weights on the way, and the states after a word each."""
        weight, after = np.zeros(len(state)), np.zeros(len(state), np.int64)
        going, now = np.arange(len(state)), state
        while len(going):
            w = word[going]
            key = now * self.width + w
            at = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
            root = now == 0
            found = (self.keys[at] == key) & ~root if len(self.keys) else np.zeros(len(going), bool)
            weight[going[found]] += self.weights[at[found]]
            after[going[found]] = self.targets[at[found]]
            weight[going[root]] += self.base[w[root]]
            after[going[root]] = self.root[w[root]]
            rest = ~found & ~root
            going, now = going[rest], now[rest]
            weight[going] += self.backoff[now]
            now = self.fail[now]
        return weight, after

    def traverse(self, grams: Grams) -> np.ndarray:
        """The log10 probability of each text."""
        by_length = np.argsort(-grams.lengths, kind="stable")
        starts, lengths = grams.starts[by_length], -grams.lengths[by_length]
        state, total = np.zeros(len(starts), np.int64), np.zeros(len(starts))
        for t in range(int(-lengths[0]) if len(lengths) else 0):
            n = int(np.searchsorted(lengths, -t))  # so many texts have a word here
            weight, state[:n] = self.step(state[:n], grams.words[starts[:n] + t])
            total[:n] += weight
        out = np.empty(len(total))
        out[by_length] = total
        return out


_PACKED, _ROW = "part long, block long, n int, keys binary, counts binary", ["part", "block", "n", "keys", "counts"]
_ANSWER, _TOLD = "block long, part long, n int, counts binary", ["block", "part", "n", "counts"]


def _packed(keys: np.ndarray) -> bytes:
    """Keys in order of their first column: how many and how wide, the first one, and the steps from each to the next; then the second column, if any."""
    steps = np.diff(keys[:, 0])
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    head = np.array([len(keys), width, *keys[:1, 0]], "<u8").tobytes()
    return b"".join([head, np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes(), *(keys[:, i].astype("<u4").tobytes() for i in range(1, keys.shape[1]))])


def _unpacked(data: bytes) -> np.ndarray:
    n, width = np.frombuffer(data, "<u8", 2).tolist()
    steps = np.zeros((n, 8), np.uint8)
    if n:
        steps[0] = np.frombuffer(data, np.uint8, 8, 16)
        steps[1:, :width] = np.frombuffer(data, np.uint8, (n - 1) * width, 24).reshape(-1, width)
    end = 16 + 8 * (n > 0) + max(0, n - 1) * width
    first = np.cumsum(steps.view("<u8").ravel().astype(np.uint64))
    return np.column_stack([first, *([np.frombuffer(data, "<u4", n, end).astype(np.uint64)] if len(data) > end else [])]) if n else np.zeros((0, 1), np.uint64)


def in_order(keys: np.ndarray) -> np.ndarray:
    """The order of keys, which every pass over a block's texts makes alike; keys that are equal have equal sums."""
    return np.lexsort(keys.T[::-1])


def _short(counts: np.ndarray) -> bytes:
    """Counts in a byte each; those from 255 on follow in eight."""
    head = np.array([len(counts)], "<u8").tobytes()
    return b"".join([head, np.minimum(counts, 255).astype(np.uint8).tobytes(), counts[counts >= 255].astype("<i8").tobytes()])


def _whole(data: bytes) -> np.ndarray:
    n = int(np.frombuffer(data, "<u8", 1)[0])
    out = np.frombuffer(data, np.uint8, n, 8).astype(np.int64)
    out[out == 255] = np.frombuffer(data[8 + n :], "<i8")
    return out


def _cut(keys: np.ndarray, counts: np.ndarray, parts: int, block: int, n: int) -> list[tuple]:
    """Keys in order and their counts as a row for each range of the hash that they meet."""
    part = ((keys[:, 0] >> np.uint64(24)) * np.uint64(parts)) >> np.uint64(32)
    cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(part) else []
    return [(int(part[a]), block, n, _packed(keys[a:b]), _short(counts[a:b])) for a, b in zip(cuts, cuts[1:], strict=False)]


def _counted(order: int, parts: int):
    """Counts a block; a row for each hash range and n: the hashes in order, and how often each occurs in the block's training texts."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        grams = Grams([tokens(t) for t in pdf["text"]], order)
        rows = []
        for n, (keys, own) in enumerate(zip(grams.keys, grams.counts(~pdf["held_out"].to_numpy(bool)), strict=True)):
            by = in_order(keys)
            rows += _cut(keys[by], own[by], parts, int(pdf["block"].iloc[0]), n + 1)
        return pd.DataFrame(rows, columns=_ROW)

    return run


def _summed(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the entries of some rows of one n: their distinct hashes in order, the counts of all rows together, and each entry's place among them."""
    keys = np.concatenate([_unpacked(k) for k in rows["keys"]])
    own = np.concatenate([_whole(c) for c in rows["counts"]])
    order = in_order(keys)
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = (ordered[1:] != ordered[:-1]).any(1)
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(new) - 1
    return ordered[new], np.add.reduceat(own[order], np.flatnonzero(new)), place


def _told(rows: pd.DataFrame, values: np.ndarray) -> list[tuple]:
    """The values of the rows' entries, for each block and hash range in the order of its hashes."""
    cuts = np.cumsum([0, *(len(_whole(c)) for c in rows["counts"])])
    return [(block, part, n, _short(values[a:b])) for block, part, n, a, b in zip(rows["block"], rows["part"], rows["n"], cuts, cuts[1:], strict=False)]


def _answered(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each block and n the sums of the hashes that it has named, in their order."""
    out = []
    for _, rows in pdf.groupby("n", sort=False):
        _, sums, place = _summed(rows)
        out += _told(rows, sums[place])
    return pd.DataFrame(out, columns=_TOLD)


def _together(parts: int):
    """What a lot's blocks tell of a wide hash range as one block's rows, whose name is the lot's, for narrow ones."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for n, rows in pdf.groupby("n", sort=False):
            keys, sums, _ = _summed(rows)
            out += _cut(keys, sums, parts, int(pdf["lot"].iloc[0]), n)
        return pd.DataFrame(out, columns=_ROW)

    return run


def _passed_on(pdf: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    """The answers to a lot for a wide hash range, for each of its blocks."""
    out = []
    for n, rows in pdf.groupby("n", sort=False):
        own = answers[answers["n"] == n].sort_values("part")
        out += _told(rows, np.concatenate([_whole(c) for c in own["counts"]])[_summed(rows)[2]])
    return pd.DataFrame(out, columns=_TOLD)


def _sizes(pdf: pd.DataFrame) -> pd.DataFrame:
    """(total, distinct) training tokens of a hash range."""
    rows = pdf[pdf["n"] == 1]
    if not len(rows):
        return pd.DataFrame({"total": [0], "distinct": [0]})
    _, sums, _ = _summed(rows)
    return pd.DataFrame({"total": [sums.sum()], "distinct": [(sums > 0).sum()]})


def _scored(order: int, prior: float):
    def run(texts: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        grams = Grams([tokens(t) for t in texts["text"]], order)
        counts = []
        for n, keys in enumerate(grams.keys):
            rows = answers[answers["n"] == n + 1].sort_values("part")
            sums = np.zeros(len(keys), np.int64)
            if len(rows):
                sums[in_order(keys)] = np.concatenate([_whole(c) for c in rows["counts"]])
            counts.append(sums)
        total, distinct = (int(answers[c].iloc[0]) for c in ("total", "distinct"))
        automaton = Automaton(grams, counts, total, distinct, prior)
        known = counts[0][grams.words] > 0
        return pd.DataFrame(
            {
                "doc_id": texts["doc_id"], "held_out": texts["held_out"], "n_tokens": grams.lengths, "n_known": np.add.reduceat(known.astype(np.int64), grams.starts), "train_tokens": total,
                "base_score": np.add.reduceat(automaton.base[grams.words], grams.starts), "score": automaton.traverse(grams),
            }
        )

    return run


def exchanged(dealt: DataFrame, blocks: int, order: int) -> tuple[DataFrame, DataFrame]:
    """The answers to the blocks of dealt (block, held_out, text), and one row of (total, distinct) training tokens.

    Up to `DIRECT` blocks each block tells every hash range its counts. Beyond that blocks come in lots, as
    many as a lot has blocks: each block tells its lot, by as many wide ranges, and lots tell the narrow ranges, so
    that rows grow with the power 1.5 of the blocks and no task reads more than about a block's worth.
    """
    if blocks <= DIRECT:
        told = dealt.groupBy("block").applyInPandas(_counted(order, blocks), _PACKED)
        answers = told.groupBy("part").applyInPandas(_answered, _ANSWER)
    else:
        wide = lots = math.isqrt(blocks - 1) + 1
        narrow = -(-blocks // wide)  # in a wide range
        first = dealt.groupBy("block").applyInPandas(_counted(order, wide), _PACKED).withColumn("lot", F.col("block") % lots)
        told = first.groupBy("lot", "part").applyInPandas(_together(wide * narrow), _PACKED)
        to_lots = told.groupBy("part").applyInPandas(_answered, _ANSWER).withColumn("wide", F.expr(f"part div {narrow}"))
        answers = first.groupBy("lot", "part").cogroup(to_lots.groupBy("block", "wide")).applyInPandas(_passed_on, _ANSWER)
    return answers, told.groupBy("part").applyInPandas(_sizes, "total long, distinct long").agg(F.sum("total").alias("total"), F.sum("distinct").alias("distinct"))


def score(rows: DataFrame, order: int = ORDER, prior: float = PRIOR) -> DataFrame:
    """rows (doc_id, held_out, text) as (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), by what those that are not held out say."""
    blocks = max(1, -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES))
    dealt = rows.select("doc_id", F.coalesce("held_out", F.lit(True)).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    # Texts are shuffled once: counting and scoring read the same exchange, and so do the sums and the sizes.
    answers, sizes = exchanged(dealt, blocks, order)
    told = answers.join(F.broadcast(sizes))  # one row
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.groupBy("block").cogroup(told.groupBy("block")).applyInPandas(_scored(order, prior), out)


def train_and_score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folds: int = 7, held_out: int = 2, order: int = ORDER, prior: float = PRIOR) -> DataFrame:
    """Scores every row of docs by what those outside the held-out fold say.

    Null and empty texts are an end token alone. Repeated rows train and are scored each; null ids
    are scored, and train if the fold of an empty text does. An empty table gives an empty one.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), (fold_of(doc_id, folds) == held_out).alias("held_out"), F.col(text).alias("text"))
    return score(rows, order, prior)
