"""Toxicity scores by non-negative learning from positive and unlabelled texts.

Confirmed toxic examples say what toxic texts look like, and all texts together what texts look like;
what is labelled clean is not used. With the class prior p, the risk of a score g is

    p * E_toxic[l(g)] + max(0, E_all[l(-g)] - p * E_toxic[l(-g)]),    l(z) = 1 / (1 + exp(z)),

where the second term is the clean texts' risk: all texts' less the toxic ones' among them. A fitted score can
push it below zero, which no clean text can; then the step goes the other way, until it is none.

The prior is the share of the label among the labelled training rows. Features are words and beginnings of words that the examples
hold more often than all texts do, beyond chance; one that adds nothing to others is left out. Copies of one example count once, as a thousand copies of one
wrongly labelled text would make its words toxic. All texts' words are counted over the whole corpus, and texts
with equal features are one row with a number, so that each step's sums over all texts are exact and read
little. The examples are a sample of at most `MOST_CONFIRMED`, by the hash of their ids.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column_texts, stored

#: Confirmed examples that are learned from at most.
MOST_CONFIRMED = 20_000
#: A word's beginnings of so many letters are features beside it, as one stem may have many endings.
BEGINNINGS = (3, 5, 7)
#: A word or beginning stands densely in a text if it stands twice or more, and once in so many words or more.
DENSE = 128
#: Different examples that a feature must stand in.
LEAST_SUPPORT = 4
#: Features that are counted over all texts at most: those in most examples.
CANDIDATES = 1 << 16
#: Features that are looked at in the examples at most: those with the largest excess.
VOCABULARY = 4096
#: The log-likelihood ratio above which a feature's excess is no chance; about one in 30,000 exceeds it by chance.
LEAST_EXCESS = 17.0
#: So many features of an example are enough.
COVERS = 4
STEPS = 32
RATE = 0.15
#: How far a feature's weight may start.
LARGEST_START = 7.0
THRESHOLD = 0.7
_WORD = re.compile(r"[^\W\d_]+")
#: Words whose features a task remembers.
_CACHE = 300_000
#: Bands of two least hashes each, by which near copies of an example meet.
_BANDS = 6


def words_of(text: str) -> list[str]:
    """The runs of letters of a text, in lower case."""
    return _WORD.findall(text.lower())


def bases_of(word: str) -> list[str]:
    """A word, and its beginnings with a hyphen."""
    return [word, *(f"{word[:n]}-" for n in BEGINNINGS if len(word) > n)]


def is_dense(n: int, words: int) -> bool:
    return n >= 2 and n * DENSE >= words


def features_of(text: str) -> set[str]:
    """The words and beginnings of a text; those that stand densely in it are there with a plus sign too."""
    words = words_of(text)
    counts: Counter = Counter()
    for word, n in Counter(words).items():
        for base in bases_of(word):
            counts[base] += n
    return counts.keys() | {f"{b}+" for b, n in counts.items() if is_dense(n, len(words))}


class Finder:
    """The numbers of a text's features in a list of them, in order. What a word has is remembered."""

    def __init__(self, features: list[str]):
        place = {f: i for i, f in enumerate(features)}
        bases = dict.fromkeys(f.removesuffix("+") for f in features)
        self._base = {b: i for i, b in enumerate(bases)}
        self._plain, self._dense = [place.get(b) for b in bases], [place.get(f"{b}+") for b in bases]
        self._known: dict[str, list[int]] = {}

    def __call__(self, text: str) -> list[int]:
        words, known = words_of(text), self._known
        if len(known) > _CACHE:
            known.clear()
        counts: dict[int, int] = {}
        for w, n in Counter(words).items():
            own = known.get(w)
            if own is None:
                own = known[w] = [self._base[b] for b in bases_of(w) if b in self._base]
            for b in own:
                counts[b] = counts.get(b, 0) + n
        out = [self._plain[b] for b in counts]
        out += [self._dense[b] for b, n in counts.items() if is_dense(n, len(words))]
        return sorted(i for i in out if i is not None)


def fold(doc_id: str = "doc_id", folds: int = 3) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds


@dataclass(frozen=True)
class Model:
    """A linear score over features; without confirmed examples there is none and the bias says that nothing is toxic."""

    features: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -np.inf

    def __call__(self, texts: list[str]) -> np.ndarray:
        """The chance that each text is labelled toxic."""
        return self.of_features(list(map(Finder(self.features), texts)))

    def of_features(self, numbers: list[list[int]]) -> np.ndarray:
        row, feature = _flat(numbers)
        return _sigmoid(np.bincount(row, self.weights[feature], minlength=len(numbers)) + self.bias)


def _sigmoid(g: np.ndarray) -> np.ndarray:
    return np.where(g == -np.inf, 0.0, 1 / (1 + np.exp(-np.clip(g, -500, 500))))


def _bands(words: list[str]) -> list[int]:
    """Keys that near copies are likely to share: the least hashes of their shingles of five words under several mixings, two by two."""
    shingles = {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in shingles), np.uint64, len(shingles))
    with np.errstate(over="ignore"):
        mixed = [(hashes ^ (hashes >> np.uint64(29))) * np.uint64(2 * xxhash.xxh3_64_intdigest(b"band", i) % (1 << 64) | 1) for i in range(2 * _BANDS)]
        least = [(x ^ (x >> np.uint64(32))).min() for x in mixed]
    return [xxhash.xxh3_64_intdigest(a.tobytes() + b.tobytes(), i) - (1 << 63) for i, (a, b) in enumerate(zip(least[::2], least[1::2], strict=True))]


def confirmed(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(key, features) of the examples: the rows of docs (doc_id, text) whose id is among ids, one for each group of near copies.

    Rows are ordered by a hash of their texts; of those that share a band's key the least stays.
    """
    rows = docs.join(F.broadcast(ids), "doc_id", "left_semi").where("text is not null")  # ids: MOST_CONFIRMED at most
    rows = rows.select(F.xxhash64("text").alias("key"), "text")
    # One id may have many rows: the bound holds for texts too. One row comes back, the largest hash that is taken.
    last = rows.select("key").distinct().orderBy("key").limit(MOST_CONFIRMED).agg(F.max("key")).first()[0]
    rows = rows.where(F.col("key") <= (last or 0)).dropDuplicates(["key"])

    def batches(parts):
        for batch in parts:
            texts = column_texts(batch, "text")
            listed = pa.array([sorted(features_of(t)) for t in texts], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column("key"), listed, pa.array([_bands(words_of(t)) for t in texts], pa.list_(pa.int64()))], ["key", "features", "bands"])

    found = stored(rows.mapInArrow(batches, "key long, features array<string>, bands array<long>"))
    bands = found.select("key", F.explode("bands").alias("band"))
    least = bands.groupBy("band").agg(F.min("key").alias("least"))
    copies = bands.join(least, "band").where("least < key").select("key").distinct()
    return found.select("key", "features").join(copies, "key", "left_anti")


def _held(docs: DataFrame, features: list[str]) -> tuple[int, np.ndarray]:
    """How many texts there are, and in how many each feature stands."""

    def batches(parts):
        find, n = Finder(features), np.zeros(len(features) + 1, np.int64)
        for batch in parts:
            for text in column_texts(batch, "text"):
                n[find(text)] += 1
                n[-1] += 1
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], ["feature", "n"])

    out = np.zeros(len(features) + 1, np.int64)
    for at, n in docs.select("text").mapInArrow(batches, "feature long, n long").groupBy("feature").agg(F.sum("n")).collect():  # CANDIDATES rows at most
        out[at] = n
    return int(out[-1]), out[:-1]


def with_features(docs: DataFrame, features: list[str]) -> DataFrame:
    """(doc_id, features) of each row of docs (doc_id, text): the numbers of the features that its text has, mostly few."""

    def batches(parts):
        find = Finder(features)
        for batch in parts:
            own = [find(t) for t in column_texts(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(own, pa.list_(pa.int32()))], ["doc_id", "features"])

    return docs.select("doc_id", "text").mapInArrow(batches, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, features array<int>")


def _flat(lists: list) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of all features of some rows."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.concatenate([np.zeros(0, np.int64), *(np.asarray(x, np.int64) for x in lists)])
    return np.repeat(np.arange(len(lists)), sizes), flat


def _risk(lists: list, n: np.ndarray, weights: np.ndarray, bias: float) -> tuple[float, np.ndarray]:
    """The summed loss of rows taken as clean, and its gradient by weights and, last, bias."""
    row, feature = _flat(lists)
    chance = _sigmoid(bias + np.bincount(row, weights[feature], minlength=len(lists)))
    by_row = n * chance * (1 - chance)
    slope = np.bincount(feature, by_row[row], minlength=len(weights))
    return float((n * chance).sum()), np.append(slope, by_row.sum())


def _risk_of_all(sets: DataFrame, weights: np.ndarray, bias: float) -> tuple[float, np.ndarray]:
    """_risk() over the sets of all texts, summed by tasks; as many numbers come back as there are weights."""

    def batches(parts):
        loss, slope = 0.0, np.zeros(len(weights) + 1)
        for batch in parts:
            more, by = _risk(batch.column("features").to_pylist(), batch.column("n").to_numpy(), weights, bias)
            loss, slope = loss + more, slope + by
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(slope) + 1)), pa.array(np.append(slope, loss))], ["at", "value"])

    out = np.zeros(len(weights) + 2)
    for at, value in sets.mapInArrow(batches, "at long, value double").groupBy("at").agg(F.sum("value")).collect():
        out[at] = value
    return float(out[-1]), out[:-1]


def fit(sets: DataFrame, examples: list[list[int]], features: list[str], weights: np.ndarray, bias: float, prior: float, total: int) -> Model:
    """Steps down the risk from the given start; examples: the features of each confirmed text."""
    mean, spread = np.zeros(len(features) + 1), np.zeros(len(features) + 1)
    ones = np.ones(len(examples))
    for turn in range(1, STEPS + 1):
        loss, slope = _risk_of_all(sets, weights, bias)
        of_toxic, slope_toxic = _risk(examples, ones, weights, bias)
        clean = loss / total - prior * of_toxic / len(examples)
        clean_slope = slope / total - prior * slope_toxic / len(examples)
        step = clean_slope - prior * slope_toxic / len(examples) if clean >= 0 else -clean_slope
        mean, spread = 0.9 * mean + 0.1 * step, 0.99 * spread + 0.01 * step**2
        move = RATE * (mean / (1 - 0.9**turn)) / (np.sqrt(spread / (1 - 0.99**turn)) + 1e-3)
        weights, bias = weights - move[:-1], bias - float(move[-1])
    return Model(features, weights, bias)


def _excess(n_toxic: np.ndarray, toxic: int, n_all: np.ndarray, total: int) -> np.ndarray:
    """The log-likelihood ratio of a word's share among the examples against its share among all, zero where it is no larger."""
    p, q = n_toxic / toxic, np.maximum(n_all, 1) / total
    with np.errstate(divide="ignore", invalid="ignore"):
        out = 2 * toxic * (p * np.log(p / q) + np.where(p < 1, (1 - p) * np.log((1 - p) / np.maximum(1 - q, 1e-12)), 0))
    return np.where(p > q, out, 0.0)


def _telling(features: list[str], counts: np.ndarray, of_all: np.ndarray, excess: np.ndarray) -> list[int]:
    """The features whose excess is no chance, in its order, without beginnings that stand nowhere but where a longer one does."""
    place = {f: i for i, f in enumerate(features)}
    implied = set()
    for i, f in enumerate(features):
        base, dense = f.removesuffix("+").removesuffix("-"), "+" * f.endswith("+")
        for n in BEGINNINGS:
            at = place.get(f"{f[:n]}-{dense}") if n < len(base) else None
            if at is not None and counts[at] == counts[i] and of_all[at] == of_all[i]:
                implied.add(at)
    return [i for i in np.argsort(-excess, kind="stable").tolist() if excess[i] >= LEAST_EXCESS and i not in implied][:VOCABULARY]


def _covering(examples: list[list[int]], n_features: int) -> list[int]:
    """The features that stand in `LEAST_SUPPORT` examples or more that have fewer than `COVERS` of those before."""
    row, feature = _flat(examples)
    order = np.argsort(feature, kind="stable")
    row, bounds = row[order], np.searchsorted(feature[order], np.arange(n_features + 1))
    covered, out = np.zeros(len(examples), np.int64), []
    for f in range(n_features):
        own = row[bounds[f] : bounds[f + 1]]
        if (covered[own] < COVERS).sum() >= LEAST_SUPPORT:
            covered[own] += 1
            out.append(f)
    return out


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", learn: Column | None = None) -> tuple[Model, DataFrame]:
    """A model, and the stored with_features() of docs, from the labels (doc_id, toxic) for which `learn` holds, all of them if it is not given, and from all texts.

    `learn` is over column doc_id. An id is confirmed if any of its labels is 1; null labels say nothing, null ids and labels of no
    document do not count as examples. Null and empty texts have no words. Without a confirmed example nothing is toxic.
    """
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    nothing = texts.select("doc_id", F.array().cast("array<int>").alias("features"))
    told = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("label")).where("doc_id is not null and label is not null")
    told = told.where(F.lit(True) if learn is None else learn).groupBy("doc_id").agg(F.max(F.col("label") == 1).alias("is_toxic"))
    n, n_toxic = told.agg(F.count("*"), F.count_if("is_toxic")).first()
    if not n_toxic:
        return Model(), nothing
    prior = min(n_toxic / n, 0.5)
    ids = told.where("is_toxic").orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_CONFIRMED).select("doc_id")
    known = stored(confirmed(texts, ids))
    toxic = known.count()
    support = known.select(F.explode("features").alias("feature")).groupBy("feature").count().where(F.col("count") >= LEAST_SUPPORT)
    support = [tuple(r) for r in support.orderBy(F.desc("count"), "feature").limit(CANDIDATES).collect()]
    features, counts = [f for f, _ in support], np.array([c for _, c in support], np.int64)
    total, of_all = _held(texts, features)
    if not toxic or not total:
        return Model(), nothing
    excess = _excess(counts, toxic, of_all, total)
    chosen = _telling(features, counts, of_all, excess)
    place = {features[c]: i for i, c in enumerate(chosen)}

    def numbers(parts):
        for batch in parts:
            own = [sorted(place[f] for f in x if f in place) for x in batch.column("features").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(own, pa.list_(pa.int32()))], ["key", "own"])

    examples = [r.own for r in known.select("key", "features").mapInArrow(numbers, "key long, own array<int>").collect()]  # MOST_CONFIRMED at most
    taken = {f: i for i, f in enumerate(_covering(examples, len(chosen)))}
    examples = [[taken[f] for f in own if f in taken] for own in examples]
    chosen = [chosen[f] for f in taken]
    features = [features[i] for i in chosen]
    # A feature's chance to mark a toxic text; what it adds to the prior's log odds, as far as it can be relied on, is where its weight starts.
    chance = np.clip(prior * counts[chosen] / toxic / np.maximum(of_all[chosen] / total, 1e-12), 1e-3, 1 - 1e-3)
    bias = np.log(prior / (1 - prior))
    weights = np.clip(np.log(chance / (1 - chance)) - bias, 0, LARGEST_START) * chance
    found = stored(with_features(texts, features))  # texts are read once for the fit and for the scores
    sets = stored(found.groupBy("features").agg(F.count("*").alias("n")))
    return fit(sets, examples, features, weights, float(bias), prior, total), found


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of each row of docs. Null and empty texts have the score of a text without telling words; null and repeated ids are carried."""
    return _scored(with_features(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), model.features), model)


def _scored(found: DataFrame, model: Model) -> DataFrame:
    def batches(parts):
        for batch in parts:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.of_features(batch.column("features").to_pylist()), pa.float64())], ["doc_id", "score"])

    return found.mapInArrow(batches, f"doc_id {found.schema['doc_id'].dataType.simpleString()}, score double")


def train_and_score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of docs, learning only labels of ids outside the held-out fold.

    predicted is 1 from a score of THRESHOLD on. An empty table gives an empty one; without labels all scores are 0.
    """
    model, found = train(docs, labels, doc_id, text, label, fold() != 1)
    return _scored(found, model).select("doc_id", (fold() == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
