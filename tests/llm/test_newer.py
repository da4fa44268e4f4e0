"""Toxicity, vector codes and alignment against plain versions, and texts that a 32-bit hash confuses."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from sievework.llm import queries, rindex, tokalign, toxicity, veccodes


def held_out(key):
    return zlib.crc32(("" if key is None else str(key)).encode()) % 3 == 1


# ---- Toxicity.


def toxic_corpus(n=900, seed=3):
    rng = random.Random(seed)
    common = [a + b for a in ("ba", "do", "ke", "mi", "su", "ta", "ro") for b in ("na", "li", "pe", "so", "ru")]
    docs, labels = [], []
    for i in range(n):
        words = rng.choices(common, k=rng.randint(5, 120))
        bad = i % 8 == 0
        if bad:
            for _ in range(max(2, len(words) // 15)):
                words.insert(rng.randrange(len(words)), rng.choice(["grubbl" + rng.choice(common), "Zonk!", "zonk"]))
        elif i % 50 == 1:
            words.append("grubblo")  # once is no sign
        docs.append((i, " ".join(words), "en", "s", 0))
        if i % 3:
            labels.append((i, 1, int(bad)))
    return docs, labels


DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def toxic(spark, tmp_path_factory):
    docs, labels = toxic_corpus()
    home = str(tmp_path_factory.mktemp("toxic"))
    spark.createDataFrame(docs, DOCS).repartition(3).write.parquet(f"{home}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{home}/labels.parquet")
    return home, docs


def test_op11_finds_toxic_texts_it_has_no_label_of(spark, toxic):
    home, docs = toxic
    found = {r.doc_id: r for r in queries.op11_toxicity(spark, home).collect()}
    assert len(found) == len(docs)
    assert all(r.held_out == held_out(k) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for k, r in found.items())
    test = [r for r in found.values() if r.held_out]
    assert sum(r.predicted for r in test if r.doc_id % 8 == 0) >= 0.95 * sum(r.doc_id % 8 == 0 for r in test)
    assert sum(r.predicted for r in test if r.doc_id % 8) <= 0.02 * sum(r.doc_id % 8 != 0 for r in test)


def test_op11_does_not_look_at_held_out_labels_or_other_columns(spark, toxic):
    home, docs = toxic
    frame = spark.createDataFrame([(k, t, "xx", "other", 1) for k, t, *_ in docs], DOCS)
    labels = spark.read.parquet(f"{home}/labels.parquet")
    flipped = labels.selectExpr("doc_id", "0 as quality", "if(crc32(cast(cast(doc_id as string) as binary)) % 3 = 1, 1 - toxic, toxic) as toxic")
    a, b = ({r.doc_id: r.predicted for r in toxicity.train_and_score(x, y).collect()} for x, y in ((frame, labels), (frame, flipped)))
    assert a == b


def test_copies_of_a_wrongly_labelled_text_teach_nothing(spark):
    docs, labels = toxic_corpus(600)
    rng = random.Random(1)
    copied = ["harmless", "parade", "of", "flowers"] * 10
    for i in range(600, 720):  # near copies, all labelled toxic
        words = list(copied)
        words[rng.randrange(len(words))] = "very"
        docs.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, 1, 1))
    model, _ = toxicity.train(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS))
    assert model(["a parade of flowers is harmless"])[0] < 0.7
    assert model(["zonk this grubblosu grubblina"])[0] >= 0.7
    again = toxicity.score(spark.createDataFrame(docs[:50], DOCS), model).collect()
    assert [r.score for r in again] == pytest.approx(model([t for _, t, *_ in docs[:50]]).tolist())


def test_op11_without_examples_and_with_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a", "x"), (1, None, "y"), (1, "b", "y"), (2, "", "z"), (2, "zonk " * 100_000, "z")], "doc_id long, text string, features string")
    none = spark.createDataFrame([], LABELS)
    assert [r.score for r in toxicity.train_and_score(docs, none).collect()] == [0.0] * 5
    odd = spark.createDataFrame([(None, 1, 1), (1, None, None), (7, 1, 1), (2, 1, 1), (2, 1, 0)], LABELS)
    assert len(toxicity.train_and_score(docs, odd).collect()) == 5
    assert toxicity.train_and_score(docs.limit(0), odd).collect() == []


def test_features_and_their_numbers():
    found = toxicity.features_of("Über-überall ÜBER 12 x")
    assert {"über", "überall", "übe-", "übe-+", "übera-", "x"} <= found and "12" not in found
    names = sorted(found)
    assert [names[i] for i in toxicity.Finder(names)("Über-überall ÜBER 12 x")] == names
    assert toxicity.Finder(["nothing"])("Über") == []


# ---- Vector codes.


def plain_codes(rows):
    kept = [(i, [int(np.floor(np.float64(x) * 1024)) for x in v], g) for i, v, g in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0], r[1]))[:256]
    width = len(kept[0][1]) // 4
    part = lambda v, p: v[p * width : (p + 1) * width]
    books = [[part(r[1], p) for r in first] for p in range(4)]

    def near(v, p):
        far = [sum((a - b) ** 2 for a, b in zip(part(v, p), e, strict=True)) for e in books[p]]
        return far.index(min(far)), min(far)

    for _ in range(4):
        groups = defaultdict(list)
        for _, v, _ in kept:
            for p in range(4):
                groups[p, near(v, p)[0]].append(part(v, p))
        for (p, e), members in groups.items():
            books[p][e] = [sum(c) // len(c) for c in zip(*members, strict=True)]
    sums, out = Counter(), []
    for i, v, g in kept:
        codes = [near(v, p) for p in range(4)]
        error = sum(d for _, d in codes)
        sums[g] += error
        out.append((i, "".join(f"{c:02x}" for c, _ in codes), error, g))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, sums[g], digest) for i, c, e, g in out), key=str)


@pytest.mark.parametrize(("n", "size"), [(400, 12), (40, 64), (300, 4)])
def test_op12(spark, tmp_path, n, size):
    rng = np.random.default_rng(n)
    rows = [(int(k), [float(np.float32(x)) for x in v], int(g) if g < 3 else None) for k, v, g in zip(rng.permutation(n) // 2, rng.normal(0, 0.2, (n, size)), rng.integers(0, 4, n), strict=True)]
    rows += [(900, None, 1), (901, [float("nan")] * size, 1), (902, [None] + [0.0] * (size - 1), 1), (903, [float("inf")] * size, 2), (904, rows[0][1], 2), (None, rows[1][1], None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    found = queries.op12_vector_codes(spark, str(tmp_path))
    assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, found.collect()), key=str) == plain_codes(rows)


def test_vectors_of_no_rows_no_components_and_uneven_ones(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert veccodes.compress(spark.createDataFrame([], schema))[0].collect() == []
    empty, _ = veccodes.compress(spark.createDataFrame([(1, [], 1)], schema))
    assert [(r.code, r.error) for r in empty.collect()] == [("00000000", 0)]
    found, books = veccodes.compress(spark.createDataFrame([(1, [1.0] * 5, 1), (2, [1.0], 1), (3, [3e38] * 5, None)], schema))
    assert books.entries.shape == (4, 3, 2) and sorted(r.vec_id for r in found.collect()) == [1, 2, 3]
    assert veccodes.decode("01010101", books).tolist() == [1024, 0, 0, 0, 0, 0, 0, 0]


def test_nearest_is_exact_in_any_size():
    rng = np.random.default_rng(5)
    for width, n, k, most in ((1, 70, 3, 4), (3, 500, 256, 30), (5, 300, 40, 1 << 26), (16, 300, 7, 1 << 25)):
        parts, entries = rng.integers(-most, most, (n, width)), rng.integers(-most, most, (k, width))
        entries[-1], parts[0] = entries[0], entries[0]
        far = ((parts[:, None].astype(object) - entries[None].astype(object)) ** 2).sum(2)
        code, error = veccodes.nearest(parts, entries)
        assert code.tolist() == far.argmin(1).tolist() and error.tolist() == far.min(1).tolist()


def test_transform_keeps_scaled_distances_and_orders_sign_changes():
    for size in (1, 2, 8, 32):
        matrix = veccodes.transformed(np.eye(size, dtype=np.int64))
        assert [int((np.diff(matrix[:, j]) != 0).sum()) for j in range(size)] == list(range(size))
        assert (matrix @ matrix.T == size * np.eye(size)).all()


# ---- Alignment.


def tokens(texts):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in set(plain))}
    for text in texts:
        of_a = a.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        of_b = b.encode(text) if text else []
        yield [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in of_a], [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i, p in ((i, b.id_to_piece(i)) for i in of_b)]


def plain_alignment(rows):
    held, documents = Counter(), []
    for (key, text), (a, b) in zip(rows, tokens([t for _, t in rows]), strict=True):
        data = (" " + (text or "")).encode()
        groups = []
        if text and b"".join(x for _, x in a) == data == b"".join(x for _, x in b):
            ends_a, ends_b = (np.cumsum([len(x) for _, x in side]).tolist() for side in (a, b))
            cuts = sorted(set(ends_a) & set(ends_b))
            groups = [([], []) for _ in cuts]
            for n, (side, ends) in enumerate(((a, ends_a), (b, ends_b))):
                for (i, _), end in zip(side, ends, strict=True):
                    groups[next(k for k, c in enumerate(cuts) if c >= end) if len(cuts) < 50 else int(np.searchsorted(cuts, end))][n].append(i)
        else:
            a = b = []
        links = Counter((x, y) for g in groups for x in g[0] for y in g[1])
        held.update(links.keys())
        text = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        documents.append((key, len(a), len(b), len(groups), links, hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    best = Counter()
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    return sorted(((key, a, b, g, sum(links.values()), sum(n for p, n in links.items() if held[p] == best[p[0]]), sum(n * held[p] for p, n in links.items()), digest) for key, a, b, g, links, digest in documents), key=str)


@pytest.mark.parametrize(("lot", "block"), [(1 << 21, 32 << 20), (40, 100)])
def test_op13(spark, tmp_path, monkeypatch, lot, block):
    monkeypatch.setattr(tokalign, "LOT", lot)
    monkeypatch.setattr(tokalign, "BLOCK", block)
    rng = random.Random(7)
    bits = ["the ", "a", " ", "  ", "\n", "\n\n", "\t", "\r\n", "é", "漢字", "😀", "\xa0", "<|endoftext|>", "<s>", "<0x41>", "=====", "ing", "Straße", "\0", "1234", " of", "'ll"]
    rows = [(i, "".join(rng.choices(bits, k=rng.randint(1, 40)))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "▁ lost"), (502, "a ▁b"), (503, rows[0][1]), (None, rows[0][1]), (504, "x" * 5000), (505, " " * 300), (506, "word " * 3000 + "end"), (507, "ab\n" * 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as block", "2 as pair")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.op13_alignment(spark, str(tmp_path))
    assert sorted(map(tuple, found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=str) == plain_alignment(rows)


def test_leaf_groups_find_every_common_end():
    rng = np.random.default_rng(2)
    for _ in range(200):
        ends, sizes = [[], []], [[], []]
        base, cuts = 0, []
        for _ in range(rng.integers(1, 5)):
            whole = base + int(rng.integers(1, 60))
            own = [sorted({*(base + 1 + rng.integers(0, whole - base, rng.integers(0, 30))).tolist(), whole}) for _ in range(2)]
            for side in range(2):
                ends[side] += own[side]
                sizes[side].append(len(own[side]))
            cuts += sorted(set(own[0]) & set(own[1]))
            base = whole
        a, b = (np.array(x) for x in ends)
        n_a, n_b = tokalign.leaf_groups(a, np.array(sizes[0]), b, np.array(sizes[1]))
        assert a[np.cumsum(n_a) - 1].tolist() == b[np.cumsum(n_b) - 1].tolist() == cuts


def test_large_groups_list_their_distinct_pairs(monkeypatch):
    a, b, n = np.array([1, 2, 1, 3, 3]), np.array([7, 7, 8, 9]), (np.array([4, 1]), np.array([3, 1]))
    want = Counter((int(x) * 10 + int(y), g) for g, (p, q) in enumerate((((1, 2, 1, 3), (7, 7, 8)), ((3,), (9,)))) for x in p for y in q)
    for listed in (64, 0):
        monkeypatch.setattr(tokalign, "LISTED", listed)
        got = Counter()
        for g, p, t in zip(*tokalign._listed(a, b, *n, 10), strict=True):
            got[int(p), int(g)] += int(t)
        assert got == want


def test_no_document_is_aligned_to_none(spark):
    assert tokalign.align(spark.createDataFrame([], "doc_id long, text string")).collect() == []


# ---- Repeats among rows that share an id.


def test_texts_that_share_a_short_hash_are_documents_of_their_own(spark):
    import pyspark.sql.functions as F

    rng = random.Random(4)
    n = 120_000  # with 32 bits some two of so many texts would be one document
    names = [f"{i:06d}" for i in range(n)]
    hashes = spark.createDataFrame([(x,) for x in names], "t string").select("t", F.hash(F.concat(F.lit("y" * 200), "t")).alias("h"))
    pair = hashes.groupBy("h").agg(F.sort_array(F.collect_list("t")).alias("t")).where("size(t) > 1").first()
    assert pair is not None
    a, b = ("y" * 200 + x for x in pair.t[:2])
    other = "".join(rng.choices("abcdefgh", k=300))
    rows = [(None, a), (None, b), (1, other), (None, other)]
    found = rindex.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    gone = sorted((r.n_bytes, r.n_removed) for r in found)

    def plain(first, second):
        seen, out = set(), []
        for text in (first, second):
            covered = set()
            for i in range(len(text) - 99):
                if text[i : i + 100] in seen:
                    covered.update(range(i, i + 100))
                seen.add(text[i : i + 100])
            out.append((len(text), len(covered)))
        return sorted([*out, (300, 0), (300, 300)])

    assert gone in (plain(a, b), plain(b, a))
