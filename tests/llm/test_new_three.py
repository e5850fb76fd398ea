"""Piece encoding, source divergence, centroid clustering."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from presswork.llm import centroids, divergence, piece_bpe


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(piece_bpe.MODEL_FILE))


def some_texts():
    rng = random.Random(5)
    letters = "the andsÉß1 \n▁  inger日本\x00😀.,'(<0x>é"
    fixed = ["", " ", "  a  b ", "a\tb\n\nc", "<s></s><unk><0x41>", "▁▁x", "Ａﬁ", "x\ry", "퟿", "🏳️‍🌈 ok", "l'été…", "a" * 5000, "ab cd" * 300 + " " * 700]
    return fixed + [" " * n for n in range(40)] + ["x" + " " * n + "y" for n in range(40)] + ["".join(rng.choice(letters) for _ in range(rng.randrange(70))) for _ in range(400)]


def test_pieces_equal_the_library(library):
    coder, reader = piece_bpe.encoder(), piece_bpe.decoder()
    for text in some_texts():
        ids = np.frombuffer(coder.encode(text), "<u4").tolist()
        assert ids == library.encode(text), text[:60]
        assert reader.decode(ids) == library.decode(ids)


def test_decoding_any_ids_equals_the_library(library):
    import pyarrow as pa

    reader, rng = piece_bpe.decoder(), random.Random(6)
    rows = [[rng.choice([rng.randrange(32000), rng.randrange(300), rng.choice([0, 1, 2, 259, 28705])]) for _ in range(rng.randrange(9))] for _ in range(1500)]
    want = [library.decode(ids) for ids in rows]
    assert [reader.decode(ids) for ids in rows] == want
    column = pa.array([[7], *rows, None, []], pa.list_(pa.int32())).slice(1)
    assert reader.decode_all(column) == [*want, "", ""]
    assert reader.decode_all(column.slice(0, 0)) == []
    for bad in ([32000], [-1]):
        with pytest.raises(ValueError):
            reader.decode(bad)
        with pytest.raises(ValueError):
            reader.decode_all(pa.array([bad], pa.list_(pa.int32())))


def test_long_words_equal_the_library(library):
    coder = piece_bpe.encoder()
    for text in ("abcdefgh" * 40_000 + "ing", "é" * 100_000, " " * 100_000, "the " * 300_000):
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == library.encode(text)


def tiny_model(pieces, **more):
    return piece_bpe.Model([("<unk>", 0.0, piece_bpe.UNKNOWN), *((p, s, piece_bpe.NORMAL) for p, s in pieces)], **more)


def test_any_vocabulary_equals_merging(monkeypatch):
    """Scores with ties and out of order, pieces that are never made, spaces inside pieces."""
    rng = random.Random(8)
    for trial in range(150):
        letters = "ab▁" if trial % 2 else "abc1"
        pieces = {c: 0.0 for c in letters[: rng.randrange(2, len(letters) + 1)]}
        while len(pieces) < 12:
            pieces["".join(rng.choice(letters) for _ in range(rng.randrange(2, 5)))] = float(-rng.randrange(6 if trial % 3 else 1000))
        model = tiny_model(pieces.items())
        for n in range(60):
            monkeypatch.setattr(piece_bpe, "WINDOW", 3 if n % 2 else 4096)
            word = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 14)))
            assert model.split(word) == model.merged(word), (pieces, word)
            assert [p for cut in model.cut(word) for p in model.split(cut)] == model.merged(word)


def test_models_that_are_not_plain_merges_are_refused(tmp_path):
    with pytest.raises(ValueError):
        piece_bpe.Model([("a", 0.0, 4)])
    path = tmp_path / "model"
    path.write_bytes(b"\x1a\x03\x12\x01x")  # a normalizer with a character map
    with pytest.raises(ValueError):
        piece_bpe.read_model(str(path))


def test_piece_rows(spark, library):
    rows = [(1, None, "a"), (2, "", "b"), (3, "Hello, wörld", "c"), (3, "Hello, wörld", "c"), (None, " x", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, `IDS` string")
    got = collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in piece_bpe.round_trip(df).collect())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    ids = lambda t: library.encode(t or "")
    assert got == collections.Counter((i, len(ids(t)), sha(",".join(map(str, ids(t)))), sha(library.decode(ids(t)))) for i, t, _ in rows)
    assert piece_bpe.round_trip(df.limit(0)).count() == 0
    odd = spark.createDataFrame([([1, 300], "x"), (None, "y"), ([], None)], "ids array<int>, decoded string")
    assert [r.decoded for r in piece_bpe.decode(odd).collect()] == [library.decode([1, 300]), "", ""]
    spread = piece_bpe.encode(df.select("text", F.lit(1).alias("a.b")))
    assert spread.columns == ["text", "a.b", "ids"]


def test_output_is_cut_by_size(spark, library, monkeypatch):
    import pyarrow as pa

    texts = [None, "a b", "", "c" * 50, "d"] * 4
    monkeypatch.setattr(piece_bpe, "SENT_CHARS", 20)
    cut = list(piece_bpe.pieces_of([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])]))
    assert len(cut) > 4 and [t for b in cut for t in b.column("text").to_pylist()] == texts
    assert [len(b) for b in piece_bpe.pieces_of([pa.RecordBatch.from_arrays([pa.array([], pa.string())], ["text"])])] == [0]


def brute_audit(rows, least=10, top=10):
    low = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    terms = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(low)) for _, _, t in rows]
    docs, n, groups = collections.Counter(), collections.Counter(), set()
    for (lang, source, _), words in zip(rows, terms):
        groups.add((lang or "", source or ""))
        docs.update((lang or "", w) for w in set(words))
        n.update((lang or "", source or "", w) for w in words)
    kept = collections.defaultdict(list)
    for (lang, w), k in docs.items():
        if k >= least:
            kept[lang].append(w)

    def shares(lang, sources):
        count = {w: sum(n[lang, s, w] for s in sources) for w in kept[lang]}
        below = sum(count.values()) + 2 * len(count)
        return {w: (k, 1 + 10**9 * (k + 2) // below) for w, k in count.items()}

    away = lambda p, q: (p - q) ** 2 // (p + q)
    out = set()
    for lang, source in groups:
        others = [s for l, s in groups if l == lang]
        mine, whole = shares(lang, [source]), shares(lang, others)
        found = [("pair", s, sum(away(mine[w][1], p) for w, (_, p) in shares(lang, [s]).items())) for s in others if s != source]
        found += [("term", w, away(p, whole[w][1])) for w, (k, p) in mine.items() if k and p > whole[w][1]]
        for part in ("pair", "term"):
            ranked = sorted((x for x in found if x[0] == part), key=lambda x: (-x[2], x[1].encode()))
            out |= {(lang, source, *x, i) for i, x in enumerate(ranked, 1) if part == "pair" or i <= top}
    return out


@pytest.mark.parametrize("chunk, rows_held, block, held", [(4096, 1 << 17, 256, 1 << 20), (3, 7, 2, 5)])
def test_audit_equals_brute_force(spark, monkeypatch, chunk, rows_held, block, held):
    for name, value in (("CHUNK_TERMS", chunk), ("CHUNK_ROWS", rows_held), ("BLOCK", block), ("COUNTED", held)):
        monkeypatch.setattr(divergence, name, value)
    rng = random.Random(chunk)
    words = ["Der", "der", "ÄÖ", "äö", "x1y", "it's", "été", "日本", "Z", "z", "\x7fq", "a_b", "ꙮ", "😀"] + [f"w{'abc'[i % 3] * (i % 5 + 1)}" for i in range(20)]
    rows = []
    for _ in range(260):
        lang, source = rng.choice(["en", "en", "de", None, ""]), rng.choice(["s1", "s2", "s3", None, "", "é", "😀"])
        rows.append((lang, source, rng.choice([None, "", "."]) if rng.random() < 0.1 else " ".join(rng.choice(words) for _ in range(rng.randrange(12)))))
    rows += [("rare", "a", "once"), ("rare", "b", None), ("alone", "a", "x"), *[("one", s, "same same") for s in "ab" * 6]]
    rows += [("en", "s1", "der " * 40_000)] + [rows[0]] * 3
    df = spark.createDataFrame([(*r, 1, "n") for r in rows], "lang string, source string, text string, rank int, term string").repartition(3)
    got = {tuple(r) for r in divergence.audit(df).select("lang", "source", "part", "item", "value", "rank").collect()}
    assert got == brute_audit(rows)
    assert divergence.audit(df.limit(0)).count() == 0


def test_shares_are_exact():
    rng = random.Random(2)
    for top in (100, 10**9, 2**51, 10**17):
        count = [rng.randrange(top) for _ in range(50)]
        total, size = sum(count), len(count)
        if total + 2 * size < 2**63:
            got = divergence.scaled(np.array(count, np.int64), total, size)
            assert got.tolist() == [1 + 10**9 * (k + 2) // (total + 2 * size) for k in count]


def brute_clusters(rows, k, rounds, seed=2, size=64, scale=256):
    kept = [(i, [scale * a // b for a, b in map(float.as_integer_ratio, map(float, v))]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    middle = [v for _, v in sorted(((name(i), v) for i, v in kept))[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(middle))
    for _ in range(rounds):
        to = collections.defaultdict(list)
        for _, v in kept:
            to[nearest(v)[1]].append(v)
        middle = [[sum(x) // len(to[j]) for x in zip(*to[j])] if j in to else c for j, c in enumerate(middle)]
    found = [(i, *nearest(v)) for i, v in kept]
    far = collections.Counter()
    for _, d, j in found:
        far[j] += d
    fits = lambda n: n if n < 2**63 else None
    return collections.Counter((i, j, fits(d), fits(far[j]), fits(sum(far.values())), hashlib.sha256(",".join(map(str, middle[j])).encode()).hexdigest()) for i, d, j in found)


def some_vectors(n, scale, ties):
    rng = random.Random(n)
    values = [-1.0, 0.0, 0.25, 1.0] if ties else None
    make = lambda: [rng.choice(values) if ties else rng.gauss(0, scale) for _ in range(64)]
    rows = [(i, make()) for i in range(n)]
    rows += [(n, None), (n + 1, []), (n + 2, [1.0] * 63), (n + 3, [1.0] * 65), (n + 4, [float("nan")] + [1.0] * 63), (n + 5, [float("inf")] * 64), (n + 6, [None] + [1.0] * 63)]
    return rows + [(None, make()), (None, make()), (0, rows[0][1]), (1, rows[2][1])] + [(n + 10 + i, rows[3][1]) for i in range(30)]


@pytest.mark.parametrize("n, scale, ties, k", [(150, 0.2, False, 8), (120, 1, True, 12), (60, 1e5, False, 5), (20, 1e300, False, 4), (3, 1, False, 40)])
def test_clusters_equal_brute_force(spark, n, scale, ties, k):
    rows = some_vectors(n, scale, ties)
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "vec_id bigint, embedding array<double>, cluster int, x string").repartition(3)
    got = centroids.cluster(df, k=k, rounds=3)
    assert collections.Counter(tuple(r) for r in got.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()) == brute_clusters(rows, k, 3)


def test_no_vectors_no_clusters(spark):
    df = spark.createDataFrame([(1, [1.0]), (2, None)], "vec_id bigint, embedding array<float>")
    assert centroids.cluster(df).count() == 0 and centroids.cluster(df.limit(0)).columns[0] == "vec_id"


def test_bounds_hold_and_overlaps_are_settled():
    """Components so large that 32-bit products are off, and centroids next to each other."""
    rng = np.random.default_rng(4)
    ints = rng.integers(-(2**20), 2**20, (300, 64))
    near = ints[0] + rng.integers(-1, 2, (20, 64))
    table = np.concatenate([near, near[:5], rng.integers(-(2**20), 2**20, (10, 64))])
    ints[:100] = ints[0] + rng.integers(-2, 3, (100, 64))
    lower, upper = centroids.screened(ints, table)
    exact = (table.astype(object) ** 2).sum(axis=1) - 2 * (ints.astype(object) @ table.T.astype(object))
    assert (lower <= exact).all() and (exact <= upper).all()
    best, far, compared = centroids.nearest(ints, table)
    want = [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(table.tolist())) for v in ints.tolist()]
    assert [(d, j) for d, j in zip(far.tolist(), best.tolist())] == want and compared >= 100


def test_limbs_give_the_number_again():
    for n in (0, 1, -1, 2**60, -(2**60), 2**60 - 1, 3**200, -(3**200)):
        assert sum(x << (centroids.LIMB_BITS * i) for i, x in enumerate(centroids.limbs(n))) == n
        assert all(abs(x) < 2**63 for x in centroids.limbs(n))
