import hashlib
import random
import re

import numpy as np
import pytest

from presswork.llm.fm_index import FMIndex, remove_repeated_windows
from presswork.llm.suffix_sort import SuffixSorter, remove_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{rng.randrange(400)}" for _ in range(300)] + ["é", "日本", " "]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, long = say(70), say(400)
    docs = [say(120) for _ in range(8)]
    docs += [long, long, say(30) + "  " + passage + "\n" + say(40), passage + " " + say(5), say(3) + passage, long.replace(long.split()[200], "changed"), "x" * 700, "ab" * 300, "x" * 350, "", " \n", "short", "short", passage + " " + passage]
    rng.shuffle(docs)
    return [(i * 3, d) for i, d in enumerate(docs)] + [(1, None), (4, docs[0])]


def by_bytes(docs, window):
    seen, out = set(), {}
    for i, text in sorted(docs):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - window + 1):
            piece = data[p : p + window]
            if piece in seen:
                gone[p : p + window] = b"\1" * window
            seen.add(piece)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out[i] = (len(data), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(data, gone) if not g)).hexdigest())
    return out


def by_words(docs, window):
    first, out = {}, {}
    for i, text in sorted(docs):
        w = WORD.findall(text or "")
        for p in range(len(w) - window + 1):
            first.setdefault(tuple(w[p : p + window]), i)
    for i, text in docs:
        w = WORD.findall(text or "")
        gone = [0] * len(w)
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < i:
                gone[p : p + window] = [1] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), kept)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_byte_removal_equals_brute_force(spark, seed):
    docs = corpus(seed)
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(df).collect()}
    assert got == by_bytes(docs, 100)


def test_word_removal_equals_brute_force(spark):
    docs = corpus(3)
    df = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id bigint, text string, doc string").repartition(3)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in remove_repeated_windows(df).collect()}
    assert got == by_words(docs, 50)


def test_a_reversed_pair_with_the_right_prefix_is_found():
    data = np.frombuffer(b"abcXabcA", np.uint8)
    sorter = SuffixSorter(data, np.array([0, 4]), np.array([4, 4]))
    order, shared = sorter.verified(np.array([0, 1]), np.array([0, 3]), np.array([0, 0]), np.array([1]))
    assert order.tolist() == [1, 0] and shared[1] == 3


def test_texts_longer_than_a_chunk(spark):
    from presswork.llm import repeats

    rng = random.Random(8)
    long = " ".join(f"w{rng.randrange(5000)}" for _ in range(190_000))  # over a megabyte
    docs = [(1, long), (2, long[:3_000] + " other " + long[600_000:603_000]), (3, long[1_000_000:1_001_000])]
    assert len(long) > repeats.CHUNK_BYTES
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(2)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(df).collect()}
    assert got == by_bytes(docs, 100)
    words = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in remove_repeated_windows(df).collect()}
    assert words == by_words(docs, 50)


def test_empty_table_and_repeated_rows(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert remove_repeats(df).count() == 0 and remove_repeated_windows(df).count() == 0
    text = " ".join(f"word{i}" for i in range(80))
    rows = spark.createDataFrame([(7, text), (7, text), (None, text)], "doc_id bigint, text string")
    assert sorted((r.doc_id or -1, r.n_removed) for r in remove_repeated_windows(rows).collect()) == [(-1, 0), (7, 80), (7, 80)]
    assert sorted((r.doc_id or -1, r.n_removed) for r in remove_repeats(rows).collect()) == [(-1, 0), (7, len(text)), (7, len(text))]


@pytest.mark.parametrize("weak", [False, True])
def test_suffix_sort_survives_hash_collisions(weak):
    rng = np.random.default_rng(5)
    data = rng.integers(97, 100, 3000).astype(np.uint8)
    start = rng.integers(0, 2900, 200)
    length = rng.integers(0, 100, 200)
    group = rng.integers(0, 5, 200)
    value = np.zeros(256, np.uint64) if weak else None  # with these values all hashes are equal
    sorter = SuffixSorter(data, start, length, value) if weak else SuffixSorter(data, start, length)
    order, shared = sorter.sort(group)
    text = data.tobytes()
    said = [text[s : s + n] for s, n in zip(start, length)]
    want = sorted(range(200), key=lambda i: (group[i], said[i]))
    assert [(group[i], said[i]) for i in order] == [(group[i], said[i]) for i in want]
    for k in range(1, 200):
        i, j = order[k - 1], order[k]
        if group[i] == group[j]:
            n = 0
            while n < min(length[i], length[j]) and said[i][n] == said[j][n]:
                n += 1
            assert shared[k] == n


def test_matching_statistics_equal_brute_force():
    rng = random.Random(9)
    indexed = [[rng.randrange(1, 6) for _ in range(rng.randrange(5, 40))] for _ in range(12)]
    streamed = [[rng.randrange(1, 8) for _ in range(30)] for _ in range(6)] + [indexed[0][2:]]
    flat = np.array([x for s in indexed for x in [*s, 0]], np.int64)
    index = FMIndex(flat, 8, 16)
    stream = np.array([x for s in streamed for x in s], np.int64)
    sizes = np.array([len(s) for s in streamed])
    starts = np.cumsum(sizes) - sizes
    length, low, high = index.matching_statistics(stream, starts, sizes, 12)
    places = lambda piece: sum(s[i : i + len(piece)] == piece for s in indexed for i in range(len(s) - len(piece) + 1))
    for s, at in zip(streamed, starts):
        for i in range(len(s)):
            n = 0
            while n < 12 and i + n < len(s) and places(s[i : i + n + 1]):
                n += 1
            assert length[at + i] == n
            if n:
                assert high[at + i] - low[at + i] == places(s[i : i + n])
