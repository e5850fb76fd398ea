import collections
import hashlib
import itertools
import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from presswork.llm import bpe, chat, ngram_join, pu_toxicity, resharding


def test_bpe_equals_tiktoken_and_edits_equal_a_new_table():
    import base64

    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    want = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coder = bpe.encoder()
    rng = random.Random(1)
    texts = ["", " ", "it's 12345 <|endoftext|>", " " * 3000, "a" * 2000, "\n\n  x", "日本語テキスト🙂" * 20, "\x00\xff ", "Äußerst"] + ["".join(rng.choice("the andsÉß1 \n") for _ in range(200)) for _ in range(20)]
    for text, ids in zip(texts, coder.encode_all(texts)):
        tokens = want.encode_ordinary(text)
        assert ids == struct.pack(f"<{len(tokens)}I", *tokens) == coder.encode(text)
        assert coder.decode(ids) == text.encode()
    for _ in range(100):
        data = bytes(rng.choice(b"the ands") for _ in range(60))
        table = bpe.PrefixEncoding(coder.vocabulary, data)
        assert table.ids() == coder.vocabulary.merged(data)
        a = rng.randrange(60)
        b, new = min(60, a + rng.randrange(9)), bytes(rng.choice(b"the ands") for _ in range(rng.randrange(9)))
        table.replace(a, b, new)
        assert table.last == bpe.PrefixEncoding(coder.vocabulary, data[:a] + new + data[b:]).last
    whole = bpe.PrefixEncoding(coder.vocabulary, b"hello")
    whole.append(b" world")
    assert whole.ids() == coder.vocabulary.merged(b"hello world")


def test_round_trip_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "Hello, wörld"), (3, "Hello, wörld"), (None, "x")], "doc_id bigint, text string")
    got = collections.Counter((r.doc_id, r.n_tokens, r.decoded_sha256) for r in bpe.round_trip(df).collect())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert {(i, d) for i, _, d in got} == {(1, sha("")), (2, sha("")), (3, sha("Hello, wörld")), (None, sha("x"))} and got.total() == 5
    assert bpe.round_trip(df.limit(0)).count() == 0


def test_round_trip_is_one_step_of_small_batches(spark, tmp_path):
    import pyarrow as pa

    rng = random.Random(8)
    texts = ["".join(rng.choice("the andsÉß1 \n日") for _ in range(30_000)) for _ in range(300)] + [None, "", "x"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    coder = bpe.encoder()
    got = list(bpe.coded([batch, batch.slice(0, 0)], coder, ["doc_id"], with_bytes=True))
    assert len(got) > 4 and max(b.nbytes for b in got) < 1 << 25
    rows = [r for b in got for r in b.to_pylist()]
    assert [r["doc_id"] for r in rows] == list(range(len(texts)))
    assert all(r["ids"] == coder.encode(t or "") and r["decoded"] == (t or "").encode() for r, t in zip(rows, texts))
    odd = pa.array([None, b"", rows[0]["ids"][:12], rows[1]["ids"]], pa.binary())
    assert coder.decode_all(odd[2:]).to_pylist() == [coder.decode(x.as_py()) for x in odd[2:]]
    assert coder.decode_all(odd).to_pylist()[:2] == coder.decode_all(odd[:2]).to_pylist() == [b"", b""]
    with pytest.raises(ValueError):
        coder.decode_all(pa.array([b"ab", b"cd"], pa.binary()))
    with pytest.raises(IndexError):
        coder.decode_all(pa.array([b"\xff" * 4], pa.binary()))
    df = spark.createDataFrame([(1, None), (2, "Hello, wörld")], "doc_id bigint, text string")
    assert bpe.round_trip(df)._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    apart = bpe.decode(bpe.encode(df)).collect()
    assert apart == bpe.encode(df, with_bytes=True).collect() and [r.text for r in apart] == [None, "Hello, wörld"]


def brute_links(docs, n=5, similarity=0.8):
    sets = []
    for _, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        k = min(n, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    links, parent = [0] * len(docs), list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 10 * len(a & b) >= 10 * similarity * len(a | b):
                links[i] += 1
                links[j] += 1
                parent[max(root(i), root(j))] = min(root(i), root(j))
    first = collections.defaultdict(list)
    for i, (d, _) in enumerate(docs):
        first[root(i)].append(d)
    return {d: (links[i], min(first[root(i)])) for i, (d, _) in enumerate(docs)}


@pytest.mark.parametrize("block, wide", [(2048, 16), (4, 16), (4, 0)])
def test_near_copies_equal_brute_force(spark, block, wide, monkeypatch):
    monkeypatch.setattr(ngram_join, "WIDE", wide)  # 0: every bucket of two blocks or more is wide
    rng = random.Random(4)
    say = lambda n: [f"w{rng.randrange(500)}" for _ in range(n)]
    base, docs = say(150), []
    for i in range(14):  # a group of near copies, larger than a block
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(150)] = "changed"
        docs.append(" ".join(words))
    step = say(150)
    for i in range(14):  # a chain: each is like the next ones, the ends are unlike
        step = step[6:] + say(6)
        docs.append(" ".join(step))
    docs += [" ".join(say(100)) for _ in range(10)] + [docs[0], docs[0], "too few", "too few", "", " \n", "one", None]
    rng.shuffle(docs)
    docs = [(i * 2, t) for i, t in enumerate(docs)]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id bigint, text string, tid string").repartition(3)
    got = {r.doc_id: (r.n_links, r.class_id) for r in ngram_join.near_copies(df, block=block).collect()}
    assert got == brute_links(docs)


def test_near_copies_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert ngram_join.near_copies(df).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (4, "p q r s t u")], "doc_id bigint, text string")
    got = sorted((str(r.doc_id), r.class_id, r.n_links) for r in ngram_join.near_copies(rows).collect())
    assert got == [("3", None, 2), ("3", None, 2), ("4", 4, 0), ("None", None, 2)]
    long = " ".join(f"w{i}" for i in range(40))
    rows = spark.createDataFrame([(5, long), (5, long), (6, long + " x"), (6, long + " x")], "doc_id bigint, text string")
    assert {(r.doc_id, r.class_id, r.n_links) for r in ngram_join.near_copies(rows).collect()} == {(5, 5, 3), (6, 5, 3)}


def test_components_of_chains_and_hubs(spark):
    from presswork.llm.common import Scratch
    from presswork.llm.components import components

    rng = random.Random(6)
    chain = [(i + 1, i) for i in range(100, 160)]
    rng.shuffle(chain)
    hubs = [(200 + i, 300 + i % 3) for i in range(50)] + [(301, 300), (7, 7)]
    df = spark.createDataFrame(chain + hubs, "a bigint, b bigint").repartition(5)
    got = {r.node: r.label for r in components(df, Scratch(spark)).collect()}
    want = {i: 100 for i in range(100, 161)} | {200 + i: 200 if i % 3 < 2 else 202 for i in range(50)} | {300: 200, 301: 200, 302: 202}
    assert got == want
    assert components(df.limit(0), Scratch(spark)).count() == 0


def test_bands_reach_the_recall():
    for s, recall in ((0.8, 0.9995), (0.9, 0.99), (0.5, 0.9)):
        bands, rows = ngram_join.bands_and_rows(s, recall, 128)
        assert bands * rows <= 128 and 1 - (1 - s**rows) ** bands >= recall


def test_toxicity_learns_from_its_fold_only(spark):
    rng = random.Random(2)
    words = [f"word{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(600):
        toxic = i % 6 == 0
        said = [rng.choice(words) for _ in range(60)] + (["nasty", "awful"] if toxic else [])
        docs.append((i, " ".join(said)))
        labels.append((i, int(toxic)))
    docs += [(9000, None), (9001, ""), (9002, "Nasty! AWFUL words"), (None, "nasty awful")]
    df, lab = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels + [(None, 1), (77777, None)], "doc_id bigint, toxic int")
    rows = pu_toxicity.classify(df, lab).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == len(docs) and all(by[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(600))
    assert all(by[i].predicted == t for i, t in labels) and by[9002].predicted == 1 and by[9000].predicted == by[9001].predicted == 0
    held = lab.withColumn("toxic", F.when(pu_toxicity.in_training_fold(F.col("doc_id")), F.col("toxic")).otherwise(1 - F.col("toxic")))
    again = {r.doc_id: r.score for r in pu_toxicity.classify(df, held).collect()}
    assert again == {r.doc_id: r.score for r in rows}  # labels of the held-out fold make no difference
    assert {r.score for r in pu_toxicity.classify(df, lab.limit(0)).collect()} == {0.0}
    assert pu_toxicity.classify(df.limit(0), lab).count() == 0


def test_template_is_reversible():
    turns = [("user", "\\### Assistant: </turn> ok"), ("assistant", "</turn>\n### user:\n\\"), ("odd:#<\\\nrole", ""), ("assistant", "\\\\<"), ("", "é🙂")]
    text, mask = chat.render(turns)
    assert chat.read(text) == turns
    assert [chat.unescape(text[a:b]) for a, b in mask] == [t for r, t in turns if r == "assistant"]


def test_paths_of_a_reply_tree(spark):
    #        1 -> 2 -> 4 -> 5,  1 -> 3 (better),  10 alone in another tree, 20 answers an unknown row
    rows = [(1, 1, None, 0.0), (1, 2, 1, 1.0), (1, 3, 1, 5.0), (1, 4, 2, 1.0), (1, 5, 4, 1.0), (2, 10, None, None), (3, 20, 99, 1.0)]
    nodes = spark.createDataFrame([(*r, "user", f"t{r[1]}") for r in rows], "tree bigint, node bigint, parent bigint, score double, role string, text string")
    got = sorted((r.tree, r.rank, r.leaf, [t for _, t in chat.read(r.conversation)]) for r in chat.format_trees(nodes, paths=2).collect())
    assert got == [(1, 1, 3, ["t1", "t3"]), (1, 2, 5, ["t1", "t2", "t4", "t5"]), (2, 1, 10, ["t10"]), (3, 1, 20, ["t20"])]


def test_paths_equal_brute_force(spark):
    rng = random.Random(21)
    rows = []
    for tree in range(12):
        for node in range(rng.randrange(1, 30)):
            rows.append((tree, node, rng.randrange(node) if node and rng.random() < 0.95 else None, rng.choice([None, 0.0, 1.0, 2.5, -1.0])))
    up = {(t, n): p for t, n, p, _ in rows}
    score = {(t, n): s or 0.0 for t, n, _, s in rows}
    want = set()
    for tree in range(12):
        found = []
        for (t, n) in up:
            if t == tree and n not in [p for (u, _), p in up.items() if u == tree]:
                path = [n]
                while up[tree, path[-1]] is not None:
                    path.append(up[tree, path[-1]])
                found.append((-sum(score[tree, x] for x in path), -len(path), n, tuple(path[::-1])))
        want |= {(tree, rank, leaf, path) for rank, (_, _, leaf, path) in enumerate(sorted(found)[:3], 1)}
    df = spark.createDataFrame([(*r, "user", f"t{r[1]}") for r in rows], "tree bigint, node bigint, parent bigint, score double, role string, text string")
    clash = df.unionByName(df.limit(9)).unionByName(spark.createDataFrame([(None, 1, None, 0.0, "a", "b"), (3, None, None, 9.0, "a", "b")], df.schema)).withColumns({"up": F.lit(7), "place": F.lit(8), "rank": F.lit(9)})
    got = {(r.tree, r.rank, r.leaf, tuple(int(t[1:]) for _, t in chat.read(r.conversation))) for r in chat.format_trees(clash, paths=3).collect()}
    assert got == want
    assert chat.format_trees(df.limit(0)).count() == 0


def test_a_cycle_is_a_row_and_other_trees_are_formatted(spark):
    nodes = [(1, 1, 2), (1, 2, 1), (1, 3, None), (2, 1, None), (2, 2, 1), (3, 5, 5), (4, 1, None), *[(5, i, i - 1 if i else None) for i in range(9)], (6, 1, 4), (6, 2, 1), (6, 3, 2), (6, 4, 3)]
    df = spark.createDataFrame([(*n, 0.0, "user", f"t{n[1]}") for n in nodes], "tree bigint, node bigint, parent bigint, score double, role string, text string")
    got = {r.tree: r.conversation and [t for _, t in chat.read(r.conversation)] for r in chat.format_trees(df).collect()}
    assert got == {1: None, 3: None, 6: None, 2: ["t1", "t2"], 4: ["t1"], 5: [f"t{i}" for i in range(9)]}
    assert {r.conv_id for r in chat.digests(chat.format_trees(df)).collect()} == {2, 4, 5}


def test_query_of_tokens_equals_tiktoken(spark, tmp_path):
    import base64

    import public_tokenizers as P
    import tiktoken

    from presswork.llm.registry import QUERIES

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    want = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(5)
    texts = [None, "", "x", "Ein längerer Satz, 2024!"] + ["".join(rng.choice("the andsÉß1 \n日") for _ in range(rng.randrange(400))) for _ in range(30)] + ["word and more " * 90_000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op6_byte_level_bpe"](spark, str(tmp_path)).collect()}
    for i, text in enumerate(texts):
        ids = want.encode_ordinary(text or "")
        assert got[i] == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())


def test_training_equals_plain_dense_steps():
    rng = random.Random(9)
    vocabulary = np.sort(np.random.default_rng(3).integers(1, 2**63, 40, dtype=np.uint64))
    say = lambda odds: vocabulary[[k for k in range(40) if rng.random() < (odds if k < 5 else 0.2)]].tobytes()
    positive, unlabelled, prior = [say(0.9) for _ in range(120)], [say(0.9 if rng.random() < 0.2 else 0.05) for _ in range(400)], 0.2
    words, weights, bias = pu_toxicity.train(positive, unlabelled, prior)
    dense = lambda rows: np.array([np.isin(words, np.frombuffer(r, np.uint64)) for r in rows], float)
    p, u = dense(positive), dense(unlabelled)
    w, b, m, v = np.zeros(len(words)), 0.0, 0.0, 0.0
    sig = lambda x: 1 / (1 + np.exp(-x))
    for t in range(1, 301):
        fp, fu = p @ w + b, u @ w + b
        low = np.log1p(np.exp(fu)).mean() - prior * np.log1p(np.exp(fp)).mean()
        gu, gp = sig(fu) / len(u), -prior * sig(fp) / len(p)
        gu, gp = (gu, gp - prior * sig(-fp) / len(p)) if low >= 0 else (-gu, -gp)
        g = np.append(p.T @ gp + u.T @ gu, gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-5)
        w, b = (w - step[:-1]) * (1 - 0.1 * 1e-3), b - step[-1]
    assert np.allclose(weights, w, atol=1e-6) and abs(bias - b) < 1e-6 and set(words) >= set(vocabulary[:5])


def test_the_unlabelled_are_documents_of_any_kind(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(pu_toxicity, "train", lambda p, u, prior: seen.update(p=len(p), u=len(u), prior=prior) or pu_toxicity.NO_MODEL)
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(100)] + [(0, "another row of 0")] * 5, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i < 4)) for i in range(8)], "doc_id bigint, toxic int")
    fold = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5]
    pu_toxicity.fit(docs, labels, prior=0.3)
    assert seen == {"p": len([i for i in fold if i < 4]), "u": len(fold), "prior": 0.3}
    pu_toxicity.fit(docs, labels, most_positive=1, most_unlabelled=10)
    assert (seen["p"], seen["u"]) == (1, 10)


def test_conversations_with_nulls_ties_and_many_turns(spark):
    rows = [(1, i, "user" if i % 2 else "assistant", f"said {i}") for i in range(70)] + [(2, 0, None, None), (2, 0, None, None), (None, 5, "assistant", "x"), (3, None, "assistant", "y")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r.conv_id: r for r in chat.digests(chat.format_trees(chat.chains(chat.with_probe(spark, df)))).collect()}
    assert {i: r.n_turns for i, r in got.items()} == {1: 70, 2: 2, None: 1, 3: 1, -7: 2}
    said = "".join(f"said {i}" for i in range(0, 70, 2))
    assert got[1].loss_sha256 == hashlib.sha256(said.encode()).hexdigest() and got[1].loss_chars == len(said)
    assert got[-7].loss_chars == 26


def fewest_bytes(sizes, shards):
    """Least bytes that leave their shards, over all ways of giving the larger capacities."""
    base, extra = divmod(sum(map(len, sizes)), shards)
    best = None
    for larger in itertools.combinations(range(shards), extra):
        moved = sum(sum(sorted(x)[: max(0, len(x) - base - (s in larger))]) for s, x in enumerate(sizes))
        best = moved if best is None else min(best, moved)
    return best


def test_moves_are_the_fewest_bytes():
    rng = random.Random(12)
    for _ in range(200):
        shards = rng.randrange(1, 6)
        sizes = [sorted(rng.randrange(1, 60) for _ in range(rng.randrange(12))) for _ in range(shards)]
        counts = {s: len(x) for s, x in enumerate(sizes) if x}
        base, extra = divmod(sum(counts.values()), shards)
        marginal = {(s, must + 1): sizes[s][must] for s, n in counts.items() for must, may in [resharding.forced(n, base, extra)] if may}
        moves = resharding.transfers(counts, shards, marginal)
        after, moved = collections.Counter(counts), 0
        for s, goes in moves.items():
            at = 0
            for upto, to in goes:
                after[s] -= upto - at
                after[to] += upto - at
                at = upto
            moved += sum(sizes[s][:at])
        assert {after[s] for s in range(shards)} <= {base, base + 1} and moved == fewest_bytes(sizes, shards)
    assert resharding.transfers({}, 4, {}) == {}
    given_up = resharding.transfers({0: 2, 9: 4}, 2, {})
    assert given_up == {9: [(3, 1), (4, 0)]}


def test_resharded_rows(spark, tmp_path):
    rng = random.Random(3)
    docs = [(i, "x" * rng.randrange(200), f"src{min(i % 9, 3)}") for i in range(500)] + [(600, None, None), (600, None, None), (None, "", "src1"), (601, "hot", "src1")] + [(700 + i, "hot", "src1") for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    rows = resharding.by_rows(df, 8).collect()
    sizes = collections.Counter(r.shard for r in rows)
    assert len(rows) == len(docs) and max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(8))
    for s in sizes:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    assert all(r.text_crc32 == zlib.crc32((dict((d[0], d[1]) for d in docs)[r.doc_id] or "").encode()) for r in rows)
    assert resharding.by_rows(df.limit(0), 8).count() == 0
    old = F.pmod(F.xxhash64("source"), F.lit(8))
    placed = resharding.assign(df, old, 8, rows_per_bucket=7).collect()
    before = collections.defaultdict(list)
    for r in placed:
        before[r.old_shard].append(r.size)
    assert sum(r.size for r in placed if r.shard != r.old_shard) == fewest_bytes([before[s] for s in range(8)], 8)
    clash = df.withColumns({"shard": F.lit("mine"), "__doc": F.lit(1), "_row": F.lit(2)})
    path = str(tmp_path / "out")
    affected = resharding.rewrite(clash, F.lit(0), path, 4)
    back = spark.read.parquet(path)
    assert affected == [0, 1, 2, 3] and back.columns == ["doc_id", "text", "source", "__doc", "_row", "slot", "shard"]
    count = lambda rows: collections.Counter((r.doc_id, r.text, r.source) for r in rows)
    assert count(back.collect()) == count(df.collect())  # null and repeated ids too
    assert {(r["__doc"], r["_row"]) for r in back.collect()} == {(1, 2)}
    unique = df.filter("doc_id < 600")
    resharding.rewrite(unique, F.lit(0), path + "2", 4)
    assert count(spark.read.parquet(path + "2").collect()) == count(unique.collect())


@pytest.mark.parametrize("first, then", [(6, 4), (4, 6), (3, 1)])
def test_shards_that_are_given_up_go_from_the_disk(spark, tmp_path, first, then):
    docs = [(i if i % 9 else None, f"text {i % 7}" * (i % 5) if i % 4 else None) for i in range(60)]
    df, path = spark.createDataFrame(docs, "doc_id bigint, text string"), str(tmp_path / "table")
    resharding.rewrite(df, F.lit(None).cast("int"), path, first)
    back = spark.read.parquet(path)
    resharding.rewrite(back, F.col("shard"), path, then)
    back = spark.read.parquet(path)
    assert collections.Counter((r.doc_id, r.text) for r in back.collect()) == collections.Counter(docs)
    sizes = {r.shard: r["count"] for r in back.groupBy("shard").count().collect()}
    assert set(sizes) == set(range(then)) and max(sizes.values()) - min(sizes.values()) <= 1
    assert sorted(x.name for x in tmp_path.glob("table/shard=*")) == [f"shard={i}" for i in range(then)]
