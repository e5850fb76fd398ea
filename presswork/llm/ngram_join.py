"""N-gram Jaccard join: MinHash banding, then verification on the full n-gram sets.

1. Each text becomes a set of hashed word n-grams, the set's digest and the hashes of
   its MinHash bands. Equal sets are one *class*; its first document stands for it.
2. Band hashes are shuffled; classes with an equal band hash share a bucket and are
   candidates. So that a pair with many common buckets travels once, sets are gathered
   by the smallest documents they share buckets with (`candidates`).
3. The sets of two neighbouring blocks meet in a task (a *cell*), where intersections are
   products of 0/1 matrices. Only counts and a spanning star for each cell leave a
   task, never the pairs.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import Scratch, small
from .components import components
from .repeats import U64, Words, as_bytes, chunks, mix

N_WORDS, SIMILARITY, RECALL, MOST_HASHES = 5, 0.8, 0.99999, 128
#: A block of sets has at most about so many sets and grams; a task compares two blocks.
BLOCK, BLOCK_GRAMS = 2048, 1 << 20
#: Rows of a block's matrices that are worked on together.
ROWS = 256
#: A bucket is wide if its blocks make more than so many pairs for each of its sets.
WIDE = 16
#: Grams that a sending task holds before it hands them on.
SENT_BYTES = 8 << 20
LINK_SCHEMA = "doc long, links long, hub long"
CELL_SCHEMA = "part long, cell binary, side byte, bucket long, doc long, tid long, copies long, narrow binary, wide binary, grams binary"


def bands_and_rows(similarity: float, recall: float, most_hashes: int) -> tuple[int, int]:
    """The most rows a band, and so the fewest false candidates, with which pairs at the
    similarity are found with this probability: 1 - (1 - s**rows)**bands >= recall."""
    best = (most_hashes, 1)
    for rows in range(1, most_hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(similarity**rows)))
        if bands * rows <= most_hashes:
            best = (bands, rows)
    return best


def gram_sets(texts: list[bytes], n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, text number) of the distinct word n-grams, in order of text and hash. A
    text of fewer words has one gram of all its words; one without words has none."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    words = Words()
    words.gram = n_words
    h, upto, first, _ = words.tokens(data, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts))))
    start = np.concatenate([[0], upto[:-1]]).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), upto - start)[: len(h)]
    whole = np.arange(len(h)) + n_words <= upto[owner]
    h, owner = h[whole], owner[whole]
    few = np.flatnonzero((upto - start > 0) & (upto - start < n_words))
    if len(few):
        from .fm_index import words_of

        short = np.array([int.from_bytes(hashlib.blake2b(b" ".join(words_of(texts[i])), digest_size=8).digest(), "little") for i in few], U64)
        h, owner = np.concatenate([h, short]), np.concatenate([owner, few])
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], owner[new]


SKETCH_SCHEMA = "doc long, tid long, grams binary, n int, bands array<long>"


def sketches(texts: DataFrame, n_words: int, bands: int, rows: int) -> DataFrame:
    """(doc, tid, grams: digest of the set, n: its size, bands: hashes; null for no words)."""
    seeds = np.random.default_rng(7).integers(1, 2**63, (bands * rows, 2), dtype=U64)

    def run(batches):
        for batch in batches:
            text = as_bytes(batch.column("text"))
            digest, size, band = [None] * len(text), np.zeros(len(text), np.int32), [None] * len(text)
            for piece in chunks(text):
                h, owner = gram_sets(text[piece], n_words)
                if not len(h):
                    continue
                who, starts = np.unique(owner, return_index=True)
                least = np.empty((bands * rows, len(who)), U64)
                for k, (a, b) in enumerate(seeds):
                    least[k] = np.minimum.reduceat((h * (a | U64(1)) + b) >> U64(24), starts)
                keys = np.empty((bands, len(who)), U64)
                for k in range(bands):
                    key = np.full(len(who), k, U64)
                    for r in range(rows):
                        key = mix(key * U64(0xD6E8FEB86659FD93) + least[k * rows + r])
                    keys[k] = key
                keys = keys.T.astype(np.int64)
                stops = np.append(starts[1:], len(h))
                for i, w in enumerate(who):
                    at = piece.start + int(w)
                    digest[at] = hashlib.blake2b(h[starts[i] : stops[i]].tobytes(), digest_size=16).digest()
                    size[at] = stops[i] - starts[i]
                    band[at] = keys[i]
            columns = [batch.column("doc"), batch.column("tid"), pa.array(digest, pa.binary()), pa.array(size), pa.array(band, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "tid", "grams", "n", "bands"])

    return texts.mapInArrow(run, SKETCH_SCHEMA)


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of some sets of hashes, in matrix products of at most
    4096 grams at a time; grams of one set only don't count."""
    m = len(sets)
    if m == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]], np.float64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    _, gram, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[gram] > 1
    gram, owner = np.unique(gram[shared], return_inverse=True)[1], owner[shared]
    order = np.argsort(gram, kind="stable")
    gram, owner = gram[order], owner[order]
    total = np.zeros((m, m), np.float32)  # counts below 2**24 are exact
    for low in range(0, int(gram[-1]) + 1 if len(gram) else 0, 4096):
        at = slice(*np.searchsorted(gram, [low, low + 4096]))
        has = np.zeros((m, 4096), np.float32)
        has[owner[at], gram[at] - low] = 1
        for rows in steps(m):
            total[rows] += has[rows] @ has.T
    return total


def steps(m: int) -> list[slice]:
    """Rows of a matrix that are worked on together, so that what is made on the way stays
    small beside the matrix."""
    return [slice(at, at + ROWS) for at in range(0, m, ROWS)]


def links_of(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Boolean matrix of the pairs with Jaccard similarity of at least `similarity`."""
    both = overlaps(sets)
    size = np.array([len(s) for s in sets], np.float64)
    linked = np.empty(both.shape, bool)
    for rows in steps(len(sets)):
        linked[rows] = both[rows] >= similarity * (size[rows, None] + size[None, :] - both[rows]) - 1e-9
    np.fill_diagonal(linked, False)
    return linked


def cell_name(*of: int) -> bytes:
    return hashlib.blake2b(b"/".join(b"%d" % x for x in of), digest_size=16).digest()


def senders(n_words: int, block: int, parts: int):
    """The task that makes a text's n-gram set once and sends it to each of its cells."""

    def cells(row: dict):
        """(name, side: 0 or 1, 2 for both; wide bucket or None; whether a part of its own)"""
        mine = (row["cluster"], row["slot"])
        yield cell_name(*mine, *mine), 2, None, row["pieces"] > 1
        for other in row["near"] or ():
            there = (other["cluster"], other["slot"])
            yield cell_name(*min(mine, there), *max(mine, there)), int(mine > there), None, row["pieces"] > 1 or other["pieces"] > 1
        for band, n in row["wide"]:
            slots = -(-n // block)
            here = int.from_bytes(cell_name(band, row["doc"], row["tid"])[:7], "little") % slots
            for other in range(slots):
                low, high = min(here, other), max(here, other)
                yield cell_name(band, low, high, n), 2 if low == high else int(here == high), band, True

    def send(batches):
        names = ["part", "cell", "side", "bucket", "doc", "tid", "copies", "narrow", "wide", "grams"]
        types = [pa.int64(), pa.binary(), pa.int8(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        out, size = [], 0

        def full():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

        for batch in batches:
            text = as_bytes(batch.column("text"))
            rest = batch.drop_columns(["text"]).to_pylist()
            for piece in chunks(text):
                h, owner = gram_sets(text[piece], n_words)
                stops = np.searchsorted(owner, np.arange(piece.stop - piece.start), "right")
                for row, a, b in zip(rest[piece], [0, *stops[:-1]], stops):
                    packed = h[a:b].tobytes()
                    row["wide"] = [(w["band"], w["n"]) for w in row["wide"]]
                    narrow, wide = np.array(row["narrow"], np.int64).tobytes(), np.array([w for w, _ in row["wide"]], np.int64).tobytes()
                    for cell, side, bucket, alone in cells(row):
                        number = int.from_bytes(cell[:7], "little")
                        out.append((-1 - number if alone else number % parts, cell, side, bucket, row["doc"], row["tid"], row["copies"], narrow, wide, packed))
                        size += len(packed)
                        if size > SENT_BYTES:
                            yield full()
                            out, size = [], 0
        if out:
            yield full()

    return send


def verifier(similarity: float):
    """The task that verifies the candidates of whole cells: pairs of sets that share a
    bucket. A pair that shares several is the business of one cell only: that of its
    blocks if it shares a narrow bucket, else that of its first wide one."""

    def links(cell: list[dict]) -> np.ndarray:
        linked = links_of([np.frombuffer(r["grams"], U64) for r in cell], similarity)
        side = np.array([r["side"] for r in cell])
        if side[0] != 2:  # two blocks: pairs within one are the business of its own cell
            linked &= side[:, None] != side[None, :]
        if not linked.any():
            return linked
        narrow = overlaps([np.frombuffer(r["narrow"], np.int64) for r in cell]) > 0
        bucket = cell[0]["bucket"]
        if bucket is None:
            return linked & narrow
        before = [np.frombuffer(r["wide"], np.int64) for r in cell]
        return linked & ~narrow & ~(overlaps([w[w < bucket] for w in before]) > 0)

    def verify(group: pa.Table) -> pa.Table:
        cells: dict[bytes, dict] = {}
        for row in group.to_pylist():  # a row that stands twice in the input is one set
            cells.setdefault(row["cell"], {})[row["doc"], row["tid"]] = row
        out_doc, out_links, out_hub = [], [], []
        for cell in map(list, map(dict.values, cells.values())):
            if len(cell) < 2:
                continue
            linked = links(cell)
            some = np.flatnonzero(linked.any(axis=1))
            if not len(some):
                continue
            linked = linked[np.ix_(some, some)]
            doc, copies = (np.array([cell[i][c] for i in some], np.int64) for c in ("doc", "copies"))
            order = np.argsort(doc, kind="stable")  # so that the first of a component is its smallest
            linked, doc, copies = linked[np.ix_(order, order)], doc[order], copies[order]
            hub = np.arange(len(doc))
            while True:
                least = [np.where(linked[rows], hub[None, :], len(doc)).min(axis=1) for rows in steps(len(doc))]
                lower = np.minimum(hub, np.concatenate(least))
                lower = lower[lower]
                if (lower == hub).all():
                    break
                hub = lower
            out_doc.append(doc)
            out_links.append(np.concatenate([linked[rows] @ copies for rows in steps(len(doc))]))
            out_hub.append(doc[hub])
        joined = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_doc, out_links, out_hub)]
        return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in joined], names=["doc", "links", "hub"])

    return verify


def candidates(classes: DataFrame, scratch: Scratch, block: int) -> DataFrame:
    """(doc, tid, copies, cluster, slot, pieces, near, narrow, wide) of each class that
    shares a band bucket with another one.

    The smallest document that shares a bucket with a set is its hub; sets with the same
    hub's hub are a *cluster*, and a large cluster is cut into `pieces` blocks by hash.
    Blocks that a bucket joins are `near` each other. Buckets spread over so many blocks that
    their pairs would outnumber their sets many times are *wide*: these are cut into
    blocks of their own. narrow and wide are the set's buckets of the two kinds.
    """
    banded = classes.select(F.col("rep").alias("doc"), "tid", "copies", "n", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("doc").alias("hub"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    shared = scratch.save(banded.join(buckets, "band"))
    mine = shared.groupBy("doc", "tid").agg(F.min("hub").alias("hub"), F.first("copies").alias("copies"), F.first("n").alias("n"))
    over = shared.groupBy(F.col("doc").alias("hub")).agg(F.min("hub").alias("cluster"))
    clustered = scratch.save(mine.join(over, "hub"))
    pieces = F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("n") / BLOCK_GRAMS)).cast("int")
    large = scratch.save(clustered.groupBy("cluster").agg(pieces.alias("pieces")).filter("pieces > 1"))
    placed = clustered.join(small(large), "cluster", "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    placed = scratch.save(placed.withColumn("slot", F.pmod(F.xxhash64("doc", "tid"), F.col("pieces")).cast("int")).drop("hub", "n"))
    spots = shared.join(placed.select("doc", "tid", "cluster", "slot", "pieces"), ["doc", "tid"])
    spots = scratch.save(spots.groupBy("band", "cluster", "slot").agg(F.first("pieces").alias("pieces"), F.first("members").alias("members")))
    spread = scratch.save(spots.groupBy("band").agg(F.count(F.lit(1)).alias("k"), F.first("members").alias("members")).filter("k > 1"))
    narrow = spread.filter(F.col("k") * F.col("k") <= WIDE * F.col("members")).select("band")
    wide = spread.filter(F.col("k") * F.col("k") > WIDE * F.col("members")).select("band", F.col("members").alias("size"))
    ends = spots.join(narrow, "band").select("band", F.struct("cluster", "slot", "pieces").alias("at"))
    near = ends.join(ends.withColumnRenamed("at", "other"), "band").filter("at <> other").select("at", "other").distinct()
    near = near.groupBy("at.cluster", "at.slot").agg(F.collect_list("other").alias("near"))
    marked = shared.select("doc", "tid", "band").join(small(scratch.save(wide)), "band", "left")
    bands = marked.groupBy("doc", "tid").agg(
        F.collect_list(F.when(F.col("size").isNull(), F.col("band"))).alias("narrow"),
        F.collect_list(F.when(F.col("size").isNotNull(), F.struct("band", F.col("size").alias("n")))).alias("wide"),
    )
    return placed.join(bands, ["doc", "tid"]).join(near, ["cluster", "slot"], "left")


def near_copies(docs: DataFrame, n_words: int = N_WORDS, similarity: float = SIMILARITY, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """One row for each input row: doc_id, set_id (smallest doc_id with the same n-gram
    set), class_id (smallest doc_id of the group that links form), n_links (other rows
    with Jaccard similarity of at least `similarity`), n_grams; also the keys doc, tid.

    Words are maximal runs of anything but ASCII white space, unchanged; a text of fewer
    than n_words words is one gram of all its words. A text without words, or null, is
    linked to none and its own class. A null doc_id counts as the smallest one; texts
    under the same doc_id are linked as one document, and repeated rows are copies of
    each other. Very long texts are whole sets like others. No rows give none; other
    columns of docs, whatever their names, play no part.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    bands, rows = bands_and_rows(similarity, recall, MOST_HASHES)
    texts = common.keyed_texts(docs)
    sketch = scratch.save(sketches(texts, n_words, bands, rows))
    first = [F.min("doc").alias("rep"), F.min_by("tid", F.struct("doc", "tid")).alias("tid"), F.count(F.lit(1)).alias("copies")]
    same = [F.first(c).alias(c) for c in ("n", "bands")]  # of equal sets
    classes = scratch.save(sketch.filter("n > 0").groupBy("grams").agg(*first, *same))
    found = texts.join(candidates(classes, scratch, block).hint("shuffle_hash"), ["doc", "tid"])
    sent = found.mapInArrow(senders(n_words, block, common.parts_for(docs)), CELL_SCHEMA)
    linked = scratch.save(sent.groupBy("part").applyInArrow(verifier(similarity), LINK_SCHEMA))
    near = components(linked.select(F.col("doc").alias("a"), F.col("hub").alias("b")), scratch).withColumnRenamed("node", "rep").withColumnRenamed("label", "class")
    counts = linked.groupBy(F.col("doc").alias("rep")).agg(F.sum("links").alias("links"))
    known = classes.select("grams", "rep", "copies").join(near, "rep", "left").join(counts, "rep", "left")
    out = sketch.select("doc", "tid", "grams", "n").join(known, "grams", "left")
    return out.select(
        common.doc_id_of("doc").alias("doc_id"),
        F.nullif(F.coalesce("rep", "doc"), F.lit(common.NO_ID)).alias("set_id"),
        F.nullif(F.coalesce("class", "rep", "doc"), F.lit(common.NO_ID)).alias("class_id"),
        (F.coalesce(F.col("copies") - 1, F.lit(0)) + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
        F.col("n").cast("long").alias("n_grams"),
        "doc",
        "tid",
    )
