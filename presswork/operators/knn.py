"""Exact cosine nearest neighbours.

One query: its 768 numbers are broadcast and each vector's similarity is worked out in
its row. Many anchors: blocks of anchors meet blocks of the corpus in one matrix
product each, and only the best rows of an anchor leave a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import EMBEDDING_DIM
from ..shipping import ship
from .embed import EMBEDDERS, dense, full, sparse
from .storage import stored

#: Anchors of one task (4096 x 768 doubles are 25 MB), corpus rows that are packed into one,
#: with at most so many entries, and how many are compared at a time. A part of the corpus
#: has at least LEAST_PART rows.
ANCHOR_BLOCK, CORPUS_BLOCK, MOST_ENTRIES, CORPUS_STEP, LEAST_PART = 4096, 8192, 1 << 21, 2048, 512
#: More than rounding to nine digits can move a similarity.
MARGIN = 1e-9


def search(query: str, articles: DataFrame, embedded: DataFrame, k: int = 10, backend: str = "hash") -> DataFrame:
    """The k articles most similar to a text: id, title, source, similarity, rank.
    Articles that share nothing with it have similarity 0. `embedded` is (id, dim, w) or
    (id, dims, ws)."""
    spark = articles.sparkSession
    asked = EMBEDDERS[backend](spark.range(1).select(F.col("id"), F.lit(query).alias("text")), "text", "id")
    return _nearest(asked, articles, embedded, k)


def related(anchor: int, articles: DataFrame, embedded: DataFrame, k: int = 10) -> DataFrame:
    """The k articles most similar to one of them, without itself."""
    mine = embedded.filter(F.col("id") == anchor)
    return _nearest(mine, articles.filter(F.col("id") != anchor), embedded.filter(F.col("id") != anchor), k)


def _nearest(query: DataFrame, articles: DataFrame, embedded: DataFrame, k: int) -> DataFrame:
    pairs = F.sort_array(F.collect_list(F.struct("dim", "w")))
    asked = sparse(query).agg(pairs.alias("p")).select(full(F.col("p.dim"), F.col("p.w")).alias("q"), F.lit(1).alias("one"))  # one row of 768 numbers
    products = F.zip_with("dims", "ws", lambda d, w: w * F.get("q", d))
    scores = dense(embedded).withColumn("one", F.lit(1)).join(F.broadcast(asked), "one").select("id", F.round(F.aggregate(products, F.lit(0.0), lambda s, x: s + x), 9).alias("s"))
    facts = articles.select("id", "title", "source")
    spark = articles.sparkSession
    best = scores.filter("s > 0").orderBy(F.desc("s"), "id").limit(k).collect()  # bounded: k rows
    if best and len(best) == k and facts.join(F.broadcast(spark.createDataFrame(best, scores.schema)), "id", "left_semi").count() == k:
        top = facts.join(F.broadcast(spark.createDataFrame(best, scores.schema)), "id")
    else:  # articles of similarity 0 are needed too, or vectors have no article
        top = facts.join(scores, "id", "left").withColumn("s", F.coalesce("s", F.lit(0.0))).orderBy(F.desc("s"), "id").limit(k)
    rank = F.row_number().over(Window.orderBy(F.desc("s"), "id"))  # over k rows
    return top.select("id", "title", "source", F.round("s", 4).alias("similarity"), rank.cast("bigint").alias("rank"))


def batch(anchors: DataFrame, corpus: DataFrame, k: int, key: str = "id", but_self: bool = True) -> DataFrame:
    """(anchor, id, sim, rn): each anchor's k nearest rows of the corpus (but_self: not the
    one with its own id); by similarity to nine digits, then id. Both sides are (id, dims,
    ws) rows; a column `k` of the anchors says how many each wants, instead of k.

    A task holds one block of anchors and their best rows so far, while a part of the corpus
    passes by: packed into rows of many vectors, it is exchanged once, and each task of its
    part reads it from there. The corpus has as many parts as give all cores work, so with
    enough anchors an anchor's rows come from one task.
    """
    spark = corpus.sparkSession
    ship(spark)
    wanted = F.col("k") if "k" in anchors.columns else F.lit(k)
    mine = stored(anchors.select(F.col(key).cast("bigint").alias("id"), "dims", "ws", wanted.cast("int").alias("k")))
    theirs = corpus.select(F.col(key).cast("bigint").alias("id"), "dims", "ws")
    rows, size = -(-max(1, mine.count()) // ANCHOR_BLOCK), theirs.count()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    columns = max(1, min(-(-tasks // rows), -(-size // LEAST_PART)))
    block = min(CORPUS_BLOCK, max(1, -(-size // (2 * columns))))
    held = mine.groupBy(F.pmod(F.xxhash64("id"), F.lit(rows)).cast("int").alias("a")).applyInArrow(_pack_anchors, ANCHORS)
    passing = theirs.mapInArrow(_packing(block, columns), CORPUS).repartitionById(columns, F.col("c"))
    met = passing.hint("shuffle_replicate_nl").crossJoin(held.repartitionById(rows, F.col("a")))
    found = met.mapInArrow(_comparing(but_self), f"{FOUND}, k int")
    order = Window.partitionBy("anchor").orderBy(F.desc("sim"), "id")
    return found.withColumn("rn", F.row_number().over(order)).filter("rn <= k").drop("k")


ANCHORS = "a int, ids binary, ks binary, left binary, right binary, width int"
CORPUS = "c int, mine binary, counts binary, dims binary, ws binary"


def _pack_anchors(key: tuple, table: pa.Table) -> pa.Table:
    """One row of a block of anchors: ids, how many they want, and their matrix, as a product
    of two where that is less work."""
    width = (pc.max(pc.list_flatten(table.column("dims"))).as_py() or 0) + 1
    left, right = _factors(_matrix(table, width))
    packed = [table.column(c).to_numpy().astype(t).tobytes() for c, t in (("id", np.int64), ("k", np.int32))]
    row = [key[0].as_py(), *packed, left.tobytes(), right.tobytes(), width]
    return pa.table({c: pa.array([v], t) for (c, t), v in zip([("a", pa.int32()), *[(c, pa.binary()) for c in ("ids", "ks", "left", "right")], ("width", pa.int32())], row)})


def _factors(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(left, right) with matrix = left @ right, if all rows lie in a space of few dimensions,
    as users' vectors do that are sums of few articles; else (matrix, nothing). What is left
    out has singular values below 1e-12, far less than the nine digits need."""
    n, width = matrix.shape
    if min(n, width) > 64 and np.isfinite(matrix).all():
        u, s, v = np.linalg.svd(matrix, full_matrices=False)
        r = max(1, int((s > 1e-12).sum()))
        if r * (n + width) < 0.7 * n * width:
            return np.ascontiguousarray(u[:, :r] * s[:r]), np.ascontiguousarray(v[:r])
    return matrix, np.zeros((0, width))


def _packing(block: int, columns: int):
    """A function of batches of vectors that makes rows of `block` of them, of fewer if they
    have many entries, dealt in turn to the parts of the corpus."""

    def rows(table, turn):
        dims, ws = (table.column(c).combine_chunks() for c in ("dims", "ws"))
        counts = dims.value_lengths().to_numpy(zero_copy_only=False).astype(np.int32)
        if counts.sum() > MOST_ENTRIES and len(table) > 1:
            yield from rows(table.slice(0, len(table) // 2), turn)
            yield from rows(table.slice(len(table) // 2), turn)
            return
        data = [table.column("id").to_numpy().astype(np.int64), counts, dims.flatten().to_numpy().astype(np.int32), ws.flatten().to_numpy().astype(np.float64)]
        turn[0] += 1
        yield pa.RecordBatch.from_arrays([pa.array([turn[0] % columns], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in data]], ["c", "mine", "counts", "dims", "ws"])

    def run(batches):
        turn, held = [TaskContext.get().partitionId()], None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            held = part if held is None else pa.concat_tables([held, part])
            while len(held) >= block:
                yield from rows(held.slice(0, block), turn)
                held = held.slice(block)
        if held is not None and len(held):
            yield from rows(held, turn)

    return run


def _comparing(but_self: bool):
    def run(batches):
        blocks: dict[int, _Nearest] = {}
        for batch in batches:
            for i in range(len(batch)):
                value = lambda c, t: np.frombuffer(batch.column(c)[i].as_buffer(), t)  # noqa: B023, E731
                a = batch.column("a")[i].as_py()
                if a not in blocks:
                    blocks[a] = _Nearest(*[value(c, t).copy() for c, t in (("ids", np.int64), ("ks", np.int32), ("left", float), ("right", float))], batch.column("width")[i].as_py(), but_self)
                blocks[a].meet(*[value(c, t) for c, t in (("mine", np.int64), ("counts", np.int32), ("dims", np.int32), ("ws", float))])
        for nearest in blocks.values():
            yield from nearest.rows()

    return run


class _Nearest:
    """The best rows so far of a block of anchors."""

    def __init__(self, ids: np.ndarray, most: np.ndarray, left: np.ndarray, right: np.ndarray, width: int, but_self: bool):
        self.ids, self.most, self.width, self.but_self = ids, most, width, but_self
        self.left, self.right = left.reshape(len(ids), -1), right.reshape(-1, width)
        self.order = np.argsort(ids, kind="stable")
        self.floor, self.best = np.full(len(ids), -np.inf), (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        self.new, self.n_new, self.seen = [], 0, False
        self.room = np.empty((len(ids), CORPUS_STEP))

    def meet(self, mine: np.ndarray, counts: np.ndarray, dims: np.ndarray, ws: np.ndarray) -> None:
        ends = np.concatenate([[0], np.cumsum(counts)])
        for at in range(0, len(mine), CORPUS_STEP):
            upto = min(len(mine), at + CORPUS_STEP)
            entries = slice(ends[at], ends[upto])
            row, d, w = np.repeat(np.arange(upto - at), counts[at:upto]), dims[entries], ws[entries]
            if len(d) and d.max() >= self.width:  # dimensions that no anchor has
                row, d, w = (x[dims[entries] < self.width] for x in (row, d, w))
            part = np.zeros((upto - at, self.width))
            part[row, d] = w
            other = self.right @ part.T if len(self.right) else part.T
            sims = np.matmul(self.left, other, out=self.room) if upto - at == CORPUS_STEP else self.left @ other
            self._take(sims, mine[at:upto])

    def _take(self, sims: np.ndarray, mine: np.ndarray) -> None:
        if self.but_self:
            low, high = (np.searchsorted(self.ids, mine, side, self.order) for side in ("left", "right"))
            times = high - low
            place = np.repeat(low - np.cumsum(times) + times, times) + np.arange(times.sum())
            sims[self.order[place], np.repeat(np.arange(len(mine)), times)] = -np.inf
        if not self.seen:  # the first rows give each anchor a bound
            enough = self.most <= len(mine)
            if enough.any():
                kth = np.sort(sims[enough], axis=1)
                self.floor[enough] = kth[np.arange(len(kth)), np.clip(len(mine) - self.most[enough], 0, len(mine) - 1)] - MARGIN
            self.seen = True
        a, j = np.divmod(np.flatnonzero(sims >= self.floor[:, None]), len(mine))
        value = sims[a, j]
        a, j, value = (x[value > -np.inf] for x in (a, j, value))
        self.new.append((a, mine[j], np.round(value, 9)))
        self.n_new += len(a)
        if self.n_new > max(len(self.best[0]), 1 << 16):
            self._settle()

    def _settle(self) -> None:
        self.best = _first(*[np.concatenate(x) for x in zip(self.best, *self.new)], self.most)
        self.new, self.n_new = [], 0
        count = np.bincount(self.best[0], minlength=len(self.ids))
        full_ = (count >= self.most) & (count > 0)
        self.floor[full_] = self.best[2][np.cumsum(count)[full_] - 1] - MARGIN

    def rows(self):
        self._settle()
        a, ids, sims = self.best
        for at in range(0, len(a), 1 << 16):
            part = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(self.ids[a[part]], pa.int64()), pa.array(ids[part], pa.int64()), pa.array(sims[part], pa.float64()), pa.array(self.most[a[part]], pa.int32())], ["anchor", "id", "sim", "k"])


#: What a meeting of blocks finds.
FOUND = "anchor bigint, id bigint, sim double"


def meeting(but_self: bool, size: int = EMBEDDING_DIM):
    """A function of a block of anchors (id, dims, ws, k) and one of the corpus (id, dims, ws)
    that returns each anchor's best k rows of the block."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, matrix, most = left.column("id").to_numpy(), _matrix(left, size), left.column("k").to_numpy()
        found = [_best(ids, matrix, most, right.slice(at, CORPUS_STEP), but_self) for at in range(0, len(right), CORPUS_STEP)] if len(left) else []
        parts = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        a, i, sim = _first(*parts, most)
        return pa.table({"anchor": pa.array(ids[a] if len(a) else a, pa.int64()), "id": pa.array(i, pa.int64()), "sim": pa.array(sim, pa.float64())})

    return run


def _matrix(vectors: pa.Table, size: int = EMBEDDING_DIM) -> np.ndarray:
    out = np.zeros((len(vectors), size))
    dims, ws = (vectors.column(c).combine_chunks() for c in ("dims", "ws"))
    counts = dims.value_lengths().to_numpy(zero_copy_only=False)
    out[np.repeat(np.arange(len(out)), counts), dims.flatten().to_numpy()] = ws.flatten().to_numpy()
    return out


def _best(ids: np.ndarray, matrix: np.ndarray, most: np.ndarray, part: pa.Table, but_self: bool):
    """(place of the anchor, id, similarity) of at least each anchor's best `most` rows of part."""
    mine = part.column("id").to_numpy()
    sims = np.round(matrix @ _matrix(part, matrix.shape[1]).T, 9)
    if but_self:
        sims[ids[:, None] == mine[None, :]] = -np.inf
    k = min(int(most.max()), len(mine))
    least = np.partition(sims, len(mine) - k, axis=1)[:, len(mine) - k] if k else np.full(len(ids), np.inf)
    a, j = np.nonzero((sims >= least[:, None]) & (sims > -np.inf))  # equals of the last one too
    return _first(a, mine[j], sims[a, j], most)


def _first(a: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: np.ndarray):
    order = np.lexsort((ids, -sims, a))
    a, ids, sims = a[order], ids[order], sims[order]
    starts = np.searchsorted(a, np.arange(len(most)))
    keep = np.arange(len(a)) - starts[a] < most[a] if len(a) else np.zeros(0, bool)
    return a[keep], ids[keep], sims[keep]


def unit_vectors(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """(id, dims, ws) of dense arrays, made in the row; null vectors, and those of no length
    or with a component that is null or not finite, are left out."""
    x = F.transform(column, lambda v: v.cast("double"))
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))
    rows = vectors.select(F.col(key).cast("bigint").alias("id"), x.alias("x"), norm.alias("n")).filter("n > 0 and n < double('infinity')")
    return rows.select("id", F.transform("x", lambda v, i: i).alias("dims"), F.transform("x", lambda v: v / F.col("n")).alias("ws"))


def to_sparse(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """(key, dim, w) unit vectors from dense arrays; vectors of no length have no entries."""
    norm = F.sqrt(F.aggregate(F.col(column), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    entries = vectors.select(key, norm.alias("n"), F.posexplode(column).alias("dim", "x"))
    return entries.filter("n > 0").select(key, "dim", (F.col("x").cast("double") / F.col("n")).alias("w"))

