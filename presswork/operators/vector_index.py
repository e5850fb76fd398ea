"""An inverted-file index of unit vectors, stored as tables.

Cells are the k-means centroids of a sample; every vector is filed under its nearest
centroid with its distance from it. A search looks into the cells next to each anchor.
The same files answer exactly too: no vector of a cell is nearer to an anchor than the
anchor's distance from the centroid less the cell's radius, so once an anchor has k
neighbours, most cells can't hold a better one and are left out.

    path/centroids              (cell, v): at most MOST_CELLS rows
    path/filed/batch=N/cell=M   (id, dims, ws, away)

Vectors are added without another fit, batch by batch; a batch that is added again
replaces its own files.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import EMBEDDING_DIM
from ..shipping import ship
from . import knn
from .embed import full
from .storage import stored

#: Centroids that every task holds: 4096 of 768 doubles are 25 MB.
MOST_CELLS = 4096
#: Vectors that the centroids are fitted to, the first by a hash of their ids.
SAMPLE = 1 << 16
#: Rows of one cell that meet a block of anchors in one task.
CELL_BLOCK = 1 << 15
#: Slack of distances for rounding: similarities have nine digits.
SLACK = 1e-6


class VectorIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        rows = spark.read.schema("cell int, v array<double>").parquet(f"{path}/centroids").orderBy("cell").collect()  # at most MOST_CELLS
        self.centroids = np.array([r.v for r in rows])
        ship(spark)

    @classmethod
    def build(cls, vectors: DataFrame, path: str, cells: int | None = None, sample: int = SAMPLE, rounds: int = 10, seed: int = 1, size: int = EMBEDDING_DIM) -> VectorIndex:
        """An index of (id, dims, ws) rows, vectors of length 1 with `size` components.
        cells: by default the square root of their number, at most MOST_CELLS."""
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        spark = vectors.sparkSession
        count = vectors.count()
        cells = min(cells or math.isqrt(max(1, count)), MOST_CELLS)
        drawn = vectors.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample)
        points = stored(drawn.select(array_to_vector(full(F.col("dims"), F.col("ws"), size)).alias("v")))
        if count:
            # by rows: by blocks it fails where there are fewer distinct points than cells
            centers = KMeans(featuresCol="v", k=max(2, cells), maxIter=rounds, seed=seed, solver="row").fit(points).clusterCenters()
        else:
            centers = [np.zeros(size)]
        spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "cell int, v array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
        index = cls(spark, path)
        index.add(vectors, 0)
        return index

    def add(self, vectors: DataFrame, batch: int) -> None:
        """Files (id, dims, ws) rows. All rows of a cell go to as many files as blocks."""
        cells = self.centroids

        def run(batches):
            for part in batches:
                cell, away = nearest_cells(knn._matrix(pa.table(part), cells.shape[1]), cells, 1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell[:, 0], pa.int32()), pa.array(away[:, 0])], ["id", "dims", "ws", "cell", "away"])

        rows = vectors.select(F.col("id").cast("bigint").alias("id"), F.col("dims").cast("array<int>").alias("dims"), F.col("ws").cast("array<double>").alias("ws"))
        filed = stored(rows.mapInArrow(run, f"{FILED}, cell int, away double"))
        blocks = self._blocks({r.cell: r.n for r in filed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}, CELL_BLOCK)
        placed = filed.withColumn("batch", F.lit(batch)).repartition("cell", F.pmod(F.xxhash64("id"), F.get(blocks, "cell")))
        placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "cell").parquet(f"{self.path}/filed")

    def _blocks(self, counts: dict[int, int], size: int) -> Column:
        """Of each cell the number of blocks of that many rows, as a literal array."""
        return F.array(*[F.lit(max(1, -(-counts.get(c, 0) // size))) for c in range(len(self.centroids))])

    def filed(self) -> DataFrame:
        return self.spark.read.schema(f"{FILED}, away double, batch int, cell int").parquet(f"{self.path}/filed")

    def cells(self) -> DataFrame:
        """(cell, n, radius) of the cells that have vectors."""
        return self.filed().groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius"))

    def search(self, anchors: DataFrame, k: int, probes: int = 8, but_self: bool = True) -> DataFrame:
        """(anchor, id, sim, rn): of the vectors in each anchor's `probes` nearest cells the k
        nearest (but_self: not the one with the anchor's id), by similarity to nine digits,
        then id. anchors: (id, dims, ws)."""
        sizes = {r.cell: r.n for r in self.cells().collect()}  # one a cell
        asked = stored(self._probed(anchors, k, lambda far, reach: near_mask(far, probes, list(sizes))))
        return ranked(self._met(asked, sizes, but_self), k)

    def exact(self, anchors: DataFrame, k: int, probes: int = 2, but_self: bool = True) -> tuple[DataFrame, float]:
        """search() over all cells that can matter: the same rows as knn.batch, and the share
        of all pairs of an anchor and a vector that were compared.

        The nearest cells give each anchor a bound on the distance of its k-th neighbour;
        a cell is looked into if its centroid's distance less its radius is within it."""
        cells = {r.cell: (r.n, r.radius) for r in self.cells().collect()}
        sizes = {c: n for c, (n, _) in cells.items()}
        radius = np.array([cells[c][1] if c in cells else -np.inf for c in range(len(self.centroids))])
        anchors = stored(anchors.select("id", "dims", "ws"))
        first = stored(self._probed(anchors, k, lambda far, reach: near_mask(far, probes, list(sizes))))
        found = stored(ranked(self._met(first, sizes, but_self), k))
        worst = found.groupBy(F.col("anchor").alias("id")).agg(F.min("sim").alias("s"), F.count(F.lit(1)).alias("n"))
        bound = F.when(F.col("n") == k, F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("s"))) + SLACK).otherwise(F.lit(float("inf")))
        bounded = anchors.join(worst, "id", "left").select("id", "dims", "ws", F.coalesce(bound, F.lit(float("inf"))).alias("reach"))

        def rest(far: np.ndarray, reach: np.ndarray) -> np.ndarray:
            open_ = far - radius[None, :] <= reach[:, None] + SLACK
            return open_ & np.isfinite(radius)[None, :] & ~near_mask(far, probes, list(sizes))

        second = stored(self._probed(bounded, k, rest))
        more = self._met(second, sizes, but_self)
        pairs = sum(sizes[r.cell] * r.n for asked in (first, second) for r in asked.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect())
        share = pairs / max(1, anchors.count() * sum(sizes.values()))
        return ranked(found.drop("rn").unionByName(more), k), share

    def probes_for(self, anchors: DataFrame, k: int, target: float = 0.95, but_self: bool = True) -> tuple[int, float]:
        """The fewest probes that find the share `target` of the anchors' k true neighbours,
        and the share that they find: of each true neighbour the place of its cell in the
        order of the anchor's nearest cells is counted."""
        truth, _ = self.exact(anchors, k, but_self=but_self)
        homes = truth.select("anchor", "id").join(self.filed().select("id", F.col("cell").alias("home")), "id")
        rows = anchors.select(F.col("id").cast("bigint").alias("anchor"), "dims", "ws").join(homes.groupBy("anchor").agg(F.collect_list("home").alias("homes")), "anchor")  # k each
        cells, used = self.centroids, [r.cell for r in self.cells().select("cell").collect()]

        def run(batches):
            for part in batches:
                far = distances(knn._matrix(pa.table(part), cells.shape[1]), cells)
                homes = part.column("homes")
                row = np.repeat(np.arange(len(part)), homes.value_lengths().to_numpy())
                home = homes.flatten().to_numpy()
                order = np.sort(far[:, sorted(used)], axis=1)
                place = np.array([np.searchsorted(order[r], far[r, h], side="right") for r, h in zip(row, home)], np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(place, pa.int32())], ["probes"])

        counts = {r.probes: r.n for r in rows.mapInArrow(run, "probes int").groupBy("probes").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most one a cell
        total, found = sum(counts.values()), 0
        for probes in sorted(counts):
            found += counts[probes]
            if found >= target * total:
                return probes, found / total
        return 1, 1.0

    def _probed(self, anchors: DataFrame, k: int, choose: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
        """(id, dims, ws, k, cell): each anchor once for every cell that choose() marks."""
        cells = self.centroids
        reach = F.col("reach") if "reach" in anchors.columns else F.lit(float("inf"))
        rows = anchors.select(F.col("id").cast("bigint").alias("id"), "dims", "ws", reach.alias("reach"))

        def run(batches):
            for part in batches:
                for at in range(0, len(part), knn.CORPUS_STEP):
                    rows = part.slice(at, knn.CORPUS_STEP)
                    far = distances(knn._matrix(pa.table(rows), cells.shape[1]), cells)
                    row, cell = np.nonzero(choose(far, rows.column("reach").to_numpy()))
                    taken = rows.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([*taken.columns[:3], pa.array(np.full(len(row), k), pa.int32()), pa.array(cell, pa.int32())], ["id", "dims", "ws", "k", "cell"])

        return rows.mapInArrow(run, f"{FILED}, k int, cell int")

    def _met(self, asked: DataFrame, sizes: dict[int, int], but_self: bool) -> DataFrame:
        """Blocks of a cell's anchors meet blocks of its vectors; only probed cells are read."""
        anchors = {r.cell: r.n for r in asked.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # one a cell
        slots, parts = self._blocks(sizes, CELL_BLOCK), self._blocks(anchors, knn.ANCHOR_BLOCK)
        mine = lambda blocks: F.pmod(F.xxhash64("id"), F.get(blocks, "cell")).cast("int")
        every = lambda blocks: F.explode(F.sequence(F.lit(0), F.get(blocks, "cell") - 1))
        left = asked.select("*", mine(parts).alias("part")).select("*", every(slots).alias("slot"))
        right = self.filed().filter(F.col("cell").isin(list(anchors))).select("id", "dims", "ws", "cell", mine(slots).alias("slot"))
        right = right.select("*", every(parts).alias("part"))
        pair = ["cell", "slot", "part"]
        return left.groupBy(*pair).cogroup(right.groupBy(*pair)).applyInArrow(knn.meeting(but_self, self.centroids.shape[1]), knn.FOUND)


FILED = "id bigint, dims array<int>, ws array<double>"


def distances(vectors: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Euclidean, off by far less than SLACK for vectors of length 1."""
    squares = (vectors**2).sum(axis=1)[:, None] + (cells**2).sum(axis=1)[None, :] - 2 * vectors @ cells.T
    return np.sqrt(np.maximum(squares, 0))


def nearest_cells(vectors: np.ndarray, cells: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, distances) of each vector's n nearest cells."""
    far = distances(vectors, cells)
    order = np.argsort(far, axis=1, kind="stable")[:, :n]
    return order, np.take_along_axis(far, order, axis=1)


def near_mask(far: np.ndarray, probes: int, used: list[int]) -> np.ndarray:
    """The `probes` nearest of the cells that have vectors."""
    out = np.zeros(far.shape, bool)
    if used:
        cells = np.array(sorted(used))
        order = np.argsort(far[:, cells], axis=1, kind="stable")[:, :probes]
        np.put_along_axis(out, cells[order], True, axis=1)
    return out


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor").orderBy(F.desc("sim"), "id")
    return found.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= k)


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(anchor, n_true, n_found): how many of the true neighbours a search has. Both sides:
    (anchor, id)."""
    hits = truth.select("anchor", "id").join(found.select("anchor", "id", F.lit(1).alias("hit")), ["anchor", "id"], "left")
    return hits.groupBy("anchor").agg(F.count(F.lit(1)).alias("n_true"), F.count("hit").alias("n_found"))
