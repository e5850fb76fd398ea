"""Centroid clustering of integer vectors, exact at the speed of 32-bit matrix products.

A product of 32-bit floats tells each centroid's distance up to a rounding error with a
proven bound, so each distance lies in an interval. A vector whose best interval lies below
all others is settled; for the rest the centroids with overlapping intervals are compared
again in whole numbers, and of equal ones the smallest number wins. Sums of a cluster are
whole numbers too, so no result depends on how the rows are dealt.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

#: Components up to this take part in the screening: floats hold them, and so do 64 bits the
#: squared distances of STEP vectors with up to 64 components, or 2**12 without their sum.
SCREENED = 1 << 20
#: Whole numbers are summed across tasks in digits to this base.
LIMB_BITS = 60
LONGEST = (1 << 63) - 1
#: Rows whose distances are worked out at a time.
STEP = 8192


def floors(x: float, scale: int) -> int:
    """floor(scale * x), exact also where the product of floats isn't."""
    top, below = x.as_integer_ratio()
    return scale * top // below


class Vectors:
    """The kept vectors of a batch: `kept` (rows of the batch); of those, `small` have the
    whole components `ints`, and `large`, with one beyond SCREENED, `huge`."""

    def __init__(self, column: pa.Array, size: int, scale: int):
        lengths = column.value_lengths().to_numpy(zero_copy_only=False)
        self.kept = np.flatnonzero(lengths == size)  # null lists have no length
        flat = column.take(pa.array(self.kept)).flatten()
        empty = flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, size)
        values = flat.cast(pa.float64()).fill_null(0.0).to_numpy().reshape(-1, size)
        fine = (np.isfinite(values) & ~empty).all(axis=1)
        self.kept, values = self.kept[fine], values[fine]
        exact = scale & (scale - 1) == 0  # floats times a power of two are
        small = exact & (np.abs(values) < SCREENED / scale).all(axis=1)
        self.small, self.large = np.flatnonzero(small), np.flatnonzero(~small)
        self.ints = np.floor(values[self.small] * scale).astype(np.int64)
        self.huge = [[floors(x, scale) for x in row] for row in values[self.large].tolist()]


def screened(ints: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) bounds of |c|^2 - 2 v.c for every vector and centroid.

    The components are exact as 32-bit floats. A product of n terms, summed in any order,
    with or without fused steps, is off by at most g |v| |c| with g = nu / (1 - nu),
    u = 2^-24. What stands before and after it is exact in 64-bit floats, and the bound
    is rounded up.
    """
    n = ints.shape[1]
    u = 2.0**-24
    products = (ints.astype(np.float32) @ centroids.T.astype(np.float32)).astype(np.float64)
    lengths = [np.sqrt((x.astype(np.float64) ** 2).sum(axis=1)) for x in (ints, centroids)]
    away = 2 * (n * u / (1 - n * u)) * np.outer(*lengths) * (1 + 1e-9)
    middle = (centroids**2).sum(axis=1).astype(np.float64) - 2 * products
    return middle - away, middle + away


def nearest(ints: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(number of the nearest centroid, squared distance) of every vector, both exact, and
    how many vectors needed whole numbers to tell."""
    lower, upper = screened(ints, centroids)
    near = lower <= upper.min(axis=1, keepdims=True)
    best = near.argmax(axis=1)
    open_ = np.flatnonzero(near.sum(axis=1) > 1)
    rows, numbers = np.nonzero(near[open_])
    exact = ((ints[open_[rows]] - centroids[numbers]) ** 2).sum(axis=1)
    order = np.lexsort((numbers, exact, rows))
    _, first = np.unique(rows[order], return_index=True)
    best[open_] = numbers[order[first]]
    return best, ((ints - centroids[best]) ** 2).sum(axis=1), len(open_)


def nearest_by_definition(row: list[int], centroids: list[list[int]]) -> tuple[int, int]:
    distance, number = min((sum((a - b) ** 2 for a, b in zip(row, c)), i) for i, c in enumerate(centroids))
    return number, distance


class Assignment:
    """Each kept vector of a batch with its cluster and squared distance; `beyond` has the
    distances that were worked out in Python's integers."""

    def __init__(self, vectors: Vectors, centroids: list[list[int]]):
        self.vectors = vectors
        self.cluster, self.distance = np.zeros(len(vectors.kept), np.int64), np.zeros(len(vectors.kept), np.int64)
        self.beyond: dict[int, int] = {}
        self.compared = 0
        by_hand = list(zip(vectors.large.tolist(), vectors.huge))
        if all(-SCREENED <= x <= SCREENED for c in centroids for x in c):
            table = np.array(centroids, np.int64)
            for at in range(0, len(vectors.small), STEP):
                rows = vectors.small[at : at + STEP]
                self.cluster[rows], self.distance[rows], more = nearest(vectors.ints[at : at + STEP], table)
                self.compared += more
        else:
            by_hand += zip(vectors.small.tolist(), vectors.ints.tolist())
        for i, row in by_hand:
            self.cluster[i], self.beyond[i] = nearest_by_definition(row, centroids)

    def add(self, count: np.ndarray, sums: np.ndarray, inertia: np.ndarray) -> None:
        """Adds the batch's rows to the clusters' figures (arrays of Python's integers)."""
        count += np.bincount(self.cluster, minlength=len(count)).astype(object)
        for at in range(0, len(self.vectors.small), STEP):
            rows = self.vectors.small[at : at + STEP]
            part, far = np.zeros(sums.shape, np.int64), np.zeros(len(count), np.int64)
            np.add.at(part, self.cluster[rows], self.vectors.ints[at : at + STEP])
            np.add.at(far, self.cluster[rows], self.distance[rows])
            sums += part.astype(object)
            inertia += far.astype(object)
        for i, row in zip(self.vectors.large.tolist(), self.vectors.huge):
            sums[self.cluster[i]] += np.array(row, object)
        for i, d in self.beyond.items():
            inertia[self.cluster[i]] += d

    def distances(self) -> pa.Array:
        """As longs; null beyond them."""
        if not self.beyond:
            return pa.array(self.distance, pa.int64())
        return pa.array([d if (d := self.beyond.get(i, int(x))) <= LONGEST else None for i, x in enumerate(self.distance)], pa.int64())


def seeds(vectors: DataFrame, k: int, seed: int, size: int, scale: int, key: str = "vec_id", column: str = "embedding") -> list[list[int]]:
    """The k kept vectors with the smallest SHA-256 of `seed:key`, in that order; of rows
    with one key the smaller vector comes first. A null key is an empty string."""
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.col(key).cast("string").alias("name"), F.col(column).cast("array<double>").alias("x"))

    def run(batches):
        for batch in batches:
            yield batch.take(pa.array(Vectors(batch.column("x"), size, scale).kept))

    kept = rows.mapInArrow(run, rows.schema)
    hashed = kept.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce("name", F.lit(""))), 256).alias("h"), "x")
    return [[floors(x, scale) for x in row.x] for row in hashed.orderBy("h", "x").limit(k).collect()]  # k rows


def totals(vectors: DataFrame, centroids: list[list[int]], scale: int, column: str = "embedding") -> tuple[list[int], list[list[int]], list[int], int]:
    """(count, sums, inertia) of each cluster, and how many vectors were compared in whole
    numbers. A task sends one number for each of the clusters' figures, in digits, and as
    many come to the driver however many vectors there are."""
    k, size = len(centroids), len(centroids[0])

    def run(batches):
        count, inertia, sums, compared = np.zeros(k, object), np.zeros(k, object), np.zeros((k, size), object), 0
        for batch in batches:
            found = Assignment(Vectors(batch.column(0), size, scale), centroids)
            found.add(count, sums, inertia)
            compared += found.compared
        figures = [*count, *inertia, *sums.reshape(-1), compared]
        digits = [(i, limb, x) for i, n in enumerate(figures) for limb, x in enumerate(limbs(int(n)))]
        if digits:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*digits), (pa.int32(), pa.int32(), pa.int64()))], ["figure", "limb", "x"])

    parts = vectors.select(F.col(column).cast("array<double>").alias("x")).mapInArrow(run, "figure int, limb int, x bigint")
    added = parts.groupBy("figure", "limb").agg(F.sum(F.col("x").cast("decimal(19,0)")).alias("x")).collect()  # figures by digits
    figures = [0] * (2 * k + k * size + 1)
    for row in added:
        figures[row.figure] += int(row.x) << (LIMB_BITS * row.limb)
    sums = figures[2 * k : -1]
    return figures[:k], [sums[i * size : (i + 1) * size] for i in range(k)], figures[k : 2 * k], figures[-1]


def limbs(n: int) -> list[int]:
    """n to the base 2^LIMB_BITS, lowest digit first; the highest has the sign. 0 has none."""
    out = []
    while n:
        if -(1 << LIMB_BITS) < n < 1 << LIMB_BITS:
            return [*out, n]
        out.append(n & ((1 << LIMB_BITS) - 1))
        n >>= LIMB_BITS
    return out


def moved(centroids: list[list[int]], count: list[int], sums: list[list[int]]) -> list[list[int]]:
    return [[x // n for x in s] if n else c for c, n, s in zip(centroids, count, sums)]


def digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, size: int = 64, scale: int = 256, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept
    vector: those with exactly `size` components, none of them null, NaN or infinite, each
    taken as floor(scale * x).

    k centroids start as seeds(); each round assigns all vectors and moves the centroids to
    the floored means (empty ones stay), and the vectors are assigned once more. With fewer
    kept vectors there are fewer centroids, and without any no rows. Repeated rows count
    each; a null key stays null; other columns don't matter. A squared distance or a sum
    beyond 64 bits is null, the clusters are exact nevertheless. Nothing is shuffled but
    one row a figure and task; every pass is a scan, which lost executors repeat in part.
    """
    spark = vectors.sparkSession
    ship(spark)
    schema = f"{key} bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    centroids = seeds(vectors, k, seed, size, scale, key, column)
    if not centroids:
        return spark.createDataFrame([], schema)
    for _ in range(rounds):
        count, sums, _, _ = totals(vectors, centroids, scale, column)
        centroids = moved(centroids, count, sums)
    _, _, inertia, _ = totals(vectors, centroids, scale, column)
    whole = sum(inertia)
    by_cluster = [n if n <= LONGEST else None for n in inertia]
    whole = whole if whole <= LONGEST else None
    names = [digest(c) for c in centroids]

    def run(batches):
        for batch in batches:
            vectors = Vectors(batch.column("x"), size, scale)
            found = Assignment(vectors, centroids)
            number = pa.array(found.cluster, pa.int32())
            take = lambda values, kind: pa.array(values, kind).take(number)
            columns = [batch.column("key").take(pa.array(vectors.kept)), number, found.distances(), take(by_cluster, pa.int64()), pa.array([whole] * len(number), pa.int64()), take(names, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    rows = vectors.select(F.col(key).cast("bigint").alias("key"), F.col(column).cast("array<double>").alias("x"))
    return rows.mapInArrow(run, schema)
