"""Rows that need the vectors of many articles each (a user's candidates, a user's history),
worked on in blocks: a block gets each vector once, however many of its rows need it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .embed import dense
from .storage import small, stored

#: Articles that the rows of a block need, about; a block has at most as many vectors, and
#: mostly far fewer, as its rows share them. A small job has blocks of fewer.
NEEDED, LEAST_NEEDED = 1 << 16, 1 << 12
#: A user's pairs are one row up to so many, about, and several rows beyond.
PAIR_BLOCK = 1024


class Vectors:
    """The vectors (id, dims, ws) of a block."""

    def __init__(self, table: pa.Table):
        ids = table.column("id").to_numpy()
        dims, ws = (table.column(c).combine_chunks() for c in ("dims", "ws"))
        counts = dims.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.argsort(ids, kind="stable")
        self.order = order  # the table's rows by id, as all places are
        self.ids, self.starts, self.counts = ids[order], (np.cumsum(counts) - counts)[order], counts[order]
        self.dims, self.ws = dims.flatten().to_numpy(), ws.flatten().to_numpy()
        self.width = int(self.dims.max()) + 1 if len(self.dims) else 1

    def places(self, ids: np.ndarray) -> np.ndarray:
        """Where the vectors of these articles are; -1 for those without one."""
        if not len(self.ids):
            return np.full(len(ids), -1)
        at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        return np.where(self.ids[at] == ids, at, -1)

    def entries(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, dimension, value) of the vectors at these places."""
        counts = self.counts[places]
        row = np.repeat(np.arange(len(places)), counts)
        at = np.repeat(self.starts[places] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        return row, self.dims[at], self.ws[at]

    def matrix(self, places: np.ndarray) -> np.ndarray:
        row, d, w = self.entries(places)
        out = np.zeros((len(places), self.width))
        out[row, d] = w
        return out


def lists(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """(all elements, where each row's begin and end) of a column of lists; null is empty."""
    rows = column.combine_chunks()
    counts = np.nan_to_num(rows.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    return rows.flatten(), np.concatenate([[0], np.cumsum(counts)])


def gathered(pairs: DataFrame, name: str) -> DataFrame:
    """(user_id, name): the pairs (user_id, id, ...) of each user as an array; users with many
    of them have several rows, dealt by a hash."""
    many = pairs.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > PAIR_BLOCK)
    many = stored(many.select("user_id", F.ceil(F.col("n") / PAIR_BLOCK).cast("int").alias("parts")))
    slot = F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).cast("int").alias("slot")
    dealt = pairs.join(small(many), "user_id", "left").select("user_id", slot, F.struct(*pairs.columns).alias("x"))
    return dealt.groupBy("user_id", "slot").agg(F.collect_list("x").alias(name))


def with_vectors(rows: DataFrame, needs: Column, embedded: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema) -> DataFrame:
    """run(rows, vectors of the articles that they need) for each block of rows (user_id, ...);
    needs: array of article ids."""
    spark = rows.sparkSession
    ship(spark)
    rows = stored(rows.withColumn("_needs", F.coalesce(needs, F.array().cast("array<bigint>"))))
    total = rows.agg(F.sum(F.size("_needs"))).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    n = max(1, -(-total // NEEDED), min(tasks, -(-total // LEAST_NEEDED)))
    rest = [c for c in rows.columns if c != "_needs"]
    block = F.pmod(F.xxhash64("user_id", F.get("_needs", F.lit(0))), F.lit(n)).cast("int").alias("block")
    needed = rows.select(block, F.explode("_needs").alias("id")).distinct()
    theirs = needed.join(dense(embedded), "id").select("block", "id", "dims", "ws")
    return rows.select(block, *rest).groupBy("block").cogroup(theirs.groupBy("block")).applyInArrow(run, schema)
