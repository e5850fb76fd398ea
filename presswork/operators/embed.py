"""Text embedders."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructType

from ..schemas import EMBEDDING_DIM
from ..shipping import ship

#: Tokens whose codes a task remembers, about 20 MB.
REMEMBERED = 1 << 17


def hash_vectors(df: DataFrame, text: str = "text", key: str = "id") -> DataFrame:
    """(id, dims, ws): each text's unit vector by its non-zero entries, one row a text;
    texts without tokens have none.

    A token ([a-z0-9]+ in lower case) adds +1 or -1 to one of 768 dimensions, as its
    SHA-256 says. All tokens of a text are in its row, so nothing is exchanged; a worker
    hashes a token that it remembers once.
    """
    ship(df.sparkSession)
    rows = df.select(key, F.lower(F.col(text)).alias("_text"))
    schema = StructType([rows.schema.fields[0]]).add("dims", ArrayType(IntegerType())).add("ws", ArrayType(DoubleType()))
    return rows.mapInArrow(_hashed, schema)


def _hashed(batches):
    codes: dict[str, int] = {}
    find, step, longest = re.compile("[a-z0-9]+").findall, 512, 64
    for batch in batches:
        for at in range(0, len(batch), step):
            part = batch.slice(at, step)
            counts, found = np.zeros(len(part), np.int64), []
            for i, said in enumerate(part.column(1).to_pylist()):
                tokens = find(said) if said else ()
                counts[i] = len(tokens)
                for t in tokens:
                    code = codes.get(t)
                    if code is None:
                        digest = hashlib.sha256(t.encode()).digest()
                        code = int.from_bytes(digest[:4], "big") % EMBEDDING_DIM * 2 + (digest[4] & 1)
                        if len(t) <= longest and len(codes) < REMEMBERED:
                            codes[t] = code
                    found.append(code)
            code = np.array(found, np.int64)
            place = np.repeat(np.arange(len(part)), counts) * EMBEDDING_DIM + code // 2
            sums = np.bincount(place, weights=1.0 - 2 * (code % 2), minlength=len(part) * EMBEDDING_DIM).reshape(len(part), -1)
            row, dim = np.nonzero(sums)
            norm = np.sqrt((sums * sums).sum(axis=1))
            kept = np.flatnonzero(norm > 0)
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(part))[kept])]), pa.int32())
            values = [pa.array(dim, pa.int32()), pa.array(sums[row, dim] / norm[row])]
            key = part.column(0).take(pa.array(kept))
            yield pa.RecordBatch.from_arrays([key, *[pa.ListArray.from_arrays(offsets, v) for v in values]], [batch.schema.names[0], "dims", "ws"])


def spread(scan: DataFrame) -> DataFrame:
    """A plain scan, dealt round-robin where it has fewer splits than there are cores, as a
    file of one row group has. It changes partitions only; a large table is left as it is."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def hash_embedding(df: DataFrame, text: str = "text", key: str = "id") -> DataFrame:
    """(id, dim, w): hash_vectors() by entries."""
    return sparse(hash_vectors(df, text, key), key)


def sparse(vectors: DataFrame, key: str | list[str] = "id") -> DataFrame:
    """(id, dim, w) rows of vectors in either form; key: the columns to keep."""
    if "dims" not in vectors.columns:
        return vectors
    keys = [key] if isinstance(key, str) else key
    return vectors.select(*keys, F.explode(F.arrays_zip("dims", "ws")).alias("_e")).select(*keys, F.col("_e.dims").alias("dim"), F.col("_e.ws").alias("w"))


def dense(vectors: DataFrame, key: str = "id") -> DataFrame:
    """(id, dims, ws) rows, one a vector, of vectors in either form."""
    if "dims" in vectors.columns:
        return vectors.select(key, "dims", "ws")
    return vectors.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("dim", "w"))).alias("_e")).select(key, F.col("_e.dim").alias("dims"), F.col("_e.w").alias("ws"))


def full(dims: Column, ws: Column, size: int = EMBEDDING_DIM) -> Column:
    """All numbers of a vector, by default 768."""
    found = F.map_from_arrays(dims, ws)
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda d: F.coalesce(F.try_element_at(found, d), F.lit(0.0)))


def model_embedder(encode: Callable[[list[str]], list[list[float]]], batch: int = 32) -> Callable[[DataFrame, str, str], DataFrame]:
    """An embedder for register() from a model's encode(texts) -> vectors, which is shipped
    to the tasks and called with `batch` texts at a time. Vectors get length 1."""

    @F.pandas_udf("array<double>")
    def vectors(texts: pd.Series) -> pd.Series:
        given = texts.fillna("").tolist()
        rows = [v for at in range(0, len(given), batch) for v in encode(given[at : at + batch])]
        full = [np.asarray(v, float) for v in rows]
        return pd.Series([(v / n).tolist() if (n := float(np.linalg.norm(v))) else v.tolist() for v in full])

    def embedder(df: DataFrame, text: str = "text", key: str = "id") -> DataFrame:
        made = df.select(key, vectors(text).alias("ws")).filter(F.exists("ws", lambda w: w != 0))
        return made.select(key, F.sequence(F.lit(0), F.size("ws") - 1).alias("dims"), "ws")

    return embedder


EMBEDDERS: dict[str, Callable[[DataFrame, str, str], DataFrame]] = {"hash": hash_vectors}


def register(name: str, embedder: Callable[[DataFrame, str, str], DataFrame]) -> None:
    """Adds an embedder: (df, text column, key column) -> (key, dims, ws), one row a vector."""
    EMBEDDERS[name] = embedder


def embed_missing(articles: DataFrame, done: DataFrame, backend: str = "hash", limit: int | None = None) -> DataFrame:
    """Vectors (id, dims, ws) of the articles that are not in `done` (id) yet, for an append.
    Texts without tokens have none, so `done` should be marks rather than vectors."""
    from ..functions.text import embedding_text

    todo = articles.join(done.select("id").distinct(), "id", "left_anti")
    todo = todo if limit is None else todo.orderBy("id").limit(limit)
    return EMBEDDERS[backend](todo.select("id", embedding_text(F.col("title"), F.col("summary")).alias("text")), "text", "id")
