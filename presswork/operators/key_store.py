"""Keys of stored articles (url, doi, title hash) in buckets, with Bloom filters.

A batch asks which of its keys are stored. Keys are filed by a hash in buckets; each has a
Bloom filter in pages of 32,768 bits, so that a key looks at one page. Only the buckets
for which some key passes its page are read, and their keys compared as they are. A small
batch so reads few files however many keys there are.

    path/keys/batch=N/bucket=B      (kind, key)
    path/pages/batch=N              (bucket, page, bits), in the order of bucket and page
    path/shape                      how many buckets, and pages in each
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import small, stored

#: Fixed by the bitmap functions: bits of a page. At so many keys a page and HASHES bits a key
#: about one key in a hundred passes that isn't there.
PAGE_BITS, KEYS_PER_PAGE, HASHES = 32_768, 3_000, 6
KEYS = ("url", "doi", "content_hash")


class KeyStore:
    """buckets and expected_keys are given when the store is made and read from it after."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, expected_keys: int = 10_000_000, keys: tuple[str, ...] = KEYS):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        if not self._exists("shape"):
            shape = [(buckets, max(1, -(-expected_keys // (buckets * KEYS_PER_PAGE))))]
            spark.createDataFrame(shape, "buckets int, pages int").coalesce(1).write.parquet(f"{self.path}/shape")
        self.buckets, self.pages = spark.read.schema("buckets int, pages int").parquet(f"{self.path}/shape").first()

    def _exists(self, name: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/_SUCCESS")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def _placed(self, rows: DataFrame) -> DataFrame:
        """(kind, key, bucket, page) of all keys in rows, each once."""
        each = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("key")) for k in self.keys])
        keys = rows.select(F.explode(each).alias("k")).select("k.kind", "k.key").filter("key is not null").distinct()
        return keys.select("kind", "key", _hashed(0, self.buckets).alias("bucket"), _hashed(1, self.pages).alias("page"))

    def add(self, rows: DataFrame, batch: int) -> None:
        """Stores the keys of rows; a batch that is added again replaces itself. The pages are
        written last: keys without them aren't found, so a batch that breaks off between
        must be added again before others ask, as a stream does."""
        placed = stored(self._placed(rows))
        files = placed.select("kind", "key", "bucket").repartition("bucket")
        files.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/keys/batch={batch}")
        bits = placed.select("bucket", "page", F.explode(_bits()).alias("bit"))
        pages = bits.groupBy("bucket", "page").agg(F.bitmap_construct_agg("bit").alias("bits"))
        pages.repartitionByRange("bucket", "page").sortWithinPartitions("bucket", "page").write.mode("overwrite").parquet(f"{self.path}/pages/batch={batch}")

    def batches(self) -> list[str]:
        """The folders of batches that are complete."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/pages")
        files = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in files.listStatus(where)] if files.exists(where) else []
        return sorted(n for n in names if self._exists(f"pages/{n}"))

    def _passed(self, asked: DataFrame, but: int | None) -> DataFrame:
        """The asked keys that pass the filter of a batch, with the batch."""
        names = [n for n in self.batches() if n != f"batch={but}"]
        if not names:
            return asked.withColumn("batch", F.lit(0).cast("bigint")).limit(0)
        read = self.spark.read.schema("bucket int, page int, bits binary, batch bigint").option("basePath", f"{self.path}/pages")
        pages = read.parquet(*[f"{self.path}/pages/{n}" for n in names])
        # the few buckets of a small batch are pushed down to the files' statistics
        wanted = [r.bucket for r in asked.select("bucket").distinct().collect()]  # at most one a bucket
        pages = pages.filter(F.col("bucket").isin(wanted)) if len(wanted) < self.buckets else pages
        met = pages.join(small(asked), ["bucket", "page"]).withColumn("asked", _bits())
        byte = "cast(conv(hex(substring(bits, cast(b div 8 as int) + 1, 1)), 16, 10) as int)"
        return met.filter(f"forall(asked, b -> shiftright({byte}, cast(b % 8 as int)) & 1 = 1)").drop("bits", "asked")

    def known(self, rows: DataFrame, but: int | None = None) -> DataFrame:
        """(kind, key): the keys of rows that are stored, in whatever batch but `but`."""
        asked = stored(self._placed(rows))
        passed = stored(self._passed(asked, but))
        hit = passed.select("batch", "bucket").distinct().collect()  # at most one a bucket and batch
        if not hit:
            return asked.select("kind", "key").limit(0)
        folders = [f"{self.path}/keys/batch={r.batch}/bucket={r.bucket}" for r in hit]
        there = self.spark.read.schema("kind string, key string").parquet(*folders)
        return there.join(small(passed.select("kind", "key").distinct()), ["kind", "key"], "left_semi").distinct()

    def history(self, rows: DataFrame, but: int | None = None) -> DataFrame:
        """The stored keys of rows as rows with one key each, for dedup.three_tier()."""
        found = stored(self.known(rows, but))
        return found.select(*[F.when(F.col("kind") == k, F.col("key")).alias(k) for k in self.keys])


def _hashed(seed: int, n: int) -> Column:
    return F.pmod(F.xxhash64("kind", "key", F.lit(seed)), F.lit(n)).cast("int")


def _bits() -> Column:
    """A key's bits in its page."""
    first, step = (F.pmod(F.xxhash64("kind", "key", F.lit(seed)), F.lit(1 << 31)) for seed in (2, 3))
    return F.array(*[(first + step * i) % PAGE_BITS for i in range(HASHES)])
