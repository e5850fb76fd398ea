"""Stored keys: the same answers as joins with all history, from few files."""

import random

import pytest
from pyspark.sql import functions as F

from presswork.operators import dedup, key_store
from presswork.operators.key_store import KeyStore

ROW = "id bigint, url string, doi string, content_hash string, name string"


def some_rows(spark, seed, start, n, spread=40):
    rng = random.Random(seed)
    pick = lambda letter: rng.choice([None, f"{letter}{rng.randrange(spread)}", f"{letter}{rng.randrange(spread)}"])
    return spark.createDataFrame([(start + i, pick("u"), pick("d"), pick("t"), "x") for i in range(n)], ROW)


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_batches_against_the_store_equal_joins_with_history(spark, tmp_path):
    store, history = KeyStore(spark, str(tmp_path), buckets=8, expected_keys=200), None
    for n in range(4):
        batch = some_rows(spark, n, 1000 * n, 30, spread=60)
        want = dedup.three_tier(batch, history=history)
        got = dedup.three_tier(batch, history=store.history(batch))
        assert ids(got) == ids(want), n
        store.add(got, n)
        store.add(got, n)  # again, as after a failure
        assert ids(dedup.three_tier(batch, history=store.history(batch, but=n))) == ids(want)
        history = got if history is None else history.union(got)
    again = KeyStore(spark, str(tmp_path), buckets=3)  # the shape is the stored one
    assert (again.buckets, again.pages) == (8, 1)
    everything = {(k, r[k]) for r in history.collect() for k in key_store.KEYS if r[k] is not None}
    assert {tuple(r) for r in again.known(history).collect()} == everything


def test_a_small_batch_reads_few_files(spark, tmp_path):
    store = KeyStore(spark, str(tmp_path), buckets=64, expected_keys=6000)
    store.add(spark.range(3000).select("id", F.concat(F.lit("u"), "id").alias("url"), F.concat(F.lit("d"), "id").alias("doi"), F.lit(None).cast("string").alias("content_hash")), 0)
    assert len(store.batches()) == 1
    asked = spark.createDataFrame([(1, "u7", "never", None, "x"), (2, "new", None, "new", "x")], ROW)
    found = store.known(asked)
    assert [tuple(r) for r in found.collect()] == [("url", "u7")]
    files = len(spark.read.schema("kind string, key string").parquet(f"{tmp_path}/keys").inputFiles())
    assert files == 64 and len(found.inputFiles()) <= 2  # one hit and at most one false one
    none = store.known(spark.createDataFrame([(1, "no", None, None, "x")], ROW))
    assert none.count() == 0


def test_filters_pass_few_strangers(spark, tmp_path):
    store = KeyStore(spark, str(tmp_path), buckets=4, expected_keys=20_000)
    row = lambda a, b: spark.range(a, b).select("id", F.concat(F.lit("u"), "id").alias("url"), F.lit(None).cast("string").alias("doi"), F.lit(None).cast("string").alias("content_hash"))
    store.add(row(0, 20_000), 0)
    assert store._passed(store._placed(row(0, 20_000)), None).count() == 20_000
    assert store._passed(store._placed(row(50_000, 70_000)), None).count() < 500


def test_an_unfinished_batch_is_not_asked(spark, tmp_path):
    store = KeyStore(spark, str(tmp_path))
    asked = some_rows(spark, 1, 0, 5)
    assert store.known(asked).count() == 0 and store.history(asked).count() == 0
    store.add(asked.limit(0), 0)
    assert store.known(asked).count() == 0
    (tmp_path / "pages" / "batch=1").mkdir()
    assert store.batches() == ["batch=0"]


@pytest.mark.parametrize("n_null", [0, 5])
def test_first_of_each_key(spark, n_null):
    rows = [(i, f"k{i % 3}", "a") for i in range(9)] + [(100 + i, None, "b") for i in range(n_null)]
    got = dedup.by_key(spark.createDataFrame(rows, "id long, key string, x string"), "key")
    assert ids(got) == [0, 1, 2, *range(100, 100 + n_null)] and got.columns == ["id", "key", "x"]
