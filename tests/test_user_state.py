"""Vectors kept by a stream against the vectors of the whole log."""

import random
from datetime import datetime, timedelta

import pytest

from presswork.operators import embed, users
from presswork.streaming.user_state import current_vectors, refresh_users

LOG = "id bigint, user_id bigint, article_id bigint, interaction_type string, read_time_seconds int, created_at timestamp_ntz"
START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def embedded(spark):
    return embed.hash_vectors(spark.createDataFrame([(i, f"w{i} w{i % 3} w{i % 5}") for i in range(20)] + [(20, "")], "id long, text string")).cache()


def some_log(n=240, seed=2):
    rng = random.Random(seed)
    kinds = ["read", "like", "bookmark", "hide", "search"]
    return [(i, rng.randrange(1, 6), rng.randrange(22), rng.choice(kinds), rng.choice([None, 0, 30, 900]), START + timedelta(minutes=rng.randrange(60))) for i in range(n)]


def vectors(df):
    return {r.user_id: (r.interaction_count, {d: round(w, 9) for d, w in zip(r.dims, r.ws)}) for r in df.collect()}


def whole(spark, rows, embedded, **limits):
    got = {}
    for r in users.vectors(spark.createDataFrame(rows, LOG), embedded, **limits).collect():
        got.setdefault(r.user_id, (r.interaction_count, {}))[1][r.dim] = round(r.w, 9)
    return got


def test_state_equals_the_whole_log_after_late_repeated_and_restarted_batches(spark, embedded, tmp_path):
    rows = some_log()
    random.Random(5).shuffle(rows)  # out of order
    odd = [(900, None, 1, "like", None, START), (901, 1, None, "like", None, START), (902, 1, 1, "like", None, None)]
    batches = [rows[:100], rows[60:160], rows[160:] + odd, rows[:20]]  # rows come again; the last batch has nothing new
    limits = {"limit": 25, "count_limit": 12}
    for n, batch in enumerate(batches):
        spark.createDataFrame(batch, LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(LOG).parquet(str(tmp_path / "in"))
        refresh_users(stream, embedded, str(tmp_path / "store"), str(tmp_path / "check"), **limits).awaitTermination()  # each a restart
        known = {r[0]: r for b in batches[: n + 1] for r in b if r not in odd}
        assert vectors(current_vectors(spark, str(tmp_path / "store"))) == whole(spark, list(known.values()), embedded, **limits), n
    assert spark.read.parquet(str(tmp_path / "store" / "batch=3")).count() == 0  # no list changed


def test_a_batch_writes_only_its_users(spark, embedded, tmp_path):
    rows = some_log()
    for part in (rows, [(1000, 3, 4, "like", None, START + timedelta(days=1)), (1001, 4, 4, "hide", None, START + timedelta(days=1))]):
        spark.createDataFrame(part, LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(LOG).parquet(str(tmp_path / "in"))
        refresh_users(stream, embedded, str(tmp_path / "store"), str(tmp_path / "check")).awaitTermination()
    assert [r.user_id for r in spark.read.parquet(str(tmp_path / "store" / "batch=1")).collect()] == [3]


def test_idle_users_are_forgotten(spark, embedded, tmp_path):
    like = lambda i, user, day: (i, user, 1, "like", None, START + timedelta(days=day))
    for part in ([like(1, 1, 0), like(2, 2, 0)], [like(3, 2, 50)], [like(4, 3, 52)], [like(5, 1, 53)]):
        spark.createDataFrame(part, LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(LOG).parquet(str(tmp_path / "in"))
        refresh_users(stream, embedded, str(tmp_path / "store"), str(tmp_path / "check"), idle_days=20, late="5 days").awaitTermination()
        got = vectors(current_vectors(spark, str(tmp_path / "store")))
        if part[0][0] == 4:
            assert {u: n for u, (n, _) in got.items()} == {2: 2, 3: 1}
    assert {u: n for u, (n, _) in got.items()} == {1: 1, 2: 2, 3: 1}  # user 1 begins anew
