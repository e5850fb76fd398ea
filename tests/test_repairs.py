"""Error messages of sources, and tables whose replacement was broken off."""

from datetime import datetime

from pyspark.sql import functions as F

from presswork.operators import ingest
from presswork.plans.engine import Engine


def test_an_error_in_a_worker_is_recorded_with_its_message(spark):
    def broken(spark):
        def run(batches):
            raise ValueError("page 3 of the feed has no date")
            yield

        return spark.range(3).mapInArrow(run, "id long")

    def missing(spark):
        return spark.read.parquet("/no/such/folder")

    rows, errors = ingest.read_sources({"a": broken, "b": lambda s: s.range(2), "c": missing}, spark)
    assert rows.count() == 2 and errors["a"] == "ValueError: page 3 of the feed has no date" and "/no/such/folder" in errors["c"]
    assert ingest.message(RuntimeError("")) == "RuntimeError"


def test_a_replacement_that_breaks_off_leaves_a_table(spark, tmp_path):
    engine = Engine(spark, str(tmp_path), [], datetime(2024, 1, 1))
    rows = spark.range(3).withColumn("email", F.lit("x"))
    engine.append("users", rows)
    (tmp_path / "users").rename(tmp_path / "users.old")
    (tmp_path / "users.new").mkdir()  # it broke off while the new table was written
    assert engine.table("users").count() == 3 and (tmp_path / "users").exists()
    engine._replace("users", rows.filter("id > 0"))
    assert engine.table("users").count() == 2 and not (tmp_path / "users.old").exists()
    (tmp_path / "users").rename(tmp_path / "users.new")  # it broke off between its renames
    assert engine.table("users").count() == 2


def test_a_first_table_that_breaks_off_is_no_table(spark, tmp_path):
    (tmp_path / "users.new").mkdir()
    assert Engine(spark, str(tmp_path), [], datetime(2024, 1, 1)).table("users").count() == 0
