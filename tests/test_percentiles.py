import math
import random

import numpy as np
import pytest

from presswork.operators import evaluate


@pytest.mark.parametrize("kind", ["floats", "ties", "wide", "whole"])
def test_percentiles_equal_sorting(spark, kind):
    rng = random.Random(kind)
    make = {
        "floats": lambda: rng.gauss(0, 1),
        "ties": lambda: float(rng.choice([-1, 0, -0.0, 3, 3, 3])),
        "wide": lambda: rng.choice([-1, 1]) * 10.0 ** rng.randrange(-300, 300) * rng.random(),
        "whole": lambda: float(rng.randrange(-(2**53), 2**53)),
    }[kind]
    rows = [(rng.choice(["a", "b", None]), rng.randrange(2), make()) for _ in range(700)]
    rows += [("one", 1, make()), ("two", 1, make()), ("two", 1, make()), ("none", 0, None), ("some", 0, None), ("some", 0, make())]
    df = spark.createDataFrame(rows, "name string, `part.no` int, v double").repartition(3)
    points = (0, 12.5, 50, 95, 99, 100)
    got = {(r["name"], r["part.no"]): [r[f"p{p}"] for p in points] for r in evaluate.percentiles(df, "v", ["name", "part.no"], points, digits=9).collect()}
    groups = {}
    for name, part, v in rows:
        groups.setdefault((name, part), []).extend([] if v is None else [v])
    assert got.keys() == groups.keys()
    for key, values in groups.items():
        want = [float(np.percentile(values, p)) if values else None for p in points]
        assert all(a == b or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-8) for a, b in zip(got[key], want)), key


def test_percentiles_of_a_whole_table_and_of_nothing(spark):
    df = spark.range(101).selectExpr("cast(id as double) v")
    assert evaluate.percentiles(df, "v").collect()[0].asDict() == {"p50": 50.0, "p95": 95.0, "p99": 99.0}
    assert evaluate.percentiles(df.limit(0), "v").count() == 0
    odd = spark.createDataFrame([(float("nan"),), (1.0,), (float("-inf"),)], "v double")
    low, middle, high = evaluate.percentiles(odd, "v", points=(0, 50, 100)).first()
    assert low == float("-inf") and middle == 1.0 and math.isnan(high)


def test_no_plan_keeps_a_groups_values(spark):
    df = spark.range(1000).selectExpr("id % 3 as g", "cast(id as double) v")
    plan = evaluate.percentiles(df, "v", ["g"])._jdf.queryExecution().toString().lower()
    assert "percentile(" not in plan and "collect_list" not in plan


def test_load_without_good_samples(spark):
    df = spark.createDataFrame([(False, 1.0, 1.0, 3)], "ok boolean, total_seconds double, ttft_seconds double, token_count int")
    row = evaluate.load_summary(df, 2.0).first()
    assert (row.n, row.n_ok, row.n_failed, row.total_p50, row.ttft_p95) == (1, 0, 1, None, None)
