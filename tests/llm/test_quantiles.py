import math

import numpy as np
import pytest

from embermill.llm import quantiles as Q

WANTED = (0.0, 0.01, 0.25, 0.5, 0.9, 1.0)


def frame(spark, data):
    return spark.createDataFrame(data, "g string, x double, n int, sign string, bucket string")


@pytest.mark.parametrize("error", [0.05, 0.01, 0.001])
def test_error_bound(spark, error):
    rng = np.random.default_rng(4)
    groups = {"a": rng.lognormal(0, 3, 2000), "b": -rng.lognormal(0, 1, 999), "c": np.concatenate([rng.normal(0, 1e-3, 500), [0.0] * 200, rng.normal(0, 1e6, 500)]), "one": np.array([7.25]), "tie": np.array([2.0] * 50), "tiny": np.array([5e-324, 1e-308]), "huge": np.array([1.79e308, -1.7e308, 1.7976931348623157e308])}
    df = frame(spark, [(k, float(x), 1, None, None) for k, v in groups.items() for x in v])
    got = Q.percentiles(Q.sketch(df, ["g"], "x", error), ["g"], WANTED, error).collect()
    assert len(got) == len(groups) * len(WANTED)
    for r in got:
        v = np.sort(groups[r["g"]])
        true = v[math.floor(r["q"] * (len(v) - 1))]
        assert r["n"] == len(v)
        assert math.isfinite(r["estimate"]) and math.isfinite(r["high"]) and math.isfinite(r["low"])
        if r["g"] != "tiny":
            assert abs(r["estimate"] - true) <= error * abs(true) * (1 + 1e-9)
            assert r["low"] <= true * (1 + 1e-9 * np.sign(true)) + 1e-300 and true <= r["high"] + 1e-9 * abs(true)


def test_merging_days_is_counting_all(spark):
    rng = np.random.default_rng(5)
    df = frame(spark, [(rng.choice(["a", "b"]), float(x), i % 3, None, None) for i, x in enumerate(rng.normal(3, 2, 900))])
    whole = {tuple(r) for r in Q.sketch(df, ["g"], "x").collect()}
    days = Q.merge(*[Q.sketch(df.filter(f"n = {k}"), ["g"], "x") for k in range(3)])
    assert {tuple(r) for r in days.select("g", "sign", "bucket", "n").collect()} == whole


def test_dirt(spark):
    df = frame(spark, [("a", None, 1, None, None), ("a", float("nan"), 1, None, None), ("a", float("inf"), 1, None, None), ("a", float("-inf"), 1, None, None), (None, 3.0, 1, None, None), ("b", -0.0, 1, None, None)])
    got = Q.percentiles(Q.sketch(df, ["g"], "x"), ["g"], (0.5,)).collect()
    assert {(r["g"], round(r["estimate"], 1), r["n"]) for r in got} == {(None, 3.0, 1), ("b", 0.0, 1)}
    assert Q.percentiles(Q.sketch(df.limit(0), ["g"], "x"), ["g"], (0.5,)).collect() == []
    with pytest.raises(ValueError):
        Q.sketch(df, ["g"], "x", 1.5)
    with pytest.raises(ValueError):
        Q.percentiles(df, ["g"], (1.5,))


def test_a_hot_group_moves_its_buckets_only(spark):
    """Nine tenths of all rows in one group: what is shuffled are its buckets, summed in each task."""
    df = spark.range(200_000).selectExpr("case when id % 10 = 0 then 'cold' else 'hot' end as g", "cast(1 + id % 1000 as double) as x")
    s = Q.sketch(df, ["g"], "x")
    assert s.count() < 2 * 400
    plan = s._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") == 2  # before and after the exchange
    got = {r["g"]: r["n"] for r in Q.percentiles(s, ["g"], (0.5,)).collect()}
    assert got == {"hot": 180_000, "cold": 20_000}
