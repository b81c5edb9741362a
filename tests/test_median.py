"""Exact distributed median against a brute-force median."""

import numpy as np
import pytest

from bridgelens.operators.quantile import exact_median


def _brute(values):
    v = sorted(x for x in values if x is not None)
    if not v:
        return None
    n = len(v)
    a, b = v[(n - 1) // 2], v[n // 2]
    return a + (b - a) * 0.5


def _df(spark, values):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], "x double")


@pytest.mark.parametrize("values", [
    [], [None, None], [5], [5, 1], [3, 1, 2], [1, 1, 1, 1], [-2.5, 7, 7, 7, 100, None],
])
def test_small_inputs(spark, values):
    assert exact_median(_df(spark, values), "x") == _brute(values)


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_random_with_forced_rounds(spark, seed):
    rng = np.random.default_rng(seed)
    n = 20_000 + seed
    vals = list(np.round(rng.lognormal(10, 2, n), 2))
    # few buckets force several narrowing rounds
    got = exact_median(_df(spark, vals), "x", buckets=8)
    assert got == _brute(vals)


def test_hot_value_holds_a_third(spark):
    rng = np.random.default_rng(7)
    vals = [42.0] * 7000 + list(rng.normal(0, 100, 14000))
    assert exact_median(_df(spark, vals), "x", buckets=8) == _brute(vals)


def test_two_heavy_values(spark):
    vals = [1.0] * 5000 + [2.0] * 5000
    assert exact_median(_df(spark, vals), "x", buckets=8) == 1.5


def test_values_the_log_scale_cannot_separate(spark):
    base = 1e15
    vals = [base + i for i in range(300)] + [base + 2 ** 20] * 100
    assert exact_median(_df(spark, vals), "x", buckets=4) == _brute(vals)


def test_extreme_magnitudes(spark):
    vals = [-1e300, -5.0, 0.0, 0.0, 1e-300, 3.0, 1e300] * 40
    assert exact_median(_df(spark, vals), "x", buckets=4) == _brute(vals)


def test_median_by_group_with_null_key(spark):
    from bridgelens.operators.quantile import exact_median_by
    rows = [("a", float(i)) for i in range(101)] + [("b", 5.0), ("b", 7.0), (None, 3.0), ("c", None)]
    df = spark.createDataFrame(rows, "k string, x double")
    got = {r.k: r.median for r in exact_median_by(df, "k", "x").collect()}
    assert got == {"a": 50.0, "b": 6.0, None: 3.0, "c": None}


def test_median_of_many_groups(spark):
    from bridgelens.operators.quantile import exact_median_by
    rng = np.random.default_rng(3)
    rows = [(int(k), float(x)) for k, x in zip(rng.integers(0, 300, 6000), np.round(rng.lognormal(3, 2, 6000), 2))]
    rows += [(7, 42.0)] * 3000 + [(8, 1e15 + i % 3) for i in range(100)] + [(9, None)] * 2
    groups = {}
    for k, x in rows:
        groups.setdefault(k, []).append(x)
    df = spark.createDataFrame(rows, "k int, x double")
    got = {r.k: r.median for r in exact_median_by(df, "k", "x", buckets=8).collect()}
    assert got == {k: _brute(v) for k, v in groups.items()}


def _jobs(spark, run):
    """Jobs that Spark started for ``run()``."""
    sc, name = spark.sparkContext, f"jobs-{np.random.default_rng().integers(1 << 40)}"
    sc.setJobGroup(name, name)
    try:
        run()
        return len(sc.statusTracker().getJobIdsForGroup(name))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_rounds_do_not_multiply_with_groups(spark):
    from bridgelens.operators.quantile import exact_median_by
    values = [float(x) for x in np.round(np.random.default_rng(5).lognormal(3, 2, 2000), 2)]
    few = spark.createDataFrame([(0, x) for x in values], "k int, x double")
    many = spark.createDataFrame([(k % 200, x) for k, x in enumerate(values)], "k int, x double")
    n_few = _jobs(spark, lambda: exact_median_by(few, "k", "x", buckets=64))
    n_many = _jobs(spark, lambda: exact_median_by(many, "k", "x", buckets=64))
    assert 0 < n_many <= n_few + 6  # 200 times the groups, no more rounds


def test_median_by_refuses_infinite_values(spark):
    from bridgelens.operators.quantile import exact_median_by
    with pytest.raises(ValueError):
        exact_median_by(spark.createDataFrame([(1, 2.0), (2, float("inf"))], "k int, x double"), "k", "x")


def test_adjacent_doubles(spark):
    import math
    a = 1e15
    b = math.nextafter(a, math.inf)
    vals = [a] * 30 + [b] * 31
    assert exact_median(_df(spark, vals), "x", buckets=4) == _brute(vals)


@pytest.mark.parametrize("bad", [float("nan"), float("inf"), float("-inf")])
def test_non_finite_values_are_refused(spark, bad):
    with pytest.raises(ValueError):
        exact_median(_df(spark, [1.0, 2.0, bad]), "x")
