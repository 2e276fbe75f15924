"""Exact distributed quantiles against numpy / DuckDB semantics."""

import numpy as np
import pytest

from tiercraft.operators.quantiles import multi_quantiles, order_statistics, quantiles

PROBS = {"q0": 0.0, "q2": 0.2, "q25": 0.25, "q5": 0.5, "q75": 0.75, "q1": 1.0}


def _frame(spark, arr):
    return spark.createDataFrame([(float(x),) for x in arr], "x double").repartition(4)


def test_exact_against_numpy_with_refinement(spark):
    rng = np.random.default_rng(3)
    arr = rng.normal(100, 30, 20_000)
    got = quantiles(_frame(spark, arr), "x", PROBS)
    for k, p in PROBS.items():
        assert got[k] == pytest.approx(float(np.quantile(arr, p)), rel=1e-12, abs=1e-12)


def test_heavy_ties_resolve(spark):
    rng = np.random.default_rng(4)
    arr = np.concatenate([np.full(7000, 5.0), rng.integers(0, 1000, 13000).astype(float)])
    got = quantiles(_frame(spark, arr), "x", PROBS)
    for k, p in PROBS.items():
        assert got[k] == float(np.quantile(arr, p))


def test_order_statistic_and_small_inputs(spark):
    arr = np.arange(1, 101, dtype=float)
    got = order_statistics(_frame(spark, arr), "x", lambda n: {"t": n - max(1, int(n * 0.1))})
    assert got["t"] == 91.0
    assert quantiles(_frame(spark, [3.0]), "x", {"m": 0.5})["m"] == 3.0
    assert quantiles(_frame(spark, [1.0, 4.0]), "x", {"q": 0.75})["q"] == 3.25
    empty = spark.createDataFrame([(None,)], "x double")
    assert quantiles(empty, "x", {"m": 0.5})["m"] is None


def test_multi_column_shares_passes(spark):
    df = spark.createDataFrame([(float(i), float(i * i)) for i in range(50)], "a double, b double")
    got = multi_quantiles(df, {"a": ("a", 0.5), "b": ("b", 0.75), "a9": ("a", 0.9)})
    assert got["a"] == 24.5
    assert got["a9"] == pytest.approx(np.quantile(np.arange(50.0), 0.9))
    assert got["b"] == pytest.approx(np.quantile(np.arange(50.0) ** 2, 0.75))


def test_methods_agree_on_small_data(spark):
    arr = np.arange(1.0, 11.0)
    df = _frame(spark, arr)
    exact = quantiles(df, "x", {"q": 0.75})["q"]
    assert exact == quantiles(df, "x", {"q": 0.75}, method="spark")["q"] == 7.75
    assert quantiles(df, "x", {"q": 0.75}, method="approx")["q"] in arr


def test_wide_range_infinities_and_neighbours_end(spark):
    arr = np.array([-np.inf, -1e308, -5e-324, 0.0, 5e-324, 1e-300, 1.0, np.nextafter(1.0, 2), 1e308, np.inf])
    got = order_statistics(_frame(spark, arr), "x", {str(i): i for i in range(len(arr))})
    assert [got[str(i)] for i in range(len(arr))] == list(arr)


def test_heavy_tail_needs_more_rounds_not_more_memory(spark):
    arr = 10.0 ** np.arange(-300, 300, 0.5)
    got = quantiles(_frame(spark, arr), "x", {"m": 0.5, "low": 0.01})
    for k, p in (("m", 0.5), ("low", 0.01)):
        h = (len(arr) - 1) * p
        lo = int(np.floor(h))
        assert arr[lo] <= got[k] <= arr[lo + 1]
