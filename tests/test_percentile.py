"""The distributed exact percentile equals the linear-interpolation percentile of NumPy/pandas."""

import numpy as np
import pytest
import pandas as pd

from ledgerflow.functions.stats import exact_percentiles


def _np(values, p):
    return float(np.percentile(np.asarray(values, dtype=float), p * 100))


def test_matches_numpy_with_refinement_passes(spark):
    rng = np.random.default_rng(7)
    vals = np.concatenate([rng.lognormal(8, 2, 4000).round(2), np.full(3000, 123.45), rng.integers(0, 50, 500)])
    df = spark.createDataFrame(pd.DataFrame({"v": vals}))
    probs = [0.0, 0.05, 0.5, 0.95, 0.99, 1.0]
    # few buckets force several histogram passes
    got = exact_percentiles(df, "v", probs, buckets=16)
    for p in probs:
        assert got[p] == pytest.approx(_np(vals, p), rel=1e-12, abs=1e-12), p


def test_nulls_skipped_single_value_and_empty(spark):
    df = spark.createDataFrame([(None,), (5.0,), (None,)], "v double")
    assert exact_percentiles(df, "v", [0.95]) == {0.95: 5.0}
    empty = spark.createDataFrame([], "v double")
    assert exact_percentiles(empty, "v", [0.5]) == {0.5: None}


def test_hot_value_holds_a_third(spark):
    vals = [1.0] * 3000 + list(np.arange(6000, dtype=float))
    df = spark.createDataFrame(pd.DataFrame({"v": vals}))
    got = exact_percentiles(df, "v", [0.3, 0.34, 0.95], buckets=8)
    for p in (0.3, 0.34, 0.95):
        assert got[p] == pytest.approx(_np(vals, p), rel=1e-12, abs=1e-12)


def test_signed_values_and_zero(spark):
    rng = np.random.default_rng(11)
    vals = np.concatenate([-rng.lognormal(3, 2, 700).round(2), np.zeros(200), rng.lognormal(3, 2, 900).round(2), [1e-300, -1e300]])
    df = spark.createDataFrame(pd.DataFrame({"v": vals}))
    probs = [0.0, 0.01, 0.3, 0.45, 0.5, 0.77, 1.0]
    got = exact_percentiles(df, "v", probs, buckets=4)
    for p in probs:
        assert got[p] == pytest.approx(_np(vals, p), rel=1e-12, abs=1e-300), p


def test_infinities_are_end_values(spark):
    vals = [float("-inf")] * 2 + [1.0, 2.0, 3.0, 4.0] + [float("inf")] * 3
    got = exact_percentiles(spark.createDataFrame([(v,) for v in vals], "v double"), "v", [0.0, 0.25, 0.5, 1.0], buckets=2)
    assert got == {0.0: float("-inf"), 0.25: 1.0, 0.5: 3.0, 1.0: float("inf")}


def test_global_statistics_have_one_row(spark):
    import pytest

    from ledgerflow.functions.stats import with_global

    df = spark.range(3)
    assert [tuple(r) for r in with_global(df, spark.range(1).selectExpr("5 AS m", "'x' AS s")).orderBy("id").collect()] == [(0, 5, "x"), (1, 5, "x"), (2, 5, "x")]
    assert with_global(df, spark.range(0).selectExpr("5 AS m")).collect() == []
    with pytest.raises(Exception, match="more than one row"):
        with_global(df, spark.range(2).selectExpr("5 AS m")).collect()
