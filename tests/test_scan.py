"""Series cut into blocks: equal to the whole-series forms at every block size, several tasks a series."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import bars
from kestrel.operators import indicators as ind
from kestrel.operators import risk, scan


@pytest.fixture(scope="module")
def prices(spark):
    rng = np.random.default_rng(3)
    rows = []
    for ticker, n, step in (("HOT", 700, 1), ("GAPS", 90, 17), ("ONE", 1, 1)):
        p = 100 * np.exp(np.cumsum(rng.normal(0, 0.03, n)))
        rows += [(ticker, (dt.date(2019, 1, 1) + dt.timedelta(days=i * step)).isoformat(), float(x)) for i, x in enumerate(p)]
    return bars(spark, rows).persist()


def rows_of(df):
    return {(r.ticker, r.date): r for r in df.collect()}


def same(a, b, rel=1e-11):
    a, b = rows_of(a), rows_of(b)
    assert a.keys() == b.keys()
    for k in a:
        for x, y in zip(a[k], b[k], strict=True):
            assert x == y or (isinstance(x, float) and y == pytest.approx(x, rel=rel, abs=1e-13)), (k, a[k], b[k])


@pytest.mark.parametrize("block_rows,days", [(7, 10), (60, 50), (64, 366), (5000, 366)])
def test_bounded_windows(prices, block_rows, days):
    same(risk.rolling_volatility(prices), risk.volatility_in_blocks(prices, block_rows, days))
    same(risk.rolling_sharpe(prices), risk.sharpe_in_blocks(prices, block_rows, days))


def test_features_in_blocks(prices):
    """The forward target looks one row ahead, which a halo of earlier rows does not hold: all but it."""
    whole, cut = ind.window_features(prices), scan.in_blocks(prices, ind.window_features, 21, 64, days=50)
    same(whole.drop("abs_return_next"), cut.drop("abs_return_next"), 1e-9)


@pytest.mark.parametrize("days", [1, 50, 366])
def test_running_maximum_and_index(prices, days):
    same(risk.drawdown_daily(prices), risk.drawdown_in_blocks(prices, days))
    at = scan.row_index(prices, days=days).toPandas().sort_values(["ticker", "date"])
    assert (at["_i"] == at.groupby("ticker").cumcount()).all()


def test_running_skips_nulls(spark):
    rows = bars(spark, [("A", "2020-01-01", None), ("A", "2020-03-01", 3.0), ("A", "2020-06-01", None), ("A", "2020-09-01", 5.0)])
    for how, combine, want in ((F.max, F.greatest, [None, 3.0, 3.0, 5.0]), (F.sum, lambda a, b: a + b, [None, 3.0, 3.0, 8.0])):
        got = scan.running_in_blocks(rows, "out", how, F.col("adj_close"), combine, days=30).orderBy("date").collect()
        assert [r.out for r in got] == want


@pytest.mark.parametrize("days", [1, 9, 50, 4000])
def test_means_by_block(prices, days):
    got = ind.ewm_means(prices.select("ticker", "date", "adj_close"), spans=(5, 26), days=days).toPandas().sort_values(["ticker", "date"])
    for _, g in got.groupby("ticker"):
        for span in (5, 26):
            want = g["adj_close"].ewm(span=span, min_periods=span, adjust=False).mean()
            assert np.allclose(g[f"ema_{span}"].astype(float), want, rtol=1e-12, equal_nan=True)


def test_indicators_do_not_depend_on_the_blocks(prices):
    wf = ind.window_features(prices)
    whole = ind.add_recursive_indicators(wf, days=100_000)
    for days in (3, 50):
        same(whole, ind.add_recursive_indicators(wf, days=days), 1e-9)


def test_a_series_runs_in_several_tasks_in_the_jvm(spark, prices):
    hot = prices.filter("ticker = 'HOT'")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")     # which would merge tasks this small
    for df in (ind.ewm_means(hot.select("ticker", "date", "adj_close"), days=50), risk.volatility_in_blocks(hot, 64, 50),
               risk.drawdown_in_blocks(hot, 50)):
        assert df.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    plan = ind.add_recursive_indicators(ind.window_features(prices))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_empty_series(prices):
    none = prices.limit(0)
    assert ind.add_recursive_indicators(ind.window_features(none)).count() == 0
    assert risk.volatility_in_blocks(none).count() == 0 and risk.drawdown_in_blocks(none).count() == 0
