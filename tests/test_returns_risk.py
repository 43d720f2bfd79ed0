import math

from pyspark.sql import functions as F

from helpers import bars, series_dates
from kestrel.operators.returns import returns_daily, returns_monthly
from kestrel.operators.risk import drawdown_daily, risk_panel, rolling_sharpe, rolling_volatility


def test_first_bar_null_and_guards(spark):
    df = bars(spark, [
        ("A", "2020-01-01", 10.0), ("A", "2020-01-02", 11.0), ("A", "2020-01-03", 0.0),
        ("A", "2020-01-04", 5.0), ("A", "2020-01-05", -2.0), ("A", "2020-01-06", None),
        ("B", "2020-01-01", 7.0),
    ])
    r = {(x.ticker, x.date.day): x for x in returns_daily(df).collect()}
    assert r[("A", 1)].simple_return is None and r[("A", 1)].log_return is None
    assert math.isclose(r[("A", 2)].simple_return, 0.1)
    assert math.isclose(r[("A", 2)].log_return, math.log(1.1))
    assert r[("A", 3)].log_return is None                 # price 0 -> no log return
    assert r[("A", 4)].simple_return is None               # previous price 0 -> NULL, no error
    assert r[("A", 5)].log_return is None                  # negative price
    assert r[("A", 6)].simple_return is None               # NULL adj_close
    assert r[("B", 1)].simple_return is None               # one-row ticker


def test_null_returns_equal_ticker_count(spark):
    df = bars(spark, [(t, day, 10.0 + i) for t in "ABC" for i, day in enumerate(series_dates(5))])
    n_null = returns_daily(df).filter(F.col("simple_return").isNull()).count()
    assert n_null == 3


def test_returns_telescope(spark):
    prices = [10.0, 12.0, 9.0, 15.0, 14.5]
    df = bars(spark, [("A", day, p) for day, p in zip(series_dates(5), prices)])
    s = returns_daily(df).agg(F.sum("log_return")).first()[0]
    assert math.isclose(s, math.log(prices[-1] / prices[0]), rel_tol=1e-12)


def test_monthly_skips_gap_month(spark):
    df = bars(spark, [("A", "2020-01-30", 10.0), ("A", "2020-01-31", 11.0),
                      ("A", "2020-03-02", 12.0), ("A", "2020-03-31", 13.2)])
    rows = sorted(returns_monthly(df).collect(), key=lambda r: r.month)
    assert [r.month.month for r in rows] == [1, 3]
    assert rows[1].prev_month_price == 11.0               # February missing: lag by row
    assert math.isclose(rows[1].simple_return, 0.2)


def test_partial_windows_and_constant_sharpe(spark):
    df = bars(spark, [("A", day, 100.0) for day in series_dates(30)])
    v = sorted(rolling_volatility(df).collect(), key=lambda r: r.date)
    assert v[0].vol_20d is None and v[1].vol_20d is None  # 0 and 1 observations
    assert v[2].vol_20d == 0.0 and v[2].n_obs_20d == 2     # value from 2 observations on
    s = rolling_sharpe(df).collect()
    assert all(r.sharpe_60d is None for r in s)            # std 0 -> NULL, not an error


def test_drawdown_nonpositive_and_panel_agrees(spark):
    import random
    rnd = random.Random(7)
    df = bars(spark, [("A", day, 50 + rnd.random() * 10) for day in series_dates(120)])
    dd = drawdown_daily(df)
    assert dd.filter(F.col("drawdown") > 0).count() == 0
    panel = risk_panel(df).select("date", "drawdown", "vol_60d").collect()
    ref = {r.date: r.drawdown for r in dd.collect()}
    assert all(abs(r.drawdown - ref[r.date]) < 1e-15 for r in panel)
    vol = {r.date: r.vol_60d for r in rolling_volatility(df).collect()}
    assert all((r.vol_60d is None and vol[r.date] is None) or abs(r.vol_60d - vol[r.date]) < 1e-12 for r in panel)
