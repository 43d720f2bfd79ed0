import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from helpers import bars, series_dates
from kestrel.operators import indicators as ind


def _series(spark, n=120, seed=1, ticker="A"):
    rnd = random.Random(seed)
    p = 100.0
    rows = []
    for day in series_dates(n):
        p *= math.exp(rnd.gauss(0, 0.02))
        rows.append((ticker, day, p, p * 1.02, p * 0.97, p, 1000 + rnd.randint(0, 500)))
    return bars(spark, rows)


def test_recursive_indicators_match_pandas_definitions(spark):
    df = _series(spark)
    got = ind.add_recursive_indicators(ind.window_features(df)).toPandas().sort_values("date").reset_index(drop=True)
    price = got["adj_close"]
    e12 = price.ewm(span=12, min_periods=12, adjust=False).mean()
    e26 = price.ewm(span=26, min_periods=26, adjust=False).mean()
    macd = e12 - e26
    sig = macd.ewm(span=9, min_periods=9, adjust=False).mean()
    np.testing.assert_allclose(got["macd"], macd, rtol=1e-12, equal_nan=True)
    np.testing.assert_allclose(got["macd_signal"], sig, rtol=1e-12, equal_nan=True)
    assert got["macd"].first_valid_index() == 25 and got["macd_signal"].first_valid_index() == 33
    assert got["rsi_14"].first_valid_index() == 13
    assert got["rsi_14"].dropna().between(0, 100).all()
    tr = np.maximum.reduce([got.high - got.low, (got.high - got.close.shift()).abs(), (got.low - got.close.shift()).abs()])
    tr[0] = got.high[0] - got.low[0]
    atr = np.zeros(len(tr))
    atr[13] = tr[:14].mean()
    for i in range(14, len(tr)):
        atr[i] = (atr[i - 1] * 13 + tr[i]) / 14.0
    np.testing.assert_allclose(got["atr_14"], atr / got["close"], rtol=1e-12)


def test_constant_price_rsi_100_and_bb_zero(spark):
    df = bars(spark, [("C", day, 50.0) for day in series_dates(40)])
    got = ind.add_recursive_indicators(ind.window_features(df)).toPandas().sort_values("date")
    assert (got["rsi_14"].dropna() == 100.0).all()
    assert (got["bb_width"].dropna() == 0.0).all()


def test_full_window_rules_and_target(spark):
    df = _series(spark, 40)
    wf = ind.window_features(df).toPandas().sort_values("date").reset_index(drop=True)
    lr = np.log(wf.adj_close / wf.adj_close.shift())
    np.testing.assert_allclose(wf.vol_5d, lr.rolling(5).std() * np.sqrt(252), rtol=1e-10, equal_nan=True)
    np.testing.assert_allclose(wf.vol_20d, lr.rolling(20).std() * np.sqrt(252), rtol=1e-10, equal_nan=True)
    target = lr.abs().shift(-1).rolling(5).mean()       # rows t-3 .. t+1, as the pipeline computes
    np.testing.assert_allclose(wf.abs_return_next, target, rtol=1e-12, equal_nan=True)
    fwd = ind.window_features(df, forward_target=True).toPandas().sort_values("date").reset_index(drop=True)
    intent = lr.abs()[::-1].rolling(5).mean()[::-1].shift(-1)   # rows t+1 .. t+5
    np.testing.assert_allclose(fwd.abs_return_next, intent, rtol=1e-12, equal_nan=True)


def test_regime_needs_60_targets(spark):
    # 64 bars -> 59 targets (first row and last row lack a full window): no labels.
    short = _series(spark, 64, ticker="S")
    # 65 bars -> 60 targets: labelled, tertiles over the ticker's own history.
    longer = _series(spark, 65, seed=2, ticker="L")
    out = ind.add_regime(ind.window_features(short.unionByName(longer)))
    counts = {r.ticker: (r.n, r.lab) for r in out.groupBy("ticker").agg(
        F.count("abs_return_next").alias("n"), F.count("regime").alias("lab")).collect()}
    assert counts["S"] == (59, 0)
    assert counts["L"] == (60, 60)
    pdf = out.filter(F.col("ticker") == "L").toPandas().dropna(subset=["abs_return_next"])
    q33, q67 = pdf.abs_return_next.quantile(1 / 3), pdf.abs_return_next.quantile(2 / 3)
    want = pd.cut(pdf.abs_return_next, [-np.inf, q33, q67, np.inf], labels=[0, 1, 2]).astype(int)
    assert (want.values == pdf.regime.values).all()


def test_equal_tertiles_label_low_or_high(spark):
    from pyspark.sql import Row
    rows = [Row(ticker="E", abs_return_next=1.0 if i < 50 else 2.0) for i in range(70)]
    out = ind.add_regime(spark.createDataFrame(rows)).groupBy("regime").count().collect()
    assert {r.regime for r in out} <= {0, 2}


def test_ewm_means_generic(spark):
    df = _series(spark, 50)
    got = ind.ewm_means(df.select("ticker", "date", "adj_close"), spans=(5,)).toPandas().sort_values("date")
    want = got.adj_close.ewm(span=5, min_periods=5, adjust=False).mean()
    np.testing.assert_allclose(got.ema_5, want, rtol=1e-13, equal_nan=True)
