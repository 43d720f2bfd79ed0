"""Registered keys: features and labels (X1-X10, W7-W10, W12, P9, U2) and exploration."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from kestrel.config import DROPNA_COLS
from kestrel.functions.exprs import by_ticker, full_window, trailing
from kestrel.operators import explore as ex
from kestrel.operators import indicators as ind
from kestrel.plans.oracle import FEATURE_FLOATS, q
from kestrel.plans.registry import register

FF = ("ml_features",)


def _wf(m):
    return ind.window_features(m.prices)


def _rec(m):
    return ind.add_recursive_indicators(_wf(m).select("ticker", "date", "close", "adj_close", "true_range", "prev_adj_close"))


def _sel(sql_cols: str, rnd: tuple, rel: str = "feature_frame", uses=FF):
    return q(uses, f"SELECT ticker, date, {sql_cols} FROM {rel}", rnd)


register("feat_returns", _sel("ret_1d, ret_5d, ret_20d", ("ret_1d", "ret_5d", "ret_20d")))(
    lambda m: _wf(m).select("ticker", "date", "ret_1d", "ret_5d", "ret_20d"))
register("feat_vol", _sel("vol_5d, vol_20d", ("vol_5d", "vol_20d")))(
    lambda m: _wf(m).select("ticker", "date", "vol_5d", "vol_20d"))
register("feat_bb_width", _sel("bb_width", ("bb_width",)))(
    lambda m: _wf(m).select("ticker", "date", "bb_width"))
register("feat_volume_ratio", _sel("volume_ratio", ("volume_ratio",)))(
    lambda m: _wf(m).select("ticker", "date", "volume_ratio"))
register("feat_atr", _sel("atr_14", ("atr_14",)))(lambda m: _rec(m).select("ticker", "date", "atr_14"))
register("feat_rsi", _sel("rsi_14", ("rsi_14",)))(lambda m: _rec(m).select("ticker", "date", "rsi_14"))
register("feat_macd", _sel("macd, macd_signal, macd_diff", ("macd", "macd_signal", "macd_diff")))(
    lambda m: _rec(m).select("ticker", "date", "macd", "macd_signal", "macd_diff"))
register("target_abs_return", _sel("abs_return_next", ("abs_return_next",)))(
    lambda m: _wf(m).select("ticker", "date", "abs_return_next"))
register("target_forward_5d", _sel("abs_return_next", ("abs_return_next",), "feature_frame_fwd",
                                   ("ml_features_fwd",)))(
    lambda m: ind.window_features(m.prices, forward_target=True).select("ticker", "date", "abs_return_next"))
register("regime_label", _sel("abs_return_next, regime", ("abs_return_next",), "labelled"))(
    lambda m: ind.add_regime(_wf(m).select("ticker", "date", "abs_return_next"))
    .select("ticker", "date", "abs_return_next", "regime"))
register("ml_features", q(FF, "SELECT * EXCLUDE (regime), regime FROM ml_features", FEATURE_FLOATS))(
    lambda m: m.features)

register("multi_lag_returns", q(FF, """
SELECT ticker, date, adj_close, p1 AS lag_1, p5 AS lag_5, p20 AS lag_20 FROM fx_lag""",
    ("adj_close", "lag_1", "lag_5", "lag_20")))(
    lambda m: m.prices.select("ticker", "date", "adj_close",
                              *[F.lag("adj_close", n).over(by_ticker()).alias(f"lag_{n}") for n in (1, 5, 20)]))

register("feature_rolling", _sel("vol_5d, vol_20d, bb_width, volume_ratio",
                                 ("vol_5d", "vol_20d", "bb_width", "volume_ratio")))(
    lambda m: _wf(m).select("ticker", "date", "vol_5d", "vol_20d", "bb_width", "volume_ratio"))


def _moving_averages(m):
    p = F.col("adj_close")
    f50, f200 = trailing(50), trailing(200)
    return m.prices.select("ticker", "date", "adj_close",
                           full_window(F.avg(p).over(f50), p, 50, f50).alias("ma_50"),
                           full_window(F.avg(p).over(f200), p, 200, f200).alias("ma_200"))


register("moving_averages", q(("prices_daily",), """
SELECT ticker, date, adj_close,
       CASE WHEN count(adj_close) OVER w50 = 50 THEN avg(adj_close) OVER w50 END AS ma_50,
       CASE WHEN count(adj_close) OVER w200 = 200 THEN avg(adj_close) OVER w200 END AS ma_200
FROM prices_daily
WINDOW w50 AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 49 PRECEDING AND CURRENT ROW),
       w200 AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)""",
    ("adj_close", "ma_50", "ma_200")))(_moving_averages)

register("ewm", q(FF, """
SELECT l.ticker, l.date, CASE WHEN l.i >= 11 THEN r.e12 END AS ema_12, CASE WHEN l.i >= 25 THEN r.e26 END AS ema_26
FROM fx_lag l JOIN fx_rec r ON r.ticker = l.ticker AND r.i = l.i""", ("ema_12", "ema_26")))(
    lambda m: ind.ewm_means(m.prices.select("ticker", "date", "adj_close")).select(
        "ticker", "date", "ema_12", "ema_26"))

register("row_dropna", q(FF, """
SELECT f.ticker, count(*) AS n_bars, count(m.ticker) AS n_complete
FROM feature_frame f LEFT JOIN ml_features m ON m.ticker = f.ticker AND m.date = f.date
GROUP BY f.ticker"""))(
    lambda m: ind.feature_frame(m.prices).groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n_bars"),
        F.count_if(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in DROPNA_COLS])).alias("n_complete")))

register("concat_features", q(FF, """
SELECT ticker, count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date
FROM ml_features GROUP BY ticker"""))(
    lambda m: m.features.groupBy("ticker").agg(F.count(F.lit(1)).alias("n_rows"),
                                               F.min("date").alias("first_date"), F.max("date").alias("last_date")))

# ---- E1-E5 ------------------------------------------------------------------------

_HIST = ", ".join(ex.HIST_FEATURES)
_BOX = ", ".join(ex.BOX_FEATURES)

register("feature_histogram", q(FF, f"""
WITH lf AS (UNPIVOT (SELECT {_HIST} FROM ml_features WHERE regime IS NOT NULL)
            ON {_HIST} INTO NAME feature VALUE value),
rng AS (SELECT feature, min(value) AS mn, max(value) AS mx FROM lf GROUP BY feature),
cnt AS (SELECT lf.feature,
               CASE WHEN mx - mn > 0 THEN least(CAST(floor((value - mn) / (mx - mn) * 80) AS BIGINT), 79)
                    ELSE 0 END AS bin,
               count(*) AS n
        FROM lf JOIN rng USING (feature) GROUP BY ALL),
grid AS (SELECT feature, mn, mx, CAST(unnest(range(0, 80)) AS INTEGER) AS bin FROM rng)
SELECT g.feature, g.bin, g.mn + g.bin * (g.mx - g.mn) / 80 AS bin_lo, coalesce(c.n, 0) AS n
FROM grid g LEFT JOIN cnt c ON c.feature = g.feature AND c.bin = g.bin""", ("bin_lo",)))(
    lambda m: ex.feature_histogram(m.features))

register("regime_counts", q(FF, """
SELECT regime, n, n / sum(n) OVER () * 100 AS pct, max(n) OVER () / min(n) OVER () AS imbalance_ratio
FROM (SELECT regime, count(*) AS n FROM ml_features WHERE regime IS NOT NULL GROUP BY regime)""",
    ("pct", "imbalance_ratio")))(lambda m: ex.regime_counts(m.features))

register("feature_box_stats", q(FF, f"""
WITH lf AS (UNPIVOT (SELECT regime, {_BOX} FROM ml_features WHERE regime IS NOT NULL)
            ON {_BOX} INTO NAME feature VALUE value),
qs AS (SELECT feature, regime, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
              quantile_cont(value, 0.75) AS q3 FROM lf GROUP BY feature, regime),
fe AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo_f, q3 + 1.5 * (q3 - q1) AS hi_f FROM qs)
SELECT fe.feature, fe.regime, count(*) AS n, fe.q1, fe.median, fe.q3,
       min(CASE WHEN lf.value >= fe.lo_f THEN lf.value END) AS whisker_lo,
       max(CASE WHEN lf.value <= fe.hi_f THEN lf.value END) AS whisker_hi
FROM fe JOIN lf ON lf.feature = fe.feature AND lf.regime = fe.regime
GROUP BY fe.feature, fe.regime, fe.q1, fe.median, fe.q3""",
    ("q1", "median", "q3", "whisker_lo", "whisker_hi")))(lambda m: ex.feature_box_stats(m.features))


def _corr_sql() -> str:
    cols = ex.HIST_FEATURES
    parts = []
    for i, a in enumerate(cols):
        for b in cols[i:]:
            expr = (f"covar_samp({a}, {b}) / nullif(stddev_samp({a}) * stddev_samp({b}), 0)")
            parts.append(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {expr} AS correlation FROM lab")
            if a != b:
                parts.append(f"SELECT '{b}' AS feature_a, '{a}' AS feature_b, {expr} AS correlation FROM lab")
    return "WITH lab AS (SELECT * FROM ml_features WHERE regime IS NOT NULL)\n" + "\nUNION ALL\n".join(parts)


register("feature_correlation", q(FF, _corr_sql(), ("correlation",)))(lambda m: ex.feature_correlation(m.features))

register("features_with_prices", q(FF, """
SELECT f.ticker, f.date, f.vol_20d, f.rsi_14, f.regime, p.adj_close
FROM ml_features f JOIN prices_daily p ON p.ticker = f.ticker AND p.date = f.date
WHERE f.regime IS NOT NULL""", ("vol_20d", "rsi_14", "adj_close")))(
    lambda m: ex.features_with_prices(m.features, m.prices))
