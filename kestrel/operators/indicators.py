"""Technical-indicator features and volatility-regime labels (X1-X10), all tickers in one plan.

Plan shape: one Window stage per ticker computes the lagged returns, rolling
std/mean features and the target; the per-ticker tertiles are window aggregates
over the same partitioning; the recursive indicators (Wilder ATR, RSI, MACD)
are folds over (ticker, year) blocks with carried block summaries (scan.py).
Everything runs in the JVM. For series too long for one task the window stage
can run per block with a halo (``scan.in_blocks``).

Indicator recipes (fixed, the publicly documented definitions):
  RSI(14):   diff of price; up = max(diff, 0), down = max(-diff, 0), first row 0;
             EWM alpha = 1/14, adjust=False, 14 observations required;
             100 where down-average = 0, else 100 - 100 / (1 + up/down).
  MACD:      EMA12 - EMA26 (alpha = 2/(span+1), adjust=False, span rows required);
             signal = EMA9 of MACD (first at row 33); diff = MACD - signal.
  ATR(14):   TR = max(high-low, |high-prev close|, |low-prev close|), first row high-low;
             row 13 = mean(TR[0..13]); then (13*prev + TR) / 14; earlier rows 0.
  Bollinger: 20-row mean m and population std s of price; width = ((m+2s)-(m-2s))/m.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrel.config import DROPNA_COLS, SQRT_252
from kestrel.functions.exprs import by_ticker, full_window, log_return, safe_ratio, trailing
from kestrel.operators.scan import BLOCK_DAYS, scan

RSI_N, ATR_N = 14, 14
MACD_FAST, MACD_SLOW, MACD_SIGN = 12, 26, 9
MIN_LABELLED = 60
OUT_COLS = [
    "ticker", "date",
    "ret_1d", "ret_5d", "ret_20d", "vol_5d", "vol_20d", "bb_width", "atr_14",
    "rsi_14", "macd", "macd_signal", "macd_diff", "volume_ratio",
    "abs_return_next", "regime",
]


def window_features(prices: DataFrame, forward_target: bool = False) -> DataFrame:
    """X1-X4, X8 (and the TR input of X5) in one Window stage."""
    w = by_ticker()
    p = F.col("adj_close")
    staged = prices.select(
        "ticker", "date", "high", "low", "close", "adj_close", "volume",
        F.lag("adj_close", 1).over(w).alias("_p1"),
        F.lag("adj_close", 5).over(w).alias("_p5"),
        F.lag("adj_close", 20).over(w).alias("_p20"),
        F.lag("close", 1).over(w).alias("_c1"),
    )
    lr = F.col("log_return")
    staged = staged.withColumn("log_return", log_return(p, F.col("_p1")))
    f5, f20 = trailing(5), trailing(20)
    m20 = F.avg(p).over(f20)
    s20 = F.stddev_pop(p).over(f20)
    vol_m20 = F.avg("volume").over(f20)
    if forward_target:   # X8b: the documented intent, rows t+1..t+5
        tw = w.rowsBetween(1, 5)
    else:                # X8: what the pipeline computes, rows t-3..t+1
        tw = w.rowsBetween(-3, 1)
    tr = F.greatest(F.col("high") - F.col("low"),
                    F.abs(F.col("high") - F.col("_c1")), F.abs(F.col("low") - F.col("_c1")))
    return staged.select(
        "ticker", "date", "high", "low", "close", "adj_close", "volume", "log_return",
        F.col("log_return").alias("ret_1d"),
        log_return(p, F.col("_p5")).alias("ret_5d"),
        log_return(p, F.col("_p20")).alias("ret_20d"),
        full_window(F.stddev_samp(lr).over(f5) * SQRT_252, lr, 5, f5).alias("vol_5d"),
        full_window(F.stddev_samp(lr).over(f20) * SQRT_252, lr, 20, f20).alias("vol_20d"),
        full_window(safe_ratio((m20 + 2 * s20) - (m20 - 2 * s20), m20), p, 20, f20).alias("bb_width"),
        full_window(safe_ratio(F.col("volume").cast("double"), vol_m20), F.col("volume"), 20, f20)
        .alias("volume_ratio"),
        F.when(F.count(lr).over(tw) == 5, F.avg(F.abs(lr)).over(tw)).alias("abs_return_next"),
        tr.alias("true_range"), F.col("_p1").alias("prev_adj_close"),
    )


# ---- recursive indicators (block folds, see scan.py) ------------------------------

def _alpha(span: int) -> Column:
    return F.lit(2.0) / F.lit(float(span + 1))


def _zero() -> Column:
    return F.lit(0.0)


def add_recursive_indicators(wf: DataFrame, days: int = BLOCK_DAYS) -> DataFrame:
    """X5-X7; passes every input column through.

    State: fast and slow mean, signal, mean gain and loss, sum of the first true ranges, ATR. A
    block's summary also holds the factor its start state enters each of them with; signal takes
    in the two means, the ATR the sum.
    """
    fast, slow, sign = _alpha(MACD_FAST), _alpha(MACD_SLOW), _alpha(MACD_SIGN)
    rsi, start = F.lit(1.0) / F.lit(float(RSI_N)), MACD_SLOW - 1
    names = ("fast", "slow", "signal", "gain", "loss", "ranges", "atr")
    factors = {"f_fast": F.lit(1.0), "f_slow": F.lit(1.0), "f_signal": F.lit(1.0), "fast_in": _zero(), "slow_in": _zero(),
               "f_rsi": F.lit(1.0), "f_atr": F.lit(1.0), "ranges_in": _zero()}

    def step(s: Column, r: Column, i: Column) -> dict[str, Column]:
        def mean(name: str, factor: str, alpha: Column, x: Column) -> tuple[Column, Column]:
            return (F.when(i == 0, x).otherwise((1 - alpha) * s[name] + alpha * x),
                    F.when(i == 0, 0.0).otherwise((1 - alpha) * s[factor]))

        def after(at: int, before: Column, here: Column, later: Column) -> Column:
            return F.when(i < at, before).when(i == at, here).otherwise(later)

        x, diff, tr = r["adj_close"], F.coalesce(r["_diff"], _zero()), r["true_range"]
        e_fast, f_fast = mean("fast", "f_fast", fast, x)
        e_slow, f_slow = mean("slow", "f_slow", slow, x)
        macd = e_fast - e_slow
        ranges = F.when(i < ATR_N, s["ranges"] + tr).otherwise(s["ranges"])
        return {
            "fast": e_fast, "slow": e_slow,
            "signal": after(start, _zero(), macd, (1 - sign) * s["signal"] + sign * macd),
            "gain": F.when(i == 0, 0.0).otherwise((1 - rsi) * s["gain"] + rsi * F.when(diff > 0, diff).otherwise(0.0)),
            "loss": F.when(i == 0, 0.0).otherwise((1 - rsi) * s["loss"] + rsi * F.when(diff < 0, -diff).otherwise(0.0)),
            "ranges": ranges,
            "atr": after(ATR_N - 1, _zero(), ranges / ATR_N, (s["atr"] * (ATR_N - 1) + tr) / ATR_N),
            "f_fast": f_fast, "f_slow": f_slow,
            "f_signal": F.when(i <= start, 0.0).otherwise((1 - sign) * s["f_signal"]),
            "fast_in": after(start, _zero(), f_fast, (1 - sign) * s["fast_in"] + sign * f_fast),
            "slow_in": after(start, _zero(), f_slow, (1 - sign) * s["slow_in"] + sign * f_slow),
            "f_rsi": F.when(i == 0, 0.0).otherwise((1 - rsi) * s["f_rsi"]),
            "f_atr": F.when(i < ATR_N, 0.0).otherwise(s["f_atr"] * (ATR_N - 1) / ATR_N),
            "ranges_in": after(ATR_N - 1, _zero(), F.lit(1.0) / ATR_N, s["ranges_in"] * (ATR_N - 1) / ATR_N),
        }

    def compose(c: Column, b: Column) -> dict[str, Column]:
        return {
            "fast": b["f_fast"] * c["fast"] + b["fast"], "slow": b["f_slow"] * c["slow"] + b["slow"],
            "signal": b["f_signal"] * c["signal"] + b["fast_in"] * c["fast"] - b["slow_in"] * c["slow"] + b["signal"],
            "gain": b["f_rsi"] * c["gain"] + b["gain"], "loss": b["f_rsi"] * c["loss"] + b["loss"],
            "ranges": c["ranges"] + b["ranges"],
            "atr": b["f_atr"] * c["atr"] + b["ranges_in"] * c["ranges"] + b["atr"],
        }

    # The difference to the row before comes with the row: a block's first row has its in another block.
    rows = wf.withColumn("_diff", F.col("adj_close") - F.col("prev_adj_close"))
    out = scan(rows, {n: _zero() for n in names}, factors, step, compose, ["fast", "slow", "signal", "gain", "loss", "atr"], days=days)
    i, macd, signal = F.col("_i"), F.col("fast") - F.col("slow"), F.col("signal")
    ready = i >= start + MACD_SIGN - 1
    return out.select(
        *wf.columns,
        F.when(F.col("close") != 0, F.col("atr") / F.col("close")).alias("atr_14"),
        F.when(i < RSI_N - 1, None).when(F.col("loss") == 0, 100.0)
        .otherwise(100 - (100 / (1 + F.col("gain") / F.col("loss")))).alias("rsi_14"),
        F.when(i >= start, macd).alias("macd"), F.when(ready, signal).alias("macd_signal"), F.when(ready, macd - signal).alias("macd_diff"))


# ---- labels ----------------------------------------------------------------------

def add_regime(df: DataFrame, target: str = "abs_return_next", min_labelled: int = MIN_LABELLED) -> DataFrame:
    """Per-ticker tertiles of the target over the ticker's whole history.

    ``percentile`` is exact with linear interpolation (pandas ``quantile``);
    as a window aggregate over the ticker partition it needs no join back.
    Equal tertiles label 0/2 where pandas ``cut`` would reject duplicate edges.
    """
    part = Window.partitionBy("ticker")
    t = F.col(target)
    q = F.percentile(t, F.array(F.lit(1 / 3), F.lit(2 / 3))).over(part)
    n = F.count(t).over(part)
    staged = df.withColumn("_q", q).withColumn("_n", n)
    q33, q67 = F.col("_q")[0], F.col("_q")[1]
    regime = (F.when((F.col("_n") < min_labelled) | t.isNull(), F.lit(None))
              .when(t <= q33, 0).when(t <= q67, 1).otherwise(2)).cast("int")
    return staged.withColumn("regime", regime).drop("_q", "_n")


def feature_frame(prices: DataFrame, forward_target: bool = False) -> DataFrame:
    """Every bar with all features, target and regime (before the null filter)."""
    # Regime (a window aggregate) reuses the ticker partitioning of the first window.
    return add_recursive_indicators(add_regime(window_features(prices, forward_target)))


def ml_features(prices: DataFrame, forward_target: bool = False) -> DataFrame:
    """Complete feature rows (P9 dropna on 11 columns), 16 output columns."""
    return feature_frame(prices, forward_target).dropna(subset=DROPNA_COLS).select(*OUT_COLS)


def ewm_means(df: DataFrame, value: str = "adj_close", spans: tuple[int, ...] = (12, 26),
              key: str = "ticker", order: str = "date", days: int = BLOCK_DAYS) -> DataFrame:
    """Exponentially weighted means (adjust=False, ``span`` rows required) per key.

    A null value leaves the means as they are.
    """
    names = {f"ema_{s}": s for s in spans}

    def step(s: Column, r: Column, i: Column) -> dict[str, Column]:
        x, out = r[value], {}
        for name, span in names.items():
            a = _alpha(span)
            out[name] = F.when(i == 0, x).when(x.isNull(), s[name]).otherwise((1 - a) * s[name] + a * x)
            out[f"f_{name}"] = F.when(i == 0, 0.0).when(x.isNull(), s[f"f_{name}"]).otherwise((1 - a) * s[f"f_{name}"])
        return out

    def compose(c: Column, b: Column) -> dict[str, Column]:
        return {n: b[f"f_{n}"] * c[n] + b[n] for n in names}

    out = scan(df, {n: _zero() for n in names}, {f"f_{n}": F.lit(1.0) for n in names}, step, compose, list(names), key, order, days)
    return out.select(*df.columns, *(F.when(F.col("_i") >= span - 1, F.col(n)).alias(n) for n, span in names.items()))
