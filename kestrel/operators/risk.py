"""Rolling risk relations (V3 volatility, V4 Sharpe, V5 drawdown).

All frames share ``partitionBy(ticker).orderBy(date)`` so Catalyst plans a
single Window operator over one shuffle and one sort for every column.
SQL semantics: partial windows are emitted (a value from two observations on).

The ``_in_blocks`` forms give the same rows for series that are too long for one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.config import DAILY_RF, SQRT_252, TRADING_DAYS
from kestrel.functions.exprs import running, safe_ratio, trailing
from kestrel.operators.returns import returns_daily
from kestrel.operators.scan import BLOCK_DAYS, BLOCK_ROWS, in_blocks, running_in_blocks


def rolling_volatility(prices: DataFrame, returns: DataFrame | None = None) -> DataFrame:
    r = returns if returns is not None else returns_daily(prices)
    f20, f60 = trailing(20), trailing(60)
    lr = F.col("log_return")
    return r.select(
        "ticker", "date", "adj_close", "simple_return", "log_return",
        (F.stddev_samp(lr).over(f20) * SQRT_252).alias("vol_20d"),
        (F.stddev_samp(lr).over(f60) * SQRT_252).alias("vol_60d"),
        F.count(lr).over(f20).alias("n_obs_20d"),
    )


def rolling_sharpe(prices: DataFrame, returns: DataFrame | None = None) -> DataFrame:
    r = returns if returns is not None else returns_daily(prices)
    f60 = trailing(60)
    lr = F.col("log_return")
    out = r.select(
        "ticker", "date", "log_return",
        F.avg(lr - F.lit(DAILY_RF)).over(f60).alias("mean_excess_60d"),
        F.stddev_samp(lr).over(f60).alias("std_60d"),
        F.count(lr).over(f60).alias("n_obs_60d"),
    )
    sharpe = F.when(
        F.col("std_60d") > 0,
        (F.col("mean_excess_60d") * TRADING_DAYS) / (F.col("std_60d") * SQRT_252),
    )
    return out.select("ticker", "date", "log_return", "mean_excess_60d", "std_60d",
                      sharpe.alias("sharpe_60d"), "n_obs_60d")


def drawdown_daily(prices: DataFrame) -> DataFrame:
    peak = F.max("adj_close").over(running())
    d = prices.select("ticker", "date", "adj_close", peak.alias("running_max"))
    return d.select(
        "ticker", "date", "adj_close", "running_max",
        safe_ratio(F.col("adj_close") - F.col("running_max"), F.col("running_max")).alias("drawdown"),
    )


def volatility_in_blocks(prices: DataFrame, block_rows: int = BLOCK_ROWS, days: int = BLOCK_DAYS) -> DataFrame:
    """``rolling_volatility`` with no window longer than a block and its halo: 59 returns, 60 bars."""
    return in_blocks(prices.select("ticker", "date", "adj_close"), rolling_volatility, 60, block_rows, days=days)


def sharpe_in_blocks(prices: DataFrame, block_rows: int = BLOCK_ROWS, days: int = BLOCK_DAYS) -> DataFrame:
    return in_blocks(prices.select("ticker", "date", "adj_close"), rolling_sharpe, 60, block_rows, days=days)


def drawdown_in_blocks(prices: DataFrame, days: int = BLOCK_DAYS) -> DataFrame:
    """``drawdown_daily`` by a two-level running maximum."""
    d = running_in_blocks(prices.select("ticker", "date", "adj_close"), "running_max", F.max, F.col("adj_close"), F.greatest, days=days)
    return d.select("ticker", "date", "adj_close", "running_max",
                    safe_ratio(F.col("adj_close") - F.col("running_max"), F.col("running_max")).alias("drawdown"))


def risk_panel(prices: DataFrame) -> DataFrame:
    """Returns, volatility, Sharpe and drawdown for every bar in ONE Window operator.

    Used when several risk relations feed one answer (e.g. key metrics): all
    frames share the ticker partitioning and date order, so there is one
    shuffle and one sort instead of three windows joined back together.
    """
    r = returns_daily(prices)
    f20, f60, run = trailing(20), trailing(60), running()
    lr = F.col("log_return")
    p = r.select(
        "ticker", "date", "adj_close", "simple_return", "log_return",
        (F.stddev_samp(lr).over(f20) * SQRT_252).alias("vol_20d"),
        (F.stddev_samp(lr).over(f60) * SQRT_252).alias("vol_60d"),
        F.avg(lr - F.lit(DAILY_RF)).over(f60).alias("mean_excess_60d"),
        F.stddev_samp(lr).over(f60).alias("std_60d"),
        F.max("adj_close").over(run).alias("running_max"),
    )
    return p.select(
        "*",
        F.when(F.col("std_60d") > 0,
               (F.col("mean_excess_60d") * TRADING_DAYS) / (F.col("std_60d") * SQRT_252)).alias("sharpe_60d"),
        safe_ratio(F.col("adj_close") - F.col("running_max"), F.col("running_max")).alias("drawdown"),
    )
