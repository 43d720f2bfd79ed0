"""Portfolio operators (PF1-PF7), evaluated for many portfolios at once.

Holdings are a DataFrame ``(portfolio_id, ticker, weight)`` and periods
``(portfolio_id, start_date, end_date)``; the reference's parallel arrays are
accepted through :func:`holdings_from_arrays`. Every window and aggregate is
keyed by ``portfolio_id`` (a portfolio's series holds one row per day), so no
step runs as a single global partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kestrel.config import RISK_FREE_ANNUAL, SQRT_252, TRADING_DAYS
from kestrel.functions.exprs import broadcast_if_small
from kestrel.operators.returns import returns_daily
from kestrel.sources.adapters import HOLDINGS_SCHEMA

UNIVERSE_SLICES = 64


class PortfolioArrayError(ValueError):
    pass


def check_arrays(tickers, weights) -> None:
    """PF7: the arrays must have the same length; NULL and empty count as equal."""
    lt = None if tickers is None or len(tickers) == 0 else len(tickers)
    lw = None if weights is None or len(weights) == 0 else len(weights)
    if lt != lw:
        raise PortfolioArrayError("tickers and weights arrays must be of the same length")


def holdings_from_arrays(spark: SparkSession, portfolio_id: str, tickers, weights) -> DataFrame:
    check_arrays(tickers, weights)
    rows = [(portfolio_id, t, float(w)) for t, w in zip(tickers or [], weights or [])]
    return spark.createDataFrame(rows, HOLDINGS_SCHEMA)


def _length(c: str) -> F.Column:
    """NULL for a NULL or empty array: both mean "no elements" to the guard."""
    return F.nullif(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0))


def holdings_from_array_columns(df: DataFrame) -> DataFrame:
    """``(portfolio_id, tickers array, weights array)`` -> rows; unequal lengths raise at run time,
    portfolios without elements have no rows."""
    guarded = df.select(
        "portfolio_id",
        F.when(_length("tickers").eqNullSafe(_length("weights")), F.arrays_zip("tickers", "weights"))
        .otherwise(F.raise_error(F.lit("tickers and weights arrays must be of the same length")))
        .alias("z"),
    )
    return guarded.select("portfolio_id", F.inline("z")).select(
        "portfolio_id", F.col("tickers").alias("ticker"), F.col("weights").cast("double").alias("weight"))


def portfolio_daily_returns(prices: DataFrame, holdings: DataFrame, periods: DataFrame) -> DataFrame:
    """Weighted daily log return per (portfolio_id, date) inside each period.

    Returns are computed over the full history of held tickers first (the
    range filter applies after LAG, so the first day in range has a return).
    Holdings with their periods are broadcast where their measured size allows:
    the bars then stay in the tasks of their bucket up to the daily sums.
    """
    h = broadcast_if_small(holdings.join(broadcast_if_small(periods), "portfolio_id"))
    held = broadcast_if_small(holdings.select("ticker").distinct())
    r = returns_daily(prices.join(held, "ticker", "left_semi"))
    j = r.join(h, "ticker").filter(
        F.col("date").between(F.col("start_date"), F.col("end_date")) & F.col("log_return").isNotNull()
    )
    return j.groupBy("portfolio_id", "date").agg(
        F.sum(F.col("log_return") * F.col("weight")).alias("portfolio_log_return")
    )


def portfolio_metrics(prices: DataFrame, holdings: DataFrame, periods: DataFrame) -> DataFrame:
    """PF1: total / annualised return, volatility, Sharpe, max drawdown, n days, all rounded to 4.

    A portfolio whose range has no returns still yields one row (n = 0, NULLs).
    """
    daily = portfolio_daily_returns(prices, holdings, periods)
    w = Window.partitionBy("portfolio_id").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    wealth = daily.withColumn("cum_wealth", F.exp(F.sum("portfolio_log_return").over(w)))
    dd = wealth.withColumn("running_max", F.max("cum_wealth").over(w)).withColumn(
        "dd", (F.col("cum_wealth") - F.col("running_max")) / F.col("running_max"))
    r = F.col("portfolio_log_return")
    summary = dd.groupBy("portfolio_id").agg(
        (F.exp(F.sum(r)) - 1).alias("total_ret"),
        (F.exp(F.avg(r) * TRADING_DAYS) - 1).alias("ann_ret"),
        (F.stddev_samp(r) * SQRT_252).alias("ann_vol"),
        F.count(F.lit(1)).alias("n_days"),
        F.min("dd").alias("max_dd"),
    )
    ids = periods.select("portfolio_id").distinct()
    out = ids.join(summary, "portfolio_id", "left")
    return out.select(
        "portfolio_id",
        F.round("total_ret", 4).alias("total_return"),
        F.round("ann_ret", 4).alias("annualized_return"),
        F.round("ann_vol", 4).alias("annualized_volatility"),
        F.when(F.col("ann_vol") > 0, F.round((F.col("ann_ret") - RISK_FREE_ANNUAL) / F.col("ann_vol"), 4))
        .alias("sharpe_ratio"),
        F.round("max_dd", 4).alias("max_drawdown"),
        F.coalesce(F.col("n_days"), F.lit(0)).cast("int").alias("n_trading_days"),
    )


def portfolio_sector_exposure(holdings: DataFrame, stocks: DataFrame) -> DataFrame:
    """PF2: per sector count and total weight; unknown tickers drop out."""
    s = stocks.select("ticker", "sector")
    return holdings.join(s, "ticker").groupBy("portfolio_id", "sector").agg(
        F.count(F.lit(1)).alias("n_stocks"),
        F.round(F.sum("weight"), 4).alias("total_weight"),
    ).orderBy("portfolio_id", F.col("total_weight").desc_nulls_first(), "sector")


def portfolio_candidates(holdings: DataFrame, stocks: DataFrame) -> DataFrame:
    """PF3: per portfolio, the tickers of the universe it does not hold.

    Portfolios are repeated once per slice of the universe and joined by slice; what a
    portfolio holds is taken out by an anti join. No task holds the universe or a portfolio.
    """
    slice_of = F.pmod(F.xxhash64("ticker"), F.lit(UNIVERSE_SLICES)).cast("int")
    universe = stocks.filter(F.col("ticker").isNotNull()).select("ticker").distinct().withColumn("slice", slice_of)
    ids = holdings.select("portfolio_id").distinct().withColumn(
        "slice", F.explode(F.sequence(F.lit(0), F.lit(UNIVERSE_SLICES - 1))))
    return ids.join(universe, "slice").select("portfolio_id", "ticker") \
        .join(holdings.select("portfolio_id", "ticker"), ["portfolio_id", "ticker"], "left_anti")


def portfolio_normalize(holdings: DataFrame) -> DataFrame:
    """PF4: w / sum(w) when the sum is positive, else unchanged."""
    tot = F.sum("weight").over(Window.partitionBy("portfolio_id"))
    return holdings.select("portfolio_id", "ticker",
                           F.when(tot > 0, F.col("weight") / tot).otherwise(F.col("weight")).alias("weight"))


def portfolio_add(holdings: DataFrame, additions: DataFrame) -> DataFrame:
    """PF5: add one ticker per portfolio at 1/n and rescale the others to fill 1 - 1/n."""
    part = Window.partitionBy("portfolio_id")
    n_new = F.count(F.lit(1)).over(part) + 1
    tot = F.sum("weight").over(part)
    scaled = holdings.join(additions.select("portfolio_id"), "portfolio_id", "left_semi").select(
        "portfolio_id", "ticker",
        F.when(tot > 0, F.col("weight") * ((1.0 - 1.0 / n_new) / tot)).otherwise(F.col("weight")).alias("weight"),
    )
    counts = holdings.groupBy("portfolio_id").agg(F.count(F.lit(1)).alias("n_old"))
    new_rows = additions.join(counts, "portfolio_id", "left").select(
        "portfolio_id", "ticker", (1.0 / (F.coalesce("n_old", F.lit(0)) + 1)).alias("weight"))
    untouched = holdings.join(additions.select("portfolio_id"), "portfolio_id", "left_anti")
    return untouched.unionByName(scaled).unionByName(new_rows)


def portfolio_weight_check(holdings: DataFrame, periods: DataFrame) -> DataFrame:
    """PF6: weight-sum status and whether the portfolio can be analysed."""
    s = holdings.groupBy("portfolio_id").agg(F.sum("weight").alias("total_weight"),
                                            F.count(F.lit(1)).alias("n_holdings"))
    s = periods.join(s, "portfolio_id", "left")
    tw = F.coalesce(F.col("total_weight"), F.lit(0.0))
    ok = F.abs(tw - 1.0) < 0.001
    status = F.when(ok, "ok").when(tw < 1.0, "under").otherwise("over")
    return s.select(
        "portfolio_id", tw.alias("total_weight"), status.alias("status"),
        F.when(ok, 0.0).otherwise(F.abs(1.0 - tw)).alias("off_by"),
        (ok & (F.coalesce("n_holdings", F.lit(0)) > 0) & (F.col("start_date") < F.col("end_date"))).alias("can_analyze"),
    )
