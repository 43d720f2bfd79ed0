"""Data-quality and sanity operators.

Each check is a single aggregation (partial + final, no sort) or a
filtered top-k (TakeOrderedAndProject); nothing is collected to the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kestrel.functions.exprs import pct


def _count_row(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [_count_row(df, n) for n, df in tables.items()])


def date_coverage(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.min("date").alias("earliest"), F.max("date").alias("latest"))
             .select(F.lit(n).alias("table_name"), "earliest", "latest") for n, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def rows_per_ticker(prices: DataFrame) -> DataFrame:
    return prices.groupBy("ticker").agg(F.count(F.lit(1)).alias("n_rows"), F.min("date").alias("first_date"),
                                        F.max("date").alias("last_date")) \
        .orderBy(F.col("n_rows").desc(), "ticker")


def sector_distribution(stocks: DataFrame) -> DataFrame:
    return stocks.groupBy("sector").agg(F.count(F.lit(1)).alias("n_stocks")) \
        .orderBy(F.col("n_stocks").desc(), "sector")


def null_prices(prices: DataFrame) -> DataFrame:
    return prices.agg(*[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in ("close", "volume", "open")])


def nonpositive_prices(prices: DataFrame) -> DataFrame:
    bad = reduce(lambda a, b: a | b, [F.col(c) <= 0 for c in ("close", "open", "high", "low")])
    return prices.agg(F.count_if(bad).alias("n_nonpositive"))


def high_lt_low(prices: DataFrame) -> DataFrame:
    return prices.agg(F.count_if(F.col("high") < F.col("low")).alias("n_high_lt_low"))


def orphan_tickers(prices: DataFrame, stocks: DataFrame) -> DataFrame:
    orphans = prices.select("ticker").join(stocks.select("ticker"), "ticker", "left_anti")
    return orphans.agg(F.count_distinct("ticker").alias("n_orphan_tickers"))


def extreme_return_count(returns: DataFrame, bound: float = 0.5) -> DataFrame:
    r = F.col("simple_return")
    return returns.agg(F.count_if((r < -bound) | (r > bound)).alias("n_extreme"))


def extreme_returns(returns: DataFrame, n: int = 10) -> DataFrame:
    return returns.filter(F.col("simple_return").isNotNull()) \
        .orderBy(F.abs("simple_return").desc(), "ticker", "date").limit(n) \
        .select("ticker", "date", "simple_return", "log_return")


def null_returns(returns: DataFrame) -> DataFrame:
    return returns.agg(F.count_if(F.col("simple_return").isNull()).alias("n_null_returns"),
                       F.count_distinct("ticker").alias("n_tickers"))


def vol_stats(vol: DataFrame) -> DataFrame:
    v = vol.filter(F.col("vol_20d").isNotNull() & (F.col("n_obs_20d") == 20))
    return v.agg(F.round(F.avg("vol_20d"), 4).alias("avg_vol_20d"), F.round(F.avg("vol_60d"), 4).alias("avg_vol_60d"),
                 F.round(F.min("vol_20d"), 4).alias("min_vol_20d"), F.round(F.max("vol_20d"), 4).alias("max_vol_20d"))


def sharpe_top(sharpe: DataFrame, n: int = 10) -> DataFrame:
    s = sharpe.filter(F.col("sharpe_60d").isNotNull() & (F.col("n_obs_60d") == 60))
    return s.orderBy(F.col("sharpe_60d").desc(), "ticker", "date").limit(n) \
        .select("ticker", "date", F.round("sharpe_60d", 3).alias("sharpe_60d"))


def worst_current_drawdowns(drawdown: DataFrame, n: int = 10) -> DataFrame:
    latest = drawdown.select(F.max("date")).scalar()  # one-row scalar subquery
    return drawdown.filter(F.col("date") == latest).orderBy(F.col("drawdown").asc_nulls_last(), "ticker").limit(n) \
        .select("ticker", "adj_close", F.round("running_max", 2).alias("running_max"),
                pct(F.col("drawdown")).alias("drawdown_pct"))


def worst_drawdown_per_ticker(drawdown: DataFrame, n: int = 10) -> DataFrame:
    w = drawdown.groupBy("ticker").agg(F.min("drawdown").alias("worst_drawdown"))
    return w.orderBy(F.col("worst_drawdown").asc_nulls_last(), "ticker").limit(n) \
        .select("ticker", "worst_drawdown", pct(F.col("worst_drawdown")).alias("worst_drawdown_pct"))


def corr_diagonal(corr: DataFrame) -> DataFrame:
    d = corr.filter(F.col("ticker_a") == F.col("ticker_b"))
    return d.agg(F.count(F.lit(1)).alias("n_self"), F.min("correlation").alias("min_corr"),
                 F.max("correlation").alias("max_corr"))


def corr_extremes(corr: DataFrame, peer_of: str, n: int = 10, n_peers: int = 5) -> DataFrame:
    """The n most and least correlated pairs and the closest peers of one ticker, from one pass over
    the matrix: every row is tagged with the lists it may enter, and a window group limit keeps
    each task's best rows of a list before they are exchanged."""
    a, b, c = F.col("ticker_a"), F.col("ticker_b"), F.col("correlation")
    kinds = F.filter(F.array(F.when(a < b, "most"), F.when(a < b, "least"),
                             F.when((a == peer_of) & (b != peer_of), "peer")), lambda k: k.isNotNull())
    tagged = corr.withColumn("kind", F.explode(kinds))
    falling = F.col("kind") != "least"
    # NULL correlations lead the falling lists and end the rising one.
    w = Window.partitionBy("kind").orderBy(F.when(falling, c.isNotNull()).otherwise(c.isNull()),
                                           F.when(falling, -c).otherwise(c), "ticker_a", "ticker_b")
    ranked = tagged.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= max(n, n_peers))
    return ranked.filter(F.col("rank") <= F.when(F.col("kind") == "peer", n_peers).otherwise(n)).select(
        "kind", "ticker_a", "ticker_b", F.round("correlation", 3).alias("corr"), "n_overlap_days")


def avg_pairwise_corr(corr: DataFrame) -> DataFrame:
    return corr.filter(F.col("ticker_a") < F.col("ticker_b")).agg(
        F.round(F.avg("correlation"), 3).alias("avg_corr"), F.count(F.lit(1)).alias("n_pairs"))


def feature_ranges(features: DataFrame) -> DataFrame:
    r = lambda c, d, f, name: F.round(f(c), d).alias(name)
    return features.agg(
        r("rsi_14", 2, F.avg, "avg_rsi"), r("rsi_14", 2, F.min, "min_rsi"), r("rsi_14", 2, F.max, "max_rsi"),
        r("vol_20d", 4, F.avg, "avg_vol_20d"), r("vol_20d", 4, F.max, "max_vol_20d"),
        r("atr_14", 4, F.avg, "avg_atr"), r("bb_width", 4, F.avg, "avg_bb_width"),
        r("volume_ratio", 2, F.avg, "avg_volume_ratio"), r("volume_ratio", 2, F.max, "max_volume_ratio"),
        r("ret_1d", 6, F.avg, "avg_ret_1d"), r("ret_1d", 4, F.stddev_samp, "std_ret_1d"),
        r("ret_1d", 3, F.min, "min_ret_1d"), r("ret_1d", 3, F.max, "max_ret_1d"),
        r("ret_5d", 6, F.avg, "avg_ret_5d"), r("ret_20d", 6, F.avg, "avg_ret_20d"),
    )


def class_balance(features: DataFrame) -> DataFrame:
    lab = features.filter(F.col("regime").isNotNull())
    total = lab.select(F.count(F.lit(1))).scalar()
    n_null = features.select(F.count_if(F.col("regime").isNull())).scalar()
    return lab.groupBy("regime").agg(F.count(F.lit(1)).alias("n")).select(
        "regime", "n", F.round(F.col("n") * 100.0 / total, 2).alias("pct"), n_null.alias("n_null_regime"))


def balance_per_ticker(features: DataFrame, tickers: list[str]) -> DataFrame:
    g = F.col("regime")
    return features.filter(F.col("ticker").isin(tickers)).groupBy("ticker").agg(
        F.count_if(g == 0).alias("low_n"), F.count_if(g == 1).alias("med_n"), F.count_if(g == 2).alias("high_n"))


NULL_AUDIT_COLS = ["ret_1d", "vol_20d", "bb_width", "atr_14", "rsi_14", "macd", "volume_ratio"]


def null_audit(features: DataFrame) -> DataFrame:
    return features.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in NULL_AUDIT_COLS])


def coverage(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("ticker").alias("n_tickers"),
                    F.min("date").alias("first_date"), F.max("date").alias("last_date"))
             .select(F.lit(n).alias("relation"), "*") for n, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def recent_rows(df: DataFrame, cols: list[str], n: int = 5, ticker: str | None = None) -> DataFrame:
    if ticker is not None:
        df = df.filter(F.col("ticker") == ticker)
    return df.orderBy(F.col("date").desc()).limit(n).select(*cols)
