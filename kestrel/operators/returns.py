"""Daily and monthly returns (V1, V2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kestrel.functions.exprs import by_ticker, log_return, simple_return


def returns_daily(prices: DataFrame) -> DataFrame:
    """ticker, date, adj_close, prev_close, simple_return, log_return.

    The first bar of every ticker has NULL returns. One Window operator
    (shuffle on ticker, sort on date); filters on dates belong above it.
    """
    lagged = prices.select(
        "ticker", "date", "adj_close",
        F.lag("adj_close").over(by_ticker()).alias("prev_close"),
    )
    p, prev = F.col("adj_close"), F.col("prev_close")
    return lagged.select(
        "ticker", "date", "adj_close", "prev_close",
        simple_return(p, prev).alias("simple_return"),
        log_return(p, prev).alias("log_return"),
    )


def month_end(prices: DataFrame) -> DataFrame:
    """Last bar per (ticker, month) in one partial+final aggregation (no join back)."""
    return prices.groupBy("ticker", F.trunc("date", "month").alias("month")).agg(
        F.max("date").alias("month_end_date"),
        F.max_by("adj_close", "date").alias("month_end_price"),
    )


def returns_monthly(prices: DataFrame) -> DataFrame:
    """Month-end to month-end returns; a month without bars is skipped over (lag by row)."""
    m = month_end(prices)
    w = Window.partitionBy("ticker").orderBy("month")
    m = m.withColumn("prev_month_price", F.lag("month_end_price").over(w))
    p, prev = F.col("month_end_price"), F.col("prev_month_price")
    return m.select(
        "ticker", "month", "month_end_date", "month_end_price", "prev_month_price",
        simple_return(p, prev).alias("simple_return"),
        log_return(p, prev).alias("log_return"),
    )
