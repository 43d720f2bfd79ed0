"""Portfolio table functions (UF1, UF2): one pass over a portfolio's ordered rows.

    SELECT * FROM portfolio_walk(TABLE(portfolio_daily_returns))
    SELECT * FROM portfolio_walk(TABLE(portfolio_daily_returns), path => true)
    SELECT * FROM portfolio_exposure(TABLE(holdings_by_sector))

``analyze`` checks the input columns when the query is planned, picks the result's columns
and asks for its own partitioning (``portfolio_id``) and order, so a caller cannot forget
them. Wealth, running maximum, drawdown and the moments are carried from row to row: a
portfolio of any length takes a few numbers of memory, where the window form keeps two
frames over the series. The functions see one row per portfolio and day (or holding), never
the bars; the join and the daily sums before them stay in the JVM.

Defined results: rows without a return (NULL) or without a portfolio are left out; a portfolio
without rows has none here (``portfolio_metrics_walk`` gives it one with n = 0); a NULL weight
counts as a holding and adds nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import Row
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from kestrel.config import RISK_FREE_ANNUAL, TRADING_DAYS
from kestrel.operators.portfolio import portfolio_daily_returns

DAILY = ("portfolio_id", "date", "portfolio_log_return")
HELD = ("portfolio_id", "sector", "weight")
SUMMARY = T.StructType([
    T.StructField("portfolio_id", T.StringType()), T.StructField("total_return", T.DoubleType()),
    T.StructField("annualized_return", T.DoubleType()), T.StructField("annualized_volatility", T.DoubleType()),
    T.StructField("sharpe_ratio", T.DoubleType()), T.StructField("max_drawdown", T.DoubleType()),
    T.StructField("n_trading_days", T.IntegerType())])
PATH = T.StructType([
    T.StructField("portfolio_id", T.StringType()), T.StructField("date", T.DateType()),
    T.StructField("portfolio_log_return", T.DoubleType()), T.StructField("wealth", T.DoubleType()),
    T.StructField("running_max", T.DoubleType()), T.StructField("drawdown", T.DoubleType())])
EXPOSURE = T.StructType([
    T.StructField("portfolio_id", T.StringType()), T.StructField("sector", T.StringType()),
    T.StructField("n_stocks", T.LongType()), T.StructField("total_weight", T.DoubleType())])


def _require(rows: AnalyzeArgument, columns: tuple[str, ...]) -> None:
    if not rows.isTable:
        raise ValueError("the first argument must be a table: TABLE(...)")
    missing = [c for c in columns if c not in rows.dataType.fieldNames()]
    if missing:
        raise ValueError(f"the input table lacks the columns {', '.join(missing)}")


class PortfolioWalk:
    """One row per portfolio, or one per day with ``path => true``."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, path: AnalyzeArgument | None = None) -> AnalyzeResult:
        _require(rows, DAILY)
        if path is not None and (not path.isConstantExpression or not isinstance(path.dataType, T.BooleanType)):
            raise ValueError("path must be a boolean constant")
        return AnalyzeResult(PATH if path is not None and path.value else SUMMARY,
                             partitionBy=[PartitioningColumn("portfolio_id")], orderBy=[OrderingColumn("date")])

    def __init__(self) -> None:
        self.portfolio: str | None = None
        self.n, self.total, self.mean, self.squares = 0, 0.0, 0.0, 0.0
        self.top, self.worst, self.summary = 0.0, 0.0, True

    def eval(self, rows: Row, path: bool = False) -> Iterator[tuple]:
        self.summary = not path
        r = rows["portfolio_log_return"]
        if r is None or rows["portfolio_id"] is None:
            return
        self.portfolio = rows["portfolio_id"]
        self.n += 1
        self.total += r
        step = r - self.mean
        self.mean += step / self.n
        self.squares += step * (r - self.mean)
        wealth = math.exp(self.total)
        self.top = max(self.top, wealth)
        drawdown = (wealth - self.top) / self.top
        self.worst = min(self.worst, drawdown)
        if path:
            yield self.portfolio, rows["date"], r, wealth, self.top, drawdown

    def terminate(self) -> Iterator[tuple]:
        if not self.summary or not self.n:
            return
        annual = math.exp(self.total / self.n * TRADING_DAYS) - 1
        vol = math.sqrt(self.squares / (self.n - 1) * TRADING_DAYS) if self.n > 1 else None
        sharpe = (annual - RISK_FREE_ANNUAL) / vol if vol else None
        yield self.portfolio, math.exp(self.total) - 1, annual, vol, sharpe, self.worst, self.n


class PortfolioExposure:
    """Number and weight of a portfolio's holdings per sector; rows arrive by sector."""

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        _require(rows, HELD)
        return AnalyzeResult(EXPOSURE, partitionBy=[PartitioningColumn("portfolio_id"), PartitioningColumn("sector")])

    def __init__(self) -> None:
        self.key: tuple | None = None
        self.n, self.weight = 0, None

    def eval(self, rows: Row) -> None:
        self.key = rows["portfolio_id"], rows["sector"]
        self.n += 1
        if rows["weight"] is not None:
            self.weight = (self.weight or 0.0) + rows["weight"]

    def terminate(self) -> Iterator[tuple]:
        if self.key is not None:
            yield *self.key, self.n, self.weight


def register_functions(spark: SparkSession) -> None:
    """``portfolio_walk`` and ``portfolio_exposure`` in the session's SQL."""
    spark.udtf.register("portfolio_walk", F.udtf(PortfolioWalk))
    spark.udtf.register("portfolio_exposure", F.udtf(PortfolioExposure))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[F.round(c, 4).alias(c) if c in columns else F.col(c) for c in df.columns])


def portfolio_metrics_walk(prices: DataFrame, holdings: DataFrame, periods: DataFrame) -> DataFrame:
    """The relation of ``portfolio_metrics`` by the table function: one exchange by portfolio after the daily sums."""
    spark = prices.sparkSession
    register_functions(spark)
    daily = portfolio_daily_returns(prices, holdings, periods)
    walked = spark.sql("SELECT * FROM portfolio_walk(TABLE({daily}))", daily=daily)
    out = periods.select("portfolio_id").distinct().join(walked, "portfolio_id", "left") \
        .withColumn("n_trading_days", F.coalesce("n_trading_days", F.lit(0)))
    return _rounded(out, *SUMMARY.names[1:-1])


def portfolio_path(prices: DataFrame, holdings: DataFrame, periods: DataFrame) -> DataFrame:
    """Per portfolio and day: return, wealth, running maximum and drawdown."""
    spark = prices.sparkSession
    register_functions(spark)
    daily = portfolio_daily_returns(prices, holdings, periods)
    return spark.sql("SELECT * FROM portfolio_walk(TABLE({daily}), path => true)", daily=daily)


def portfolio_exposure_walk(holdings: DataFrame, stocks: DataFrame) -> DataFrame:
    """The relation of ``portfolio_sector_exposure`` by the table function."""
    spark = holdings.sparkSession
    register_functions(spark)
    held = holdings.join(stocks.select("ticker", "sector"), "ticker").select(*HELD)
    return _rounded(spark.sql("SELECT * FROM portfolio_exposure(TABLE({held}))", held=held), "total_weight")
