"""One place that wires the base relations for a data directory."""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.config import ship_package
from kestrel.sources import adapters

BAR_SOURCES = ("lineitem", "supplier", "nation")


class Market:
    """Lazily built relations (plans, not data) for one dataset.

    ``as_of`` replaces CURRENT_DATE everywhere; ``None`` means "max date in
    the data", resolved inside each plan.
    """

    def __init__(self, spark: SparkSession, base: str,
                 as_of: dt.date | None = None,
                 index_as_of: dt.date | None = None):
        ship_package(spark)   # grouped pandas functions import kestrel in the workers
        self.spark = spark
        self.base = base
        self.as_of = as_of
        self.index_as_of = index_as_of

    @cached_property
    def stocks(self) -> DataFrame:
        return adapters.stocks(self.spark, self.base)

    @cached_property
    def prices(self) -> DataFrame:
        """The bar fact table: derived once per dataset, stored bucketed by ticker (see store.py)."""
        from kestrel.sources.store import stored
        return stored(self.spark, "bars", self.base, BAR_SOURCES,
                      lambda: adapters.prices_daily(self.spark, self.base))

    @cached_property
    def index(self) -> DataFrame:
        """The index, stored like the bars in one file by date: one row a day, read several times by the index queries."""
        from kestrel.sources.store import stored
        return stored(self.spark, "index", self.base, ("orders",), lambda: adapters.index_daily(self.spark, self.base),
                      bucket_by="date", sort_by=("date",), buckets=1)

    @cached_property
    def predictions(self) -> DataFrame:
        return adapters.predictions_from_bars(self.prices)

    @cached_property
    def derived_holdings(self) -> DataFrame:
        """Read three times by the portfolio plans; one row per ticker, so it is materialised
        once (identical plans share one cache entry) and joins see its measured size."""
        df = adapters.sector_volume_holdings(self.prices, self.stocks).persist()
        df.count()
        return df

    @cached_property
    def holdings(self) -> DataFrame:
        """Fixed parameter portfolios plus one volume-weighted portfolio per sector from the data."""
        return adapters.holdings(self.spark).unionByName(self.derived_holdings)

    @cached_property
    def periods(self) -> DataFrame:
        as_of = self.as_of if self.as_of is not None else self.prices.select(F.max("date")).scalar()
        return adapters.periods(self.spark).unionByName(adapters.derived_periods(self.derived_holdings, as_of))

    @cached_property
    def returns(self) -> DataFrame:
        from kestrel.operators.returns import returns_daily
        return returns_daily(self.prices)

    @cached_property
    def volatility(self) -> DataFrame:
        from kestrel.operators.risk import rolling_volatility
        return rolling_volatility(self.prices, self.returns)

    @cached_property
    def sharpe(self) -> DataFrame:
        from kestrel.operators.risk import rolling_sharpe
        return rolling_sharpe(self.prices, self.returns)

    @cached_property
    def drawdown(self) -> DataFrame:
        from kestrel.operators.risk import drawdown_daily
        return drawdown_daily(self.prices)

    def correlation(self, min_overlap: int = adapters.MIN_OVERLAP) -> DataFrame:
        from kestrel.operators.correlation import correlation_matrix
        # Upper bound on the ticker count from parquet footers (stocks is nation inner-joined
        # with region): sizes the block grid without a pass over the facts.
        n = self.spark.read.parquet(f"{self.base.rstrip('/')}/nation.parquet").count()
        return correlation_matrix(self.returns, as_of=self.as_of, min_overlap=min_overlap, n_tickers=n)

    @cached_property
    def enriched(self) -> DataFrame:
        from kestrel.operators.scoring import predictions_enriched
        return predictions_enriched(self.predictions, self.stocks)

    @cached_property
    def features(self) -> DataFrame:
        """The feature table (X10), stored bucketed by ticker like the bars."""
        from kestrel.operators.indicators import ml_features
        from kestrel.sources.store import stored
        return stored(self.spark, "features", self.base, BAR_SOURCES, lambda: ml_features(self.prices))
