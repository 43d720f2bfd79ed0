"""SQL surface: the relations as temp views and the portfolio functions as SQL table functions.

    m = register_sql(spark, "/data/sf1")
    spark.sql("SELECT ticker, vol_20d FROM rolling_volatility WHERE date = DATE'2024-06-28'")
    spark.sql("SELECT * FROM portfolio_metrics(array('A','B'), array(0.6D,0.4D), DATE'2024-01-01', DATE'2024-12-31')")
    spark.sql("SELECT date, adj_close FROM prices_daily WHERE ticker = :t ORDER BY date", args={"t": "A"})

Every view is the same DataFrame plan the Python API builds (Catalyst sees
through the view). The table functions take the original array-style
arguments for one portfolio; many portfolios at once are served by
``kestrel.operators.portfolio`` keyed by ``portfolio_id`` and by the table
functions of ``kestrel.operators.walk``:

    spark.sql("SELECT * FROM portfolio_walk(TABLE(portfolio_daily_returns), path => true)")
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import SparkSession

from kestrel.config import RISK_FREE_ANNUAL, TRADING_DAYS
from kestrel.operators import portfolio as pf
from kestrel.operators import scoring as sc
from kestrel.operators import walk
from kestrel.plans.context import Market

_HOLDINGS = """p AS (
    SELECT inline(zip_with(
      CASE WHEN nullif(greatest(size({f}.tickers), 0), 0) <=> nullif(greatest(size({f}.weights), 0), 0)
           THEN CASE WHEN size({f}.tickers) > 0 THEN {f}.tickers ELSE array() END
           ELSE raise_error('tickers and weights arrays must be of the same length') END,
      CASE WHEN size({f}.weights) > 0 THEN {f}.weights ELSE array() END, (t, w) -> named_struct('ticker', t, 'weight', w))))"""

PORTFOLIO_METRICS = f"""
CREATE OR REPLACE TEMPORARY FUNCTION portfolio_metrics(
    tickers ARRAY<STRING>, weights ARRAY<DOUBLE>, start_date DATE, end_date DATE)
RETURNS TABLE (total_return DOUBLE, annualized_return DOUBLE, annualized_volatility DOUBLE,
               sharpe_ratio DOUBLE, max_drawdown DOUBLE, n_trading_days INT)
RETURN
  WITH {_HOLDINGS.format(f="portfolio_metrics")},
  daily AS (
    SELECT r.date, sum(r.log_return * p.weight) AS plr
    FROM returns_daily r JOIN p ON p.ticker = r.ticker
    WHERE r.date BETWEEN portfolio_metrics.start_date AND portfolio_metrics.end_date
      AND r.log_return IS NOT NULL
    GROUP BY r.date),
  cum AS (SELECT date, exp(sum(plr) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING)) AS wealth FROM daily),
  dd AS (SELECT (wealth - max(wealth) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING))
                / max(wealth) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS dd FROM cum),
  s AS (SELECT exp(sum(plr)) - 1 AS tr, exp(avg(plr) * {TRADING_DAYS}) - 1 AS ar,
               stddev_samp(plr) * sqrt({TRADING_DAYS}D) AS av, count(*) AS n FROM daily)
  SELECT round(tr, 4), round(ar, 4), round(av, 4),
         CASE WHEN av > 0 THEN round((ar - {RISK_FREE_ANNUAL}D) / av, 4) END,
         round((SELECT min(dd) FROM dd), 4), CAST(n AS INT)
  FROM s
"""

PORTFOLIO_SECTOR_EXPOSURE = f"""
CREATE OR REPLACE TEMPORARY FUNCTION portfolio_sector_exposure(tickers ARRAY<STRING>, weights ARRAY<DOUBLE>)
RETURNS TABLE (sector STRING, n_stocks BIGINT, total_weight DOUBLE)
RETURN
  WITH {_HOLDINGS.format(f="portfolio_sector_exposure")}
  SELECT s.sector, count(*), round(sum(p.weight), 4)
  FROM p JOIN stocks s ON s.ticker = p.ticker
  GROUP BY s.sector
"""


def register_sql(spark: SparkSession, base: str, as_of: dt.date | None = None,
                 min_overlap: int = 180) -> Market:
    """Register every relation as a temp view and the portfolio table functions."""
    m = Market(spark, base, as_of=as_of, index_as_of=None)   # as_of None: latest date in the data
    enriched = m.enriched
    views = {
        "stocks": m.stocks, "prices_daily": m.prices, "index_daily": m.index,
        "returns_daily": m.returns, "rolling_volatility": m.volatility, "rolling_sharpe": m.sharpe,
        "drawdown_daily": m.drawdown, "correlation_matrix": m.correlation(min_overlap=min_overlap),
        "ml_features": m.features, "ml_predictions": m.predictions, "predictions_enriched": enriched,
        "latest_predictions": sc.latest_predictions(enriched),
        "accuracy_by_date": sc.accuracy_by_date(m.predictions),
        "accuracy_by_sector": sc.accuracy_by_sector(enriched),
        "accuracy_by_confidence_tier": sc.accuracy_by_confidence_tier(m.predictions),
        "accuracy_by_ticker": sc.accuracy_by_ticker(enriched),
        "confusion_matrix": sc.confusion_matrix(m.predictions),
        "holdings": m.holdings, "periods": m.periods,
        "portfolio_daily_returns": pf.portfolio_daily_returns(m.prices, m.holdings, m.periods),
        "holdings_by_sector": m.holdings.join(m.stocks.select("ticker", "sector"), "ticker"),
    }
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    spark.sql(PORTFOLIO_METRICS)
    spark.sql(PORTFOLIO_SECTOR_EXPOSURE)
    walk.register_functions(spark)
    return m
