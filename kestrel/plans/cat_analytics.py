"""Registered keys: scans, analytic relations (V1-V6) and named queries (Q1-Q29)."""

from __future__ import annotations

from kestrel.operators import risk
from kestrel.operators.returns import month_end, returns_monthly
from kestrel.plans import named as N
from kestrel.plans.oracle import AS_OF, INDEX_AS_OF, TICKER, q
from kestrel.plans.registry import register

# ---- S1 / V1-V6 ----------------------------------------------------------------

register("scan_prices", q(("prices_daily",), "SELECT * FROM prices_daily",
                          ("open", "high", "low", "close", "adj_close")))(lambda m: m.prices)

register("returns_daily", q(("returns_daily",), "SELECT * FROM returns_daily",
                            ("adj_close", "prev_close", "simple_return", "log_return")))(lambda m: m.returns)

register("returns_monthly", q(("prices_daily",), """
SELECT ticker, month, month_end_date, month_end_price, prev_month_price,
       CASE WHEN prev_month_price IS NOT NULL AND prev_month_price <> 0
            THEN (month_end_price - prev_month_price) / prev_month_price END AS simple_return,
       CASE WHEN prev_month_price > 0 AND month_end_price > 0
            THEN ln(month_end_price / prev_month_price) END AS log_return
FROM (SELECT *, lag(month_end_price) OVER (PARTITION BY ticker ORDER BY month) AS prev_month_price
      FROM (SELECT DISTINCT ON (ticker, month) ticker, CAST(date_trunc('month', date) AS DATE) AS month,
                   date AS month_end_date, adj_close AS month_end_price
            FROM prices_daily ORDER BY ticker, month, date DESC))""",
    ("month_end_price", "prev_month_price", "simple_return", "log_return")))(lambda m: returns_monthly(m.prices))

register("month_end", q(("prices_daily",), """
SELECT DISTINCT ON (ticker, month) ticker, CAST(date_trunc('month', date) AS DATE) AS month,
       date AS month_end_date, adj_close AS month_end_price
FROM prices_daily ORDER BY ticker, month, date DESC""", ("month_end_price",)))(lambda m: month_end(m.prices))

register("rolling_volatility", q(("rolling_volatility",), "SELECT * FROM rolling_volatility",
                                 ("adj_close", "simple_return", "log_return", "vol_20d", "vol_60d")))(
    lambda m: m.volatility)

register("rolling_sharpe", q(("rolling_sharpe",), "SELECT * FROM rolling_sharpe",
                             ("log_return", "mean_excess_60d", "std_60d", "sharpe_60d")))(lambda m: m.sharpe)

register("drawdown_daily", q(("drawdown_daily",), "SELECT * FROM drawdown_daily",
                             ("adj_close", "running_max", "drawdown")))(lambda m: m.drawdown)

# The same relations cut into blocks of the time axis, for series too long for one task.
register("rolling_volatility_in_blocks", q(("rolling_volatility",), "SELECT * FROM rolling_volatility",
                                           ("adj_close", "simple_return", "log_return", "vol_20d", "vol_60d")))(
    lambda m: risk.volatility_in_blocks(m.prices, 500))

register("rolling_sharpe_in_blocks", q(("rolling_sharpe",), "SELECT * FROM rolling_sharpe",
                                       ("log_return", "mean_excess_60d", "std_60d", "sharpe_60d")))(
    lambda m: risk.sharpe_in_blocks(m.prices, 500))

register("drawdown_in_blocks", q(("drawdown_daily",), "SELECT * FROM drawdown_daily",
                                 ("adj_close", "running_max", "drawdown")))(lambda m: risk.drawdown_in_blocks(m.prices))

register("correlation_matrix", q(("correlation_matrix",), "SELECT * FROM correlation_matrix",
                                 ("correlation",)))(lambda m: m.correlation())

# ---- Q1-Q29 --------------------------------------------------------------------

register("index_history", q(("index_daily",), f"""
SELECT date, close FROM index_daily
WHERE date >= {INDEX_AS_OF} - INTERVAL 5 YEAR AND date <= {INDEX_AS_OF}""", ("close",)))(N.index_history)

_YTD = f"""ytd AS (
  SELECT s.sector, (l.price_now - y.price_then) / y.price_then * 100 AS chg
  FROM stocks s
  JOIN (SELECT DISTINCT ON (ticker) ticker, adj_close AS price_then FROM prices_daily
        WHERE date >= date_trunc('year', {AS_OF}) AND date <= {AS_OF} ORDER BY ticker, date) y
    ON y.ticker = s.ticker
  JOIN (SELECT DISTINCT ON (ticker) ticker, adj_close AS price_now FROM prices_daily
        WHERE date <= {AS_OF} ORDER BY ticker, date DESC) l ON l.ticker = s.ticker),
sector_ytd AS (
  SELECT sector, count(*) AS n_stocks, round(avg(chg), 2) AS avg_ytd_return_pct FROM ytd GROUP BY sector)"""

register("sector_performance_ytd", q(("stocks", "prices_daily"), f"WITH {_YTD} SELECT * FROM sector_ytd",
                                     ("avg_ytd_return_pct",)))(N.sector_performance_ytd)


def _movers_sql(col: str, start_cond: str, order: str, limit: int) -> str:
    return f"""
SELECT * FROM (
  SELECT s.ticker, s.company_name, s.sector,
         round((l.price_now - sp.price_then) / sp.price_then * 100, 2) AS {col}
  FROM stocks s
  JOIN (SELECT DISTINCT ON (ticker) ticker, adj_close AS price_then FROM prices_daily
        WHERE {start_cond} ORDER BY ticker, date DESC) sp ON sp.ticker = s.ticker
  JOIN (SELECT DISTINCT ON (ticker) ticker, adj_close AS price_now FROM prices_daily
        WHERE date <= {AS_OF} ORDER BY ticker, date DESC) l ON l.ticker = s.ticker)
ORDER BY {col} {order}, ticker LIMIT {limit}"""


register("top_gainers", q(("stocks", "prices_daily"),
                          _movers_sql("return_pct", f"date <= {AS_OF} - INTERVAL 365 DAY", "DESC NULLS FIRST", 5),
                          ("return_pct",)))(N.top_gainers)
register("top_losers", q(("stocks", "prices_daily"),
                         _movers_sql("return_pct", f"date <= {AS_OF} - INTERVAL 365 DAY", "ASC NULLS LAST", 5),
                         ("return_pct",)))(N.top_losers)

register("stock_price_history", q(("prices_daily",), f"""
SELECT date, open, high, low, close, adj_close, volume FROM prices_daily WHERE ticker = {TICKER}""",
    ("open", "high", "low", "close", "adj_close")))(N.stock_price_history)

register("stock_volatility", q(("rolling_volatility",), f"""
SELECT date, adj_close, vol_20d, vol_60d FROM rolling_volatility
WHERE ticker = {TICKER} AND vol_20d IS NOT NULL""", ("adj_close", "vol_20d", "vol_60d")))(N.stock_volatility)

register("stock_drawdown", q(("drawdown_daily",), f"""
SELECT date, adj_close, running_max, drawdown FROM drawdown_daily WHERE ticker = {TICKER}""",
    ("adj_close", "running_max", "drawdown")))(N.stock_drawdown)

register("stock_key_metrics", q(("stocks", "prices_daily", "rolling_volatility", "rolling_sharpe", "drawdown_daily"), """
SELECT s.ticker, s.company_name, s.sector,
       lp.adj_close AS latest_price,
       round(lv.vol_60d, 4) AS current_vol_60d,
       round(ls.sharpe_60d, 3) AS current_sharpe_60d,
       round(wd.worst, 4) AS worst_drawdown,
       round(cd.drawdown, 4) AS current_drawdown
FROM stocks s
LEFT JOIN (SELECT DISTINCT ON (ticker) ticker, adj_close FROM prices_daily ORDER BY ticker, date DESC) lp
  ON lp.ticker = s.ticker
LEFT JOIN (SELECT DISTINCT ON (ticker) ticker, vol_60d FROM rolling_volatility WHERE vol_60d IS NOT NULL
           ORDER BY ticker, date DESC) lv ON lv.ticker = s.ticker
LEFT JOIN (SELECT DISTINCT ON (ticker) ticker, sharpe_60d FROM rolling_sharpe WHERE sharpe_60d IS NOT NULL
           ORDER BY ticker, date DESC) ls ON ls.ticker = s.ticker
LEFT JOIN (SELECT ticker, min(drawdown) AS worst FROM drawdown_daily GROUP BY ticker) wd ON wd.ticker = s.ticker
LEFT JOIN (SELECT DISTINCT ON (ticker) ticker, drawdown FROM drawdown_daily ORDER BY ticker, date DESC) cd
  ON cd.ticker = s.ticker""",
    ("latest_price", "current_vol_60d", "current_sharpe_60d", "worst_drawdown", "current_drawdown")))(
    N.stock_key_metrics)

register("available_tickers", q(("stocks",), "SELECT ticker, company_name, sector FROM stocks"))(N.available_tickers)

register("latest_prediction_for_ticker", q(("latest_predictions",), f"""
SELECT ticker, company_name, sector, date, predicted_label, confidence_tier,
       round(confidence, 3) AS confidence, round(prob_low, 3) AS prob_low,
       round(prob_medium, 3) AS prob_medium, round(prob_high, 3) AS prob_high
FROM latest_predictions WHERE ticker = {TICKER}""",
    ("confidence", "prob_low", "prob_medium", "prob_high")))(N.latest_prediction_for_ticker)

register("predictions_heatmap", q(("latest_predictions",), """
SELECT ticker, sector, predicted_label, confidence, prob_low, prob_medium, prob_high
FROM latest_predictions""", ("confidence", "prob_low", "prob_medium", "prob_high")))(N.predictions_heatmap)

_ACC = """count(*) AS n_predictions, count(*) FILTER (WHERE correct) AS n_correct,
       round(count(*) FILTER (WHERE correct) / count(*), 4) AS accuracy"""

register("model_accuracy_over_time", q(("ml_predictions",), f"""
SELECT date, accuracy, n_predictions FROM (SELECT date, {_ACC} FROM ml_predictions GROUP BY date)""",
    ("accuracy",)))(N.model_accuracy_over_time)

register("model_confusion_matrix", q(("ml_predictions",), """
SELECT CASE actual_regime WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' WHEN 2 THEN 'High' END AS actual_label,
       CASE predicted_regime WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' WHEN 2 THEN 'High' END AS predicted_label,
       count(*) AS n
FROM ml_predictions GROUP BY actual_regime, predicted_regime"""))(N.model_confusion_matrix)

_BUCKET = """CASE WHEN confidence < 0.40 THEN '1. <40%' WHEN confidence < 0.50 THEN '2. 40-50%'
            WHEN confidence < 0.60 THEN '3. 50-60%' WHEN confidence < 0.70 THEN '4. 60-70%'
            ELSE '5. >=70%' END"""

register("model_calibration", q(("ml_predictions",), f"""
SELECT {_BUCKET} AS confidence_bucket, {_ACC}, round(avg(confidence), 4) AS avg_confidence
FROM ml_predictions GROUP BY 1""", ("accuracy", "avg_confidence")))(N.model_calibration)

register("model_accuracy_by_sector", q(("predictions_enriched",), f"""
SELECT sector, n_predictions, accuracy FROM (SELECT sector, {_ACC} FROM predictions_enriched GROUP BY sector)""",
    ("accuracy",)))(N.model_accuracy_by_sector)

register("ticker_prediction_history", q(("predictions_enriched",), f"""
SELECT date, actual_label, predicted_label, round(confidence, 3) AS confidence, correct
FROM predictions_enriched WHERE ticker = {TICKER} ORDER BY date DESC LIMIT 60""",
    ("confidence",)))(N.ticker_prediction_history)

register("prediction_history_codes", q(("ml_predictions",), f"""
SELECT date, actual_regime AS actual_int, predicted_regime AS predicted_int, round(confidence, 3) AS confidence, correct
FROM ml_predictions WHERE ticker = {TICKER} ORDER BY date DESC LIMIT 60""", ("confidence",)))(N.prediction_history_codes)

register("latest_price_return", q(("stocks", "returns_daily"), """
SELECT s.ticker, s.company_name, s.sector, r.date, r.adj_close,
       round(r.simple_return * 100, 2) AS last_day_return_pct
FROM stocks s
JOIN (SELECT DISTINCT ON (ticker) ticker, date, adj_close, simple_return FROM returns_daily
      ORDER BY ticker, date DESC) r ON r.ticker = s.ticker""",
    ("adj_close", "last_day_return_pct")))(N.latest_price_return)

register("top_performers_1y", q(("stocks", "prices_daily"),
                                _movers_sql("return_1yr_pct", f"date <= {AS_OF} - INTERVAL 1 YEAR",
                                            "DESC NULLS FIRST", 10),
                                ("return_1yr_pct",)))(N.top_performers_1y)

register("sector_return_1y", q(("stocks", "prices_daily"), f"""
SELECT s.sector, count(*) AS n_stocks,
       round(avg((l.price_now - y.price_then) / y.price_then * 100), 2) AS avg_return_pct
FROM stocks s
JOIN (SELECT DISTINCT ON (ticker) ticker, adj_close AS price_then FROM prices_daily
      WHERE date <= {AS_OF} - INTERVAL 1 YEAR ORDER BY ticker, date DESC) y ON y.ticker = s.ticker
JOIN (SELECT DISTINCT ON (ticker) ticker, adj_close AS price_now FROM prices_daily
      WHERE date <= {AS_OF} ORDER BY ticker, date DESC) l ON l.ticker = s.ticker
GROUP BY s.sector""", ("avg_return_pct",)))(N.sector_return_1y)



def _near_high(threshold: float) -> str:
    return q(("stocks", "drawdown_daily"), f"""
WITH today AS (SELECT ticker, arg_max(drawdown, date) AS drawdown FROM drawdown_daily GROUP BY ticker)
SELECT ticker, company_name, sector, round(drawdown * 100, 2) AS drawdown_pct
FROM today JOIN stocks USING (ticker) WHERE drawdown > {threshold}""", ("drawdown_pct",))


register("near_all_time_high", _near_high(-0.05))(N.near_all_time_high)
# The derived prices jump too much for any ticker to be within 5 %; the same query with a wide band has rows.
register("near_all_time_high_wide", _near_high(-0.99))(lambda m: N.near_all_time_high(m, threshold=-0.99))

register("highest_volatility", q(("stocks", "rolling_volatility"), """
SELECT ticker, company_name, sector, vol_20d_pct, vol_60d_pct FROM (
  SELECT s.ticker, s.company_name, s.sector, v.vol_20d,
         round(v.vol_20d * 100, 2) AS vol_20d_pct, round(v.vol_60d * 100, 2) AS vol_60d_pct
  FROM stocks s
  JOIN (SELECT DISTINCT ON (ticker) ticker, date, vol_20d, vol_60d FROM rolling_volatility
        WHERE vol_20d IS NOT NULL ORDER BY ticker, date DESC) v ON v.ticker = s.ticker
  ORDER BY v.vol_20d DESC NULLS FIRST, s.ticker LIMIT 10)""", ("vol_20d_pct", "vol_60d_pct")))(
    N.highest_volatility)

register("best_sharpe", q(("stocks", "rolling_sharpe"), """
SELECT ticker, company_name, sector, sharpe_60d FROM (
  SELECT s.ticker, s.company_name, s.sector, x.sharpe_60d AS raw, round(x.sharpe_60d, 3) AS sharpe_60d
  FROM stocks s
  JOIN (SELECT DISTINCT ON (ticker) ticker, date, sharpe_60d FROM rolling_sharpe
        WHERE sharpe_60d IS NOT NULL ORDER BY ticker, date DESC) x ON x.ticker = s.ticker
  ORDER BY raw DESC NULLS FIRST, s.ticker LIMIT 10)""", ("sharpe_60d",)))(N.best_sharpe)

register("biggest_moves", q(("stocks", "returns_daily"), f"""
SELECT ticker, company_name, sector, date, daily_return_pct FROM (
  SELECT r.ticker, s.company_name, s.sector, r.date, r.simple_return,
         round(r.simple_return * 100, 2) AS daily_return_pct
  FROM returns_daily r JOIN stocks s ON s.ticker = r.ticker
  WHERE r.date >= {AS_OF} - INTERVAL 1 YEAR AND r.date <= {AS_OF} AND r.simple_return IS NOT NULL
  ORDER BY abs(r.simple_return) DESC, r.ticker, r.date LIMIT 20)""", ("daily_return_pct",)))(N.biggest_moves)

register("top_correlated_pairs", q(("stocks", "correlation_matrix"), """
WITH placed AS (
  SELECT *, row_number() OVER (ORDER BY correlation DESC NULLS FIRST, ticker_a, ticker_b) AS place
  FROM correlation_matrix WHERE ticker_a < ticker_b),
sector_of AS (SELECT map_from_entries(list((ticker, sector))) AS m FROM stocks)
SELECT ticker_a, m[ticker_a] AS sector_a, ticker_b, m[ticker_b] AS sector_b, round(correlation, 3) AS correlation
FROM placed, sector_of WHERE place <= 15""", ("correlation",)))(N.top_correlated_pairs)

register("index_cumulative", q(("index_daily",), f"""
SELECT n.date, n.close, round((n.close - f.c0) / f.c0 * 100, 2) AS return_from_3yr_start_pct
FROM index_daily n,
     (SELECT close AS c0 FROM index_daily WHERE date >= {INDEX_AS_OF} - INTERVAL 3 YEAR
      ORDER BY date LIMIT 1) f
WHERE n.date >= {INDEX_AS_OF} - INTERVAL 3 YEAR AND n.date <= {INDEX_AS_OF}""",
    ("close", "return_from_3yr_start_pct")))(N.index_cumulative)

register("index_kpis", q(("index_daily",), f"""
WITH h AS (SELECT date, close FROM index_daily
           WHERE date >= {INDEX_AS_OF} - INTERVAL 5 YEAR AND date <= {INDEX_AS_OF}),
last AS (SELECT date AS latest_date, close AS latest_close FROM h ORDER BY date DESC LIMIT 1),
ytd AS (SELECT close AS c FROM h, last WHERE year(h.date) = year(last.latest_date) ORDER BY h.date LIMIT 1),
ago AS (SELECT close AS c FROM h, last WHERE h.date <= last.latest_date - INTERVAL 365 DAY
        ORDER BY h.date DESC LIMIT 1)
SELECT last.latest_date, last.latest_close,
       (last.latest_close - ytd.c) / ytd.c * 100 AS ytd_return_pct,
       (last.latest_close - ago.c) / ago.c * 100 AS one_year_return_pct
FROM last, ytd, ago""", ("latest_close", "ytd_return_pct", "one_year_return_pct")))(N.index_kpis)

register("best_worst_sector", q(("stocks", "prices_daily"), f"""
WITH {_YTD}
(SELECT 'best' AS position, sector, avg_ytd_return_pct FROM sector_ytd
 ORDER BY avg_ytd_return_pct DESC NULLS FIRST, sector LIMIT 1)
UNION ALL
(SELECT 'worst' AS position, sector, avg_ytd_return_pct FROM sector_ytd
 ORDER BY avg_ytd_return_pct ASC NULLS LAST, sector DESC LIMIT 1)""", ("avg_ytd_return_pct",)))(N.best_worst_sector)
