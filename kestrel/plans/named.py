"""Named dashboard and analysis queries (Q1-Q29) and the by-name lookup.

``as_of`` stands in for CURRENT_DATE. "Price at A vs price at B" queries
(Q2-Q4, Q20-Q21) read the bars once: one grouped ``max_by/min_by``
aggregation gives both prices, no self join.

Top-k queries order with PostgreSQL's NULL placement made explicit
(DESC -> NULLS FIRST, ASC -> NULLS LAST) and break ties by key columns so the
first k rows are deterministic.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.functions.exprs import label_to_code, pct, safe_ratio
from kestrel.operators import portfolio as pf
from kestrel.operators import scoring as sc
from kestrel.operators.latest import latest_per_key, price_change
from kestrel.plans.context import Market

DEFAULT_TICKER = "NATION_3"


def _as_of(m: Market) -> F.Column:
    return F.lit(m.as_of) if m.as_of is not None else m.prices.select(F.max("date")).scalar()


def _index_as_of(m: Market) -> F.Column:
    return F.lit(m.index_as_of) if m.index_as_of is not None else m.index.select(F.max("date")).scalar()


def _names(m: Market, cols=("ticker", "company_name", "sector")) -> DataFrame:
    return m.stocks.select(*cols)


def _change_pct(then: str = "price_then", now: str = "price_now") -> F.Column:
    return safe_ratio(F.col(now) - F.col(then), F.col(then)) * 100


def index_history(m: Market, years_back: int = 5) -> DataFrame:
    start = F.add_months(_index_as_of(m), -12 * years_back)
    return m.index.filter((F.col("date") >= start) & (F.col("date") <= _index_as_of(m))) \
        .select("date", "close").orderBy("date")


def sector_performance_ytd(m: Market) -> DataFrame:
    a = _as_of(m)
    chg = price_change(m.prices, F.col("date") >= F.trunc(a, "year"), start_earliest=True,
                       end_cond=F.col("date") <= a)
    return chg.join(_names(m), "ticker").groupBy("sector").agg(
        F.count(F.lit(1)).alias("n_stocks"),
        F.round(F.avg(_change_pct()), 2).alias("avg_ytd_return_pct"),
    ).orderBy(F.col("avg_ytd_return_pct").desc_nulls_first(), "sector")


def _movers(m: Market, days_back: int, limit_n: int, ascending: bool, col: str) -> DataFrame:
    a = _as_of(m)
    chg = price_change(m.prices, F.col("date") <= F.date_sub(a, days_back), start_earliest=False,
                       end_cond=F.col("date") <= a)
    out = chg.join(_names(m), "ticker").select(
        "ticker", "company_name", "sector", F.round(_change_pct(), 2).alias(col))
    order = F.col(col).asc_nulls_last() if ascending else F.col(col).desc_nulls_first()
    return out.orderBy(order, "ticker").limit(limit_n)


def top_gainers(m: Market, days_back: int = 365, limit_n: int = 5) -> DataFrame:
    return _movers(m, days_back, limit_n, False, "return_pct")


def top_losers(m: Market, days_back: int = 365, limit_n: int = 5) -> DataFrame:
    return _movers(m, days_back, limit_n, True, "return_pct")


def stock_price_history(m: Market, ticker: str = DEFAULT_TICKER) -> DataFrame:
    return m.prices.filter(F.col("ticker") == ticker) \
        .select("date", "open", "high", "low", "close", "adj_close", "volume").orderBy("date")


def stock_volatility(m: Market, ticker: str = DEFAULT_TICKER) -> DataFrame:
    # The ticker filter is on the window's partition key: Catalyst pushes it below the Window.
    return m.volatility.filter((F.col("ticker") == ticker) & F.col("vol_20d").isNotNull()) \
        .select("date", "adj_close", "vol_20d", "vol_60d").orderBy("date")


def stock_drawdown(m: Market, ticker: str = DEFAULT_TICKER) -> DataFrame:
    return m.drawdown.filter(F.col("ticker") == ticker) \
        .select("date", "adj_close", "running_max", "drawdown").orderBy("date")


def stock_key_metrics(m: Market, ticker: str | None = None) -> DataFrame:
    """Q8 for every ticker (or one): five "latest" metrics from one window pass and one aggregation."""
    from kestrel.operators.risk import risk_panel
    panel = risk_panel(m.prices)
    if ticker is not None:
        panel = panel.filter(F.col("ticker") == ticker)
    d = F.col("date")
    metrics = panel.groupBy("ticker").agg(
        F.max_by("adj_close", d).alias("latest_price"),
        F.max_by("vol_60d", F.when(F.col("vol_60d").isNotNull(), d)).alias("current_vol_60d"),
        F.max_by("sharpe_60d", F.when(F.col("sharpe_60d").isNotNull(), d)).alias("current_sharpe_60d"),
        F.min("drawdown").alias("worst_drawdown"),
        F.max_by("drawdown", d).alias("current_drawdown"),
    )
    names = _names(m)
    if ticker is not None:
        names = names.filter(F.col("ticker") == ticker)
    return names.join(metrics, "ticker", "left").select(
        "ticker", "company_name", "sector", "latest_price",
        F.round("current_vol_60d", 4).alias("current_vol_60d"),
        F.round("current_sharpe_60d", 3).alias("current_sharpe_60d"),
        F.round("worst_drawdown", 4).alias("worst_drawdown"),
        F.round("current_drawdown", 4).alias("current_drawdown"),
    )


def portfolio_metrics(m: Market) -> DataFrame:
    return pf.portfolio_metrics(m.prices, m.holdings, m.periods)


def portfolio_sector_exposure(m: Market) -> DataFrame:
    return pf.portfolio_sector_exposure(m.holdings, m.stocks)


def available_tickers(m: Market) -> DataFrame:
    return _names(m).orderBy("sector", "company_name")


def latest_prediction_for_ticker(m: Market, ticker: str = DEFAULT_TICKER) -> DataFrame:
    lp = sc.latest_predictions(m.enriched.filter(F.col("ticker") == ticker))
    return lp.select(
        "ticker", "company_name", "sector", "date", "predicted_label", "confidence_tier",
        *[F.round(c, 3).alias(c) for c in ("confidence", "prob_low", "prob_medium", "prob_high")],
    )


def predictions_heatmap(m: Market) -> DataFrame:
    return sc.latest_predictions(m.enriched).select(
        "ticker", "sector", "predicted_label", "confidence", "prob_low", "prob_medium", "prob_high"
    ).orderBy("sector", "ticker")


def model_accuracy_over_time(m: Market) -> DataFrame:
    return sc.accuracy_by_date(m.predictions).select("date", "accuracy", "n_predictions").orderBy("date")


def model_confusion_matrix(m: Market) -> DataFrame:
    return sc.confusion_matrix(m.predictions).orderBy("actual_regime", "predicted_regime") \
        .select("actual_label", "predicted_label", "n")


def model_calibration(m: Market) -> DataFrame:
    return sc.accuracy_by_confidence_tier(m.predictions).orderBy("confidence_bucket")


def model_accuracy_by_sector(m: Market) -> DataFrame:
    return sc.accuracy_by_sector(m.enriched).select("sector", "n_predictions", "accuracy") \
        .orderBy(F.col("accuracy").desc_nulls_first(), "sector")


def ticker_prediction_history(m: Market, ticker: str = DEFAULT_TICKER, limit_n: int = 60) -> DataFrame:
    return m.enriched.filter(F.col("ticker") == ticker).select(
        "date", "actual_label", "predicted_label", F.round("confidence", 3).alias("confidence"), "correct"
    ).orderBy(F.col("date").desc()).limit(limit_n)


def prediction_history_codes(m: Market, ticker: str = DEFAULT_TICKER, limit_n: int = 60) -> DataFrame:
    """The history of Q18 by date with the labels as ordinal codes (F10); an unknown label has none."""
    return ticker_prediction_history(m, ticker, limit_n).select(
        "date", label_to_code("actual_label").alias("actual_int"), label_to_code("predicted_label").alias("predicted_int"),
        "confidence", "correct").orderBy("date")


def latest_price_return(m: Market) -> DataFrame:
    last = latest_per_key(m.returns, cols=["date", "adj_close", "simple_return"])
    return _names(m).join(last, "ticker").select(
        "ticker", "company_name", "sector", "date", "adj_close",
        pct(F.col("simple_return")).alias("last_day_return_pct"),
    ).orderBy(F.col("last_day_return_pct").desc_nulls_last(), "ticker")


def _one_year(m: Market) -> DataFrame:
    a = _as_of(m)
    chg = price_change(m.prices, F.col("date") <= F.add_months(a, -12), start_earliest=False,
                       end_cond=F.col("date") <= a)
    return chg.join(_names(m), "ticker")


def top_performers_1y(m: Market, limit_n: int = 10) -> DataFrame:
    return _one_year(m).select(
        "ticker", "company_name", "sector", F.round(_change_pct(), 2).alias("return_1yr_pct")
    ).orderBy(F.col("return_1yr_pct").desc_nulls_first(), "ticker").limit(limit_n)


def sector_return_1y(m: Market) -> DataFrame:
    return _one_year(m).groupBy("sector").agg(
        F.count(F.lit(1)).alias("n_stocks"), F.round(F.avg(_change_pct()), 2).alias("avg_return_pct")) \
        .orderBy(F.col("avg_return_pct").desc_nulls_first(), "sector")


def near_all_time_high(m: Market, threshold: float = -0.05) -> DataFrame:
    last = latest_per_key(m.drawdown, cols=["date", "drawdown"])
    return _names(m).join(last, "ticker").filter(F.col("drawdown") > threshold) \
        .orderBy(F.col("drawdown").desc(), "ticker") \
        .select("ticker", "company_name", "sector", pct(F.col("drawdown")).alias("drawdown_pct"))


def highest_volatility(m: Market, limit_n: int = 10) -> DataFrame:
    lv = latest_per_key(m.volatility, cols=["date", "vol_20d", "vol_60d"], where=F.col("vol_20d").isNotNull())
    return _names(m).join(lv, "ticker").orderBy(F.col("vol_20d").desc_nulls_first(), "ticker") \
        .limit(limit_n).select("ticker", "company_name", "sector",
                               pct(F.col("vol_20d")).alias("vol_20d_pct"), pct(F.col("vol_60d")).alias("vol_60d_pct"))


def best_sharpe(m: Market, limit_n: int = 10) -> DataFrame:
    ls = latest_per_key(m.sharpe, cols=["date", "sharpe_60d"], where=F.col("sharpe_60d").isNotNull())
    return _names(m).join(ls, "ticker").orderBy(F.col("sharpe_60d").desc_nulls_first(), "ticker") \
        .limit(limit_n).select("ticker", "company_name", "sector", F.round("sharpe_60d", 3).alias("sharpe_60d"))


def biggest_moves(m: Market, limit_n: int = 20) -> DataFrame:
    a = _as_of(m)
    r = m.returns.filter((F.col("date") >= F.add_months(a, -12)) & (F.col("date") <= a)
                         & F.col("simple_return").isNotNull())
    return r.join(_names(m), "ticker").orderBy(F.abs("simple_return").desc(), "ticker", "date") \
        .limit(limit_n).select("ticker", "company_name", "sector", "date",
                               pct(F.col("simple_return")).alias("daily_return_pct"))


def top_correlated_pairs(m: Market, limit_n: int = 15) -> DataFrame:
    c = m.correlation().filter(F.col("ticker_a") < F.col("ticker_b"))
    sa = m.stocks.select(F.col("ticker").alias("ticker_a"), F.col("sector").alias("sector_a"))
    sb = m.stocks.select(F.col("ticker").alias("ticker_b"), F.col("sector").alias("sector_b"))
    return c.join(sa, "ticker_a").join(sb, "ticker_b") \
        .orderBy(F.col("correlation").desc_nulls_first(), "ticker_a", "ticker_b").limit(limit_n) \
        .select("ticker_a", "sector_a", "ticker_b", "sector_b", F.round("correlation", 3).alias("correlation"))


def index_cumulative(m: Market, years: int = 3) -> DataFrame:
    a = _index_as_of(m)
    start = F.add_months(a, -12 * years)
    window = m.index.filter((F.col("date") >= start) & (F.col("date") <= a))
    first_close = window.select(F.min_by("close", "date")).scalar()  # one-row scalar subquery
    return window.select("date", "close",
                         F.round(safe_ratio(F.col("close") - first_close, first_close) * 100, 2)
                         .alias("return_from_3yr_start_pct")).orderBy("date")


def index_kpis(m: Market) -> DataFrame:
    """Latest close, YTD (vs first bar of the latest bar's year) and 1-year change, one row."""
    hist = index_history(m, 5)
    latest = hist.select(F.max("date")).scalar()
    d = F.col("date")
    k = hist.agg(
        F.max_by("close", d).alias("latest_close"),
        F.max(d).alias("latest_date"),
        F.min_by("close", F.when(F.year(d) == F.year(latest), d)).alias("ytd_start"),
        F.max_by("close", F.when(d <= F.date_sub(latest, 365), d)).alias("year_ago_close"),
    )
    return k.select(
        "latest_date", "latest_close",
        _change_pct("ytd_start", "latest_close").alias("ytd_return_pct"),
        _change_pct("year_ago_close", "latest_close").alias("one_year_return_pct"),
    )


def best_worst_sector(m: Market) -> DataFrame:
    s = sector_performance_ytd(m)
    v = F.col("avg_ytd_return_pct")
    best = s.orderBy(v.desc_nulls_first(), "sector").limit(1).withColumn("position", F.lit("best"))
    worst = s.orderBy(v.asc_nulls_last(), F.col("sector").desc()).limit(1).withColumn("position", F.lit("worst"))
    return best.unionByName(worst).select("position", "sector", "avg_ytd_return_pct")


def latest_kinds(m: Market, days_back: int = 365) -> DataFrame:
    """A4 in its three forms: latest bar, first bar, latest bar on/before a date; one aggregation."""
    d, p = F.col("date"), F.col("adj_close")
    old = F.when(d <= F.date_sub(_as_of(m), days_back), d)
    wide = m.prices.groupBy("ticker").agg(
        F.max(d).alias("d1"), F.max_by(p, d).alias("p1"), F.min(d).alias("d2"), F.min_by(p, d).alias("p2"),
        F.max(old).alias("d3"), F.max_by(p, old).alias("p3"))
    return wide.select("ticker", F.stack(F.lit(3), F.lit("latest"), F.col("d1"), F.col("p1"), F.lit("first"), F.col("d2"),
                                         F.col("p2"), F.lit("as_of"), F.col("d3"), F.col("p3"))
                       .alias("kind", "date", "adj_close")).filter(F.col("date").isNotNull())


NAMED: dict[str, Callable[..., DataFrame]] = {
    "index_history": index_history,
    "sector_performance_ytd": sector_performance_ytd,
    "top_gainers": top_gainers,
    "top_losers": top_losers,
    "stock_price_history": stock_price_history,
    "stock_volatility": stock_volatility,
    "stock_drawdown": stock_drawdown,
    "stock_key_metrics": stock_key_metrics,
    "portfolio_metrics": portfolio_metrics,
    "portfolio_sector_exposure": portfolio_sector_exposure,
    "available_tickers": available_tickers,
    "latest_prediction_for_ticker": latest_prediction_for_ticker,
    "predictions_heatmap": predictions_heatmap,
    "model_accuracy_over_time": model_accuracy_over_time,
    "model_confusion_matrix": model_confusion_matrix,
    "model_calibration": model_calibration,
    "model_accuracy_by_sector": model_accuracy_by_sector,
    "ticker_prediction_history": ticker_prediction_history,
    "latest_price_return": latest_price_return,
    "top_performers_1y": top_performers_1y,
    "sector_return_1y": sector_return_1y,
    "near_all_time_high": near_all_time_high,
    "highest_volatility": highest_volatility,
    "best_sharpe": best_sharpe,
    "biggest_moves": biggest_moves,
    "top_correlated_pairs": top_correlated_pairs,
    "index_cumulative": index_cumulative,
    "index_kpis": index_kpis,
    "best_worst_sector": best_worst_sector,
}


class UnknownQuery(KeyError):
    pass


def query_by_name(m: Market, name: str, **params) -> DataFrame:
    """Run a named query with parameters; an unknown name lists the known ones."""
    try:
        fn = NAMED[name]
    except KeyError:
        raise UnknownQuery(f"unknown query {name!r}; known: {', '.join(sorted(NAMED))}") from None
    return fn(m, **params)
