import datetime as dt
import math

import pytest

from helpers import SF_SMALL, bars, series_dates
from kestrel.operators import portfolio as pf
from kestrel.operators import walk
from kestrel.plans.sql_surface import register_sql
from kestrel.sources import adapters
from kestrel.sources.adapters import PERIODS_SCHEMA

DAILY_SCHEMA = "portfolio_id string, date date, portfolio_log_return double"


def daily(spark, rows):
    start = dt.date(2020, 1, 1)
    return spark.createDataFrame([(p, None if i is None else start + dt.timedelta(days=i), r) for p, i, r in rows],
                                 DAILY_SCHEMA).repartition(3)


def brute_path(returns):
    total, top, out = 0.0, 0.0, []
    for r in returns:
        total += r
        top = max(top, math.exp(total))
        out.append((r, math.exp(total), top, math.exp(total) / top - 1))
    return out


def test_path_follows_the_dates_of_each_portfolio(spark):
    walk.register_functions(spark)
    moves = {"a": [0.1, -0.2, 0.05, 0.3, -0.01], "b": [-0.5, 0.2], "c": [0.0]}
    rows = [(p, i, r) for p, rs in moves.items() for i, r in enumerate(rs)]
    df = daily(spark, rows[::-1] + [("a", 9, None), (None, 0, 0.7)])
    got = spark.sql("SELECT * FROM portfolio_walk(TABLE({df}), path => true) ORDER BY portfolio_id, date", df=df).collect()
    for p, rs in moves.items():
        have = [(r.portfolio_log_return, r.wealth, r.running_max, r.drawdown) for r in got if r.portfolio_id == p]
        assert have == [pytest.approx(w) for w in brute_path(rs)]
    assert len(got) == sum(map(len, moves.values()))


def test_summary_needs_two_days_for_a_volatility(spark):
    walk.register_functions(spark)
    df = daily(spark, [("one", 0, 0.01), ("flat", 0, 0.02), ("flat", 1, 0.02), ("none", 0, None)])
    got = {r.portfolio_id: r for r in spark.sql("SELECT * FROM portfolio_walk(TABLE({df}))", df=df).collect()}
    assert set(got) == {"one", "flat"}
    assert got["one"].annualized_volatility is None and got["one"].sharpe_ratio is None and got["one"].n_trading_days == 1
    assert got["flat"].annualized_volatility == 0 and got["flat"].sharpe_ratio is None and got["flat"].max_drawdown == 0
    assert spark.sql("SELECT * FROM portfolio_walk(TABLE({df}))", df=df.limit(0)).count() == 0


def test_table_function_equals_the_window_form(spark):
    rows = [(t, day, base + step * i) for t, base, step in (("A", 100.0, 1.0), ("B", 50.0, -0.5)) for i, day in enumerate(series_dates(40))]
    prices = bars(spark, rows)
    holdings = pf.holdings_from_arrays(spark, "p", ["A", "B"], [0.5, 0.5]).unionByName(
        pf.holdings_from_arrays(spark, "none", ["A"], [1.0]))
    periods = spark.createDataFrame([("p", dt.date(2020, 1, 5), dt.date(2020, 2, 3)), ("none", dt.date(2021, 1, 1), dt.date(2021, 2, 1))],
                                    PERIODS_SCHEMA)
    key = lambda r: r.portfolio_id                                          # noqa: E731
    want = sorted(pf.portfolio_metrics(prices, holdings, periods).collect(), key=key)
    got = sorted(walk.portfolio_metrics_walk(prices, holdings, periods).collect(), key=key)
    assert [r.asDict() for r in got] == [pytest.approx(r.asDict(), abs=1e-9) for r in want]
    assert got[0].n_trading_days == 0 and got[0].total_return is None


def test_wrong_input_is_refused_when_planned(spark):
    walk.register_functions(spark)
    df = daily(spark, [("a", 0, 0.1)])
    with pytest.raises(Exception, match="lacks the columns portfolio_log_return"):
        spark.sql("SELECT * FROM portfolio_walk(TABLE({df}))", df=df.drop("portfolio_log_return"))
    with pytest.raises(Exception, match="boolean constant"):
        spark.sql("SELECT * FROM portfolio_walk(TABLE({df}), path => 3)", df=df)
    with pytest.raises(Exception, match="must be a table"):
        spark.sql("SELECT * FROM portfolio_exposure(1)")


def test_exposure_counts_null_weights_as_holdings(spark):
    holdings = spark.createDataFrame([("p", "A", 0.5), ("p", "A", 0.25), ("p", "B", None), ("p", "Z", 0.25), ("q", "B", None)],
                                     "portfolio_id string, ticker string, weight double")
    stocks = spark.createDataFrame([("A", "s1"), ("B", "s1")], "ticker string, sector string")
    want = sorted(tuple(r) for r in pf.portfolio_sector_exposure(holdings, stocks).collect())
    assert sorted(tuple(r) for r in walk.portfolio_exposure_walk(holdings, stocks).collect()) == want
    assert want == [("p", "s1", 3, 0.75), ("q", "s1", 1, None)]


def test_sql_surface_offers_the_functions(spark):
    register_sql(spark, SF_SMALL, as_of=adapters.AS_OF)
    worst = spark.sql("SELECT portfolio_id, min(drawdown) AS worst FROM portfolio_walk(TABLE(portfolio_daily_returns), path => true) "
                      "GROUP BY portfolio_id")
    summary = spark.sql("SELECT portfolio_id, max_drawdown FROM portfolio_walk(TABLE(portfolio_daily_returns))")
    both = worst.join(summary, "portfolio_id").collect()
    assert both and all(r.worst == pytest.approx(r.max_drawdown) for r in both)
    held = {(r.portfolio_id, r.sector): r.n_stocks for r in spark.sql("SELECT * FROM portfolio_exposure(TABLE(holdings_by_sector))").collect()}
    assert sum(held.values()) == spark.table("holdings_by_sector").count()


def test_few_holdings_leave_the_bars_in_their_tasks(spark):
    from kestrel.plans.context import Market
    m = Market(spark, SF_SMALL, as_of=adapters.AS_OF)
    daily_returns = pf.portfolio_daily_returns(m.prices, m.holdings, m.periods)
    plan = daily_returns._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_candidates_are_an_anti_join_by_slice(spark):
    h = spark.createDataFrame([("p", "A", 0.2), ("p", "A", 0.2), ("q", "Z", 1.0)], "portfolio_id string, ticker string, weight double")
    stocks = spark.createDataFrame([(t,) for t in ["A", "B", "C", None]], "ticker string")
    out = pf.portfolio_candidates(h, stocks)
    assert sorted(tuple(r) for r in out.collect()) == [("p", "B"), ("p", "C"), ("q", "A"), ("q", "B"), ("q", "C")]
    assert "Cartesian" not in out._jdf.queryExecution().toString() and "NestedLoop" not in out._jdf.queryExecution().toString()
