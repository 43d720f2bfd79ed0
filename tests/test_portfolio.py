import datetime as dt
import math

import pytest

from helpers import bars, series_dates
from kestrel.operators import portfolio as pf
from kestrel.sources.adapters import PERIODS_SCHEMA


def _prices(spark):
    rows = []
    for t, base, step in (("A", 100.0, 1.0), ("B", 50.0, -0.5)):
        for i, day in enumerate(series_dates(10)):
            rows.append((t, day, base + step * i))
    return bars(spark, rows)


def _periods(spark, items):
    return spark.createDataFrame([(p, dt.date.fromisoformat(s), dt.date.fromisoformat(e)) for p, s, e in items],
                                 PERIODS_SCHEMA)


def test_metrics_and_empty_range(spark):
    h = pf.holdings_from_arrays(spark, "p", ["A", "B"], [0.5, 0.5]) \
        .unionByName(pf.holdings_from_arrays(spark, "empty", ["A"], [1.0]))
    per = _periods(spark, [("p", "2020-01-02", "2020-01-10"), ("empty", "2021-01-01", "2021-02-01")])
    out = {r.portfolio_id: r for r in pf.portfolio_metrics(_prices(spark), h, per).collect()}
    assert out["empty"].n_trading_days == 0 and out["empty"].total_return is None
    # First day in range keeps its return (range filter after LAG): 9 days from 2020-01-02.
    assert out["p"].n_trading_days == 9
    ra = math.log(109 / 100) * 0.5 + math.log(45.5 / 50) * 0.5
    assert math.isclose(out["p"].total_return, round(math.exp(ra) - 1, 4), abs_tol=1e-12)
    assert out["p"].max_drawdown <= 0


def test_unknown_and_duplicate_tickers(spark):
    h = spark.createDataFrame([("p", "A", 0.5), ("p", "A", 0.25), ("p", "ZZZ", 0.25)],
                              "portfolio_id string, ticker string, weight double")
    per = _periods(spark, [("p", "2020-01-01", "2020-01-10")])
    r = pf.portfolio_metrics(_prices(spark), h, per).first()
    # Unknown ticker contributes nothing (no renormalisation); duplicate rows both count.
    assert math.isclose(r.total_return, round(math.exp(0.75 * math.log(109 / 100)) - 1, 4), abs_tol=1e-12)
    stocks = spark.createDataFrame([("A", "Co A", "S1", "I")], "ticker string, company_name string, sector string, industry string")
    exp = pf.portfolio_sector_exposure(h, stocks).collect()
    assert len(exp) == 1 and exp[0].n_stocks == 2 and exp[0].total_weight == 0.75


def test_unequal_arrays_raise(spark):
    with pytest.raises(pf.PortfolioArrayError):
        pf.holdings_from_arrays(spark, "p", ["A", "B"], [1.0])
    arr = spark.createDataFrame([("p", ["A", "B"], [1.0])], "portfolio_id string, tickers array<string>, weights array<double>")
    with pytest.raises(Exception):
        pf.holdings_from_array_columns(arr).collect()


def test_weight_tools(spark):
    h = spark.createDataFrame([("p", "A", 0.2), ("p", "B", 0.2)], "portfolio_id string, ticker string, weight double")
    per = _periods(spark, [("p", "2020-01-01", "2020-01-10")])
    chk = pf.portfolio_weight_check(h, per).first()
    assert chk.status == "under" and not chk.can_analyze and math.isclose(chk.off_by, 0.6)
    norm = {r.ticker: r.weight for r in pf.portfolio_normalize(h).collect()}
    assert norm == {"A": 0.5, "B": 0.5}
    added = {r.ticker: r.weight for r in pf.portfolio_add(h, spark.createDataFrame([("p", "C")], "portfolio_id string, ticker string")).collect()}
    assert math.isclose(added["C"], 1 / 3) and math.isclose(sum(added.values()), 1.0)
    stocks = spark.createDataFrame([(t, t, "S", "I") for t in "ABCD"], "ticker string, company_name string, sector string, industry string")
    cand = sorted(r.ticker for r in pf.portfolio_candidates(h, stocks).collect())
    assert cand == ["C", "D"]


def test_array_guard_treats_null_and_empty_as_equal(spark):
    from kestrel.operators import portfolio as pf
    schema = "portfolio_id string, tickers array<string>, weights array<double>"
    ok = spark.createDataFrame([("a", None, None), ("b", None, []), ("c", [], None), ("d", [], []), ("e", ["X"], [1.0])], schema)
    assert [(r.portfolio_id, r.ticker) for r in pf.holdings_from_array_columns(ok).collect()] == [("e", "X")]
    for bad in ((["X"], None), (["X"], []), (["X", "Y"], [1.0]), (None, [1.0])):
        with pytest.raises(Exception, match="same length"):
            pf.holdings_from_array_columns(spark.createDataFrame([("a", *bad)], schema)).collect()
