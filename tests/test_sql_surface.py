import pytest

from helpers import SF_SMALL
from kestrel.operators import portfolio as pf
from kestrel.plans.sql_surface import register_sql
from kestrel.sources import adapters


def test_table_functions_match_dataframe_operators(spark):
    m = register_sql(spark, SF_SMALL, as_of=adapters.AS_OF)
    want = {r.portfolio_id: r for r in pf.portfolio_metrics(m.prices, m.holdings, m.periods).collect()}
    for pid in ("p1", "p3"):
        tickers = [t for t, _ in adapters.PORTFOLIOS[pid]]
        weights = ", ".join(f"{w}D" for _, w in adapters.PORTFOLIOS[pid])
        start, end = adapters.PERIODS[pid]
        got = spark.sql(f"SELECT * FROM portfolio_metrics(array({', '.join(repr(t) for t in tickers)}), "
                        f"array({weights}), DATE'{start}', DATE'{end}')").first()
        w = want[pid]
        assert got.n_trading_days == w.n_trading_days
        for c in ("total_return", "annualized_return", "annualized_volatility", "sharpe_ratio", "max_drawdown"):
            assert got[c] == pytest.approx(w[c], abs=1e-4)
    exp = spark.sql("SELECT * FROM portfolio_sector_exposure(array('NATION_3','NATION_8','ZZZ'), "
                    "array(0.5D, 0.25D, 0.25D))").collect()
    assert sum(r.n_stocks for r in exp) == 2          # unknown ticker drops out
    with pytest.raises(Exception):
        spark.sql("SELECT * FROM portfolio_metrics(array('A','B'), array(1.0D), DATE'2000-01-01', "
                  "DATE'2001-01-01')").collect()


def test_views_and_parameters(spark):
    register_sql(spark, SF_SMALL, as_of=adapters.AS_OF)
    n = spark.sql("SELECT count(*) AS n FROM prices_daily WHERE ticker = :t", args={"t": "NATION_3"}).first().n
    assert n > 0
    top = spark.sql("SELECT ticker FROM rolling_volatility WHERE vol_20d IS NOT NULL "
                    "ORDER BY vol_20d DESC LIMIT :k", args={"k": 3}).collect()
    assert len(top) == 3
    assert spark.sql("SELECT count(*) FROM correlation_matrix WHERE ticker_a = ticker_b").first()[0] >= 0


def test_table_functions_accept_null_arrays(spark):
    register_sql(spark, SF_SMALL, as_of=adapters.AS_OF)
    none = "CAST(NULL AS ARRAY<STRING>), CAST(NULL AS ARRAY<DOUBLE>)"
    row = spark.sql(f"SELECT * FROM portfolio_metrics({none}, DATE'2000-01-01', DATE'2001-01-01')").first()
    assert row.n_trading_days == 0 and row.total_return is None
    assert spark.sql(f"SELECT * FROM portfolio_sector_exposure({none})").count() == 0
