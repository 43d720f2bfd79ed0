"""The driver contract and the oracle check on the smallest scale."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from oracle_compare import compare, duck

SF = "/root/testdata/sf0.001"
# Their own tests: tests/llm.
TRAINING_DATA = {k for k in E.queries() if k.startswith("op") or k == "pipeline"}


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "vol_20d_pct" in df.columns


def test_every_oracle_key_is_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("key", sorted(set(E.oracle_sql()) - TRAINING_DATA))
def test_oracle_matches(spark, con, key):
    r = compare(spark, SF, key, E.queries()[key], E.oracle_sql()[key], con)
    assert r["ok"], r


@pytest.mark.parametrize("key", sorted(set(E.queries()) - set(E.oracle_sql()) - TRAINING_DATA - {"hyperparam_sweep"}))
def test_rows_only_keys_run(spark, key):
    assert E.queries()[key](spark, SF).count() > 0


# Every key that can hold NULLs, and a column that does at this scale.
NULLS = {
    "returns_daily": "log_return", "returns_monthly": "log_return", "rolling_volatility": "vol_20d",
    "rolling_sharpe": "sharpe_60d", "moving_averages": None, "rolling_accuracy": None, "portfolio_metrics": "total_return",
    "feat_returns": "ret_20d", "feat_vol": "vol_20d", "feat_bb_width": "bb_width", "feat_volume_ratio": "volume_ratio",
    "feat_rsi": "rsi_14", "feat_macd": "macd_signal", "target_abs_return": "abs_return_next",
    "target_forward_5d": "abs_return_next", "regime_label": "abs_return_next", "multi_lag_returns": "lag_20",
    "feature_rolling": "vol_20d", "ewm": None, "stock_key_metrics": None, "ml_features": None,
}


@pytest.mark.parametrize("key", sorted(NULLS))
def test_nulls_stay_null(spark, con, key):
    df = E.queries()[key](spark, SF)
    numbers = [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    nulls = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in df.columns)).first().asDict()
    want = con.execute("SELECT " + ", ".join(f'count(*) - count("{c}") AS "{c}"' for c in df.columns)
                       + f" FROM ({E.oracle_sql()[key]})").fetchone()
    assert tuple(nulls.values()) == want
    assert NULLS[key] is None or nulls[NULLS[key]] > 0
    assert df.filter(" OR ".join(f"abs({c}) = 9e12" for c in numbers)).isEmpty()


def test_empty_portfolio_is_null(spark):
    r = {x.portfolio_id: x for x in E.queries()["portfolio_metrics"](spark, SF).collect()}["p5"]
    assert r.n_trading_days == 0 and r.total_return is None and r.max_drawdown is None
