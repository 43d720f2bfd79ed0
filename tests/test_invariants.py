"""Invariants on the real (smallest) dataset and a property test for exact quantiles."""

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from helpers import SF_SMALL
from kestrel.operators.quantiles import exact_quantiles
from kestrel.plans.context import Market


@pytest.fixture(scope="module")
def m(spark):
    return Market(spark, SF_SMALL)


def test_relation_invariants(m):
    assert m.drawdown.filter(F.col("drawdown") > 0).count() == 0
    n_tickers = m.prices.select("ticker").distinct().count()
    assert m.returns.filter(F.col("simple_return").isNull()).count() == n_tickers
    f = m.features
    assert f.filter((F.col("rsi_14") < 0) | (F.col("rsi_14") > 100)).count() == 0
    shares = [r.n for r in f.filter(F.col("regime").isNotNull()).groupBy("regime").count()
              .withColumnRenamed("count", "n").collect()]
    assert all(abs(s / sum(shares) - 1 / 3) < 0.02 for s in shares)
    p = m.predictions.select((F.col("prob_low") + F.col("prob_medium") + F.col("prob_high")).alias("s"))
    assert p.filter(F.abs(F.col("s") - 1) > 1.5e-4).count() == 0


def test_correlation_symmetric_unit_diagonal(m):
    c = {(r.ticker_a, r.ticker_b): r for r in m.correlation(min_overlap=2).collect()}
    for (a, b), r in c.items():
        assert c[(b, a)].correlation == pytest.approx(r.correlation, abs=1e-12)
        if a == b:
            assert r.correlation == pytest.approx(1.0, abs=1e-12)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6, allow_nan=False), min_size=1, max_size=300),
       st.sampled_from([0.0, 0.1, 1 / 3, 0.5, 0.9, 1.0]))
def test_exact_quantiles_property(spark, values, p):
    df = spark.createDataFrame([("g", float(v)) for v in values], "g string, v double")
    got = exact_quantiles(df, ["g"], "v", [p], buckets=4).first().quantile
    assert got == pytest.approx(float(np.quantile(np.array(values), p)), rel=1e-9, abs=1e-9)
