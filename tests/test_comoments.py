"""Correlation from stored monthly co-moment states."""

import datetime as dt
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import bars, d, series_dates
from kestrel.operators.correlation import correlation_matrix
from kestrel.operators.returns import returns_daily
from kestrel.sources import comoments


@pytest.fixture(scope="module")
def prices(spark):
    rnd = random.Random(5)
    rows = []
    for t in range(6):
        p = 100.0
        for i, day in enumerate(series_dates(500, "2020-01-10")):
            if rnd.random() < 0.1 or (t == 4 and i > 250) or (t == 5 and i < 400):
                continue        # gaps, a ticker that ends, one that begins late
            p *= math.exp(0 if t == 0 else rnd.gauss(0.01, 0.02) + 0.01 * (i % 3) * t)
            rows.append((f"T{t}", day, p))
    return bars(spark, rows).persist()


def check(got, want):
    index = ["ticker_a", "ticker_b"]
    got, want = (x.toPandas().set_index(index).sort_index() for x in (got, want))
    assert len(want) and list(got.index) == list(want.index)
    assert (got.n_overlap_days.values == want.n_overlap_days.values).all()
    for a, b in zip(got.correlation.values, want.correlation.values):
        assert (pd.isna(a) and pd.isna(b)) or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12)


def test_window_parts():
    whole, cut = comoments.window_parts(d("2020-01-31"), d("2020-04-01"))
    assert whole == ["2020-02", "2020-03"]
    assert cut == [(d("2020-01-31"), d("2020-01-31")), (d("2020-04-01"), d("2020-04-01"))]
    assert comoments.window_parts(d("2020-02-01"), d("2020-02-29")) == (["2020-02"], [])
    assert comoments.window_parts(d("2020-02-03"), d("2020-02-20")) == ([], [(d("2020-02-03"), d("2020-02-20"))])
    assert comoments.window_parts(d("2019-12-01"), d("2020-01-31")) == (["2019-12", "2020-01"], [])


def test_windows_equal_the_matrix_at_any_block_size(spark, prices, tmp_path):
    returns = returns_daily(prices).persist()
    for block in (1, 2, 64):
        root = str(tmp_path / str(block))
        comoments.write_states(prices, root, block_size=block)
        for as_of, days in ((None, 365), (d("2021-03-31"), 90), (d("2020-09-15"), 10)):
            check(comoments.correlation_from_states(spark, as_of, days, 5, root),
                  correlation_matrix(returns, as_of, days, 5))


def test_a_moved_date_reads_states_and_the_cut_months_only(spark, prices, tmp_path):
    root = str(tmp_path)
    comoments.write_states(prices, root)
    for as_of in (d("2021-03-10"), d("2021-03-11")):
        got = comoments.correlation_from_states(spark, as_of, 365, 5, root)
        plan = got._jdf.queryExecution().toString()
        scans = [line for line in plan.splitlines() if "FileScan" in line]
        states = [line for line in scans if "state#" in line]
        cut = [line for line in scans if "log_return#" in line]
        assert states and all("2020-04" in line and "2020-03" not in line for line in states)
        assert cut and all("month" in line.split("PartitionFilters:")[1].split("]")[0] and "2020-03,2021-03" in line for line in cut)
        check(got, correlation_matrix(returns_daily(prices), as_of, 365, 5))


def test_refresh_makes_only_the_changed_months(spark, prices, tmp_path):
    root, last = str(tmp_path), prices.select(F.max("date")).first()[0]
    before = prices.filter(F.col("date") < F.lit(last))
    comoments.write_states(before, root)
    assert comoments.refresh_states(before, prices, root) == {f"{last:%Y-%m}"}
    check(comoments.correlation_from_states(spark, None, 365, 5, root), correlation_matrix(returns_daily(prices), None, 365, 5))
    assert comoments.refresh_states(prices, prices, root) == set()
    fixed = prices.withColumn("adj_close", F.when((F.col("ticker") == "T2") & (F.col("date") == F.lit(d("2020-11-05"))), 1.0)
                              .otherwise(F.col("adj_close"))).filter((F.col("ticker") != "T3") | (F.col("date") < F.lit(dt.date(2021, 1, 1))))
    assert "2020-10" not in comoments.refresh_states(prices, fixed, root)
    check(comoments.correlation_from_states(spark, None, 365, 5, root), correlation_matrix(returns_daily(fixed), None, 365, 5))


def test_no_bars(spark, prices, tmp_path):
    comoments.write_states(prices.filter("ticker = 'T1' AND date < DATE'2020-01-14'"), str(tmp_path))
    assert comoments.correlation_from_states(spark, d("2030-01-01"), 30, 1, str(tmp_path)).collect() == []
