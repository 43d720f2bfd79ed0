import datetime as dt
import math
import random

import duckdb
import pandas as pd

from helpers import series_dates
from kestrel.operators.correlation import correlation_matrix

AS_OF = dt.date(2020, 12, 31)


def _returns(spark, n_tickers=7, n_days=300, seed=3):
    rnd = random.Random(seed)
    rows = []
    days = series_dates(n_days, "2020-03-01")
    for t in range(n_tickers):
        for i, day in enumerate(days):
            if rnd.random() < 0.15:   # gaps: pairwise overlaps differ
                continue
            x = 0.0 if t == 0 else rnd.gauss(0, 1) + (0.5 * t if i % 3 else 0)
            rows.append((f"T{t}", dt.date.fromisoformat(day), x))
    return spark.createDataFrame(rows, "ticker string, date date, log_return double")


def _brute(pdf, min_overlap):
    con = duckdb.connect()
    con.register("r", pdf)
    return con.execute(f"""
        SELECT a.ticker AS ticker_a, b.ticker AS ticker_b,
               covar_samp(a.log_return, b.log_return) / nullif(stddev_samp(a.log_return) * stddev_samp(b.log_return), 0)
                 AS correlation, count(*) AS n_overlap_days
        FROM r a JOIN r b ON a.date = b.date
        WHERE a.date >= DATE '{AS_OF}' - INTERVAL 365 DAY
        GROUP BY 1, 2 HAVING count(*) >= {min_overlap}""").df()


def test_blocked_matches_brute_force_for_any_block_size(spark):
    df = _returns(spark)
    want = _brute(df.toPandas(), 50).set_index(["ticker_a", "ticker_b"]).sort_index()
    for block in (1, 2, 3, 256):
        got = correlation_matrix(df, as_of=AS_OF, min_overlap=50, block_size=block).toPandas() \
            .set_index(["ticker_a", "ticker_b"]).sort_index()
        assert list(got.index) == list(want.index)
        assert (got.n_overlap_days.values == want.n_overlap_days.values).all()
        for a, b in zip(got.correlation.values, want.correlation.values):
            assert (pd.isna(a) and pd.isna(b)) or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12)


def test_symmetric_unit_diagonal_constant_null(spark):
    df = _returns(spark)
    got = {(r.ticker_a, r.ticker_b): r for r in correlation_matrix(df, as_of=AS_OF, min_overlap=2, block_size=2).collect()}
    for (a, b), r in got.items():
        assert got[(b, a)].n_overlap_days == r.n_overlap_days
        if a == b and a != "T0":
            assert math.isclose(r.correlation, 1.0, rel_tol=1e-12)
    assert got[("T0", "T0")].correlation is None and got[("T0", "T3")].correlation is None
