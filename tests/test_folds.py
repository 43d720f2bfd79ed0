import datetime as dt

import numpy as np
import pytest

from kestrel.operators import ml

COLS = ["x", "y"]


def frame(spark, n, seed=0):
    """Several tickers a day over some months; x has a large offset, y is constant in places."""
    rng = np.random.default_rng(seed)
    rows = [(f"T{i % 3}", dt.date(2020, 1, 1) + dt.timedelta(days=i // 3), float(1e6 + rng.normal()), float(i >= n // 2) if i % 7 else None,
             int(rng.integers(0, 3))) for i in range(n)]
    return rows, spark.createDataFrame(rows, "ticker string, date date, x double, y double, regime int").repartition(4)


def brute(rows, column, upto):
    v = np.array([r[column] for r in rows[:upto] if r[column] is not None])
    return (len(v), v.mean(), v.std(), v.min(), v.max()) if len(v) else (0, None, None, None, None)


@pytest.mark.parametrize("n,splits", [(400, 3), (401, 3), (17, 5), (4, 3), (90, 1)])
def test_prefix_sums_equal_separate_fits(spark, n, splits):
    rows, df = frame(spark, n)
    rows = sorted(rows, key=lambda r: (r[1], r[0]))
    got = {(r.fold, r.feature): r for r in ml.fold_statistics(ml.fold_states(df, COLS, splits), splits).collect()}
    size = n // (splits + 1)
    assert len(got) == splits * len(COLS)
    for k in range(1, splits + 1):
        upto = n - (splits + 1 - k) * size
        for c, name in ((2, "x"), (3, "y")):
            r = got[(k, name)]
            count, *want = brute(rows, c, upto)
            assert r.n_train == count
            assert [r.mean, r["std"], r.low, r.high] == [None if w is None else pytest.approx(w, rel=1e-12, abs=1e-9) for w in want]


def test_scaled_rows_are_the_test_rows_of_each_fold(spark):
    rows, df = frame(spark, 203)
    rows = sorted(rows, key=lambda r: (r[1], r[0]))
    got = ml.fold_scaled(df, ["x"], 3).collect()
    size = 203 // 4
    assert len(got) == 3 * size
    for k in (1, 2, 3):
        first = 203 - (4 - k) * size
        _, mean, std, _, _ = brute(rows, 2, first)
        want = {(r[0], r[1]): (r[2] - mean) / std for r in rows[first:first + size]}
        have = {(r.ticker, r.date): r.x for r in got if r.fold == k}
        assert have.keys() == want.keys() and all(have[i] == pytest.approx(want[i], abs=1e-6) for i in want)


def test_states_are_few_and_merge_in_any_order(spark):
    _, df = frame(spark, 400)
    states = ml.fold_states(df, COLS, 3)
    months = {r.month for r in states.select("month").distinct().collect()}
    assert states.count() <= (len(months) + 3) * len(COLS)
    whole = {r.feature: r for r in ml.merge_states(states, ["feature"]).collect()}
    direct = df.selectExpr("avg(x) m", "var_pop(x) * count(x) s").first()
    assert whole["x"]["mean"] == pytest.approx(direct.m) and whole["x"].squares == pytest.approx(direct.s, rel=1e-6)


def test_odd_values_and_fewer_rows_than_folds(spark):
    schema = "ticker string, date date, x double, y double, regime int"
    day = dt.date(2020, 1, 1)
    odd = spark.createDataFrame([(t, day, x, None, 0) for t, x in (("A", float("nan")), ("B", None), ("C", 2.0), ("D", 4.0))], schema)
    got = {(r.fold, r.feature): r for r in ml.fold_statistics(ml.fold_states(odd, COLS, 3), 3).collect()}
    assert [got[(k, "x")].n_train for k in (1, 2, 3)] == [0, 0, 1] and got[(3, "x")]["mean"] == 2.0
    assert got[(3, "y")].n_train == 0 and got[(3, "y")]["mean"] is None
    two = odd.limit(2)
    assert {r.segment for r in ml.fold_states(two, COLS, 3).collect()} == {0}
    assert ml.fold_states(odd.limit(0), COLS, 3).count() == 0
