"""Incremental view refresh and checked writes."""

import datetime as dt
import pathlib

import pytest
from pyspark.sql import functions as F

from helpers import bars, d, series_dates
from kestrel.sources import checked, incremental


@pytest.fixture(scope="module")
def prices(spark):
    rows = [(t, day, 100 + 7 * ((i * k) % 13)) for k, t in ((3, "A"), (5, "B"), (7, "C")) for i, day in enumerate(series_dates(200))]
    return bars(spark, [(t, day, float(p)) for t, day, p in rows]).persist()


def months(root, view):
    folder = pathlib.Path(root) / "by_month" / view
    return {p.parent.name: {f.name for f in p.parent.glob("*.parquet")} for p in folder.glob("month=*/*.parquet")}


def equal(spark, root, prices):
    for name, view in incremental.VIEWS.items():
        got = {(r.ticker, r.date): r for r in incremental.read_view(spark, name, root).collect()}
        want = {(r.ticker, r.date): r for r in view.relation(prices).collect()}
        assert got.keys() == want.keys()
        for k, r in want.items():
            for x, y in zip(got[k], r, strict=True):
                assert x == (pytest.approx(y, rel=1e-12, abs=1e-15) if isinstance(y, float) else y), (name, k)


def test_an_appended_day_rewrites_its_month_only(spark, prices, tmp_path):
    root, last = str(tmp_path), d("2020-01-01") + dt.timedelta(days=199)
    before = prices.filter(F.col("date") < F.lit(last))
    incremental.write_views(before, root)
    old = {v: months(root, v) for v in incremental.VIEWS}
    report = {r.view: r for r in incremental.refresh_views(before, prices, root).collect()}
    for view in incremental.VIEWS:
        new = months(root, view)
        assert {m for m in new if new[m] != old[view].get(m)} == {f"month={last:%Y-%m}"}
        assert (report[view].n_months, report[view].n_rows) == (1, 3)
    equal(spark, root, prices)


def test_a_corrected_bar_and_a_removed_tail(spark, prices, tmp_path):
    root = str(tmp_path)
    incremental.write_views(prices, root)
    fixed = prices.withColumn("adj_close", F.when((F.col("ticker") == "B") & (F.col("date") == F.lit(d("2020-03-05"))), 900.0)
                              .otherwise(F.col("adj_close")))
    first = {r.ticker: r.first_changed for r in incremental.first_changes(prices, fixed).collect()}
    assert first == {"B": d("2020-03-05")}
    incremental.refresh_views(prices, fixed, root)
    equal(spark, root, fixed)
    # The last month goes, a ticker goes, one comes.
    kept = fixed.filter("date < DATE'2020-07-01' AND ticker <> 'C'").unionByName(bars(spark, [("D", "2020-02-01", 5.0), ("D", "2020-02-02", 4.0)]))
    incremental.refresh_views(fixed, kept, root)
    equal(spark, root, kept)
    assert "month=2020-07" not in months(root, "drawdown_daily")
    report = incremental.refresh_views(kept, kept, root).collect()
    assert all(r.n_months == 0 and r.n_rows == 0 for r in report)
    equal(spark, root, kept)


def test_checked_refresh_reads_its_source_once(spark, prices, tmp_path):
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    source = prices.withColumn("low", F.when(F.col("ticker") == "A", F.col("high") + 1).otherwise(F.col("low"))) \
        .withColumn("close", F.when((F.col("ticker") != "A") | (F.dayofmonth("date") > 1), F.col("close")))
    source = source.mapInArrow(counted, source.schema)
    path, metrics = checked.checked_refresh(source, "t", checked.bar_rules(), str(tmp_path))
    assert reads.value == 600 == metrics["n_rows"]
    n_null = prices.filter("ticker = 'A' AND dayofmonth(date) = 1").count()
    assert (metrics["n_good"], metrics["rule_null_price"], metrics["rule_high_below_low"]) == (400, n_null, 200 - n_null)
    good, bad = checked.read_good(spark, "t", str(tmp_path)), checked.read_quarantine(spark, "t", str(tmp_path))
    assert good.columns == prices.columns and good.count() == 400
    assert {r.rule_id: r["count"] for r in bad.groupBy("rule_id").count().collect()} == {"null_price": n_null, "high_below_low": 200 - n_null}


def test_parts_without_rows(spark, prices, tmp_path):
    for source, good, bad in ((prices, 600, 0), (prices.withColumn("open", F.lit(0.0)), 0, 600), (prices.limit(0), 0, 0)):
        checked.checked_refresh(source, "t", checked.bar_rules(), str(tmp_path))
        assert checked.read_good(spark, "t", str(tmp_path)).count() == good
        assert checked.read_quarantine(spark, "t", str(tmp_path)).count() == bad
