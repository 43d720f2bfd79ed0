"""Models, the refresh job and its failure signal."""

import datetime as dt
import pickle

import pytest
from pyspark import RDD
from pyspark.sql import functions as F

import __spark_entry__ as E
from helpers import SF_SMALL
from kestrel.operators import boosting, ml
from kestrel.operators.boosting import Params
from kestrel.plans import job, named
from kestrel.plans.context import Market
from kestrel.sources import adapters, ingest, sinks


@pytest.fixture(scope="module")
def split(spark):
    m = Market(spark, SF_SMALL)
    return [ml.materialize(x) for x in ml.time_split(ml.load_features(m.features))]


def test_models_beat_chance_and_importances_sum_to_one(spark):
    q = E.queries()
    for key in ("logistic_baseline", "tree_classifier"):
        r = q[key](spark, SF_SMALL).first()
        assert r.accuracy > 1 / 3 and r.n_test > 0
    imp = q["feature_importance"](spark, SF_SMALL).collect()
    assert len(imp) == 12 and abs(sum(r.importance for r in imp) - 1) < 1e-5
    lift = {r.model: r for r in q["baseline_compare"](spark, SF_SMALL).collect()}
    assert abs(lift["random"].accuracy - 1 / 3) < 1e-5 and lift["logistic_regression"].lift_vs_logistic_pp == 0


def test_predictions_cover_the_test_rows(spark, split):
    got = E.queries()["generate_predictions"](spark, SF_SMALL)
    assert got.count() == split[1].count()
    assert got.filter(F.abs(F.col("prob_low") + F.col("prob_medium") + F.col("prob_high") - 1) > 1e-5).isEmpty()


def test_sweep_reports_every_configuration(split):
    got = ml.hyperparam_sweep(*split, configs=[("default", Params(rounds=5)), ("depth=2", Params(rounds=8, depth=2))]).collect()
    assert [r.n_trees for r in sorted(got, key=lambda r: r.config)] == [5, 8] and sum(r.is_best for r in got) >= 1
    assert all(r.best_n_trees_accuracy >= r.accuracy and r.best_n_trees <= r.n_trees for r in got)


def test_sweep_sends_the_driver_splits_only(split, monkeypatch):
    """A level of 16 nodes and 9 columns in 32 bins is 74 kB of sums a tree; its splits are half a kB."""
    seen, advance = [], boosting._Booster.advance

    def spy(self, *found):
        seen.append(len(pickle.dumps(found)))
        return advance(self, *found)

    monkeypatch.setattr(boosting._Booster, "advance", spy)
    monkeypatch.setattr(boosting, "ROWS_PER_BLOCK", 1000)
    ml.hyperparam_sweep(*split, configs=[("default", Params(rounds=1)), ("depth=7", Params(rounds=1, depth=7))])
    assert len(seen) == 12 and max(seen) < 12_000


def test_sweep_sends_the_driver_no_more_with_more_rows(spark, split, monkeypatch):
    """Four times the rows in four times the blocks: every level returns the same few bytes a node."""
    train, test = split
    longer = ml.materialize(train.crossJoin(spark.range(4)).withColumn("date", F.expr("date_sub(date, int(id) * 4000)")).drop("id"))
    configs = [("default", Params(rounds=2, depth=4)), ("depth=6", Params(rounds=1, depth=6))]
    monkeypatch.setattr(boosting, "ROWS_PER_BLOCK", -(-train.count() // 2))
    sent, collect = [], RDD.collect

    def spy(self):
        found = collect(self)
        sent[-1].append(len(pickle.dumps(found)))
        return found

    monkeypatch.setattr(RDD, "collect", spy)
    for rows in (train, longer):
        sent.append([])
        ml.hyperparam_sweep(rows, test, configs=configs)
    assert len(sent[0]) == len(sent[1]) == 8
    assert max(sent[0] + sent[1]) < 20_000 and sum(sent[1]) < 1.1 * sum(sent[0])


def test_incomplete_rows_are_an_error_not_dropped(spark, split):
    bad = split[0].limit(50).withColumn("ret_1d", F.lit(None).cast("double"))
    with pytest.raises(Exception, match="(?i)null|invalid"):
        ml.tree_classifier(bad, rounds=2)


def test_ingest_drops_bars_without_a_close(spark):
    raw = adapters.raw_vendor_bars(spark, SF_SMALL)
    holed = raw.withColumn("Close", F.when(F.dayofmonth("Date") != 13, F.col("Close")))
    n, all_bars = ingest.ingest_bars(holed).count(), ingest.ingest_bars(raw).count()
    assert all_bars == raw.count() and n == raw.filter(F.dayofmonth("Date") != 13).count()


def test_refresh_views_hold_every_bar_and_failures_raise(spark, tmp_path):
    m = Market(spark, SF_SMALL)
    root = str(tmp_path)
    bars, index = (lambda: adapters.raw_vendor_bars(spark, SF_SMALL)), (lambda: adapters.raw_vendor_index(spark, SF_SMALL))
    span = ingest.index_fetch_range(dt.date(2001, 8, 2))
    report = job.refresh_job(spark, bars, index, m.stocks, span, root, skip_ml=True).collect()
    assert [r.status for r in report] == ["ok"] * 3
    for view in ("rolling_volatility", "rolling_sharpe", "drawdown_daily"):
        assert sinks.read_current(spark, view, root).count() == m.prices.count()
    broken = lambda: bars().drop("Close")
    with pytest.raises(job.RefreshFailed, match="ingest prices"):
        job.refresh_job(spark, broken, index, m.stocks, span, root, skip_ml=True)
    report = job.refresh_job(spark, broken, index, m.stocks, span, root, skip_ml=True, raise_on_failure=False).collect()
    assert [r.status for r in report] == ["failed"]
    assert sinks.read_current(spark, "prices_daily", root).count() == m.prices.count()


def test_later_bars_change_the_movers(spark):
    m = Market(spark, SF_SMALL)
    before = [r.ticker for r in named.top_gainers(m).collect()]
    later = Market(spark, SF_SMALL)
    last = m.prices.groupBy("ticker").agg(F.max_by("adj_close", "date").alias("p"))
    jump = last.select("ticker", F.lit(dt.date(2002, 6, 1)).alias("date"),
                       *(F.col("p").alias(c) for c in ("open", "high", "low", "close")),
                       (F.col("p") * F.when(F.col("ticker") == before[-1], 1e6).otherwise(1.0)).alias("adj_close"), F.lit(1).cast("long").alias("volume"))
    later.__dict__["prices"] = m.prices.unionByName(jump)
    after = named.top_gainers(later).collect()
    assert after[0].ticker == before[-1] != before[0]


ORDERED = {
    "index_history": [("date", 1)], "sector_performance_ytd": [("avg_ytd_return_pct", -1)], "stock_price_history": [("date", 1)],
    "stock_volatility": [("date", 1)], "stock_drawdown": [("date", 1)], "model_accuracy_over_time": [("date", 1)],
    "model_calibration": [("confidence_bucket", 1)], "model_accuracy_by_sector": [("accuracy", -1)],
    "latest_price_return": [("last_day_return_pct", -1)], "sector_return_1y": [("avg_return_pct", -1)],
    "index_cumulative": [("date", 1)], "rows_per_ticker": [("n_rows", -1)], "sector_distribution": [("n_stocks", -1)],
}


@pytest.mark.parametrize("key", sorted(ORDERED))
def test_outputs_are_ordered(spark, key):
    rows = E.queries()[key](spark, SF_SMALL).collect()
    for column, sign in ORDERED[key]:
        values = [r[column] for r in rows if r[column] is not None]
        assert values == sorted(values, reverse=sign < 0) and len(rows) > 1


def test_nulls_last_in_latest_price_return(spark):
    m = Market(spark, SF_SMALL)
    one = m.prices.limit(1).withColumn("ticker", F.lit("NATION_0")).withColumn("date", F.lit(dt.date(2001, 1, 1)))
    m.__dict__["prices"] = m.prices.filter("ticker <> 'NATION_0'").unionByName(one)
    rows = named.latest_price_return(m).collect()
    assert rows[-1].ticker == "NATION_0" and rows[-1].last_day_return_pct is None
