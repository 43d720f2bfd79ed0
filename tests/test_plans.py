"""Plan-shape guards for the scale design (checked on the physical plan text)."""

import re

import pytest

import __spark_entry__ as E
from helpers import SF_SMALL
from kestrel.sources import adapters


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _between(plan: str, below: str, above: str) -> str:
    """Plan text from the first ``above`` operator down to the first ``below`` after it."""
    i = plan.index(above)
    j = plan.find(below, i)
    return plan[i:j if j >= 0 else len(plan)]


@pytest.mark.parametrize("key", ["returns_daily", "rolling_volatility", "rolling_sharpe", "drawdown_daily"])
def test_ticker_windows_read_bucketed_bars_without_shuffle(spark, key):
    plan = _plan(E.queries()[key](spark, SF_SMALL))
    assert "Bucketed: true" in plan
    assert "Exchange" not in _between(plan, "FileScan", "Window")


@pytest.mark.parametrize("key", ["highest_volatility", "top_gainers", "best_sharpe", "biggest_moves",
                                 "top_correlated_pairs", "extreme_returns"])
def test_topk_is_take_ordered(spark, key):
    plan = _plan(E.queries()[key](spark, SF_SMALL))
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan


def test_bar_aggregation_is_partial_before_the_shuffle(spark):
    plan = _plan(adapters.prices_daily(spark, SF_SMALL))
    assert re.search(r"partial_max\(unit", plan) and "Exchange hashpartitioning" in plan
    assert "SortAggregate" not in plan
    # the big side is streamed, never broadcast: lineitem is not under a BroadcastExchange
    for m in re.finditer(r"BroadcastExchange", plan):
        assert "lineitem" not in plan[m.start():m.start() + 600]


def test_correlation_has_no_date_self_join(spark):
    plan = _plan(E.queries()["correlation_matrix"](spark, SF_SMALL))
    assert "FlatMapGroupsInPandas" in plan
    assert not re.search(r"(SortMergeJoin|BroadcastHashJoin|ShuffledHashJoin) \[date", plan)
