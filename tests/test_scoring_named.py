import datetime as dt

import pytest

from kestrel.operators import scoring as sc
from kestrel.plans import named as N


def _preds(spark, rows):
    return spark.createDataFrame(
        [("A", dt.date(2020, 1, i + 1), a, p, 0.1, 0.2, 0.7, c, a == p) for i, (a, p, c) in enumerate(rows)],
        "ticker string, date date, actual_regime int, predicted_regime int, prob_low double, "
        "prob_medium double, prob_high double, confidence double, correct boolean")


def test_bucket_edges_left_vs_right_closed(spark):
    p = _preds(spark, [(0, 0, 0.40), (0, 0, 0.50), (0, 0, 0.60), (0, 0, 0.70), (0, 1, 0.39)])
    left = {r.confidence_bucket: r.n_predictions for r in sc.accuracy_by_confidence_tier(p).collect()}
    assert left == {"1. <40%": 1, "2. 40-50%": 1, "3. 50-60%": 1, "4. 60-70%": 1, "5. >=70%": 1}
    right = {r.conf_bucket: r.n for r in sc.confidence_buckets_right_closed(p).collect()}
    assert right == {"<40%": 2, "40-50%": 1, "50-60%": 1, "60-70%": 1}


def test_confusion_pivot_zero_fill(spark):
    p = _preds(spark, [(0, 0, 0.5), (0, 2, 0.5), (2, 2, 0.9)])
    m = {r.actual_label: (r.Low, r.Medium, r.High) for r in sc.confusion_pivot(p).collect()}
    assert m == {"Low": (1, 0, 1), "Medium": (0, 0, 0), "High": (0, 0, 1)}
    rep = {r.label: r for r in sc.classification_report(p).collect()}
    assert rep["accuracy"].precision == pytest.approx(2 / 3) and rep["Medium"].support == 0


def test_query_by_name_unknown_lists_names(spark):
    with pytest.raises(N.UnknownQuery) as e:
        N.query_by_name(None, "no_such_query")
    assert "top_gainers" in str(e.value)


def test_named_queries_with_latest_date(spark):
    """as_of=None: every named query resolves "today" as the latest date inside its plan."""
    from helpers import SF_SMALL
    from kestrel.plans.context import Market
    m = Market(spark, SF_SMALL, as_of=None, index_as_of=None)
    for name, fn in N.NAMED.items():
        assert fn(m).count() >= 0, name
