from helpers import SF_SMALL
from kestrel.functions.exprs import label_to_code
from kestrel.operators import quality as dq
from kestrel.plans.context import Market

CORR = "ticker_a string, ticker_b string, correlation double, n_overlap_days long"


def test_extremes_keep_the_null_order_and_tie_rules(spark):
    pairs = [("A", "B", 0.5), ("A", "C", None), ("A", "D", -0.5), ("B", "C", 0.5), ("B", "D", 0.1), ("C", "D", -0.5)]
    both = pairs + [(b, a, c) for a, b, c in pairs] + [(t, t, 1.0) for t in "ABCD"]
    corr = spark.createDataFrame([(*p, 9) for p in both], CORR).repartition(3)
    got = dq.corr_extremes(corr, "D", n=3, n_peers=2).collect()
    lists = {k: sorted((r.ticker_a, r.ticker_b) for r in got if r.kind == k) for k in ("most", "least", "peer")}
    assert lists == {"most": [("A", "B"), ("A", "C"), ("B", "C")], "least": [("A", "D"), ("B", "D"), ("C", "D")],
                     "peer": [("D", "A"), ("D", "B")]}
    assert dq.corr_extremes(corr.limit(0), "D").count() == 0


def test_extremes_compute_the_matrix_once(spark):
    plan = dq.corr_extremes(Market(spark, SF_SMALL).correlation(), "NATION_3")._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FlatMapGroupsInPandas") == 1 and "WindowGroupLimit" in plan


def test_index_is_stored_and_read_without_the_orders(spark):
    index = Market(spark, SF_SMALL).index
    plan = index._jdf.queryExecution().executedPlan().toString()
    assert "o_orderdate" not in plan and "HashAggregate" not in plan
    assert index.count() == index.select("date").distinct().count()


def test_labels_and_codes(spark):
    df = spark.createDataFrame([("Low",), ("Medium",), ("High",), ("low",), (None,)], "l string")
    assert [r[0] for r in df.select(label_to_code("l")).collect()] == [0, 1, 2, None, None]
