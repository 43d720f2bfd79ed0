import random

import numpy as np
from pyspark.sql import Row

from kestrel.operators.quantiles import exact_quantiles


def _check(spark, values_by_group, probs, **kw):
    rows = [Row(g=g, v=float(v)) for g, vs in values_by_group.items() for v in vs]
    got = {(r.g, r.p): r.quantile for r in exact_quantiles(spark.createDataFrame(rows), ["g"], "v", probs, **kw).collect()}
    for g, vs in values_by_group.items():
        for p in probs:
            assert abs(got[(g, p)] - np.quantile(np.array(vs, dtype=float), p)) <= 1e-9 * max(1.0, abs(got[(g, p)]))


def test_narrowing_passes_exact(spark):
    rnd = random.Random(5)
    groups = {"hot": [rnd.gauss(0, 1) for _ in range(5000)], "small": [rnd.random() for _ in range(7)],
              "one": [3.5]}
    # Few buckets force many narrowing passes.
    _check(spark, groups, [0.25, 0.5, 0.75, 1 / 3], buckets=8)


def test_heavy_duplicates_and_constant(spark):
    groups = {"dup": [1.0] * 400 + [2.0] * 300 + [5.0] * 3, "const": [7.0] * 50}
    _check(spark, groups, [0.1, 0.5, 0.9], buckets=4)


def test_passes_never_shuffle_the_values(spark):
    from kestrel.operators import quantiles as Q
    df = spark.createDataFrame([("g", float(i)) for i in range(50)], "g string, v double")
    state = spark.createDataFrame([("g", 0.0, 49.0, 0.5, 0, 24, 0.5)], "g string, lo double, hi double, p double, which int, k long, frac double")
    plan = Q._narrow(df, state, ["g"], 8, True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") <= 1 and "BroadcastHashJoin" in plan   # the one merge is of state rows
    values = plan[plan.rindex("BroadcastHashJoin"):]
    assert "SortMergeJoin" not in values
