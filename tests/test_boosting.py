"""Gradient boosting against an exhaustive booster on a small table."""

import pickle

import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrel.operators import boosting as gb

COLUMNS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(7)
    x = np.round(rng.normal(size=(240, 3)), 1)
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(int) + (x[:, 2] > 0.5)
    rows = [(i, *map(float, r), int(k)) for i, (r, k) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id int, a double, b double, c double, y int").persist()


def exhaustive(x, y, edges, params, classes=3):
    """Every split of every node tried on the raw values; gradients rounded to the same unit."""
    margins, seen = np.zeros((len(x), classes)), np.arange(len(x)) if params.upto is None else np.arange(params.upto)
    for _ in range(params.rounds):
        p = np.exp(margins) / np.exp(margins).sum(axis=1, keepdims=True)
        g = np.rint((p - np.eye(classes)[y]) * gb.UNIT) / gb.UNIT
        h = np.rint(2 * p * (1 - p) * gb.UNIT) / gb.UNIT
        step = np.zeros_like(margins)
        for cls in range(classes):
            def grow(train, everyone, depth):
                G, H = g[train, cls].sum(), h[train, cls].sum()
                best = (1e-9, None)
                if depth:
                    for j, cuts in enumerate(edges):
                        for cut in cuts:
                            left = train[x[train, j] <= cut]
                            right = train[x[train, j] > cut]
                            hl, hr = h[left, cls].sum(), h[right, cls].sum()
                            if min(hl, hr) < params.min_hessian:
                                continue
                            gain = (g[left, cls].sum() ** 2 / (hl + params.l2) + g[right, cls].sum() ** 2 / (hr + params.l2)
                                    - G ** 2 / (H + params.l2))
                            if gain > best[0] + 1e-12:
                                best = (gain, (j, cut))
                if best[1] is None:
                    step[everyone, cls] = -params.rate * G / (H + params.l2)
                    return
                j, cut = best[1]
                for side in (lambda r: r[x[r, j] <= cut], lambda r: r[x[r, j] > cut]):
                    grow(side(train), side(everyone), depth - 1)
            grow(seen, np.arange(len(x)), params.depth)
        margins += step
    return margins


def blocks_of(table, n):
    blocks = gb.Blocks(table.repartition(n), COLUMNS, "y", ["id"], "id", bins=16)
    return blocks


def arrays(table):
    rows = sorted(table.collect())
    return np.array([r[1:4] for r in rows]), np.array([r.y for r in rows])


def test_equal_to_the_exhaustive_booster(spark, table, monkeypatch):
    monkeypatch.setattr(gb, "ROWS_PER_BLOCK", 50)       # several blocks
    params = [gb.Params(rounds=3, depth=3, rate=0.3, rows=1.0, columns=1.0),
              gb.Params(rounds=2, depth=2, rate=0.5, rows=1.0, columns=1.0, upto=120)]
    blocks = blocks_of(table, 3)
    assert blocks.rdd.getNumPartitions() == 5
    models = gb.fit_many(blocks, params)
    blocks.close()
    x, y = arrays(table)
    for model, p in zip(models, params):
        assert np.allclose(model.margins(x), exhaustive(x, y, model.edges, p), atol=1e-9)


def test_same_trees_however_the_rows_are_dealt(spark, table, monkeypatch):
    monkeypatch.setattr(gb, "SNAPSHOT", 2)              # rounds come partly from a broadcast
    x, _ = arrays(table)
    got = []
    for size in (1000, 60):
        monkeypatch.setattr(gb, "ROWS_PER_BLOCK", size)
        blocks = blocks_of(table, 4)
        got.append(gb.fit_many(blocks, [gb.Params(rounds=5, depth=3, seed=1)])[0].margins(x))
        blocks.close()
    assert (got[0] == got[1]).all()
    monkeypatch.setattr(gb, "ROWS_PER_BLOCK", 1000)
    blocks = blocks_of(table, 1)
    assert (gb.fit_many(blocks, [gb.Params(rounds=5, depth=3, seed=2)])[0].margins(x) != got[0]).any()
    blocks.close()


def test_staged_scores_are_those_of_prefixes(spark, table, tmp_path):
    blocks = blocks_of(table, 2)
    model = gb.fit_many(blocks, [gb.Params(rounds=6, depth=2, rate=0.3)])[0]
    blocks.close()
    x, y = arrays(table)
    staged = {r.n_trees: r for r in gb.staged_correct([model], table.repartition(3), "y").collect()}
    for n in range(1, 7):
        right = (model.prefix(n).margins(x).argmax(axis=1) == y).sum()
        assert (staged[n].n_correct, staged[n].n_rows) == (right, len(y))
    model.save(spark, str(tmp_path / "m"))
    again = gb.BoostedModel.load(spark, str(tmp_path / "m"))
    assert (again.margins(x) == model.margins(x)).all() and again.importances() == model.importances()
    scored = model.transform(table.repartition(4)).select("id", "probability", "prediction").orderBy("id").collect()
    assert np.allclose([r.probability for r in scored], gb.softmax(model.margins(x)))
    assert [r.prediction for r in scored] == model.margins(x).argmax(axis=1).tolist()


def test_odd_inputs(spark, table):
    with pytest.raises(ValueError, match="null"):
        gb.Blocks(table.withColumn("a", F.when(F.col("id") != 3, F.col("a"))), COLUMNS, "y", ["id"])
    flat = table.withColumns({c: F.lit(1.0) for c in COLUMNS})          # nothing to split
    model = gb.fit(flat, COLUMNS, "y", ["id"], gb.Params(rounds=2, depth=2, rate=0.3, rows=1.0))
    assert all((t.feature < 0).all() for trees in model.trees for t in trees) and model.importances() == [0.0] * 3
    share = np.bincount(arrays(table)[1], minlength=3)
    assert model.margins(np.ones((1, 3))).argmax() == share.argmax()


def test_driver_sees_splits_not_sums(spark, table, monkeypatch):
    """What a level brings to the driver follows its nodes, not columns x bins x blocks."""
    seen, advance = [], gb._Booster.advance

    def spy(self, *found):
        seen.append((1 << self.level, len(pickle.dumps(found))))
        return advance(self, *found)

    monkeypatch.setattr(gb._Booster, "advance", spy)
    for size in (1000, 60):
        monkeypatch.setattr(gb, "ROWS_PER_BLOCK", size)
        blocks = gb.Blocks(table.repartition(3), COLUMNS, "y", ["id"], bins=200)
        gb.fit_many(blocks, [gb.Params(rounds=2, depth=4), gb.Params(rounds=1, depth=2, seed=1)])
        blocks.close()
    assert len(seen) == 2 * (2 * 4 + 2)
    assert all(size < 3 * (60 * nodes + 1000) for nodes, size in seen)
