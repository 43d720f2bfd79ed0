"""Distributed gradient boosting for three or more classes (softmax, second order, histogram trees).

The training rows are binned once into packed blocks that Spark keeps. A round grows one tree per
class, level by level: every block sums gradients and hessians per node, column and bin, Spark adds
the blocks' histograms up by tree, the task that holds a tree's sums splits its nodes, and the driver
sees only the splits: a few numbers a node, however many rows, columns and blocks there are. Sums are fixed-point integers, so the trees do not depend on how the rows
are dealt to blocks or on the order of the additions.

Several boosters (parameter sets, or expanding prefixes of the rows) grow side by side in the same
jobs over the same blocks: ``fit_many``.

A row's margins follow from the trees so far. A worker keeps the margins it has for a block and
catches up from the round it knows; one that has none (a new worker, a lost executor) starts at
round 0. So nothing but the trees has to survive, and no lineage grows with the rounds.
"""

from __future__ import annotations

import json
import pickle
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from kestrel.config import checkpoint_dir

BINS = 32
ROWS_PER_BLOCK = 1 << 16    # at least; beyond two blocks a core they grow. One block needs no shuffle a level
UNIT = float(1 << 20)          # gradients are summed as multiples of 1 / UNIT
SNAPSHOT = 25                  # rounds between broadcasts of the trees so far
EDGE_ACCURACY = 10_000


@dataclass(frozen=True)
class Params:
    rounds: int = 300
    depth: int = 5
    rate: float = 0.05
    rows: float = 0.8          # share of the rows a round sees
    columns: float = 0.8       # share of the columns a tree sees
    seed: int = 42
    l2: float = 1.0
    min_hessian: float = 1.0
    upto: int | None = None    # train on rows at positions below it only


@dataclass
class Tree:
    """A complete binary tree in arrays; node i has children 2 i and 2 i + 1. ``feature`` -1: a leaf."""
    feature: np.ndarray
    cut: np.ndarray            # a row whose bin is above goes right
    value: np.ndarray
    gain: np.ndarray

    @staticmethod
    def empty(depth: int) -> "Tree":
        n = 2 << depth
        return Tree(np.full(n, -1, np.int8), np.zeros(n, np.uint8), np.zeros(n), np.zeros(n))


def _descend(bins: np.ndarray, tree: Tree, nodes: np.ndarray) -> np.ndarray:
    """One level down; rows in a leaf stay where they are."""
    feature = tree.feature[nodes]
    inner = feature >= 0
    right = bins[np.arange(len(nodes)), np.where(inner, feature, 0)] > tree.cut[nodes]
    return np.where(inner, 2 * nodes + right, nodes)


def tree_output(bins: np.ndarray, tree: Tree) -> np.ndarray:
    nodes = np.ones(len(bins), np.int32)
    for _ in range(int(len(tree.feature)).bit_length() - 2):
        nodes = _descend(bins, tree, nodes)
    return tree.value[nodes]


def to_bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Column-wise number of edges below each value."""
    return np.stack([np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(edges)], axis=1).astype(np.uint8)


def softmax(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def sampled(keys: np.ndarray, seed: int, round_no: int, share: float) -> np.ndarray:
    """Rows of a round: a mix of key, seed and round below ``share``."""
    if share >= 1:
        return np.ones(len(keys), bool)
    with np.errstate(over="ignore"):
        z = keys + np.uint64((seed * 1_000_003 + round_no + 1) & 0xFFFFFFFF) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return (z >> np.uint64(11)).astype(np.float64) < share * float(1 << 53)


def sampled_columns(n: int, params: Params, round_no: int, cls: int) -> np.ndarray:
    count = max(1, int(params.columns * n))
    return np.sort(np.random.default_rng([params.seed, round_no, cls]).permutation(n)[:count])


# ---- blocks ---------------------------------------------------------------------------

def bin_edges(train: DataFrame, columns: list[str], bins: int = BINS) -> list[np.ndarray]:
    """Distinct quantile edges per column, one aggregation."""
    shares = [i / bins for i in range(1, bins)]
    row = train.agg(*(F.percentile_approx(c, shares, EDGE_ACCURACY).alias(c) for c in columns)).first()
    return [np.unique(np.array(row[c] or [0.0], dtype=np.float64)) for c in columns]


class Blocks:
    """Binned training rows, a block a partition: (number, bins, labels, keys, positions)."""

    def __init__(self, train: DataFrame, columns: list[str], label: str, key: list[str], position: str | None = None,
                 bins: int = BINS):
        spark = train.sparkSession
        incomplete = train.filter(" OR ".join(f"{c} IS NULL OR isnan({c})" for c in columns) + f" OR {label} IS NULL")
        if not incomplete.isEmpty():
            raise ValueError("null or NaN in the training rows")
        self.spark, self.columns, self.edges = spark, columns, bin_edges(train, columns, bins)
        stats = train.agg(F.count(F.lit(1)).alias("n"), F.max(label).alias("top")).first()
        self.rows, self.classes, self.bins = stats["n"], int(stats["top"] or 0) + 1, bins
        edges, names = self.edges, columns

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = [b for b in batches if b.num_rows]
            if not table:
                return
            t = pa.Table.from_batches(table)
            x = np.column_stack([t.column(c).to_numpy() for c in names]).astype(np.float64)
            packed = [to_bins(x, edges).tobytes(), t.column("label").to_numpy().astype(np.int8).tobytes(),
                      t.column("key").to_numpy().astype(np.int64).tobytes(), t.column("position").to_numpy().astype(np.int64).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.binary()) for p in packed], ["bins", "label", "key", "position"])

        rows = train.select(*(F.col(c).cast("double").alias(c) for c in columns), F.col(label).cast("int").alias("label"),
                            F.xxhash64(*key).alias("key"), (F.col(position) if position else F.lit(0)).cast("long").alias("position"))
        n = max(1, min(-(-self.rows // ROWS_PER_BLOCK), 2 * spark.sparkContext.defaultParallelism))
        packed = rows.repartition(n).mapInArrow(pack, "bins binary, label binary, key binary, position binary")
        checkpoint_dir(spark)
        packed = packed.checkpoint()      # every job walks the lineage of the blocks
        width = len(columns)

        def unpack(number: int, found) -> Iterator[tuple]:
            for i, r in enumerate(found):
                yield ((number, i), np.frombuffer(r.bins, np.uint8).reshape(-1, width), np.frombuffer(r.label, np.int8),
                       np.frombuffer(r.key, np.int64).astype(np.uint64), np.frombuffer(r.position, np.int64))

        self.rdd = packed.rdd.mapPartitionsWithIndex(unpack).persist(StorageLevel.MEMORY_AND_DISK)

    def close(self) -> None:
        self.rdd.unpersist()


# ---- one level, in the workers ---------------------------------------------------------

@dataclass
class _Growing:
    """One booster as the workers see it."""
    params: Params
    trees: list[list[Tree]]                  # rounds from ``base`` on
    base: int
    current: list[Tree]                      # the round being grown, one tree a class
    columns: list[np.ndarray]
    level: int


@dataclass
class _State:
    round_no: int
    margins: np.ndarray
    gradients: tuple | None = None           # (round, rows, g, h)
    nodes: tuple | None = None               # (round, level, node of the sampled rows per class)


_STATES: dict[tuple, _State] = {}            # (fit, booster, block) -> what this worker knows


def _caught_up(fit: str, k: int, block: tuple, g: _Growing, snapshot) -> _State:
    number, bins, labels, keys, positions = block
    for old in [s for s in _STATES if s[0] != fit]:
        del _STATES[old]
    state = _STATES.get((fit, k, number))
    if state is None:
        state = _STATES[fit, k, number] = _State(0, np.zeros((len(labels), len(g.current))))
    upto = g.base + len(g.trees)
    earlier = snapshot.value[k] if state.round_no < g.base else None
    for r in range(state.round_no, upto):
        for cls, tree in enumerate(earlier[r] if r < g.base else g.trees[r - g.base]):
            state.margins[:, cls] += tree_output(bins, tree)
    state.round_no = upto
    if state.gradients is None or state.gradients[0] != upto:
        p = g.params
        seen = sampled(keys, p.seed, upto, p.rows)
        if p.upto is not None:
            seen &= positions < p.upto
        rows = np.flatnonzero(seen)
        prob = softmax(state.margins[rows])
        grad = np.rint((prob - (labels[rows, None] == np.arange(prob.shape[1]))) * UNIT)
        hess = np.rint(np.maximum(2 * prob * (1 - prob), 1e-16) * UNIT)
        state.gradients, state.nodes = (upto, rows, grad, hess), None
    return state


def _histograms(fit: str, growing: dict[int, _Growing], snapshot, n_bins: int, blocks) -> dict[int, list[np.ndarray]]:
    """Per booster and class: int64 sums (column, node x bin, 2) of this task's rows on the current level."""
    total: dict[int, list[np.ndarray]] = {}
    for block in blocks:
        for k, g in growing.items():
            state = _caught_up(fit, k, block, g, snapshot)
            round_no, rows, grad, hess = state.gradients
            bins = block[1][rows]
            at = state.nodes
            if at is None or at[0] != round_no or at[1] > g.level:
                at = (round_no, 0, [np.ones(len(rows), np.int32) for _ in g.current])
            nodes = at[2]
            for _ in range(at[1], g.level):
                nodes = [_descend(bins, t, n) for t, n in zip(g.current, nodes)]
            state.nodes = (round_no, g.level, nodes)
            first, sums = 1 << g.level, []
            for cls, node in enumerate(nodes):
                columns = g.columns[cls]
                active = np.flatnonzero(node >= first)
                size, out = first * n_bins, np.zeros((len(columns), first * n_bins, 2), np.int64)
                local = (node[active] - first).astype(np.int64) * n_bins
                gc, hc, b = grad[active, cls], hess[active, cls], bins[active]
                for j, c in enumerate(columns):
                    flat = local + b[:, c]          # sums of whole numbers below 2 ** 53 are exact as doubles
                    out[j, :, 0] = np.bincount(flat, gc, size)
                    out[j, :, 1] = np.bincount(flat, hc, size)
                sums.append(out)
            total[k] = [a + b for a, b in zip(total[k], sums)] if k in total else sums
    return total


def _pack(sums: np.ndarray) -> bytes:
    return zlib.compress(pickle.dumps(sums, pickle.HIGHEST_PROTOCOL), 1)


def _unpack(packed: bytes) -> np.ndarray:
    return pickle.loads(zlib.decompress(packed))


def _added(a: bytes, b: bytes) -> bytes:
    return _pack(_unpack(a) + _unpack(b))


# ---- splits, where a tree's sums meet -----------------------------------------------------

def best_splits(sums: np.ndarray, columns: np.ndarray, level: int, n_bins: int, params: Params, tree: Tree) -> None:
    """Split the nodes of a level from their sums (column, node x bin, 2); ties: first column, lowest cut."""
    first = 1 << level
    s = sums.reshape(len(columns), first, n_bins, 2).astype(np.float64) / UNIT
    left = s.cumsum(axis=2)
    whole = left[:, :, -1:, :]
    right = whole - left

    def score(x):
        return x[..., 0] ** 2 / (x[..., 1] + params.l2)

    gain = score(left) + score(right) - score(whole)
    gain[(left[..., 1] < params.min_hessian) | (right[..., 1] < params.min_hessian)] = -np.inf
    for i in range(first):
        node = first + i
        if level and tree.feature[node // 2] < 0:
            continue
        if level == 0:
            g, h = whole[0, i, 0]
            tree.value[node] = -params.rate * g / (h + params.l2)
        j, cut = np.unravel_index(np.argmax(gain[:, i]), gain[:, i].shape)
        if not gain[j, i, cut] > 1e-9:
            continue
        tree.feature[node], tree.cut[node], tree.gain[node] = columns[j], cut, gain[j, i, cut]
        for child, (g, h) in ((2 * node, left[j, i, cut]), (2 * node + 1, right[j, i, cut])):
            tree.value[child] = -params.rate * g / (h + params.l2)


@dataclass
class _Split:
    """Sums of a tree's level -> its splits."""
    growing: dict[int, _Growing]
    classes: int
    n_bins: int

    def __call__(self, found: tuple[int, bytes]) -> tuple[int, tuple]:
        k, cls = divmod(found[0], self.classes)
        g = self.growing[k]
        tree, first = g.current[cls], 1 << g.level
        best_splits(_unpack(found[1]), g.columns[cls], g.level, self.n_bins, g.params, tree)
        own, below = slice(first, 2 * first), slice(first, 4 * first)
        return found[0], (tree.feature[own], tree.cut[own], tree.gain[own], tree.value[below])


@dataclass
class _Booster:
    """A booster between two jobs, on the driver."""
    params: Params
    classes: int
    width: int
    done: list[list[Tree]] = field(default_factory=list)
    current: list[Tree] = field(default_factory=list)
    columns: list[np.ndarray] = field(default_factory=list)
    level: int = 0
    sent: int = 0                            # rounds in the snapshot

    def start_round(self) -> None:
        r, self.level = len(self.done), 0
        self.current = [Tree.empty(self.params.depth) for _ in range(self.classes)]
        self.columns = [sampled_columns(self.width, self.params, r, c) for c in range(self.classes)]

    def advance(self, splits: dict[int, tuple]) -> None:
        """One level on, from the splits of every class."""
        first = 1 << self.level
        for cls, tree in enumerate(self.current):
            own, below = slice(first, 2 * first), slice(first, 4 * first)
            tree.feature[own], tree.cut[own], tree.gain[own], tree.value[below] = splits[cls]
        self.level += 1
        if self.level == self.params.depth:
            self.done.append(self.current)
            self.start_round()


def fit_many(blocks: Blocks, params: list[Params]) -> list["BoostedModel"]:
    """One model per parameter set; each job serves the current level of every booster that still grows."""
    fit, sc = uuid.uuid4().hex, blocks.spark.sparkContext
    boosters = {k: _Booster(p, blocks.classes, len(blocks.columns)) for k, p in enumerate(params)}
    for b in boosters.values():
        b.start_round()
    snapshot = None
    while growing := {k: b for k, b in boosters.items() if len(b.done) < b.params.rounds}:
        if any(len(b.done) >= b.sent + SNAPSHOT for b in growing.values()):
            old, snapshot = snapshot, sc.broadcast({k: b.done[:] for k, b in growing.items()})
            for b in growing.values():
                b.sent = len(b.done)
            if old is not None:
                old.unpersist()
        task = _Task(fit, {k: _Growing(b.params, b.done[b.sent:], b.sent, b.current, b.columns, b.level)
                           for k, b in growing.items()}, snapshot, blocks.bins)
        split = _Split({k: replace(g, trees=[]) for k, g in task.growing.items()}, blocks.classes, blocks.bins)
        tasks = min(blocks.classes * len(growing), sc.defaultParallelism)
        sums = blocks.rdd.mapPartitions(task)
        if blocks.rdd.getNumPartitions() > 1:
            sums = sums.reduceByKey(_added, tasks, _itself)
        found = dict(sums.map(split).collect())
        for k, b in growing.items():
            b.advance({cls: found[k * blocks.classes + cls] for cls in range(blocks.classes)})
    return [BoostedModel(blocks.columns, blocks.edges, blocks.classes, b.params, b.done) for b in boosters.values()]


@dataclass
class _Task:
    fit: str
    growing: dict[int, _Growing]
    snapshot: object
    n_bins: int

    def __call__(self, blocks) -> Iterator[tuple[int, bytes]]:
        """Number of a booster's tree (booster x classes + class) and its sums."""
        for k, sums in _histograms(self.fit, self.growing, self.snapshot, self.n_bins, blocks).items():
            for cls, x in enumerate(sums):
                yield k * len(sums) + cls, _pack(x)


def _itself(key: int) -> int:
    return key


# ---- the model ----------------------------------------------------------------------------

@dataclass
class BoostedModel:
    columns: list[str]
    edges: list[np.ndarray]
    classes: int
    params: Params
    trees: list[list[Tree]] = field(repr=False)

    def margins(self, x: np.ndarray) -> np.ndarray:
        bins, out = to_bins(x, self.edges), np.zeros((len(x), self.classes))
        for trees in self.trees:
            for cls, tree in enumerate(trees):
                out[:, cls] += tree_output(bins, tree)
        return out

    def prefix(self, rounds: int) -> "BoostedModel":
        return replace(self, trees=self.trees[:rounds], params=replace(self.params, rounds=rounds))

    def probability(self, spark: SparkSession) -> Column:
        """array<double> of the class probabilities of ``columns``."""
        held = spark.sparkContext.broadcast(self)

        @F.pandas_udf("array<double>")
        def predict(x: pd.DataFrame) -> pd.Series:
            values = x.to_numpy(np.float64)
            if np.isnan(values).any():
                raise ValueError("null or NaN in the rows to predict")
            return pd.Series(list(softmax(held.value.margins(values))))

        return predict(F.struct(*(F.col(c).cast("double") for c in self.columns)))

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``probability`` (array) and ``prediction`` (ties: the lowest class)."""
        scored = df.withColumn("probability", self.probability(df.sparkSession))
        p = F.col("probability")
        return scored.withColumn("prediction", (F.array_position(p, F.array_max(p)) - 1).cast("double"))

    def importances(self) -> list[float]:
        """Mean gain of a column's splits, scaled to sum 1."""
        total, n = np.zeros(len(self.columns)), np.zeros(len(self.columns))
        for trees in self.trees:
            for t in trees:
                inner = t.feature >= 0
                np.add.at(total, t.feature[inner], t.gain[inner])
                np.add.at(n, t.feature[inner], 1)
        mean = np.divide(total, n, out=np.zeros_like(total), where=n > 0)
        return (mean / mean.sum() if mean.sum() > 0 else mean).tolist()

    def save(self, spark: SparkSession, path: str) -> None:
        """Nodes and one row of settings as Parquet below ``path``."""
        rows = [(r, c, int(i), int(t.feature[i]), int(t.cut[i]), float(t.value[i]), float(t.gain[i]))
                for r, trees in enumerate(self.trees) for c, t in enumerate(trees) for i in np.flatnonzero((t.feature >= 0) | (t.value != 0))]
        spark.createDataFrame(rows, "round int, cls int, node int, feature int, cut int, value double, gain double") \
            .coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        meta = {"columns": self.columns, "edges": [e.tolist() for e in self.edges], "classes": self.classes, "params": asdict(self.params)}
        spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "BoostedModel":
        meta = json.loads(spark.read.parquet(f"{path}/meta").first()["meta"])
        params = Params(**meta["params"])
        trees = [[Tree.empty(params.depth) for _ in range(meta["classes"])] for _ in range(params.rounds)]
        for r in spark.read.parquet(f"{path}/nodes").collect():     # the model's own size
            t = trees[r["round"]][r["cls"]]
            t.feature[r["node"]], t.cut[r["node"]], t.value[r["node"]], t.gain[r["node"]] = r["feature"], r["cut"], r["value"], r["gain"]
        return BoostedModel(meta["columns"], [np.array(e) for e in meta["edges"]], meta["classes"], params, trees)


def fit(train: DataFrame, columns: list[str], label: str, key: list[str], params: Params = Params()) -> BoostedModel:
    blocks = Blocks(train, columns, label, key)
    try:
        return fit_many(blocks, [params])[0]
    finally:
        blocks.close()


def staged_correct(models: list[BoostedModel], test: DataFrame, label: str, bounds: list[tuple[int, int]] | None = None,
                   position: str | None = None) -> DataFrame:
    """model, n_trees, n_correct, n_rows: right answers of every prefix of every model, in one pass over ``test``.

    With ``bounds`` a model is scored on the rows at positions of its own half-open range.
    """
    held = test.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(m.trees), np.int64) for m in held.value]
        rows = [0] * len(held.value)
        for b in batches:
            y, at = b.column("label").to_numpy(), b.column("position").to_numpy()
            for k, m in enumerate(held.value):
                mine = slice(None) if bounds is None else (at >= bounds[k][0]) & (at < bounds[k][1])
                x, labels = np.column_stack([b.column(c).to_numpy() for c in m.columns])[mine], y[mine]
                bins, margins = to_bins(x, m.edges), np.zeros((len(labels), m.classes))
                rows[k] += len(labels)
                for r, trees in enumerate(m.trees):
                    for cls, tree in enumerate(trees):
                        margins[:, cls] += tree_output(bins, tree)
                    counts[k][r] += int((margins.argmax(axis=1) == labels).sum())
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, c in enumerate(counts) for _ in c], pa.int32()), pa.array([r + 1 for c in counts for r in range(len(c))], pa.int32()),
             pa.array([int(x) for c in counts for x in c], pa.int64()), pa.array([rows[k] for k, c in enumerate(counts) for _ in c], pa.int64())],
            ["model", "n_trees", "n_correct", "n_rows"])

    columns = models[0].columns
    seen = test.select(*(F.col(c).cast("double").alias(c) for c in columns), F.col(label).cast("int").alias("label"),
                       (F.col(position) if position else F.lit(0)).cast("long").alias("position"))
    return seen.mapInArrow(run, "model int, n_trees int, n_correct long, n_rows long").groupBy("model", "n_trees").agg(
        F.sum("n_correct").alias("n_correct"), F.sum("n_rows").alias("n_rows"))
