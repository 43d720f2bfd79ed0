"""Volatility-regime classifier on ``pyspark.ml``.

* data: labelled feature rows; the time split is one scalar subquery (max date)
  plus filters, never a driver-side loop over rows;
* scaling: z-scores with the training set's mean and POPULATION std, as one
  aggregation whose one-row result is used as a scalar subquery;
* models: multinomial logistic regression (the baseline) and softmax gradient
  boosting (``operators/boosting.py``); both train distributed;
* the training frame is checkpointed to ``spark.checkpoint.dir`` before
  iterative fits: each pass re-reads materialised rows, lineage is cut, and a
  lost executor recomputes from the checkpoint.

Parity note: the original boosted-tree library draws its samples with its own
random numbers; model accuracy is reported, not matched.
"""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kestrel.config import FEATURE_COLS, checkpoint_dir
from kestrel.operators import boosting
from kestrel.operators.boosting import BoostedModel, Params

TEST_DAYS = 360
LABEL = "regime"
KEY = ["ticker", "date"]
FOREST_DEFAULTS = dict(numTrees=300, maxDepth=5, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=42)


def load_features(features: DataFrame) -> DataFrame:
    """L1: labelled rows, features as double, regime as int."""
    return features.filter(F.col(LABEL).isNotNull()).select(
        "ticker", "date", *[F.col(c).cast("double").alias(c) for c in FEATURE_COLS],
        F.col("abs_return_next").cast("double").alias("abs_return_next"),
        F.col(LABEL).cast("int").alias(LABEL))


def cutoff_date(df: DataFrame, test_days: int = TEST_DAYS):
    """max(date) - test_days as a scalar-subquery Column."""
    return df.select(F.date_sub(F.max("date"), test_days)).scalar()


def time_split(df: DataFrame, test_days: int = TEST_DAYS, inclusive_train: bool = False):
    """Train before the cutoff (``<``, or ``<=`` for the tuner), test after it (``>``)."""
    cut = cutoff_date(df, test_days)
    train = df.filter(F.col("date") <= cut) if inclusive_train else df.filter(F.col("date") < cut)
    test = df.filter(F.col("date") > cut)
    return train, test


def split_summary(df: DataFrame, test_days: int = TEST_DAYS, inclusive_train: bool = False) -> DataFrame:
    cut = cutoff_date(df, test_days)
    train_cond = (F.col("date") <= cut) if inclusive_train else (F.col("date") < cut)
    part = F.when(train_cond, "train").when(F.col("date") > cut, "test").otherwise("excluded")
    return df.groupBy(part.alias("split")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def scaler_stats(train: DataFrame, cols: list[str] = FEATURE_COLS) -> DataFrame:
    """Per-feature training mean and population std (0 std scales by 1, as the reference scaler does)."""
    return train.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).alias("x")) for c in cols])).alias("s")) \
        .select("s.*").groupBy("feature").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))


def standard_scale(train: DataFrame, other: DataFrame, cols: list[str] = FEATURE_COLS) -> DataFrame:
    """L3: z-score ``other`` with ``train`` statistics (one-row scalar subquery, no join)."""
    stats = train.select(F.struct(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c)
                                    for c in cols])).scalar()
    scaled = []
    for c in cols:
        m, s = stats.getField(c).getField("m"), stats.getField(c).getField("s")
        scaled.append(((F.col(c) - m) / F.when(s > 0, s).otherwise(F.lit(1.0))).alias(c))
    keep = [c for c in other.columns if c not in cols]
    return other.select(*keep, *scaled)


def _assembler(cols: list[str] = FEATURE_COLS) -> VectorAssembler:
    return VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="error")


def materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (shared checkpoint folder) before iterative algorithms."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def logistic_baseline(train: DataFrame, max_iter: int = 1000, c: float = 1.0) -> PipelineModel:
    """L4: multinomial LR on z-scored inputs; L2 strength C=1 maps to regParam = 1 / (C * n_train)."""
    n = train.count()
    lr = LogisticRegression(featuresCol="features", labelCol=LABEL, family="multinomial", maxIter=max_iter,
                            regParam=1.0 / (c * max(n, 1)), elasticNetParam=0.0, standardization=False)
    return Pipeline(stages=[_assembler(), lr]).fit(train)


def tree_classifier(train: DataFrame, **params) -> BoostedModel:
    """Gradient-boosted trees with 3-class probabilities."""
    return boosting.fit(train, FEATURE_COLS, LABEL, KEY, Params(**params))


def forest_classifier(train: DataFrame, **params) -> PipelineModel:
    """A random forest, the yardstick of the boosted trees."""
    rf = RandomForestClassifier(featuresCol="features", labelCol=LABEL, **{**FOREST_DEFAULTS, **params})
    return Pipeline(stages=[_assembler(), rf]).fit(train)


def accuracy(model: PipelineModel | BoostedModel, test: DataFrame) -> float:
    pred = model.transform(test)
    return MulticlassClassificationEvaluator(labelCol=LABEL, predictionCol="prediction",
                                             metricName="accuracy").evaluate(pred)


def generate_predictions(model: PipelineModel | BoostedModel, test: DataFrame) -> DataFrame:
    """The ml_predictions relation from a fitted model."""
    p = model.transform(test)
    p = p.withColumn("prob", F.col("probability") if isinstance(model, BoostedModel) else vector_to_array("probability"))
    return p.select(
        "ticker", "date", F.col(LABEL).alias("actual_regime"),
        F.col("prediction").cast("int").alias("predicted_regime"),
        F.col("prob")[0].alias("prob_low"), F.col("prob")[1].alias("prob_medium"), F.col("prob")[2].alias("prob_high"),
        F.array_max("prob").alias("confidence"),
        (F.col("prediction").cast("int") == F.col(LABEL)).alias("correct"),
    )


def prediction_checks(predictions: DataFrame) -> DataFrame:
    """Every predicted row with its label, and whether its probabilities fit its prediction."""
    p = F.array("prob_low", "prob_medium", "prob_high")
    return predictions.select(
        "ticker", "date", "actual_regime", (F.abs(F.col("prob_low") + F.col("prob_medium") + F.col("prob_high") - 1) < 1e-9).alias("probabilities_sum_to_1"),
        ((p[F.col("predicted_regime")] == F.array_max(p)) & (F.col("confidence") == F.array_max(p))
         & (F.col("correct") == (F.col("predicted_regime") == F.col("actual_regime")))).alias("most_probable_predicted"))


def feature_importance(spark: SparkSession, model: BoostedModel) -> DataFrame:
    """Mean split gain of the 12 inputs, ranked (12 numbers of the model, not data)."""
    df = spark.createDataFrame(list(zip(model.columns, model.importances())), "feature string, importance double")
    return df.withColumn("rank", F.row_number().over(Window.orderBy(F.col("importance").desc(), "feature")))


def _date_offsets(df: DataFrame) -> DataFrame:
    """Rows per date and the number of rows on earlier dates (one row per date)."""
    per_date = df.groupBy("date").agg(F.count(F.lit(1)).alias("c"))
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    return per_date.withColumn("before", F.coalesce(F.sum("c").over(w), F.lit(0)))


def row_positions(df: DataFrame) -> DataFrame:
    """0-based position of every row in (date, ticker) order without a global sort:
    rows on earlier dates (small per-date table) plus the rank inside the row's date."""
    offsets = _date_offsets(df).select("date", "before")
    rank = F.row_number().over(Window.partitionBy("date").orderBy("ticker")) - 1
    return df.join(offsets, "date").withColumn("pos", F.col("before") + rank).drop("before")


def fold_bounds(train: DataFrame, n_splits: int = 3) -> DataFrame:
    """Expanding walk-forward folds cut by row position in (date, ticker) order.

    Positions come from per-date row counts and a running sum over dates
    (one row per date, bounded by the calendar); the cut row is located in
    its date without sorting the whole table.
    """
    per_date = _date_offsets(train)
    n = train.select(F.count(F.lit(1))).scalar()
    size = F.floor(n / (n_splits + 1))
    folds = train.sparkSession.range(1, n_splits + 1).select(F.col("id").cast("int").alias("fold"))
    folds = folds.select("fold", (n - (n_splits + 1 - F.col("fold")) * size).alias("train_size"),
                         size.alias("test_size"))
    located = folds.join(per_date, (F.col("train_size") >= F.col("before"))
                         & (F.col("train_size") < F.col("before") + F.col("c")), "left")
    return located.select("fold", F.col("train_size").cast("bigint").alias("train_size"),
                          F.col("test_size").cast("bigint").alias("test_size"),
                          F.col("date").alias("test_start_date"),
                          (F.col("train_size") - F.col("before")).cast("bigint").alias("rows_into_date"))


def _segments(train: DataFrame, n_splits: int) -> DataFrame:
    """Rows with their segment: 0 before the first cut, k the test rows of fold k."""
    n = train.select(F.count(F.lit(1))).scalar()
    size = F.floor(n / (n_splits + 1))
    after = F.col("pos") - (n - n_splits * size)     # rows since the first cut
    return row_positions(train).withColumn("segment", F.when((after < 0) | (size == 0), 0).otherwise(
        F.floor(after / F.greatest(size, F.lit(1))) + 1).cast("int"))


def fold_states(train: DataFrame, cols: list[str] = FEATURE_COLS, n_splits: int = 3) -> DataFrame:
    """Mergeable statistics of a walk-forward split, from one aggregation over the rows.

    One row per (month, segment, feature): rows, mean, centred sum of squares and range. A
    segment is the rows between two cuts, so only the month that holds a cut has two
    states; their number is the calendar's, not the data's. Null and NaN values are no part of
    a state; a feature without any has n = 0.
    """
    of = [F.nanvl(F.col(c), F.lit(None).cast("double")).alias(c) for c in cols]
    sums = _segments(train, n_splits).select(F.trunc("date", "month").alias("month"), "segment", *of).groupBy("month", "segment").agg(
        *[F.struct(F.lit(c).alias("feature"), F.count(c).alias("n"), F.avg(c).alias("mean"),
                   (F.var_pop(c) * F.count(c)).alias("squares"), F.min(c).alias("low"), F.max(c).alias("high")).alias(c)
          for c in cols])
    return sums.select("month", "segment", F.explode(F.array(*cols)).alias("s")).select("month", "segment", "s.*")


def merge_states(states: DataFrame, keys: list[str]) -> DataFrame:
    """The states of disjoint rows as one state per key: centred sums move to the common mean."""
    part = Window.partitionBy(*keys)
    total = F.sum("n").over(part)
    mean = F.sum(F.col("n") * F.col("mean")).over(part) / F.nullif(total, F.lit(0))
    return states.withColumn("_mean", mean).groupBy(*keys).agg(
        F.sum("n").alias("n"), F.first("_mean").alias("mean"),
        F.sum(F.col("squares") + F.col("n") * F.pow(F.col("mean") - F.col("_mean"), 2)).alias("squares"),
        F.min("low").alias("low"), F.max("high").alias("high"))


def fold_statistics(states: DataFrame, n_splits: int = 3) -> DataFrame:
    """Scaler statistics of every expanding fold, as prefix sums of :func:`fold_states`.

    The months of a segment are merged first; fold k then merges the segments before k.
    """
    segments = merge_states(states, ["segment", "feature"])
    grown = segments.filter(F.col("segment") < n_splits).withColumn(
        "fold", F.explode(F.sequence(F.col("segment") + 1, F.lit(n_splits))))
    return merge_states(grown, ["fold", "feature"]).select(
        "fold", "feature", F.col("n").alias("n_train"), "mean",
        F.sqrt(F.col("squares") / F.nullif(F.col("n"), F.lit(0))).alias("std"), "low", "high")


def fold_scaled(train: DataFrame, cols: list[str] = FEATURE_COLS, n_splits: int = 3) -> DataFrame:
    """Every fold's test rows, z-scored with the statistics of the rows before them (population std, 0 scales by 1).

    The rows are aggregated once and read once more; the folds' statistics are n_splits rows.
    """
    folds = fold_statistics(fold_states(train, cols, n_splits), n_splits).groupBy(F.col("fold").alias("segment")).agg(
        *[F.max(F.when(F.col("feature") == c, F.struct("mean", "std"))).alias(f"_{c}") for c in cols])
    scaled = [((F.col(c) - F.col(f"_{c}.mean")) / F.when(F.col(f"_{c}.std") > 0, F.col(f"_{c}.std")).otherwise(1.0)).alias(c)
              for c in cols]
    keep = [c for c in train.columns if c not in cols]
    return _segments(train, n_splits).join(F.broadcast(folds), "segment").select(F.col("segment").alias("fold"), *keep, *scaled)


# The cross-validation grows 200 trees a class and samples neither rows nor columns.
FOLD_PARAMS = Params(rounds=200, rows=1.0, columns=1.0)


def walk_forward_scores(train: DataFrame, n_splits: int = 3, params: Params = FOLD_PARAMS) -> DataFrame:
    """L6 with models: per fold, fit on the row prefix and score the next block.

    The rows are binned once; the folds are prefixes of the same blocks, grow in the same jobs
    and are scored in one pass.
    """
    spark = train.sparkSession
    pos = materialize(row_positions(train))
    bounds = fold_bounds(train, n_splits).collect()  # n_splits small rows of fold metadata
    last = bounds[-1]
    blocks = boosting.Blocks(pos.filter(F.col("pos") < last["train_size"]), FEATURE_COLS, LABEL, KEY, "pos")
    try:
        models = boosting.fit_many(blocks, [replace(params, upto=b["train_size"]) for b in bounds])
    finally:
        blocks.close()
    tests = [(b["train_size"], b["train_size"] + b["test_size"]) for b in bounds]
    scored = boosting.staged_correct(models, pos, LABEL, tests, "pos").filter(F.col("n_trees") == params.rounds)
    folds = spark.createDataFrame([(k, int(b["fold"]), int(b["train_size"]), int(b["test_size"])) for k, b in enumerate(bounds)],
                                  "model int, fold int, train_size bigint, test_size bigint")
    every = Window.partitionBy()
    return folds.join(F.broadcast(scored), "model").select(
        "fold", "train_size", "test_size", (F.col("n_correct") / F.col("n_rows")).alias("accuracy")) \
        .withColumn("mean_accuracy", F.avg("accuracy").over(every)) \
        .withColumn("std_accuracy", F.stddev_pop("accuracy").over(every))


DEFAULT = Params()
# The parameters varied one or two at a time.
VARIANTS = [{"depth": 3}, {"depth": 7}, {"rate": 0.02, "rounds": 600}, {"rate": 0.1, "rounds": 150}, {"rows": 1.0}, {"rows": 0.6}]
SWEEP = [("default", DEFAULT),
         *((", ".join(f"{k}={v}" for k, v in changed.items()), replace(DEFAULT, **changed)) for changed in VARIANTS)]


def hyperparam_sweep(train: DataFrame, test: DataFrame, configs=SWEEP) -> DataFrame:
    """Accuracy of each configuration, the best one and its lift over the default (pp).

    All configurations share one binned matrix and the same jobs; scoring gives the accuracy of
    every number of trees, of which the best is reported beside the whole model's.
    """
    spark = train.sparkSession
    blocks = boosting.Blocks(materialize(train), FEATURE_COLS, LABEL, KEY)
    try:
        models = boosting.fit_many(blocks, [p for _, p in configs])
    finally:
        blocks.close()
    staged = boosting.staged_correct(models, test, LABEL).withColumn("accuracy", F.col("n_correct") / F.col("n_rows"))
    whole = staged.groupBy("model").agg(
        F.max_by("accuracy", "n_trees").alias("accuracy"), F.max("n_trees").alias("n_trees"),
        F.max(F.struct("accuracy", (-F.col("n_trees")).alias("fewer"))).alias("best"))
    names = spark.createDataFrame([(k, name) for k, (name, _) in enumerate(configs)], "model int, config string")
    df = names.join(F.broadcast(whole), "model")
    every = Window.partitionBy()
    default = F.max(F.when(F.col("model") == 0, F.col("accuracy"))).over(every)
    best = F.max("accuracy").over(every)
    return df.select("config", "n_trees", "accuracy", (-F.col("best.fewer")).alias("best_n_trees"),
                     F.col("best.accuracy").alias("best_n_trees_accuracy"),
                     (F.col("accuracy") == best).alias("is_best"), ((best - default) * 100).alias("best_lift_pp"),
                     ((best - default) * 100 < 1.0).alias("keep_default"))


def model_persist(model: BoostedModel, test: DataFrame, root: str | None = None) -> DataFrame:
    """Save to the shared checkpoint folder, load back, check identical predictions."""
    spark = test.sparkSession
    path = f"{(root or checkpoint_dir(spark)).rstrip('/')}/models/trees-{uuid.uuid4().hex[:12]}"
    model.save(spark, path)
    a, b = model.probability(spark), BoostedModel.load(spark, path).probability(spark)
    return test.select(a.alias("a"), b.alias("b")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("a") == F.col("b")).alias("n_equal")
    ).withColumn("path", F.lit(path))


def baseline_compare(lr_acc: float, tree_acc: float, spark: SparkSession) -> DataFrame:
    """Random (1/3), logistic, trees and the trees' lift over logistic in pp."""
    rows = [("random", 1 / 3), ("logistic_regression", lr_acc), ("boosted_trees", tree_acc)]
    df = spark.createDataFrame(rows, "model string, accuracy double")
    return df.withColumn("lift_vs_logistic_pp", (F.col("accuracy") - F.lit(lr_acc)) * 100)
