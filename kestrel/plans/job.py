"""End-to-end refresh job (R1) in one Spark session.

ingest prices -> ingest index -> materialise the risk views -> features ->
predictions from the saved model -> prediction views. Each step writes a new
table version and flips its pointer only on success; the job stops at the
first failing step. It does not retrain the model or reload the dimension.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.operators import indicators, ml, scoring
from kestrel.operators.boosting import BoostedModel
from kestrel.operators.correlation import correlation_matrix
from kestrel.operators.returns import returns_daily
from kestrel.operators.risk import drawdown_daily, rolling_sharpe, rolling_volatility
from kestrel.sources import ingest, sinks

STEP_SCHEMA = "step string, status string, seconds double, detail string"


class RefreshFailed(RuntimeError):
    pass


def model_root(spark: SparkSession, root: str | None) -> str:
    return f"{sinks._root(spark, root)}/models"


def save_model(spark: SparkSession, model: BoostedModel, root: str | None = None) -> str:
    """Save a fitted model as the job's current one."""
    path = f"{model_root(spark, root)}/trees-{int(time.time() * 1e6)}"
    model.save(spark, path)
    sinks._set_current(spark, model_root(spark, root), path.rsplit("/", 1)[1])
    return path


def train_and_save(spark: SparkSession, prices: DataFrame, root: str | None = None) -> str:
    """Train the tree model on the time-split training rows and save it (L5 + L10)."""
    train, _ = ml.time_split(ml.load_features(indicators.ml_features(prices)))
    return save_model(spark, ml.tree_classifier(ml.materialize(train)), root)


def refresh_job(spark: SparkSession, raw_bars: Callable[[], DataFrame], raw_index: Callable[[], DataFrame],
                universe: DataFrame, index_range, root: str | None = None,
                skip_ingest: bool = False, skip_ml: bool = False, raise_on_failure: bool = True) -> DataFrame:
    """Run the steps in order; a failing step stops the job and raises :class:`RefreshFailed`
    (a scheduler sees a failed run), or ends the returned report with ``raise_on_failure=False``."""
    results: list[tuple] = []

    def run(name: str, fn: Callable[[], str]) -> bool:
        t0 = time.time()
        try:
            detail = fn()
            results.append((name, "ok", round(time.time() - t0, 3), detail))
            return True
        except Exception as e:  # the job reports the failing step and stops
            results.append((name, "failed", round(time.time() - t0, 3), f"{type(e).__name__}: {str(e)[:300]}"))
            return False

    def prices() -> DataFrame:
        return sinks.read_current(spark, "prices_daily", root)

    steps: list[tuple[str, Callable[[], str]]] = []
    if not skip_ingest:
        steps.append(("1. ingest prices", lambda: sinks.full_refresh(ingest.ingest_bars(raw_bars()), "prices_daily", root)))
        steps.append(("2. ingest index", lambda: sinks.full_refresh(
            ingest.ingest_index(raw_index(), *index_range), "index_daily", root)))

    def views() -> str:
        p = prices()
        r = returns_daily(p)
        n = universe.count()
        out = sinks.materialize_views({
            "rolling_volatility": rolling_volatility(p, r),
            "rolling_sharpe": rolling_sharpe(p, r),
            "drawdown_daily": drawdown_daily(p),
            "correlation_matrix": correlation_matrix(r, n_tickers=n),
        }, shared=r, root=root)
        return ", ".join(f"{row['view']}={row['n_rows']}" for row in out.collect())  # four count rows
    steps.append(("3. refresh views", views))

    if not skip_ml:
        steps.append(("4. features", lambda: sinks.drop_create(indicators.ml_features(prices()), "ml_features",
                                                               sinks.ML_FEATURES_DDL, root)))

        def predictions() -> str:
            model = BoostedModel.load(spark, sinks.current_path(spark, "models", root))
            feats = ml.load_features(sinks.read_current(spark, "ml_features", root))
            _, test = ml.time_split(feats)
            return sinks.drop_create(ml.generate_predictions(model, test), "ml_predictions",
                                     sinks.ML_PREDICTIONS_DDL, root)
        steps.append(("5. predictions", predictions))

        def prediction_views() -> str:
            preds = sinks.read_current(spark, "ml_predictions", root).select(
                "ticker", "date", F.col("actual_regime").cast("int").alias("actual_regime"),
                F.col("predicted_regime").cast("int").alias("predicted_regime"),
                *[F.col(c).cast("double").alias(c) for c in ("prob_low", "prob_medium", "prob_high", "confidence")],
                "correct")
            enriched = scoring.predictions_enriched(preds, universe)
            sinks.full_refresh(enriched, "predictions_enriched", root)
            return sinks.full_refresh(scoring.latest_predictions(enriched), "latest_predictions", root)
        steps.append(("6. prediction views", prediction_views))

    for name, fn in steps:
        if not run(name, fn):
            if raise_on_failure:
                raise RefreshFailed(f"{results[-1][0]}: {results[-1][3]}")
            break
    return spark.createDataFrame(results, STEP_SCHEMA)
