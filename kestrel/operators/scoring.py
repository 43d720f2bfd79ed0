"""Prediction-scoring relations.

Every grouped metric is a hash aggregate with partial combine; groups are
dates, sectors, tickers or the nine (actual, predicted) cells, and a hot
group only costs one partial row per map task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kestrel.config import REGIME_LABELS
from kestrel.functions.exprs import (
    confidence_bucket, confidence_bucket_right_closed, confidence_tier, regime_label,
)
from kestrel.operators.latest import latest_per_key

LABELS = [REGIME_LABELS[i] for i in sorted(REGIME_LABELS)]


def predictions_enriched(predictions: DataFrame, stocks: DataFrame) -> DataFrame:
    s = stocks.select("ticker", "company_name", "sector", "industry")
    return predictions.join(s, "ticker").select(
        "ticker", "company_name", "sector", "industry", "date",
        "actual_regime", "predicted_regime", "prob_low", "prob_medium", "prob_high",
        "confidence", "correct",
        regime_label("predicted_regime").alias("predicted_label"),
        regime_label("actual_regime").alias("actual_label"),
        confidence_tier("confidence").alias("confidence_tier"),
    )


def latest_predictions(enriched: DataFrame) -> DataFrame:
    return latest_per_key(enriched, cols=[
        "company_name", "sector", "date", "predicted_regime", "predicted_label",
        "confidence", "confidence_tier", "prob_low", "prob_medium", "prob_high",
    ])


def _accuracy_aggs():
    n = F.count(F.lit(1))
    k = F.count_if(F.col("correct"))
    return [n.alias("n_predictions"), k.alias("n_correct"), F.round(k / n, 4).alias("accuracy")]


def accuracy_by_date(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("date").agg(*_accuracy_aggs())


def accuracy_by_sector(enriched: DataFrame) -> DataFrame:
    return enriched.groupBy("sector").agg(*_accuracy_aggs())


def accuracy_by_ticker(enriched: DataFrame) -> DataFrame:
    return enriched.groupBy("ticker", "company_name", "sector").agg(*_accuracy_aggs())


def accuracy_by_confidence_tier(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy(confidence_bucket("confidence").alias("confidence_bucket")).agg(
        *_accuracy_aggs(), F.round(F.avg("confidence"), 4).alias("avg_confidence")
    )


def confusion_matrix(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("actual_regime", "predicted_regime").agg(
        F.count(F.lit(1)).alias("n")
    ).select(
        "actual_regime", "predicted_regime", "n",
        regime_label("actual_regime").alias("actual_label"),
        regime_label("predicted_regime").alias("predicted_label"),
    )


def confusion_pivot(predictions: DataFrame) -> DataFrame:
    """3x3 wide matrix; labels missing on either axis are zero-filled."""
    cm = confusion_matrix(predictions)
    wide = cm.groupBy("actual_label").pivot("predicted_label", LABELS).agg(F.sum("n"))
    axis = predictions.sparkSession.createDataFrame([(lbl,) for lbl in LABELS], "actual_label string")
    out = F.broadcast(axis).join(wide, "actual_label", "left")  # 3-row label axis
    return out.select("actual_label", *[F.coalesce(F.col(lbl), F.lit(0)).cast("bigint").alias(lbl) for lbl in LABELS])


def confusion_row_pct(predictions: DataFrame) -> DataFrame:
    """Row-normalised matrix (recall per actual class), percent."""
    cm = confusion_matrix(predictions)
    tot = F.sum("n").over(Window.partitionBy("actual_regime"))  # at most 3 rows per partition
    return cm.select("actual_label", "predicted_label", "n", (F.col("n") / tot * 100).alias("row_pct"))


def classification_report(predictions: DataFrame) -> DataFrame:
    """Per class precision / recall / F1 / support, plus accuracy, macro and weighted rows."""
    p = predictions.filter(F.col("actual_regime").isNotNull())
    a, b = F.col("actual_regime"), F.col("predicted_regime")
    # One pass: per class tp / predicted / support counts; the explode runs on the one-row result.
    cells = p.agg(*[F.struct(F.lit(c).alias("cls"),
                             F.count_if((a == c) & (b == c)).alias("tp"),
                             F.count_if(b == c).alias("pred_n"),
                             F.count_if(a == c).alias("support")).alias(f"c{c}")
                    for c in sorted(REGIME_LABELS)])
    stats = cells.select(F.explode(F.array(*[F.col(f"c{c}") for c in sorted(REGIME_LABELS)])).alias("s")) \
        .select("s.*")
    prec = F.when(F.col("pred_n") > 0, F.col("tp") / F.col("pred_n")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    cls_rows = stats.select(
        regime_label("cls").alias("label"), prec.alias("precision"), rec.alias("recall"),
        F.col("support"), F.col("tp"),
    ).withColumn("f1", F.when((F.col("precision") + F.col("recall")) > 0,
                              2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
                 .otherwise(0.0))
    tot = F.sum("support")
    summary = cls_rows.agg(
        (F.sum("tp") / tot).alias("acc"),
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
        (F.sum(F.col("precision") * F.col("support")) / tot).alias("wp"),
        (F.sum(F.col("recall") * F.col("support")) / tot).alias("wr"),
        (F.sum(F.col("f1") * F.col("support")) / tot).alias("wf"),
        tot.alias("n"),
    )

    def row(label, p, r, f):
        return F.struct(F.lit(label).alias("label"), F.col(p).alias("precision"), F.col(r).alias("recall"),
                        F.col(f).alias("f1"), F.col("n").alias("support"))
    rows = summary.select(F.explode(F.array(
        row("accuracy", "acc", "acc", "acc"), row("macro avg", "mp", "mr", "mf"), row("weighted avg", "wp", "wr", "wf"),
    )).alias("r")).select("r.*")
    return cls_rows.select("label", "precision", "recall", "f1", "support").unionByName(rows)


def per_class_recall(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("actual_regime").agg(
        F.avg(F.col("correct").cast("double")).alias("recall"), F.count(F.lit(1)).alias("n")
    ).select(regime_label("actual_regime").alias("label"), "actual_regime", "recall", "n")


def confidence_buckets_right_closed(predictions: DataFrame) -> DataFrame:
    b = confidence_bucket_right_closed("confidence").alias("conf_bucket")
    return predictions.groupBy(b).agg(
        F.avg(F.col("correct").cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n")
    ).filter(F.col("conf_bucket").isNotNull())


def rolling_accuracy(predictions: DataFrame, window: int = 20) -> DataFrame:
    """Daily accuracy plus its full-window rolling mean (mean of daily ratios).

    The series has one row per date, bounded by the calendar, so the global
    date order is a small single-partition window after the aggregation.
    """
    daily = predictions.groupBy("date").agg(
        F.avg(F.col("correct").cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n")
    )
    w = Window.orderBy("date").rowsBetween(-(window - 1), 0)
    return daily.select(
        "date", "accuracy", "n",
        F.when(F.count("accuracy").over(w) == window, F.avg("accuracy").over(w)).alias("rolling_acc"),
    )


def predicted_regime_counts(latest: DataFrame) -> DataFrame:
    """Count of latest predictions per label, zero-filled, with the overall mean confidence."""
    counts = latest.groupBy("predicted_label").agg(F.count(F.lit(1)).alias("n"))
    axis = latest.sparkSession.createDataFrame([(lbl, i) for i, lbl in enumerate(LABELS)],
                                               "predicted_label string, ord int")
    avg_conf = latest.select(F.avg("confidence")).scalar()
    return F.broadcast(axis).join(counts, "predicted_label", "left").select(
        "predicted_label", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
        avg_conf.alias("avg_confidence"),
    )


def ticker_history_stats(enriched: DataFrame, n_last: int = 60) -> DataFrame:
    """Newest ``n_last`` predictions of every ticker: n, n_correct, accuracy (percent)."""
    w = Window.partitionBy("ticker").orderBy(F.col("date").desc())
    recent = enriched.select("ticker", "correct", F.row_number().over(w).alias("rn")) \
        .filter(F.col("rn") <= n_last)
    return recent.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(F.col("correct")).alias("n_correct"),
    ).withColumn("accuracy_pct", F.col("n_correct") / F.col("n_total") * 100)


def accuracy_best_worst(by_ticker: DataFrame, n: int = 5) -> DataFrame:
    """Top n and bottom n tickers by accuracy, UNION ALL."""
    top = by_ticker.orderBy(F.col("accuracy").desc_nulls_first(), "ticker").limit(n) \
        .withColumn("side", F.lit("top"))
    bottom = by_ticker.orderBy(F.col("accuracy").asc_nulls_last(), "ticker").limit(n) \
        .withColumn("side", F.lit("bottom"))
    return top.unionByName(bottom)
