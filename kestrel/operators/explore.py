"""Exploratory statistics over the labelled features."""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kestrel.operators.quantiles import exact_quantiles

HIST_FEATURES = ["ret_1d", "ret_5d", "ret_20d", "vol_5d", "vol_20d", "bb_width", "atr_14",
                 "rsi_14", "macd_diff", "volume_ratio"]
BOX_FEATURES = ["vol_5d", "vol_20d", "atr_14", "bb_width", "rsi_14", "volume_ratio"]


def labelled(features: DataFrame) -> DataFrame:
    return features.filter(F.col("regime").isNotNull())


def _long(df: DataFrame, cols: list[str], ids: list[str] | None = None) -> DataFrame:
    return df.unpivot(ids or [], cols, "feature", "value").filter(F.col("value").isNotNull())


def feature_histogram(features: DataFrame, bins: int = 80, cols: list[str] | None = None) -> DataFrame:
    """Equal-width bins per feature over [min, max], last bin closed; empty bins are 0."""
    cols = cols or HIST_FEATURES
    long = _long(labelled(features), cols)
    rng = long.groupBy("feature").agg(F.min("value").alias("mn"), F.max("value").alias("mx"))
    width = F.col("mx") - F.col("mn")
    b = F.when(width > 0, F.least(F.floor((F.col("value") - F.col("mn")) / width * bins), F.lit(bins - 1))) \
        .otherwise(F.lit(0))
    # rng has one row per feature (a fixed, small count), so broadcasting it is bounded.
    counts = long.join(F.broadcast(rng), "feature").groupBy("feature", b.alias("bin")) \
        .agg(F.count(F.lit(1)).alias("n"))
    grid = rng.select("feature", "mn", "mx", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return grid.join(counts, ["feature", "bin"], "left").select(
        "feature", "bin",
        (F.col("mn") + F.col("bin") * (F.col("mx") - F.col("mn")) / bins).alias("bin_lo"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def regime_counts(features: DataFrame) -> DataFrame:
    """Count and share per regime plus the max/min imbalance ratio."""
    c = labelled(features).groupBy("regime").agg(F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy()  # three rows after the aggregation
    return c.select(
        "regime", "n",
        (F.col("n") / F.sum("n").over(everything) * 100).alias("pct"),
        (F.max("n").over(everything) / F.min("n").over(everything)).alias("imbalance_ratio"),
    )


def feature_box_stats(features: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Quartiles, median, IQR whiskers (most extreme values within 1.5 IQR) per feature and regime."""
    cols = cols or BOX_FEATURES
    # Read by the quantile passes and the whisker pass: keep it for the duration.
    long = _long(labelled(features), cols, ["regime"]).persist(StorageLevel.MEMORY_AND_DISK)
    q = exact_quantiles(long, ["feature", "regime"], "value", [0.25, 0.5, 0.75])
    wide = q.groupBy("feature", "regime").agg(
        F.max(F.when(F.col("p") == 0.25, F.col("quantile"))).alias("q1"),
        F.max(F.when(F.col("p") == 0.5, F.col("quantile"))).alias("median"),
        F.max(F.when(F.col("p") == 0.75, F.col("quantile"))).alias("q3"),
    )
    iqr = F.col("q3") - F.col("q1")
    fences = wide.select("*", (F.col("q1") - 1.5 * iqr).alias("lo_f"), (F.col("q3") + 1.5 * iqr).alias("hi_f"))
    v = F.col("value")
    # One row per feature and regime: a fixed, small number.
    whisk = long.join(F.broadcast(fences.select("feature", "regime", "lo_f", "hi_f")), ["feature", "regime"]).groupBy(
        "feature", "regime").agg(
        F.min(F.when(v >= F.col("lo_f"), v)).alias("whisker_lo"),
        F.max(F.when(v <= F.col("hi_f"), v)).alias("whisker_hi"),
        F.count(F.lit(1)).alias("n"),
    )
    out = fences.join(whisk, ["feature", "regime"]).select(
        "feature", "regime", "n", "q1", "median", "q3", "whisker_lo", "whisker_hi") \
        .persist(StorageLevel.MEMORY_AND_DISK)
    out.count()          # small answer materialised once before the input is released
    long.unpersist()
    return out


def feature_correlation(features: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Pearson matrix of the features over complete rows.

    ``pyspark.ml.stat.Correlation`` computes the column means and the centred
    covariance in two distributed passes (tree aggregation of per-partition
    k x k partials, numerically stable); only the k x k result (k = number of
    features) reaches the driver and is returned as rows, both orders plus the
    diagonal. A zero-variance feature gives NULL.
    """
    cols = cols or HIST_FEATURES
    df = labelled(features).select(*cols).dropna()
    # Two passes read the vectors: keep them for the duration (lost blocks recompute).
    vec = VectorAssembler(inputCols=cols, outputCol="_v").transform(df).select("_v") \
        .persist(StorageLevel.MEMORY_AND_DISK)
    mat = Correlation.corr(vec, "_v").first()[0].toArray()
    vec.unpersist()
    rows = [(a, b, None if math.isnan(mat[i, j]) else float(mat[i, j]))
            for i, a in enumerate(cols) for j, b in enumerate(cols)]
    return features.sparkSession.createDataFrame(rows, "feature_a string, feature_b string, correlation double")


def features_with_prices(features: DataFrame, prices: DataFrame) -> DataFrame:
    """Labelled features joined to bars on (ticker, date)."""
    return labelled(features).select("ticker", "date", "vol_20d", "rsi_14", "regime").join(
        prices.select("ticker", "date", "adj_close"), ["ticker", "date"])
