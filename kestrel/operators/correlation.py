"""Pairwise Pearson correlation of daily log returns (V6) without a pair explosion.

The relational form joins the returns with themselves on date and
aggregates per pair: every date group emits all ticker pairs, T^2 x D rows.
Here the matrix is computed as blocked co-moments instead:

1. keep the trailing window (``as_of - window_days .. as_of``), non-null returns;
   a ticker holds at most ``window_days + 1`` values (one per calendar day);
2. hash tickers into ``nb = ceil(T / block_size)`` (at least ``LEAST_BLOCKS``) blocks and route every row
   to the ``nb`` block pairs it takes part in (replication nb, like a
   distributed block-matrix product; the shuffle is proportional to the T^2
   output, larger blocks trade replication for task size);
3. ``applyInPandas`` per block pair builds two dense (tickers x days) matrices
   with masks and gets every pairwise overlap count and co-moment by six
   matrix products; a task holds at most ``2 * block_size * (window_days+1)``
   values and emits at most ``2 * block_size^2`` pairs, whatever the data size.

Each ticker is centred on its own window mean first (exact for covariance,
better conditioned). A constant series gives NULL, like
``covar_samp / nullif(stddev_samp * stddev_samp, 0)``.
"""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tickers are hashed into blocks of about this many; every pair of blocks is a task's group.
BLOCK = 64
LEAST_BLOCKS = 4

OUT_SCHEMA = T.StructType([
    T.StructField("ticker_a", T.StringType()),
    T.StructField("ticker_b", T.StringType()),
    T.StructField("correlation", T.DoubleType()),
    T.StructField("n_overlap_days", T.LongType()),
])


def _matrix(pdf: pd.DataFrame, n_days: int):
    tickers, idx = np.unique(pdf["ticker"].to_numpy(), return_inverse=True)
    x = np.zeros((len(tickers), n_days))
    m = np.zeros((len(tickers), n_days))
    days = pdf["day"].to_numpy()
    x[idx, days] = pdf["x"].to_numpy()
    m[idx, days] = 1.0
    # Centre each ticker on its own window mean (shift-invariant moments, less cancellation).
    mean = x.sum(axis=1) / np.maximum(m.sum(axis=1), 1.0)
    x = (x - mean[:, None]) * m
    return tickers, x, m, mean


def _pairs(ta, tb, n, corr, min_overlap: int, mirrored: bool) -> pd.DataFrame:
    """The pairs with enough common days, in both orders if the two blocks differ."""
    ia, ib = np.nonzero(n >= min_overlap)
    out = pd.DataFrame({
        "ticker_a": ta[ia], "ticker_b": tb[ib],
        "correlation": corr[ia, ib], "n_overlap_days": n[ia, ib].astype("int64"),
    })
    if mirrored:
        mirror = out.rename(columns={"ticker_a": "ticker_b", "ticker_b": "ticker_a"})
        out = pd.concat([out, mirror[out.columns]], ignore_index=True)
    out["correlation"] = out["correlation"].astype("float64")   # NaN arrives as NULL via Arrow
    return out


def _pair_moments(n_days: int, min_overlap: int):
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        left = pdf[pdf["role"] <= 1]
        right = pdf[pdf["role"] != 1]
        ta, xa, ma, _ = _matrix(left, n_days)
        tb, xb, mb, _ = _matrix(right, n_days)
        n = ma @ mb.T
        sa = xa @ mb.T
        sb = ma @ xb.T
        saa = (xa * xa) @ mb.T
        sbb = ma @ (xb * xb).T
        sab = xa @ xb.T
        with np.errstate(divide="ignore", invalid="ignore"):
            cov = sab - sa * sb / n
            va = saa - sa * sa / n
            vb = sbb - sb * sb / n
            corr = cov / np.sqrt(va * vb)
        ok = (n >= 2) & (va > 0) & (vb > 0)
        corr = np.where(ok, corr, np.nan)
        mirrored = bool(len(pdf)) and pdf["bi"].iloc[0] != pdf["bj"].iloc[0]
        return _pairs(ta, tb, n, corr, min_overlap, mirrored)
    return fn


def n_blocks(n_tickers: int, block_size: int = BLOCK) -> int:
    return max(min(LEAST_BLOCKS, n_tickers or 1), math.ceil(n_tickers / block_size))


def routed(rows: DataFrame, nb: int) -> DataFrame:
    """Every row once for each block pair (bi, bj) its ticker's block takes part in."""
    return (
        rows.withColumn("blk", F.pmod(F.xxhash64("ticker"), F.lit(nb)))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(nb - 1))))
        .select(
            *rows.columns,
            F.least("blk", "other").alias("bi"),
            F.greatest("blk", "other").alias("bj"),
            F.when(F.col("blk") == F.col("other"), 0).when(F.col("blk") < F.col("other"), 1)
            .otherwise(2).alias("role"),
        )
    )


def correlation_matrix(
    returns: DataFrame,
    as_of: dt.date | None = None,   # None: the latest date in the data
    window_days: int = 365,
    min_overlap: int = 180,
    block_size: int = BLOCK,
    n_tickers: int | None = None,
) -> DataFrame:
    """ticker_a, ticker_b, correlation, n_overlap_days: both orders plus the diagonal."""
    end = F.lit(as_of) if as_of is not None else returns.select(F.max("date")).scalar()
    start = F.date_sub(end, window_days)
    recent = returns.filter(
        (F.col("date") >= start) & (F.col("date") <= end) & F.col("log_return").isNotNull()
    ).select("ticker", F.datediff("date", start).alias("day"), F.col("log_return").alias("x"))
    if n_tickers is None:  # callers with a ticker dimension pass its size and skip this pass
        n_tickers = recent.agg(F.approx_count_distinct("ticker")).first()[0] or 0
    return routed(recent, n_blocks(n_tickers, block_size)).groupBy("bi", "bj").applyInPandas(
        _pair_moments(window_days + 1, min_overlap), OUT_SCHEMA
    )
