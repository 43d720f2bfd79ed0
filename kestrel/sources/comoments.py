"""Stored co-moment states of the correlation matrix (V6), one per ticker block pair and month.

A state holds, for every pair of tickers of its two blocks, the number of common days, both means,
both centred sums of squares and the centred sum of products over the month's common days. States
of disjoint days merge exactly, so a window is the merge of its whole months' stored states and of
two states made from the days of the months it cuts; only those days' returns are read. A moved
``as_of`` or an appended day therefore reads 12 states a block pair, not the year's returns.

The returns are stored by month beside the states (an incremental view with one warm-up row), and a
refresh makes anew only the states of the months whose returns it rewrote. The number of blocks is
part of every state; a universe that outgrows it needs ``write_states`` again. A state takes 48
bytes a pair: 200 kB at 64 tickers a block; a task merges one state a month of the window at a time.
"""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.config import checkpoint_dir
from kestrel.operators.correlation import BLOCK, OUT_SCHEMA, _matrix, _pairs, n_blocks, routed
from kestrel.operators.returns import returns_daily
from kestrel.sources import incremental
from kestrel.sources.incremental import View

RETURNS = {"returns_daily": View(returns_daily, 1)}
STATES = "comoment_states"
_STATE_SCHEMA = "month string, bi long, bj long, nb int, tickers_a array<string>, tickers_b array<string>, state binary"


def _month_state(nb: int):
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        ta, xa, ma, mean_a = _matrix(pdf[pdf["role"] <= 1], 31)
        tb, xb, mb, mean_b = _matrix(pdf[pdf["role"] != 1], 31)
        n = ma @ mb.T
        # Sums about each ticker's mean of the month, moved to the mean of the pair's common days.
        at = np.maximum(n, 1.0)
        da, db = xa @ mb.T / at, ma @ xb.T / at
        state = np.stack([n, (mean_a[:, None] + da) * (n > 0), (mean_b[None, :] + db) * (n > 0),
                          (xa * xa) @ mb.T - n * da * da, ma @ (xb * xb).T - n * db * db, xa @ xb.T - n * da * db])
        first = pdf.iloc[0]
        return pd.DataFrame([(first["month"], first["bi"], first["bj"], nb, list(ta), list(tb), state.tobytes())],
                            columns=["month", "bi", "bj", "nb", "tickers_a", "tickers_b", "state"])
    return fn


def month_states(returns: DataFrame, nb: int) -> DataFrame:
    """The states of returns (ticker, date, log_return), one row per month and block pair."""
    rows = returns.filter(F.col("log_return").isNotNull()).select(
        "ticker", F.date_format("date", "yyyy-MM").alias("month"), (F.dayofmonth("date") - 1).alias("day"),
        F.col("log_return").alias("x"))
    return routed(rows, nb).groupBy("month", "bi", "bj").applyInPandas(_month_state(nb), _STATE_SCHEMA)


def _merge(into: np.ndarray, state: np.ndarray, ia: np.ndarray, ib: np.ndarray) -> None:
    """Add a state to the rows ia and columns ib of another."""
    at = np.ix_(range(6), ia, ib)
    n, mean_a, mean_b, saa, sbb, sab = into[at]
    k, mean_a2, mean_b2, saa2, sbb2, sab2 = state
    total = np.maximum(n + k, 1.0)
    da, db, w = mean_a2 - mean_a, mean_b2 - mean_b, n * k / total
    into[at] = np.stack([n + k, mean_a + da * k / total, mean_b + db * k / total,
                         saa + saa2 + da * da * w, sbb + sbb2 + db * db * w, sab + sab2 + da * db * w])


def _merged(min_overlap: int):
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        ta = np.unique(np.concatenate([np.asarray(t, dtype=object) for t in pdf["tickers_a"]]))
        tb = np.unique(np.concatenate([np.asarray(t, dtype=object) for t in pdf["tickers_b"]]))
        total = np.zeros((6, len(ta), len(tb)))
        for r in pdf.sort_values("month").itertuples():
            a, b = np.asarray(r.tickers_a, dtype=object), np.asarray(r.tickers_b, dtype=object)
            state = np.frombuffer(r.state).reshape(6, len(a), len(b))
            _merge(total, state, np.searchsorted(ta, a), np.searchsorted(tb, b))
        n, _, _, saa, sbb, sab = total
        with np.errstate(divide="ignore", invalid="ignore"):
            corr = np.where((n >= 2) & (saa > 0) & (sbb > 0), sab / np.sqrt(saa * sbb), np.nan)
        return _pairs(ta, tb, n, corr, min_overlap, pdf["bi"].iloc[0] != pdf["bj"].iloc[0])
    return fn


def write_states(prices: DataFrame, root: str | None = None, n_tickers: int | None = None, block_size: int = BLOCK) -> None:
    """Store the returns and the states of every month of the bars."""
    spark = prices.sparkSession
    incremental.write_views(prices, root, RETURNS)
    returns = incremental.read_view(spark, "returns_daily", root)
    if n_tickers is None:
        n_tickers = returns.agg(F.approx_count_distinct("ticker")).first()[0]
    (month_states(returns, n_blocks(n_tickers, block_size)).repartition("month").write.mode("overwrite")
     .partitionBy("month").parquet(incremental._path(spark, STATES, root)))


def _stored(spark: SparkSession, name: str, root: str | None) -> DataFrame:
    return spark.read.parquet(incremental._path(spark, name, root)).withColumn("month", F.col("month").cast("string"))


def _n_blocks(spark: SparkSession, root: str | None) -> int:
    row = _stored(spark, STATES, root).select("nb").first()
    return row.nb if row else 1


def refresh_states(old: DataFrame, new: DataFrame, root: str | None = None) -> set[str]:
    """Bring returns and states from the bars ``old`` to ``new``; returns the months made anew."""
    spark = new.sparkSession
    checkpoint_dir(spark)
    nb = _n_blocks(spark, root)
    changes = incremental.first_changes(old, new).persist()
    months, _ = incremental.refresh_view("returns_daily", RETURNS["returns_daily"], new, changes, root)
    changes.unpersist()
    path = incremental._path(spark, STATES, root)
    spark.catalog.refreshByPath(incremental._path(spark, "", root))
    if months:
        states = month_states(_stored(spark, "returns_daily", root).filter(F.col("month").isin(*months)), nb).checkpoint()
        left = {r.month for r in states.select("month").distinct().collect()}
        incremental.overwrite_months(states, path, months, left)
        spark.catalog.refreshByPath(path)
    return months


def _next_month(day: dt.date) -> dt.date:
    return (day.replace(day=1) + dt.timedelta(days=31)).replace(day=1)


def window_parts(start: dt.date, end: dt.date) -> tuple[list[str], list[tuple[dt.date, dt.date]]]:
    """The whole months of [start, end] and the day ranges of the months it cuts."""
    whole, cut = [], []
    first = start.replace(day=1)
    while first <= end:
        after = _next_month(first)
        last = after - dt.timedelta(days=1)
        if first >= start and last <= end:
            whole.append(f"{first:%Y-%m}")
        else:
            cut.append((max(first, start), min(last, end)))
        first = after
    return whole, cut


def correlation_from_states(spark: SparkSession, as_of: dt.date | None = None, window_days: int = 365,
                            min_overlap: int = 180, root: str | None = None) -> DataFrame:
    """``correlation_matrix`` from the stored states; ``as_of`` None is the latest stored date."""
    returns = _stored(spark, "returns_daily", root)
    if as_of is None:
        last = returns.agg(F.max("month")).first()[0]
        as_of = returns.filter(F.col("month") == last).agg(F.max("date")).first()[0]
        if as_of is None:
            return spark.createDataFrame([], OUT_SCHEMA)
    whole, cut = window_parts(as_of - dt.timedelta(days=window_days), as_of)
    states = _stored(spark, STATES, root).filter(F.col("month").isin(*whole))
    days = F.lit(False)
    for first, last in cut:
        days = days | F.col("date").between(F.lit(first), F.lit(last))
    cut_months = sorted({f"{first:%Y-%m}" for first, _ in cut})
    cut_states = month_states(returns.filter(F.col("month").isin(*cut_months) & days), _n_blocks(spark, root))
    return (states.select(*cut_states.columns).unionByName(cut_states).groupBy("bi", "bj")
            .applyInPandas(_merged(min_overlap), OUT_SCHEMA))
