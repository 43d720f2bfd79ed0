"""Latest / first row per key (A4): one ``max_by(column, date)`` per column.

``DISTINCT ON (key) ... ORDER BY key, date DESC`` becomes one aggregation with a map-side
partial step, so a hot key is combined before the shuffle: a hash aggregate where the
columns have a fixed width, a sort aggregate where one of them is a string.
Unlike DuckDB's ``max_by``, Spark keeps the chosen row's NULL values, which
is the ``DISTINCT ON`` behaviour.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_per_key(
    df: DataFrame,
    key: str | list[str] = "ticker",
    order: str = "date",
    cols: list[str] | None = None,
    where: Column | None = None,
    earliest: bool = False,
) -> DataFrame:
    keys = [key] if isinstance(key, str) else list(key)
    if where is not None:
        df = df.filter(where)
    cols = cols or [c for c in df.columns if c not in keys]
    pick, end = (F.min_by, F.min) if earliest else (F.max_by, F.max)
    return df.groupBy(*keys).agg(
        *((end(c) if c == order else pick(F.col(c), F.col(order))).alias(c) for c in cols))


def first_per_key(df: DataFrame, **kw) -> DataFrame:
    return latest_per_key(df, earliest=True, **kw)


def price_change(
    prices: DataFrame,
    start_cond: Column,
    start_earliest: bool,
    end_cond: Column | None = None,
    price: str = "adj_close",
) -> DataFrame:
    """Price at a start point and the latest price per ticker, in ONE aggregation.

    ``start_cond`` selects the rows eligible as start; the start is the
    latest (or earliest) of them. Tickers without a start row drop out
    (inner-join semantics of the two DISTINCT ON relations it replaces).
    """
    if end_cond is not None:
        prices = prices.filter(end_cond)
    start_date = F.when(start_cond, F.col("date"))
    pick = F.min_by if start_earliest else F.max_by
    agg = prices.groupBy("ticker").agg(
        pick(F.col(price), start_date).alias("price_then"),
        (F.min if start_earliest else F.max)(start_date).alias("start_date"),
        F.max_by(F.col(price), F.col("date")).alias("price_now"),
    )
    return agg.filter(F.col("start_date").isNotNull())
