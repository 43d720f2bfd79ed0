"""Normalising vendor-shaped bars into the fact relations.

Vendor fetching itself (HTTP, retries) is out of scope; these operators take
whatever DataFrame a reader produced (CSV, parquet, JSON) and apply the
ingest rules as column operations, so they run distributed on any volume.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAR_COLUMNS = ["date", "open", "high", "low", "close", "volume"]
PRICE_COLUMNS = ["ticker", "date", "open", "high", "low", "close", "adj_close", "volume"]
STOCK_SCHEMA = T.StructType([
    T.StructField("ticker", T.StringType(), False),
    T.StructField("company_name", T.StringType(), False),
    T.StructField("sector", T.StringType(), True),
    T.StructField("industry", T.StringType(), True),
])


class MissingColumns(ValueError):
    pass


def normalise_names(df: DataFrame, level_sep: str | None = None) -> DataFrame:
    """Lower-case, spaces to underscores; with ``level_sep`` keep only the first level of a
    flattened two-level name (``'Close|^IDX'`` -> ``'close'``)."""
    names = []
    for c in df.columns:
        if level_sep and level_sep in c:
            c = c.split(level_sep, 1)[0]
        names.append(c.lower().replace(" ", "_"))
    return df.toDF(*names)


def require(df: DataFrame, expected: list[str]) -> None:
    missing = [c for c in expected if c not in df.columns]
    if missing:
        raise MissingColumns(f"Missing columns {missing}. Got: {df.columns}")


def ingest_bars(raw: DataFrame, ticker: str | None = None, ticker_col: str = "symbol") -> DataFrame:
    """Vendor bars -> prices_daily rows.

    Names normalised, the six bar columns required, ``adj_close := close``
    (the vendor already adjusts), timestamps reduced to their calendar date
    without zone conversion, ticker attached, rows without a close dropped.
    """
    df = normalise_names(raw)
    require(df, BAR_COLUMNS)
    tick = F.lit(ticker) if ticker is not None else F.col(ticker_col)
    return df.select(
        tick.cast("string").alias("ticker"),
        F.to_date(F.col("date")).alias("date"),
        *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close")],
        F.col("close").cast("double").alias("adj_close"),
        F.col("volume").cast("bigint").alias("volume"),
    ).dropna(subset=["close"])


def index_fetch_range(end: dt.date | Column, years: int = 5, buffer_days: int = 30):
    """The index fetch window: ``end - (years*365 + buffer)`` up to ``end`` (exclusive end, inclusive start)."""
    if isinstance(end, Column):
        return F.date_sub(end, years * 365 + buffer_days), end
    return end - dt.timedelta(days=years * 365 + buffer_days), end


def ingest_index(raw: DataFrame, start: dt.date | Column, end_exclusive: dt.date | Column, level_sep: str = "|") -> DataFrame:
    """S3: vendor index bars -> index_daily rows (no ticker, no adj_close).

    Two-level names are flattened to their first level. ``close`` is NOT NULL
    in the target relation, so bars without a close are dropped.
    """
    df = normalise_names(raw, level_sep)
    require(df, BAR_COLUMNS)
    d = F.to_date(F.col("date"))
    return df.select(
        d.alias("date"),
        *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close")],
        F.col("volume").cast("bigint").alias("volume"),
    ).filter((F.col("date") >= start) & (F.col("date") < end_exclusive)).dropna(subset=["close"])


def ingest_summary(bars: DataFrame, universe: DataFrame) -> DataFrame:
    """Per ticker of the universe: rows, earliest, latest; tickers without bars are 'failed'."""
    per = bars.groupBy("ticker").agg(F.count(F.lit(1)).alias("n_rows"), F.min("date").alias("earliest"),
                                     F.max("date").alias("latest"))
    out = universe.select("ticker").join(per, "ticker", "left")
    return out.select(
        "ticker",
        F.when(F.col("n_rows").isNull(), "failed").otherwise("ok").alias("status"),
        F.coalesce("n_rows", F.lit(0)).alias("n_rows"), "earliest", "latest",
    )


def static_dimension(spark: SparkSession, rows: list[dict] | DataFrame) -> DataFrame:
    """A constituent list (Python rows or a DataFrame) as the typed ``stocks`` dimension."""
    if isinstance(rows, DataFrame):
        return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in STOCK_SCHEMA])
    return spark.createDataFrame([tuple(r.get(f.name) for f in STOCK_SCHEMA) for r in rows], STOCK_SCHEMA)
