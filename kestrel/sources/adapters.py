"""Adapters that derive the market relations from the given star-schema tables.

* ``stocks``         nation x region (ticker = nation name, sector = region name)
* ``prices_daily``   lineitem x supplier x nation, one OHLCV bar per (ticker, date)
* ``index_daily``    orders, one bar per order date
* ``ml_predictions`` a deterministic classifier stand-in derived from the bars
* ``holdings``       portfolio parameters (ticker, weight) keyed by portfolio_id

Scale notes: nation (25 rows) and region (5 rows) are fixed-size TPC-H
dimensions, so broadcasting them is bounded. supplier grows with the data, so
it is broadcast only after a count proves it small; beyond the bound the join
is left to Catalyst/AQE (shuffle join with skew splitting). The bar aggregation is a hash aggregate with a map-side partial step, so
a nation holding a third of all lineitem rows is collapsed before the shuffle.
Because (ticker, date) is the grouping key, every later per-ticker window
holds at most one row per calendar day of that ticker: its size is bounded
by the calendar, not by the data volume.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrel.functions.exprs import broadcast_if_small
from kestrel.sources.tables import read_table

# Ends of the fixed portfolio periods (call parameters, not "today").
AS_OF = dt.date(2001, 11, 4)
MIN_OVERLAP = 180

HOLDINGS_SCHEMA = T.StructType([
    T.StructField("portfolio_id", T.StringType(), False),
    T.StructField("ticker", T.StringType(), False),
    T.StructField("weight", T.DoubleType(), False),
])
PERIODS_SCHEMA = T.StructType([
    T.StructField("portfolio_id", T.StringType(), False),
    T.StructField("start_date", T.DateType(), True),
    T.StructField("end_date", T.DateType(), True),
])

# Fixed portfolio parameters (FIXTURES): p1 .5/.5 one year, p2 five at .2 one
# year, p3 .3/.3/.2/.1/.1 three years, p4 ten-name sector-exposure basket.
PORTFOLIOS = {
    "p1": [("NATION_3", 0.5), ("NATION_8", 0.5)],
    "p2": [("NATION_3", 0.2), ("NATION_8", 0.2), ("NATION_12", 0.2), ("NATION_13", 0.2), ("NATION_15", 0.2)],
    "p3": [("NATION_12", 0.3), ("NATION_15", 0.3), ("NATION_18", 0.2), ("NATION_19", 0.1), ("NATION_20", 0.1)],
    "p4": [("NATION_3", 0.15), ("NATION_8", 0.15), ("NATION_12", 0.12), ("NATION_13", 0.10),
           ("NATION_15", 0.10), ("NATION_18", 0.08), ("NATION_19", 0.08), ("NATION_20", 0.07),
           ("NATION_21", 0.08), ("NATION_24", 0.07)],
    "p5": [("NATION_3", 0.3), ("NATION_8", 0.3), ("NATION_12", 0.2), ("NATION_13", 0.2)],
}
PERIODS = {
    "p1": (dt.date(2000, 11, 4), AS_OF),
    "p2": (dt.date(2000, 11, 4), AS_OF),
    "p3": (dt.date(1998, 11, 4), AS_OF),
    "p4": (dt.date(2000, 11, 4), AS_OF),
    "p5": (dt.date(2003, 1, 1), dt.date(2003, 12, 31)),  # empty range: one row, n = 0
}


def stocks(spark: SparkSession, base: str) -> DataFrame:
    nation = read_table(spark, base, "nation", ["n_nationkey", "n_name", "n_regionkey"])
    region = read_table(spark, base, "region", ["r_regionkey", "r_name"])
    return (
        nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey)
        .select(
            F.col("n_name").alias("ticker"),
            F.concat(F.lit("Company "), F.col("n_name")).alias("company_name"),
            F.col("r_name").alias("sector"),
            F.concat(F.lit("Industry "), (F.col("n_nationkey") % 7).cast("string")).alias("industry"),
        )
    )


# Grouping key for the bar aggregation: (nation key, day) packed into one long.
DAY_BITS = 21                 # 2^21 days ~ 5,700 years
DAY_OFFSET = 1 << 20          # unix days may be negative


def _pack(nationkey, day) -> F.Column:
    return F.shiftleft(nationkey.cast("long"), DAY_BITS) + (F.unix_date(day) + DAY_OFFSET)


def _unpack_day(g: F.Column) -> F.Column:
    return F.date_from_unix_date((g.bitwiseAND((1 << DAY_BITS) - 1) - DAY_OFFSET).cast("int"))


def prices_daily(spark: SparkSession, base: str) -> DataFrame:
    """One bar per (nation, ship day) from lineitem.

    High, low, volume and the smallest and largest order key of a bar are one hash
    aggregation. Open and close belong to the first and last row in the order of a 5-field
    key that begins with the order key; a second scan keeps only the rows at those two
    order keys (a few per bar) and ranks them.
    """
    li = read_table(spark, base, "lineitem", [
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        "l_quantity", "l_extendedprice", "l_shipdate",
    ])
    supplier = read_table(spark, base, "supplier", ["s_suppkey", "s_nationkey"])
    nation = read_table(spark, base, "nation", ["n_nationkey", "n_name"])
    # supplier grows with the data: broadcast it only when its counted size is bounded.
    supp = broadcast_if_small(supplier, bound=spark.read.parquet(f"{base.rstrip('/')}/supplier.parquet"))
    unit = F.try_divide(F.col("l_extendedprice"), F.col("l_quantity"))
    g = _pack(F.col("s_nationkey"), F.to_date("l_shipdate"))
    rows = li.join(supp, li.l_suppkey == supp.s_suppkey).select(
        g.alias("g"), unit.alias("unit"), "l_quantity", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        "l_extendedprice")
    bars = rows.groupBy("g").agg(
        F.max("unit").alias("high"), F.min("unit").alias("low"), F.sum("l_quantity").cast("bigint").alias("volume"),
        F.min("l_orderkey").alias("o1"), F.max("l_orderkey").alias("o2"))
    # One row per nation and calendar day: bounded by the calendar, however large lineitem is.
    ends = F.broadcast(bars.select("g", "o1", "o2"))
    edge = rows.join(ends, "g").filter((F.col("l_orderkey") == F.col("o1")) | (F.col("l_orderkey") == F.col("o2")))
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]

    def end(order: list, name: str) -> DataFrame:
        n = F.row_number().over(Window.partitionBy("g").orderBy(*order))
        return edge.withColumn("n", n).filter("n = 1").select("g", F.col("unit").alias(name))

    bars = bars.join(end([F.asc(c) for c in key], "open"), "g").join(end([F.desc(c) for c in key], "close"), "g")
    bars = bars.select(F.shiftright("g", DAY_BITS).cast("int").alias("nk"), _unpack_day(F.col("g")).alias("date"),
                       "open", "high", "low", "close", "volume")
    # nation: fixed 25-row dimension -> bounded broadcast.
    named = bars.join(F.broadcast(nation), bars.nk == nation.n_nationkey)
    return named.select(F.col("n_name").alias("ticker"), "date", "open", "high", "low", "close",
                        F.col("close").alias("adj_close"), "volume")


def index_daily(spark: SparkSession, base: str) -> DataFrame:
    orders = read_table(spark, base, "orders", ["o_orderkey", "o_totalprice", "o_orderdate"])
    return (
        orders.groupBy(F.to_date("o_orderdate").alias("date"))
        .agg(
            F.min_by("o_totalprice", "o_orderkey").alias("open"),
            F.max("o_totalprice").alias("high"),
            F.min("o_totalprice").alias("low"),
            F.max_by("o_totalprice", "o_orderkey").alias("close"),
            F.count(F.lit(1)).alias("volume"),
        )
    )


def predictions_from_bars(prices: DataFrame) -> DataFrame:
    """Deterministic 3-class predictions with probabilities, one per bar."""
    fclose = F.floor("close")
    a = 1 + (fclose % 97)
    b = 1 + (F.floor(F.col("open") * 7) % 89)
    c = 1 + (F.col("volume") % 83)
    k = fclose % 10
    tot = a + b + c
    pred = F.when((a >= b) & (a >= c), 0).when(b >= c, 1).otherwise(2)
    df = prices.select(
        "ticker", "date",
        F.round(a / tot, 4).alias("prob_low"),
        F.round(b / tot, 4).alias("prob_medium"),
        F.round(c / tot, 4).alias("prob_high"),
        pred.cast("int").alias("predicted_regime"),
        k.alias("_k"),
    )
    actual = F.when(F.col("_k") < 6, F.col("predicted_regime")) \
        .otherwise((F.col("predicted_regime") + 1) % 3).cast("int")
    return df.select(
        "ticker", "date",
        actual.alias("actual_regime"),
        "predicted_regime", "prob_low", "prob_medium", "prob_high",
        F.greatest("prob_low", "prob_medium", "prob_high").alias("confidence"),
        (actual == F.col("predicted_regime")).alias("correct"),
    )


def ml_predictions(spark: SparkSession, base: str) -> DataFrame:
    return predictions_from_bars(prices_daily(spark, base))


def holdings(spark: SparkSession, portfolios: dict | None = None) -> DataFrame:
    portfolios = PORTFOLIOS if portfolios is None else portfolios
    rows = [(pid, t, float(w)) for pid, items in portfolios.items() for t, w in items]
    return spark.createDataFrame(rows, HOLDINGS_SCHEMA)


def periods(spark: SparkSession, ranges: dict | None = None) -> DataFrame:
    ranges = PERIODS if ranges is None else ranges
    return spark.createDataFrame([(pid, s, e) for pid, (s, e) in ranges.items()], PERIODS_SCHEMA)


def sector_volume_holdings(prices: DataFrame, stocks: DataFrame) -> DataFrame:
    """One portfolio per sector (``vol_<sector>``) holding each ticker in proportion to its
    total traded volume: portfolio parameters derived from the data, so the portfolio
    operators' work grows with it. Volumes are integers, so the shares are exact."""
    vol = prices.groupBy("ticker").agg(F.sum("volume").cast("double").alias("vol"))
    j = vol.join(stocks.select("ticker", "sector"), "ticker")
    share = F.col("vol") / F.sum("vol").over(Window.partitionBy("sector"))  # a few tickers per sector
    return j.select(F.concat(F.lit("vol_"), F.col("sector")).alias("portfolio_id"), "ticker",
                    share.alias("weight"))


def derived_periods(holdings: DataFrame, as_of) -> DataFrame:
    """The trailing year up to ``as_of`` for every data-derived portfolio."""
    end = F.lit(as_of) if isinstance(as_of, dt.date) else as_of
    return holdings.select("portfolio_id").distinct().select(
        "portfolio_id", F.add_months(end, -12).alias("start_date"), end.alias("end_date"))


def raw_vendor_bars(spark: SparkSession, base: str) -> DataFrame:
    """Vendor-shaped bars (capitalised names, timestamp index)."""
    p = prices_daily(spark, base)
    return p.select(
        F.col("ticker").alias("Symbol"),
        F.to_timestamp(F.col("date")).alias("Date"),
        F.col("open").alias("Open"), F.col("high").alias("High"), F.col("low").alias("Low"),
        F.col("close").alias("Close"),
        F.col("volume").alias("Volume"),
    )


def raw_vendor_index(spark: SparkSession, base: str) -> DataFrame:
    """Vendor-shaped index bars: two-level names flattened as ``'Close|^IDX'``."""
    i = index_daily(spark, base)
    return i.select(
        F.to_timestamp("date").alias("Date"),
        F.col("open").alias("Open|^IDX"), F.col("high").alias("High|^IDX"),
        F.col("low").alias("Low|^IDX"),
        F.col("close").alias("Close|^IDX"),
        F.col("volume").alias("Volume|^IDX"),
    )
