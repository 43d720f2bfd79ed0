"""Incremental refresh of the risk views (S7) between two versions of the bars.

A view is stored by month. The first changed date of every ticker follows from comparing row
hashes of the two versions; from there on the ticker's rows are recomputed, reading its bars from
the warm-up rows before that date. Only the months that hold such rows are rewritten (dynamic
partition overwrite, staged and moved by Spark's commit); other tickers' rows of these months are
carried over. The running maximum starts from the stored one instead of the whole history.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kestrel.config import checkpoint_dir
from kestrel.functions.exprs import safe_ratio
from kestrel.operators.risk import drawdown_daily, rolling_sharpe, rolling_volatility
from kestrel.sources.sinks import _fs, _root


@dataclass(frozen=True)
class View:
    relation: Callable[[DataFrame], DataFrame]
    warm_up: int                   # rows before a bar that its result depends on
    seeded: bool = False           # a running maximum, continued from the stored view


VIEWS = {
    "rolling_volatility": View(rolling_volatility, 60),
    "rolling_sharpe": View(rolling_sharpe, 60),
    "drawdown_daily": View(drawdown_daily, 0, seeded=True),
}


def _month(df: DataFrame) -> DataFrame:
    return df.withColumn("month", F.date_format("date", "yyyy-MM"))


def _path(spark: SparkSession, name: str, root: str | None) -> str:
    return f"{_root(spark, root)}/by_month/{name}"


def read_view(spark: SparkSession, name: str, root: str | None = None) -> DataFrame:
    return spark.read.parquet(_path(spark, name, root)).drop("month")


def write_views(prices: DataFrame, root: str | None = None, views: dict[str, View] = VIEWS) -> None:
    """The full refresh: every month of every view."""
    for name, view in views.items():
        (_month(view.relation(prices)).repartition("month").write.mode("overwrite").partitionBy("month")
         .parquet(_path(prices.sparkSession, name, root)))


def first_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """ticker, first_changed: the first date at which a row was added, removed or altered."""
    def hashed(df: DataFrame, side: str) -> DataFrame:
        values = [c for c in sorted(new.columns) if c not in ("ticker", "date")]
        return df.select("ticker", "date", F.lit(side).alias("side"), F.xxhash64(*values).alias("h"))

    both = hashed(old, "old").unionByName(hashed(new, "new")).groupBy("ticker", "date").agg(
        *(F.max(F.when(F.col("side") == s, F.col("h"))).alias(s) for s in ("old", "new")))
    return both.filter(~F.col("old").eqNullSafe(F.col("new"))).groupBy("ticker").agg(F.min("date").alias("first_changed"))


def _recomputed(view: View, stored: DataFrame, prices: DataFrame, changes: DataFrame) -> DataFrame:
    """The view's rows from each changed ticker's first changed date on."""
    bars = prices.join(changes, "ticker")
    later, earlier = bars.filter("date >= first_changed"), bars.filter("date < first_changed")
    if view.seeded:
        out = view.relation(later)
        seed = stored.join(changes, "ticker").filter("date < first_changed").groupBy("ticker").agg(F.max("running_max").alias("seed"))
        peak = F.greatest("running_max", "seed")
        return out.join(seed, "ticker", "left").withColumn("running_max", peak).select(
            "ticker", "date", "adj_close", "running_max",
            safe_ratio(F.col("adj_close") - F.col("running_max"), F.col("running_max")).alias("drawdown"))
    latest = Window.partitionBy("ticker").orderBy(F.col("date").desc())
    warm = earlier.withColumn("_n", F.row_number().over(latest)).filter(F.col("_n") <= view.warm_up).drop("_n")
    out = view.relation(later.unionByName(warm).drop("first_changed"))
    return out.join(changes, "ticker").filter("date >= first_changed").drop("first_changed")


def refresh_view(name: str, view: View, new: DataFrame, changes: DataFrame, root: str | None = None) -> tuple[set[str], int]:
    """Bring one stored view up to the bars ``new``: (months rewritten or removed, rows recomputed)."""
    spark = new.sparkSession
    path = _path(spark, name, root)
    stored = spark.read.parquet(path)
    fresh = _month(_recomputed(view, stored.drop("month"), new, changes)).withColumn("_fresh", F.lit(True))
    kept = stored.withColumn("month", F.col("month").cast("string")).join(changes, "ticker", "left")
    replaced = F.coalesce(F.col("date") >= F.col("first_changed"), F.lit(False))
    # Months with rows to write or to take away: bounded by the calendar.
    touched = fresh.select("month").unionByName(kept.filter(replaced).select("month")).distinct()
    rewritten = {r.month for r in touched.collect()}
    carried = kept.filter(~replaced & F.col("month").isin(*rewritten)).withColumn("_fresh", F.lit(False))
    # Materialised before the months it is read from are overwritten.
    rows = fresh.unionByName(carried.select(*fresh.columns)).checkpoint()
    n_rows, left = rows.filter("_fresh").count(), {r.month for r in rows.select("month").distinct().collect()}
    overwrite_months(rows.drop("_fresh"), path, rewritten, left)
    return rewritten, n_rows


def overwrite_months(rows: DataFrame, path: str, rewritten: set[str], left: set[str]) -> None:
    """Replace the months ``rewritten`` of a table by ``rows``, which hold the months ``left``."""
    if left:
        (rows.repartition("month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("month").parquet(path))
    for month in rewritten - left:      # nothing overwrites a month that lost all its rows
        fs, p, _ = _fs(rows.sparkSession, f"{path}/month={month}")
        fs.delete(p, True)


def refresh_views(old: DataFrame, new: DataFrame, root: str | None = None, views: dict[str, View] = VIEWS) -> DataFrame:
    """Bring the stored views from the bars ``old`` to ``new``: view, months rewritten, rows recomputed."""
    spark = new.sparkSession
    checkpoint_dir(spark)
    changes = first_changes(old, new).persist()
    report = []
    for name, view in views.items():
        months, n_rows = refresh_view(name, view, new, changes, root)
        report.append((name, len(months), n_rows))
    changes.unpersist()
    spark.catalog.refreshByPath(_path(spark, "", root))
    return spark.createDataFrame(report, "view string, n_months int, n_rows long")
