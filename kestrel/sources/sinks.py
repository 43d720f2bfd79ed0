"""Table sinks (S4-S7): versioned writes with an atomic "current" pointer.

A refresh never truncates what readers see: every write goes to a fresh
version folder under ``<root>/<table>/``; only after the write job has
committed (Spark's commit protocol retries lost tasks) is the pointer file
``_CURRENT`` replaced by a rename. A failed refresh leaves the previous
version in place. ``root`` defaults to the shared folder named by
``spark.checkpoint.dir``.
"""

from __future__ import annotations

import datetime as dt
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrel.config import checkpoint_dir

# Declared column types of the derived tables (NUMERIC(p,s) -> DecimalType(p,s)).
ML_FEATURES_DDL = {
    "ticker": T.StringType(), "date": T.DateType(),
    **{c: T.DecimalType(12, 8) for c in ("ret_1d", "ret_5d", "ret_20d", "vol_5d", "vol_20d", "bb_width",
                                         "atr_14", "rsi_14", "volume_ratio", "abs_return_next")},
    **{c: T.DecimalType(14, 8) for c in ("macd", "macd_signal", "macd_diff")},
    "regime": T.ShortType(),
}
KEEP_VERSIONS = 5
ML_PREDICTIONS_DDL = {
    "ticker": T.StringType(), "date": T.DateType(), "actual_regime": T.ShortType(),
    "predicted_regime": T.ShortType(),
    **{c: T.DecimalType(6, 4) for c in ("prob_low", "prob_medium", "prob_high", "confidence")},
    "correct": T.BooleanType(),
}
PRICES_DDL = {
    "ticker": T.StringType(), "date": T.DateType(),
    **{c: T.DecimalType(12, 4) for c in ("open", "high", "low", "close", "adj_close")},
    "volume": T.LongType(),
}


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def _root(spark: SparkSession, root: str | None) -> str:
    return (root or f"{checkpoint_dir(spark).rstrip('/')}/tables").rstrip("/")


def _set_current(spark: SparkSession, table_dir: str, version: str) -> None:
    fs, _, jvm = _fs(spark, table_dir)
    tmp = jvm.org.apache.hadoop.fs.Path(f"{table_dir}/_CURRENT.{uuid.uuid4().hex}")
    out = fs.create(tmp, True)
    out.write(bytearray(version.encode()))
    out.close()
    final = jvm.org.apache.hadoop.fs.Path(f"{table_dir}/_CURRENT")
    # One overwriting rename: a reader sees the old pointer or the new one, never none.
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context.rename(fs.makeQualified(tmp), fs.makeQualified(final), options)


def _expire(spark: SparkSession, table_dir: str, keep: int) -> None:
    """Drop all but the newest ``keep`` versions (names sort by time)."""
    fs, path, _ = _fs(spark, table_dir)
    versions = sorted(s.getPath().getName() for s in fs.listStatus(path) if s.getPath().getName().startswith("v="))
    for name in versions[:-keep]:
        fs.delete(_fs(spark, f"{table_dir}/{name}")[1], True)


def current_path(spark: SparkSession, name: str, root: str | None = None) -> str:
    table_dir = f"{_root(spark, root)}/{name}"
    fs, _, jvm = _fs(spark, table_dir)
    stream = fs.open(jvm.org.apache.hadoop.fs.Path(f"{table_dir}/_CURRENT"))
    version = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return f"{table_dir}/{version}"


def full_refresh(df: DataFrame, name: str, root: str | None = None,
                 partition_by: list[str] | None = None, keep: int = KEEP_VERSIONS) -> str:
    """Write a complete new version, then switch readers to it (idempotent full reload);
    the newest ``keep`` versions stay for readers that are still on one of them."""
    spark = df.sparkSession
    table_dir = f"{_root(spark, root)}/{name}"
    version = f"v={dt.datetime.now(dt.timezone.utc):%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"
    w = df.write.mode("errorifexists")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(f"{table_dir}/{version}")
    _set_current(spark, table_dir, version)
    _expire(spark, table_dir, keep)
    return f"{table_dir}/{version}"


def read_current(spark: SparkSession, name: str, root: str | None = None) -> DataFrame:
    return spark.read.parquet(current_path(spark, name, root))


def conform(df: DataFrame, ddl: dict[str, T.DataType]) -> DataFrame:
    """Project to the declared columns and cast to the declared types (ANSI: overflow raises)."""
    return df.select(*[F.col(c).cast(t).alias(c) for c, t in ddl.items()])


def drop_create(df: DataFrame, name: str, ddl: dict[str, T.DataType], root: str | None = None) -> str:
    """Replace a typed table with exactly the declared columns."""
    return full_refresh(conform(df, ddl), name, root)


def upsert_dimension(old: DataFrame, new: DataFrame, key: str = "ticker",
                     update_cols: tuple[str, ...] = ("company_name", "sector", "industry")) -> DataFrame:
    """INSERT ... ON CONFLICT (key) DO UPDATE of ``update_cols`` as a full outer join."""
    o = old.alias("o")
    n = new.alias("n")
    j = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    cols = [F.coalesce(F.col(f"n.{key}"), F.col(f"o.{key}")).alias(key)]
    for c in old.columns:
        if c == key:
            continue
        if c in update_cols and c in new.columns:
            cols.append(F.when(F.col(f"n.{key}").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
        else:
            cols.append(F.col(f"o.{c}").alias(c))
    return j.select(*cols)


def materialize_views(views: dict[str, DataFrame], shared: DataFrame | None = None,
                      root: str | None = None) -> DataFrame:
    """Recompute and replace each derived relation; ``shared`` (e.g. the daily returns
    feeding several views) is persisted once while they are written."""
    if shared is not None:
        shared.persist()
    try:
        written = {name: full_refresh(df, name, root) for name, df in views.items()}
    finally:
        if shared is not None:
            shared.unpersist()
    spark = next(iter(views.values())).sparkSession
    counts = [spark.read.parquet(p).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("view"), "n_rows")
              for n, p in written.items()]
    return reduce(DataFrame.unionByName, counts)
