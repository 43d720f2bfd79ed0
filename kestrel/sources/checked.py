"""Checked writes (D1-D10): quality metrics and a quarantine out of the pass that writes a table.

``bar_rules`` names what can be wrong with a bar. ``checked_refresh`` marks every row with the first rule it
breaks, observes the metrics while the rows are written, and writes good and quarantined rows to
their own parts of one new version, so the source is read once. Readers are switched to the good
part after the write has committed.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from kestrel.sources.sinks import KEEP_VERSIONS, _expire, _root, _set_current, current_path


def bar_rules() -> list[tuple[str, Column]]:
    """(rule_id, what breaks it) for bars, in order; a comparison with null breaks no rule."""
    prices = ("open", "high", "low", "close", "adj_close")
    return [
        ("null_key", F.col("ticker").isNull() | F.col("date").isNull()),
        ("null_price", F.greatest(*(F.col(c).isNull().cast("int") for c in prices)) == 1),
        ("nonpositive_price", F.least(*prices) <= 0),
        ("high_below_low", F.col("high") < F.col("low")),
        ("close_outside_range", (F.col("close") > F.col("high")) | (F.col("close") < F.col("low"))),
        ("negative_volume", F.col("volume") < 0),
    ]


def first_broken(rules: list[tuple[str, Column]]) -> Column:
    """The id of the first broken rule, null for a good row."""
    return F.coalesce(*(F.when(broken, F.lit(rule)) for rule, broken in rules), F.lit(None).cast("string"))


def checked_refresh(df: DataFrame, name: str, rules: list[tuple[str, Column]], root: str | None = None,
                    keep: int = KEEP_VERSIONS) -> tuple[str, dict]:
    """Write a new version of ``name``; its path and the metrics of the pass that wrote it."""
    spark = df.sparkSession
    table_dir = f"{_root(spark, root)}/{name}"
    version = f"v={dt.datetime.now(dt.timezone.utc):%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"
    seen = Observation(f"{name}-{version}")
    marked = df.withColumn("rule_id", first_broken(rules))
    metrics = [F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("rule_id").isNull()).alias("n_good")]
    metrics += [F.count_if(F.col("rule_id") == rule).alias(f"rule_{rule}") for rule, _ in rules]
    metrics += [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in df.columns]
    if "date" in df.columns:
        metrics += [F.min("date").alias("first_date"), F.max("date").alias("last_date")]
    status = F.when(F.col("rule_id").isNull(), "good").otherwise("quarantined")
    marked.observe(seen, *metrics).withColumn("status", status).write.partitionBy("status").parquet(f"{table_dir}/{version}")
    found = seen.get
    for part in ("good", "quarantined"):       # a part without rows has no folder
        if found["n_good"] == (0 if part == "good" else found["n_rows"]):
            marked.limit(0).write.parquet(f"{table_dir}/{version}/status={part}")
    _set_current(spark, table_dir, version)
    _expire(spark, table_dir, keep)
    return f"{table_dir}/{version}", found


def read_good(spark: SparkSession, name: str, root: str | None = None) -> DataFrame:
    return spark.read.parquet(f"{current_path(spark, name, root)}/status=good").drop("rule_id")


def read_quarantine(spark: SparkSession, name: str, root: str | None = None) -> DataFrame:
    """Quarantined rows with ``rule_id``."""
    return spark.read.parquet(f"{current_path(spark, name, root)}/status=quarantined")


def metrics_frame(spark: SparkSession, metrics: dict) -> DataFrame:
    """metric, value (text) rows of ``checked_refresh``'s metrics."""
    return spark.createDataFrame([(k, str(v)) for k, v in metrics.items()], "metric string, value string")
