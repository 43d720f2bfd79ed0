"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.config import checkpoint_dir, ship_package

# ASCII white space, ``[\x20\x09-\x0D]``.
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
# A key with more than 1/HOT_SHARE of all rows is "hot"; there are fewer than HOT_SHARE of them.
HOT_SHARE = 200


def prepare(spark: SparkSession) -> None:
    """Ship the package to the workers; a union never stands in for a shuffle.

    With ``unionOutputPartitioning`` a grouping over a union of bucketed tables was planned
    without a shuffle although the scans had lost their buckets, and kept a key twice.
    """
    ship_package(spark)
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder of ``spark.checkpoint.dir``."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def store(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_n_chars(docs: DataFrame) -> DataFrame:
    """``n_chars`` recomputed from ``text``, where there is such a column."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z, every other character unchanged (``lower`` is exact for pure ASCII strings)."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def hash_share(key: Column) -> Column:
    """A number in [0, 1) that a key always gets."""
    return F.pmod(F.xxhash64(key), F.lit(1 << 40)) / F.lit(float(1 << 40))


def hash_sample(df: DataFrame, key: str, n: int, rows: int) -> DataFrame:
    """The ``n`` rows of ``df`` (of about ``rows``) whose key comes first by a hash.

    A threshold leaves about 2 n + 100 of them before the sort, however many there are.
    """
    share = hash_share(F.col(key))
    return df.filter(share * max(rows, 1) < 2 * n + 100).orderBy(share, key).limit(n)


def join_by_hot_key(rows: DataFrame, groups: DataFrame, key: list[str], is_hot: Column) -> DataFrame:
    """Inner join of ``rows`` to the one-row-per-key ``groups``.

    ``is_hot`` (over ``groups``) must hold for fewer than ``HOT_SHARE`` keys: those are
    broadcast, so no task gathers the rows of a hot key; the rest is a shuffle join.
    """
    hot, cold = F.broadcast(groups.filter(is_hot)), groups.filter(~is_hot)
    return rows.join(hot, key).unionByName(
        rows.join(F.broadcast(groups.filter(is_hot).select(*key)), key, "left_anti").join(cold, key))


def local_uri(path: str) -> str:
    """``file:/x`` as ``file:///x``, a bare path as ``file://``; other schemes unchanged."""
    if path.startswith("/"):
        return "file://" + path
    return re.sub(r"^file:/+", "file:///", path)


def sorted_rows(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` range-partitioned and sorted by ``order``; equal rows may be dealt to several tasks."""
    tied = [*order, F.col("__tie")]
    return (df.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(*tied)
            .sortWithinPartitions(*tied).drop("__tie"))


def crc32_sql(text: str) -> str:
    """DuckDB: CRC-32 of an ASCII string, bit by bit: a byte, then eight shifts (-1)."""
    steps = (f"flatten(list_transform(regexp_extract_all({text}, '.'), lambda c: [ascii(c)::BIGINT] || "
             f"list_value({', '.join(['-1::BIGINT'] * 8)})))")
    return (f"xor(list_reduce([4294967295::BIGINT] || {steps}, lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) "
            f"ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295)")
