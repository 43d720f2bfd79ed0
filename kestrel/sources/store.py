"""Stored relations: derive once per dataset, read bucketed afterwards.

The bar fact table and the feature table are what every analytic reads. They
are written once per (dataset, source-file state) into the shared folder
named by ``spark.checkpoint.dir``, bucketed by ``ticker`` and sorted by
``date`` inside each bucket. Reading them back gives a scan that is already
hash-partitioned by ticker, so every per-ticker Window (and grouped
``applyInPandas``) runs without a shuffle: the co-located layout a cluster
deployment keeps for its fact tables.

A stored table's folder is named by the dataset, the size and modification time of every
source file, and the bucket count; a finished build leaves a marker in it. A later session
registers such a folder as a table instead of building it again. Superseded folders of a
dataset are removed when its new one is finished, the newest ``KEEP`` excepted.
"""

from __future__ import annotations

import hashlib
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kestrel.config import checkpoint_dir

_LOCK = threading.RLock()  # re-entrant: building one stored relation may read another
_STORED: dict[tuple[str, str], str] = {}   # (folder, stem) -> table name


KEEP = 3
DONE = "_KESTREL_STORED"


def source_signature(spark: SparkSession, base: str, tables: tuple[str, ...]) -> tuple[str, int]:
    """Hash of (path, length, mtime) of every file of the given parquet tables, and their total bytes."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    parts = []
    total = 0
    for t in tables:
        p = jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/{t}.parquet")
        fs = p.getFileSystem(conf)
        it = fs.listFiles(p, True)
        while it.hasNext():
            st = it.next()
            parts.append(f"{st.getPath().toString()}:{st.getLen()}:{st.getModificationTime()}")
            total += st.getLen()
    return hashlib.sha1("\n".join(sorted(parts)).encode()).hexdigest()[:16], total


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _finish(spark: SparkSession, folder: str, prefix: str, name: str) -> None:
    """Mark ``name`` as complete and drop the oldest other folders with its prefix."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = hadoop.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.create(hadoop.Path(f"{folder}/{name}.{DONE}"), True).close()
    old = sorted((s for s in fs.listStatus(root) if s.isDirectory() and s.getPath().getName().startswith(prefix)
                  and s.getPath().getName() != name), key=lambda s: s.getModificationTime())
    for s in old[:max(0, len(old) - KEEP + 1)]:
        fs.delete(hadoop.Path(f"{folder}/{s.getPath().getName()}.{DONE}"), False)
        fs.delete(s.getPath(), True)


def stored(spark: SparkSession, name: str, base: str, sources: tuple[str, ...],
           build: Callable[[], DataFrame], bucket_by: str = "ticker", sort_by: tuple[str, ...] = ("ticker", "date"),
           buckets: int | None = None) -> DataFrame:
    """The relation ``build()`` stored bucketed by ``bucket_by``; built at most once per source state.

    ``buckets`` defaults to one per core: the stored relations hold one row per ticker and
    day, so their size is bounded by the calendar, not by the source.
    """
    sig, _ = source_signature(spark, base, sources)
    n = buckets or spark.sparkContext.defaultParallelism
    prefix = f"{name}_{hashlib.sha1(base.rstrip('/').encode()).hexdigest()[:8]}_"
    folder = f"{checkpoint_dir(spark).rstrip('/')}/store"
    stem = f"{prefix}{sig}_{n}"
    with _LOCK:
        hit = _STORED.get((folder, stem))
        if hit is not None and spark.catalog.tableExists(hit):
            return spark.table(hit)
        table = f"kestrel_{stem}"
        if not _exists(spark, f"{folder}/{stem}.{DONE}"):
            # Repartition on the bucket column first: each write task then holds exactly one
            # bucket, so the table has one file per bucket instead of tasks x buckets files.
            (build().repartition(n, bucket_by).write.format("parquet").mode("overwrite")
             .bucketBy(n, bucket_by).sortBy(*sort_by).option("path", f"{folder}/{stem}").saveAsTable(table))
            _finish(spark, folder, prefix, stem)
        elif not spark.catalog.tableExists(table):
            schema = spark.read.parquet(f"{folder}/{stem}").schema
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
            spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY ({bucket_by}) "
                      f"SORTED BY ({', '.join(sort_by)}) INTO {n} BUCKETS LOCATION '{folder}/{stem}'")
        _STORED[(folder, stem)] = table
        return spark.table(table)
