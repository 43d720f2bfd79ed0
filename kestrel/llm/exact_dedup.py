"""Exact dedup: a persistent digest index, bucketed and sorted by hash.

Texts are equal when their SHA-256 is equal after deleting every ASCII white-space
character. Each batch is pre-aggregated to one row per digest, split by a sort-merge
anti-join against the index into digests seen for the first time and digests already
known, and appended; the index side of every join is read in its buckets, unshuffled.

Defined results: null text counts as empty; all empty texts are one group; of equal texts
the longest original (code points) stays, then the smallest doc_id (null last), then the
row read first, so exactly one row of a group stays even when rows repeat; with a
stored index a text of an earlier run stays what that run kept; an empty table
gives an empty result; only ``doc_id`` and ``text`` are read, extra columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm.common import HOT_SHARE, documents, join_by_hot_key, shared_path, store
from kestrel.sources.sinks import _fs

BATCHES = 4
ROWS_PER_BUCKET = 1_000_000


def text_digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", ""), 256))


class DigestIndex:
    """Append-only table of (digest, run, n_rows, best, first), bucketed and sorted by digest.

    A digest has one row per batch that held it; ``first`` marks the batch that brought it.
    The folder ``path`` is the index: opening it again, in this or a later session, finds its
    entries and its bucket count (``buckets`` counts for a new index only) and begins the next run.
    The catalog holds it under a name of this object's own, until ``drop``; the folder stays.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int):
        self.spark, self.path = spark, path.rstrip("/")
        self.table = "digest_index_" + uuid.uuid4().hex[:12]
        self.created, self.run = self._exists("entries/_SUCCESS"), 0
        if self._exists("buckets/_SUCCESS"):
            self.buckets = spark.read.parquet(f"{self.path}/buckets").first().buckets
        else:
            self.buckets = buckets
            spark.range(1).select(F.lit(buckets).alias("buckets")).write.mode("overwrite").parquet(f"{self.path}/buckets")
        if self.created:
            schema = spark.read.parquet(f"{self.path}/entries").schema
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
            spark.sql(f"CREATE TABLE {self.table} ({columns}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) "
                      f"INTO {self.buckets} BUCKETS LOCATION '{self.path}/entries'")
            last = self.entries().agg(F.max("run")).first()[0]
            self.run = 0 if last is None else last + 1

    def _exists(self, name: str) -> bool:
        fs, path, _ = _fs(self.spark, f"{self.path}/{name}")
        return fs.exists(path)

    def entries(self) -> DataFrame:
        return self.spark.table(self.table)

    def append(self, batch: DataFrame) -> DataFrame:
        """Add a batch with columns digest, doc_id, n_chars, rid; returns the index's digests so far."""
        best = F.min(F.struct((-F.col("n_chars")).alias("neg_chars"), F.col("doc_id").isNull().alias("no_id"),
                              "doc_id", "rid"))
        grouped = batch.groupBy("digest").agg(F.count("*").alias("n_rows"), best.alias("best"))
        if not self.created:
            out = grouped.withColumn("first", F.lit(True))
        else:
            grouped = store(grouped, "digest-batch")
            known = self.entries().filter("first").select("digest")
            fresh = grouped.join(known.hint("merge"), "digest", "left_anti").withColumn("first", F.lit(True))
            seen = grouped.join(known.hint("merge"), "digest", "left_semi").withColumn("first", F.lit(False))
            out = fresh.unionByName(seen)
        out = out.select("digest", F.lit(self.run).cast("long").alias("run"), "n_rows", "best", "first")
        (out.repartition(self.buckets, "digest").write.mode("append").bucketBy(self.buckets, "digest")
         .sortBy("digest").option("path", f"{self.path}/entries").saveAsTable(self.table))
        self.created = True
        return self.entries().filter("first")

    def groups(self) -> DataFrame:
        """One row per digest; the bucketed scan needs no shuffle."""
        kept = F.min(F.struct("run", "best"))      # what an earlier run kept stays
        new_rows = F.sum(F.when(F.col("run") == self.run, F.col("n_rows")).otherwise(0))
        return (self.entries().groupBy("digest")
                .agg(F.sum("n_rows").alias("group_size"), new_rows.alias("new_rows"), kept.alias("kept"))
                .select("digest", "group_size", "new_rows", F.col("kept.best.doc_id").alias("keep_id"),
                        F.col("kept.best.rid").alias("keep_rid"), F.col("kept.run").alias("keep_run")))

    def drop(self) -> None:
        """Take the index's name out of the catalog; frames read from it stay valid."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def exact_dedup(docs: DataFrame, batches: int = BATCHES, index_path: str | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    With ``index_path`` the digests of earlier calls on that folder count: a text that one of them
    held is kept by none of these rows, ``keep_id`` is the row kept then and ``group_size`` counts
    all rows so far. A call is one run; calls on the same folder must not overlap in time.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("n_chars"),
                       text_digest(F.col("text")).alias("digest"),
                       F.monotonically_increasing_id().alias("rid"))
    rows = rows.withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int"))
    rows = store(rows, "digest-rows", ("batch",))
    n = rows.count()
    index = DigestIndex(spark, index_path or shared_path(spark, "digest-index"), max(12, -(-n // ROWS_PER_BUCKET)))
    for b in range(batches):
        index.append(rows.filter(F.col("batch") == b))
    # A digest with more than n / HOT_SHARE of these rows: fewer than HOT_SHARE of them.
    is_hot = F.col("new_rows") * HOT_SHARE > n
    out = join_by_hot_key(rows.select("doc_id", "digest", "rid"), index.groups(), ["digest"], is_hot)
    kept = (F.col("rid") == F.col("keep_rid")) & (F.col("keep_run") == index.run)
    index.drop()
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"),
                      F.lower(F.hex("digest")).alias("text_sha256"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


OP7_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
