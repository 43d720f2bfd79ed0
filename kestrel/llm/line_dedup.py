"""Line dedup (DataFrame functions only): levelled sorted runs of line hashes.

A line's key is the line stripped of ASCII white space with A-Z lower-cased; a key of at
least ``min_chars`` code points found in at least ``min_docs`` documents loses its lines
everywhere but in the largest doc_id that holds it. Keys are 128-bit hashes.

The index is a list of runs, each bucketed and sorted by hash. Batches come in descending
doc_id order: a batch is pre-aggregated to one row per hash, merge-anti-joined with the
runs to find the lines seen for the first time (their keeper is in this batch, as later
batches hold smaller ids), and written as a run of its own. ``FANOUT`` runs of a level are
compacted into one run of the next level, bucket by bucket, without a shuffle.

Defined results: null or empty text is one empty line; every row is a document, a null
doc_id ranks below all others; a document with one key on several lines holds it once and
loses or keeps all of them; an empty table gives an empty result; extra columns are kept.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm.common import BLANKS, HOT_SHARE, documents, lower_ascii, shared_path, store

MIN_CHARS, MIN_DOCS = 40, 5
BATCHES, FANOUT = 4, 2
HASHES_PER_BUCKET = 4_000_000


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(BLANKS)))


def key_hash(line: Column) -> Column:
    """128 bits as (h, g): two chained 64-bit hashes of the key with different seeds."""
    key = line_key(line)
    return F.struct(F.xxhash64(key).alias("h"), F.xxhash64(F.lit(1), key).alias("g"))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class LineIndex:
    """Levelled sorted runs of (h, g, n_docs, keeper); keeper is set by the batch that brought the hash."""

    def __init__(self, spark: SparkSession, path: str, buckets: int, fanout: int = FANOUT):
        self.spark, self.path, self.buckets, self.fanout = spark, path, buckets, fanout
        self.levels: list[list[str]] = []

    def _write(self, run: DataFrame, level: int, shuffle: bool) -> None:
        name = "line_run_" + uuid.uuid4().hex[:12]
        run = run.repartition(self.buckets, "h", "g") if shuffle else run
        (run.write.bucketBy(self.buckets, "h", "g").sortBy("h", "g").option("path", f"{self.path}/{name}")
         .saveAsTable(name))
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            merged, self.levels[level] = self.levels[level], []
            self._write(self._merged(merged), level + 1, shuffle=False)
            for old in merged:
                self.spark.sql(f"DROP TABLE {old}")

    def _merged(self, runs: list[str]) -> DataFrame:
        """Merge of sorted runs: full outer sort-merge joins on their common buckets."""
        out = self.spark.table(runs[0])
        for r in runs[1:]:
            a, b = out.alias("a"), self.spark.table(r).alias("b")
            key = [F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c) for c in ("h", "g")]
            n_docs = F.coalesce("a.n_docs", F.lit(0)) + F.coalesce("b.n_docs", F.lit(0))
            both = a.join(b.hint("merge"), (F.col("a.h") == F.col("b.h")) & (F.col("a.g") == F.col("b.g")), "full_outer")
            out = both.select(
                *key, n_docs.alias("n_docs"),
                (F.coalesce("a.first", F.lit(False)) | F.coalesce("b.first", F.lit(False))).alias("first"),
                F.coalesce("a.keeper", "b.keeper").alias("keeper"))
        return out

    def runs(self) -> list[str]:
        return [r for level in self.levels for r in level]

    def add(self, batch: DataFrame) -> None:
        """Add a batch of (h, g, doc_id), one row per document and hash; ids below all earlier batches'."""
        grouped = batch.groupBy("h", "g").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("top"))
        runs = self.runs()
        if runs:
            grouped = store(grouped, "line-batch")
        fresh = grouped
        for r in runs:
            fresh = fresh.join(self.spark.table(r).filter("first").select("h", "g").hint("merge"),
                               ["h", "g"], "left_anti")
        fresh = fresh.select("h", "g", "n_docs", F.lit(True).alias("first"), F.col("top").alias("keeper"))
        if runs:
            known = grouped.join(fresh.select("h", "g").hint("merge"), ["h", "g"], "left_anti")
            fresh = fresh.unionByName(known.select("h", "g", "n_docs", F.lit(False).alias("first"),
                                                   F.lit(None).cast("long").alias("keeper")))
        self._write(fresh, 0, shuffle=True)

    def drop(self) -> None:
        for r in self.runs():
            self.spark.sql(f"DROP TABLE {r}")

    def repeated(self, min_docs: int) -> DataFrame:
        return self._merged(self.runs()).filter(F.col("n_docs") >= min_docs)


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
               batches: int = BATCHES, counts: bool = True) -> DataFrame:
    """``docs`` with ``text`` replaced by its kept lines; with ``counts`` also n_lines and n_dropped,
    which replace input columns of these names."""
    spark = docs.sparkSession
    long_lines = F.filter(lines_of(F.col("text")), lambda x: F.length(x) >= min_chars)
    hashes = F.array_distinct(F.transform(
        F.filter(long_lines, lambda x: F.length(line_key(x)) >= min_chars), key_hash))
    ids = docs.select("doc_id")
    cuts = ids.select(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0] or []
    batch = reduce(lambda a, c: a - (F.col("doc_id") > c).cast("int"), cuts, F.lit(batches - 1))
    keyed = docs.select("doc_id", F.explode(hashes).alias("k")).select(
        "doc_id", "k.h", "k.g", F.coalesce(batch, F.lit(batches - 1)).alias("batch"))
    keyed = store(keyed, "line-keys", ("batch",))
    index = LineIndex(spark, shared_path(spark, "line-index"), max(12, -(-keyed.count() // HASHES_PER_BUCKET)))
    for b in range(batches):   # batch 0 holds the largest ids
        index.add(keyed.filter(F.col("batch") == b).select("h", "g", "doc_id"))

    repeated = store(index.repeated(min_docs).select("h", "g", "n_docs", "keeper"), "line-repeated")
    # Hashes in more than 1/HOT_SHARE of the rows are fewer than HOT_SHARE * lines per document
    # could ever be: each needs that share of all (document, hash) rows, so the bound is HOT_SHARE.
    total = keyed.count()
    hot = repeated.filter(F.col("n_docs") * HOT_SHARE > total).select("h", "g", "keeper")
    cold = repeated.filter(F.col("n_docs") * HOT_SHARE <= total).select("h", "g", "keeper")
    keys = keyed.select("doc_id", "h", "g")
    hit = keys.join(F.broadcast(hot), ["h", "g"]).unionByName(
        keys.join(F.broadcast(hot.select("h", "g")), ["h", "g"], "left_anti").join(cold.hint("merge"), ["h", "g"]))
    drops = (hit.filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
             .groupBy(F.col("doc_id").alias("__id")).agg(F.collect_set(F.struct("h", "g")).alias("__drops")))
    index.drop()
    lines, drop = lines_of(F.col("text")), F.col("__drops")
    kept = F.filter(lines, lambda x: ~((F.length(x) >= min_chars) & F.array_contains(drop, key_hash(x))))
    out = (docs.join(drops, docs["doc_id"].eqNullSafe(drops["__id"]), "left")
           .withColumn("__kept", F.when(drop.isNull(), lines).otherwise(kept)))
    if counts:
        n_lines = F.size(lines).cast("long")
        out = (out.withColumn("n_lines", n_lines)
               .withColumn("n_dropped", n_lines - F.size("__kept").cast("long")))
    return (out.withColumn("text", F.when(drop.isNull(), F.coalesce("text", F.lit("")))
                           .otherwise(F.array_join("__kept", "\n")))
            .drop("__id", "__drops", "__kept"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


_TRIM = r"chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
OP4_SQL = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (
  SELECT *, translate(trim(line, {_TRIM}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= {MIN_CHARS}
  GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
m AS (SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.keeper AS dropped FROM k LEFT JOIN r ON r.key = k.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN dropped THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
