"""Exact top-k inner products without random access (NRA aggregation).

Rows are dealt into shards. Per shard every component is a list of (value, row) sorted by
value, read from the top for queries with a positive weight on it and from the bottom for
negative ones. All lists are read in step, each round to twice the depth of the last one, for
a batch of queries at a time. An entry not read contributes at most weight times the value at
its list's frontier. A row's first entry carries its norm, so Cauchy's inequality bounds the
rest as well: the weights of the lists where the row was not read times what the entries read
leave of its norm. The smaller of both makes the upper bound, the second one the lower bound.

A row that cannot reach the k-th best lower bound is out. A query stops reading when no more
rows are open than the depth read, whatever the size of the shard: resolving their exact
scores then costs no more than the reading did. The shards' top k merge into the result.

Components are floor(256 x), x as double; beyond the range of long they are its ends. Integer
arithmetic stays exact in doubles below 2**53; larger sums take Python integers, and a score
beyond long is given as its end. Defined results: rows whose vector is null or holds
null or non-finite components take no part; vectors of unequal length are padded with
zeros; a query's own row is its vec_id's, so repeated rows of it are left out as well; rows
without a vec_id take no part; repeated candidate rows are ranked each, repeated query rows
answer once (by their first vector in value order); ties go to the smaller vec_id; an empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kestrel.llm.common import prepare

K, QUERY_STEP, SCALE = 5, 50, 256.0
SHARD_ROWS, QUERY_ROWS = 8192, 512
QUERIES_AT_ONCE = 128
FIRST = 4                       # the first round reads 1 / 2**FIRST of every list
EXACT, LONG = 2.0 ** 53, 2 ** 63 - 1


def quantised(df: DataFrame) -> DataFrame:
    """vec_id and v, the integer components (as doubles), of every row that takes part."""
    x = F.col("embedding").cast("array<double>")
    ok = ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return (df.filter(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & ok)
            .select(F.col("vec_id").cast("long"), F.transform(x, lambda c: F.floor(c * SCALE).cast("double")).alias("v")))


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def _exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products as integers, in Python integers where doubles could round."""
    if np.abs(x).max(initial=0) * np.abs(q).sum() < EXACT:
        return (x @ q).astype(np.int64)
    return np.array([sum(int(a) * int(b) for a, b in zip(r, q)) for r in x], object)


def nra_shard(queries: np.ndarray, query_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int,
              report: list | None = None) -> list[tuple[int, int, int]]:
    """(query_id, vec_id, score) of every query's k best rows of one shard.

    ``report`` receives (depth read, rows scored exactly) for each query.
    """
    n, width = x.shape
    out: list[tuple[int, int, int]] = []
    if not n or not len(queries):
        return out
    order = np.argsort(x, axis=0, kind="stable")
    at = np.arange(width)
    norms = (x * x).sum(axis=1)
    # Both directions side by side: the left half serves positive weights, the right half negative ones.
    signed = np.hstack([np.maximum(queries, 0), np.minimum(queries, 0)])
    total = (signed * signed).sum(axis=1)
    slack = 2e-12 * np.abs(x).max(initial=0) * np.abs(signed).sum(axis=1)      # far above the rounding of the bounds
    value, unread = np.zeros((n, 2 * width)), np.ones((n, 2 * width))
    live, depth, step = np.arange(len(queries)), 0, max(1, n >> FIRST)
    while len(live):
        to = min(n, step)
        for rows, half in ((order[n - to:n - depth], at), (order[depth:to], at + width)):
            value[rows, half], unread[rows, half] = x[rows, at], 0
        depth, step = to, 2 * step
        w = signed[live]
        upper = value @ w.T
        lower = upper
        if depth < n:
            frontier = np.concatenate([x[order[n - depth], at], x[order[depth - 1], at]])
            norm = np.where(unread.min(axis=1, initial=1) == 0, norms, norms.max()) * (1 + 1e-12)
            left = np.maximum(norm[:, None] - (value * value) @ (w != 0).T, 0)
            rest = np.sqrt(left * (unread @ (w * w).T + 1e-12 * total[live]))
            lower = upper - rest
            upper = upper + np.minimum(unread @ (w * frontier).T, rest)
        own = ids[:, None] == query_ids[live][None, :]
        if n > k:
            lower[own] = -np.inf
            kth = np.partition(lower, n - k, axis=0)[n - k]
        else:
            kth = np.full(len(live), -np.inf)
        still = (upper >= kth - slack[live]) & ~own
        stop = (still.sum(axis=0) <= depth) | (depth == n)
        for c in np.flatnonzero(stop):
            rows = np.flatnonzero(still[:, c])
            if report is not None:
                report.append((depth, len(rows)))
            score = _exact_scores(queries[live[c]], x[rows])
            best = sorted(zip((-s for s in score.tolist()), ids[rows].tolist()))[:k]
            out.extend((int(query_ids[live[c]]), i, max(-LONG - 1, min(LONG, -s))) for s, i in best)
        live = live[~stop]
    return out


def top_k(rows: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows (vec_id, v) for every query (query_id, v).

    Every query block meets every shard once; a group holds one shard and one block.
    """
    n, n_queries = rows.count(), queries.count()
    shards = max(-(-n // SHARD_ROWS), 1)
    blocks = max(-(-n_queries // QUERY_ROWS), 1)
    left = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"),
                       F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "vec_id", "v")
    right = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
                           F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"), "query_id", "v")

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int]] = []
        if len(a) and len(b):
            width = max(a["v"].map(len).max(), b["v"].map(len).max())
            x, ids = _matrix(a["v"], width), a["vec_id"].to_numpy()
            for i in range(0, len(b), QUERIES_AT_ONCE):
                part = b.iloc[i:i + QUERIES_AT_ONCE]
                out += nra_shard(_matrix(part["v"], width), part["query_id"].to_numpy(), x, ids, k)
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(
        search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return (found.withColumn("rank", rank).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    rows = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    queries = rows.filter(F.col("vec_id") % QUERY_STEP == 0).groupBy(F.col("vec_id").alias("query_id")).agg(
        F.min("v").alias("v"))
    return top_k(rows, queries)


OP3_SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: CAST(floor({SCALE} * CAST(c AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(CAST(c AS DOUBLE)))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % {QUERY_STEP} = 0),
r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
         vec_id, score
  FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
