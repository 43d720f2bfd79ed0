"""Ordered computations of long series, split over tasks by blocks of the time axis.

Three forms, all in the JVM; none needs a whole series in one task:

* ``in_blocks``: a relation with bounded look-back (lags, rolling windows) runs per block, each
  block preceded by a halo of the rows before it, which are dropped afterwards;
* ``running_in_blocks``: a running aggregate is the aggregate inside the block combined with that of the
  blocks before it (a two-level prefix aggregate);
* ``scan``: a linear recursion is folded per block to a summary, the summaries of a series are
  composed to the state every block starts from, and the blocks are folded again from there.

Results do not depend on the block size but for the last bits of a composed state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 4096
BLOCK_DAYS = 366


def day_block(order: str, days: int) -> Column:
    return F.floor(F.unix_date(order) / days)


def _earlier(key: str) -> Window:
    return Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)


def _with_carry(rows: DataFrame, per_block: DataFrame, key: str) -> DataFrame:
    """``rows`` (with _b) joined to their block's row of ``per_block``: one thin row a block,
    which is the hash table; the rows stay where they are."""
    return rows.join(per_block.hint("shuffle_hash"), [key, "_b"])


def row_index(df: DataFrame, key: str = "ticker", order: str = "date", days: int = BLOCK_DAYS) -> DataFrame:
    """``df`` with ``_i``, the row's position (from 0) in its series."""
    rows = df.withColumn("_b", day_block(order, days)).repartition(key, "_b")
    counts = rows.groupBy(key, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select(key, "_b", F.coalesce(F.sum("_n").over(_earlier(key)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(key, "_b").orderBy(order)) - 1
    return (_with_carry(rows.withColumn("_inside", inside), before, key)
            .withColumn("_i", F.col("_before") + F.col("_inside")).drop("_b", "_inside", "_before"))


def in_blocks(df: DataFrame, relation: Callable[[DataFrame], DataFrame], halo: int, block_rows: int = BLOCK_ROWS,
              key: str = "ticker", order: str = "date", days: int = BLOCK_DAYS) -> DataFrame:
    """``relation(df)``, where a row's result depends on its series' ``halo`` rows before it only.

    Inside ``relation`` the key is a struct of the series, the block and the block's first
    ``order``: windows by key stay inside a block and its halo.
    """
    n = F.lit(block_rows).cast("long")
    own = row_index(df, key, order, days).withColumn("_block", F.floor(F.col("_i") / n))
    starts = own.groupBy(key, "_block").agg(F.min(order).alias("_start"))
    # A row also belongs to the halo of every block that begins at most ``halo`` rows after it.
    last = F.floor((F.col("_i") + halo) / n)
    dealt = own.withColumn("_block", F.explode(F.sequence("_block", last)))
    keyed = dealt.join(starts.hint("shuffle_hash"), [key, "_block"]).withColumn(
        key, F.struct(F.col(key).alias("series"), F.col("_block").alias("block"), F.col("_start").alias("start")))
    out = relation(keyed.drop("_i", "_block", "_start"))
    return out.filter(F.col(order) >= F.col(f"{key}.start")).withColumn(key, F.col(f"{key}.series"))


def running_in_blocks(df: DataFrame, name: str, aggregate: Callable[[Column], Column], value: Column, combine: Callable[[Column, Column], Column],
            key: str = "ticker", order: str = "date", days: int = BLOCK_DAYS) -> DataFrame:
    """``df`` with ``name``: ``aggregate(value)`` over the series up to the row."""
    rows = df.withColumn("_b", day_block(order, days)).withColumn("_v", value).repartition(key, "_b")
    sums = rows.groupBy(key, "_b").agg(aggregate(F.col("_v")).alias("_s"))
    before = sums.select(key, "_b", aggregate(F.col("_s")).over(_earlier(key)).alias("_before"))
    inside = Window.partitionBy(key, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    here, earlier = F.col("_here"), F.col("_before")
    return (_with_carry(rows.withColumn("_here", aggregate(F.col("_v")).over(inside)), before, key)
            .withColumn(name, F.when(earlier.isNull(), here).when(here.isNull(), earlier).otherwise(combine(earlier, here)))
            .drop("_b", "_v", "_here", "_before"))


Fields = dict[str, Column]


def scan(df: DataFrame, carry: Fields, local: Fields, step: Callable[[Column, Column, Column], Fields],
         compose: Callable[[Column, Column], Fields], outputs: list[str], key: str = "ticker", order: str = "date",
         days: int = BLOCK_DAYS) -> DataFrame:
    """``df`` with the ``outputs`` of a linear recursion along each series and the position ``_i``.

    ``carry`` names the state and its start value, ``local`` what a block's summary holds besides
    it (the factors its start state enters with). ``step(state, row, i)`` gives the state after a row,
    ``compose(carry, summary)`` the state after a block.
    """
    passed = [c for c in df.columns if c not in (key, order)]
    rows = F.array_sort(F.collect_list(F.struct(order, *passed)))
    blocks = (df.withColumn("_b", day_block(order, days)).repartition(key, "_b")
              .groupBy(key, "_b").agg(rows.alias("_rows")))
    counts = blocks.select(key, "_b", F.size("_rows").cast("long").alias("_n"))
    blocks = _with_carry(blocks, counts.select(key, "_b", F.coalesce(F.sum("_n").over(_earlier(key)), F.lit(0)).alias("_first")), key)

    def struct(fields: Fields, i: Column) -> Column:
        return F.struct(*(fields[n].alias(n) for n in (*carry, *local)), i.alias("_i"))

    def fold(s: Column, r: Column) -> Column:
        return struct(step(s, r, s["_i"]), s["_i"] + 1)

    summary = F.aggregate("_rows", struct({**carry, **local}, F.col("_first")), fold)
    found = blocks.select(key, "_b", summary.alias("_s")).groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("_b", "_s"))).alias("_found"))
    state = F.struct(*(c.alias(n) for n, c in carry.items()))
    kept = F.struct(state.alias("now"), F.array().cast(_starts_type(carry)).alias("starts"))

    def walk(acc: Column, x: Column) -> Column:
        after = compose(acc["now"], x["_s"])
        return F.struct(F.struct(*(after[n].alias(n) for n in carry)).alias("now"),
                        F.array_append(acc["starts"], F.struct(x["_b"].alias("_b"), acc["now"].alias("_c"))).alias("starts"))

    starts = found.select(key, F.explode(F.aggregate("_found", kept, walk)["starts"]).alias("_x")).select(key, "_x._b", "_x._c")
    blocks = _with_carry(blocks, starts, key)
    begin = F.struct(struct({**{n: F.col("_c")[n] for n in carry}, **local}, F.col("_first")).alias("s"),
                     F.array().cast("array<struct<" + ", ".join(f"`{n}`: double" for n in outputs) + ", `_i`: bigint>>").alias("out"))

    def emit(acc: Column, r: Column) -> Column:
        after = fold(acc["s"], r)
        seen = F.struct(*(after[n].alias(n) for n in outputs), acc["s"]["_i"].alias("_i"))
        return F.struct(after.alias("s"), F.array_append(acc["out"], seen).alias("out"))

    pairs = F.explode(F.arrays_zip(F.col("_rows").alias("r"), F.aggregate("_rows", begin, emit)["out"].alias("o")))
    return blocks.select(key, pairs.alias("_p")).select(key, "_p.r.*", "_p.o.*").select(*df.columns, *outputs, "_i")


def _starts_type(carry: Fields) -> str:
    fields = ", ".join(f"`{n}`: double" for n in carry)
    return f"array<struct<`_b`: bigint, `_c`: struct<{fields}>>>"
