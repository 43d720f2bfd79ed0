"""Conversation structure repair by a checkpointed dynamic program.

Turns are edited so that the role initials of a conversation read ``(s?(ua)+)?``: Keep costs 0,
Rerole 2, Delete 3 (the only way for a blank or repeated turn), Insert 2, and an undeleted
truncated turn 1 more. Of the cheapest edit sequences the one with the ASCII-least initials wins.

The program runs backward over four states (nothing yet, after a system turn, after a user turn,
after an assistant turn). Conversations are cut into blocks of about the square root of all rows.
Each block is condensed to the 4 x 4 matrix that takes the cost vector after it to the one before
it; the vectors at the block ends, the checkpoints, follow from a conversation's matrices. The
walk forward recomputes one block's vectors from its checkpoint at a time and emits the least
tight edit, so memory is one block and the matrices, however long a conversation is.

Defined results: null role and text are one space, null conv_id is a conversation, null turns come
first; turns with one number are ordered by role and text; a conversation without rows has zeros, an empty
audit and the digest of the empty string; an empty table gives an empty result; extra columns
are ignored. Long texts stay whole: a task holds one block of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm.common import BLANKS, HOT_SHARE, crc32_sql, join_by_hot_key, prepare, sorted_rows, store

REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
DAMAGE_KINDS = 20
START, SYSTEM, USER, ASSISTANT = range(4)
KEEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
EXPECTED = [USER, USER, ASSISTANT, USER]     # the state after an inserted or reroled turn
ROLE = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
# A turn's code is the initial of its role (x: another) followed by its fault.
BLANK, REPEATED, CUT, SOUND = "b", "r", "t", "-"
FAR = 1 << 40
END = (0, 2 * INSERT, INSERT, 0)             # costs to go after the last turn


# ---- the dynamic program ------------------------------------------------------------

@lru_cache(maxsize=1 << 16)
def _before(code: str, after: tuple[int, ...]) -> tuple[int, ...]:
    """Costs to go before a turn from the costs to go after it; the smallest ``after`` is 0."""
    initial, fault = code
    cost = [DELETE + v for v in after]
    if fault in (SOUND, CUT):
        extra = TRUNCATED if fault == CUT else 0
        for state in range(4):
            cost[state] = min(cost[state], REROLE + extra + after[EXPECTED[state]])
            if (state, initial) in KEEP:
                cost[state] = min(cost[state], extra + after[KEEP[state, initial]])
    user, assistant = min(cost[USER], INSERT + cost[ASSISTANT]), min(cost[ASSISTANT], INSERT + cost[USER])
    return min(cost[START], INSERT + user), min(cost[SYSTEM], INSERT + user), user, assistant


def step_back(code: str, after: tuple[int, ...]) -> tuple[int, ...]:
    least = min(after)
    return tuple(least + v for v in _before(code, tuple(min(v - least, FAR) for v in after)))


def block_matrix(codes: str) -> list[int]:
    """Row-major least costs from a state before the block to a state after it."""
    columns = []
    for j in range(4):
        v = tuple(0 if i == j else FAR for i in range(4))
        for at in range(len(codes) - 2, -1, -2):
            v = step_back(codes[at:at + 2], v)
        columns.append(v)
    return [min(columns[j][i], FAR) for i in range(4) for j in range(4)]


def checkpoints(blocks: list[tuple[int, list[int]]]) -> list[tuple[int, list[int]]]:
    """The cost vector after every block of a conversation, from its (block, matrix) in order."""
    v, out = END, []
    for block, m in reversed(blocks):
        out.append((block, list(v)))
        v = tuple(min(m[4 * i + j] + v[j] for j in range(4)) for i in range(4))
    return out


def walk(codes: str, end: tuple[int, ...], state: int) -> tuple[list[str], int]:
    """Least tight edits of one block from ``state``: for each turn its inserts and its edit; the state after it."""
    vectors = [end]
    for at in range(len(codes) - 2, -1, -2):
        vectors.append(step_back(codes[at:at + 2], vectors[-1]))
    vectors.reverse()
    edits = []
    for i in range(len(codes) // 2):
        (initial, fault), here, after = codes[2 * i:2 * i + 2], vectors[i], vectors[i + 1]
        extra, text = TRUNCATED if fault == CUT else 0, ""
        while True:
            if here[state] == DELETE + after[state]:
                text += "D"
                break
            if here[state] == INSERT + here[EXPECTED[state]]:
                text += "I"
                state = EXPECTED[state]
                continue
            kept = KEEP.get((state, initial))
            if kept is not None and here[state] == extra + after[kept]:
                text += "K"
                state = kept
            else:
                text += "R"
                state = EXPECTED[state]
            break
        edits.append(text)
    return edits, state


# ---- on Spark -----------------------------------------------------------------------

def _initial(role: Column) -> Column:
    first = F.left(role, F.lit(1))
    return F.when(first.isin("s", "u", "a"), first).otherwise("x")


def damage(rows: DataFrame) -> DataFrame:
    """``rows`` damaged by a hash of their conversation and turn; dropped ones stay, marked ``gone``."""
    def text_of(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.pmod(F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")), F.lit(DAMAGE_KINDS))
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text_of("text"), "[.!?]", "")).otherwise(text_of("text"))
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(text_of("role")).alias("role"),
                       text.alias("text"), (kind == 0).alias("gone"), F.explode(copies).alias("copy")).drop("copy")


def _ordered(rows: DataFrame) -> DataFrame:
    gone = F.col("gone") if "gone" in rows.columns else F.lit(False)
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), gone.alias("gone"), F.col("turn").cast("long").alias("turn"),
                       *(F.when(gone, "").otherwise(F.coalesce(F.col(c), F.lit(" "))).alias(c) for c in ("role", "text")))
    order = [F.col("conv_id").asc_nulls_first(), F.col("gone"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    bare = F.btrim("text", F.lit(BLANKS))
    fault = F.when(bare == "", BLANK).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), CUT).otherwise(SOUND)
    return store(sorted_rows(rows, order).withColumn("fault", fault)
                 .withColumn("rid", F.monotonically_increasing_id()), "turns")


def _blocks(rows: DataFrame, bits: int) -> DataFrame:
    """conv_id, block, codes of the block's turns in order, its cost vector ``ends``."""
    there = rows.filter(~F.col("gone"))
    # The digest of a text that is not blank, in its conversation and role.
    spoken = there.filter(F.col("fault") != BLANK).select("rid", F.sha2(F.concat(
        F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.length("role").cast("string"), F.lit(":"),
        "role", "text"), 256).alias("digest"))
    repeated = spoken.groupBy("digest").agg(F.count("*").alias("n"), F.min("rid").alias("first")).filter("n > 1")
    later = join_by_hot_key(spoken, repeated, ["digest"], F.col("n") * HOT_SHARE > rows.count())
    later = later.filter("rid > first").select("rid", F.lit(REPEATED).alias("again"))
    code = F.concat(_initial(F.col("role")), F.coalesce("again", "fault"))
    coded = there.select("conv_id", "rid", "role", "fault").join(later, "rid", "left").select(
        "conv_id", F.shiftright("rid", bits).alias("block"), "rid", code.alias("code"))
    in_order = F.array_sort(F.collect_list(F.struct("rid", "code")))
    blocks = coded.groupBy("conv_id", "block").agg(F.array_join(F.transform(in_order, lambda x: x["code"]), "").alias("codes"))

    @F.pandas_udf("array<long>")
    def matrix(codes: pd.Series) -> pd.Series:
        known = {c: block_matrix(c) for c in codes.unique()}
        return pd.Series([known[c] for c in codes])

    @F.pandas_udf("array<struct<block: long, ends: array<long>>>")
    def ends(found: pd.Series) -> pd.Series:
        return pd.Series([[{"block": b, "ends": v} for b, v in checkpoints([(x["block"], list(x["matrix"])) for x in blocks])]
                          for blocks in found])

    blocks = store(blocks.withColumn("matrix", matrix("codes")), "turn-blocks")
    found = blocks.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("block", "matrix"))).alias("found"))
    after = found.select("conv_id", F.explode(ends("found")).alias("x")).select("conv_id", "x.block", "x.ends")
    # Codes and vectors of a block meet in the walk, which is grouped by conversation anyway.
    return blocks.select("conv_id", "block", "codes", F.lit(None).cast("array<long>").alias("ends")).unionByName(
        after.select("conv_id", "block", F.lit(None).cast("string").alias("codes"), "ends"))


class _Conversation:
    """One conversation while its rows pass."""

    def __init__(self, conv_id, keep_turns: bool):
        self.conv_id, self.keep_turns = conv_id, keep_turns
        self.state, self.cost, self.audit, self.digest, self.lines = START, 0, [], sha256(), 0
        self.counts = {BLANK: 0, REPEATED: 0, CUT: 0, SOUND: 0}
        self.illegal, self.initial = 0, None
        self.low = self.high = None
        self.distinct = 0
        self.turns: list[tuple] = []

    def _say(self, role: str, text: str, edit: str) -> None:
        self.digest.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
        if self.keep_turns:
            self.turns.append((self.conv_id, self.lines, role, text, edit))
        self.lines += 1

    def _insert(self) -> None:
        self.state = EXPECTED[self.state]
        self.cost += INSERT
        self._say(ROLE[self.state], "", "I")

    def block(self, codes: str, end: tuple[int, ...], rows: list[tuple]) -> None:
        edits, _ = walk(codes, end, self.state)
        for i, (edit, (turn, role, text)) in enumerate(zip(edits, rows, strict=True)):
            initial, fault = codes[2 * i:2 * i + 2]
            self.counts[fault] += 1
            if self.initial is not None and self.initial + initial not in LEGAL:
                self.illegal += 1
            self.initial = initial
            if turn is not None:
                self.distinct += turn != self.high
                self.low, self.high = turn if self.low is None else self.low, turn
            for _ in edit[:-1]:
                self._insert()
            if edit[-1] == "D":
                self.cost += DELETE
            else:
                self.cost += TRUNCATED if fault == CUT else 0
                if edit[-1] == "R":
                    self.cost += REROLE
                    self.state = EXPECTED[self.state]
                    role = ROLE[self.state]
                else:
                    self.state = KEEP[self.state, initial]
                self._say(role, text, edit[-1])
            self.audit.append(edit)

    def close(self) -> tuple:
        while self.state in (SYSTEM, USER):
            self._insert()
            self.audit.append("I")
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return (self.conv_id, gaps, self.counts[BLANK], self.counts[REPEATED], self.counts[CUT], self.illegal, self.cost,
                "".join(self.audit), self.digest.hexdigest())


SUMMARY = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
           "repaired_sha256 string")
TURNS = "conv_id long, position long, role string, text string, edit string"
TURNS_A_BATCH = 4096


def _walked(batches: Iterator[pa.RecordBatch], turns: bool) -> Iterator[list[tuple]]:
    conversation, key, ends, codes, held, out = None, (), None, "", [], []

    def close_block():
        if codes:
            conversation.block(codes, tuple(ends), held)

    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in ("conv_id", "gone", "kind", "ends", "codes", "turn", "role", "text"))):
            conv_id, gone, kind, vector, code, *turn = row
            if key != (conv_id,) or kind == 0 and codes and held:
                if conversation is not None:
                    close_block()
                    codes, held = "", []
                    if turns:
                        out, conversation.turns = out + conversation.turns, []
                if key != (conv_id,):
                    if conversation is not None:
                        row = conversation.close()
                        out = out + conversation.turns if turns else [*out, row]
                    key, conversation, ends = (conv_id,), _Conversation(conv_id, turns), None
            if kind == 0:
                ends, codes = vector or ends, code or codes
            elif not gone:
                held.append(tuple(turn))
            if len(out) >= TURNS_A_BATCH:
                yield out
                out = []
    if conversation is not None:
        close_block()
        row = conversation.close()
        out = out + conversation.turns if turns else [*out, row]
    yield out


def repair(rows: DataFrame, turns: bool = False) -> DataFrame:
    """One row a conversation (``SUMMARY``), or with ``turns`` the repaired turns in order (``TURNS``).

    ``rows`` has conv_id, turn, role, text and, optionally, ``gone``: such rows only name their conversation.
    """
    rows = _ordered(rows)
    bits = (max(rows.count(), 1).bit_length() + 1) // 2     # blocks of about the square root of all rows
    heads = _blocks(rows, bits).withColumn("kind", F.lit(0)).withColumn("gone", F.lit(False))
    said = rows.select("conv_id", "gone", F.shiftright("rid", bits).alias("block"), "rid", "turn", "role", "text",
                       F.lit(1).alias("kind"))
    ddl = TURNS if turns else SUMMARY

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in _walked(batches, turns):
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)

    names = ddl.replace(",", " ").split()[::2]
    types = [pa.string() if t == "string" else pa.int64() for t in ddl.replace(",", " ").split()[1::2]]
    # A conversation's digest is sequential: its blocks pass through one task, one at a time.
    stream = heads.unionByName(said, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions(
        F.col("conv_id").asc_nulls_first(), "gone", "block", "kind", "rid")
    return stream.mapInArrow(run, ddl)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return repair(damage(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


_BLANKS_SQL = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _op13_sql() -> str:
    """The same program run forward: per conversation the least (cost, audit, text) of each state, turn by turn."""
    far = f"{{'c': {FAR}::BIGINT, 'a': '~', 't': ''}}"

    def step(x: str, cost: str, edit: str, line: str = "''") -> str:
        return f"{{'c': least({x}.c + {cost}, {FAR}), 'a': {x}.a || '{edit}', 't': {x}.t || {line}}}"

    def insert(x: str, state: int) -> str:
        return step(x, str(INSERT), "I", f"chr(10) || '{ROLE[state]}:'")

    def least(*options: str) -> str:
        return f"list_min([{', '.join(options)}])"

    cut = f"(CASE WHEN fault = '{CUT}' THEN {TRUNCATED} ELSE 0 END)"
    undeleted = f"fault IN ('{CUT}', '{SOUND}')"
    after = []
    for state in range(4):
        options = [step(f"y{state}", str(DELETE), "D")]
        for source in range(4):
            if EXPECTED[source] == state:
                options.append(f"CASE WHEN {undeleted} THEN " + step(f"y{source}", f"{REROLE} + {cut}", "R",
                               f"chr(10) || '{ROLE[state]}:' || text") + f" ELSE {far} END")
            for initial in "sua":
                if KEEP.get((source, initial)) == state:
                    options.append(f"CASE WHEN {undeleted} AND initial = '{initial}' THEN " + step(
                        f"y{source}", cut, "K", "chr(10) || role || ':' || text") + f" ELSE {far} END")
        after.append(f"{least(*options)} AS x{state}")

    def relaxed(source: str) -> str:
        user = least("x2", *(insert(f"x{s}", USER) for s in (START, SYSTEM, ASSISTANT)))
        return (f"(SELECT *, x0 AS y0, x1 AS y1, y2, {least('x3', insert('y2', ASSISTANT))} AS y3 "
                f"FROM (SELECT *, {user} AS y2 FROM {source}))")

    return f"""
WITH RECURSIVE d AS (
  SELECT conv_id, coalesce('c' || conv_id, '') AS k, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {crc32_sql("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % {DAMAGE_KINDS} AS kind
  FROM conversations),
e AS (
  SELECT k, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM d JOIN (VALUES (0), (1)) AS copies(copy) ON copy = 0 OR kind = 3 WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, text) AS i, trim(text, {_BLANKS_SQL}) AS bare FROM e),
f AS (
  SELECT *, CASE WHEN bare = '' THEN '{BLANK}' WHEN row_number() OVER (PARTITION BY k, role, text ORDER BY i) > 1 THEN '{REPEATED}'
                 WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN '{CUT}' ELSE '{SOUND}' END AS fault,
         CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'x' END AS initial
  FROM o),
p AS (SELECT *, lag(initial) OVER (PARTITION BY k ORDER BY i) || initial AS pair FROM f),
w AS (
  SELECT DISTINCT k, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 't': ''}} AS x0, {far} AS x1, {far} AS x2, {far} AS x3 FROM d
  UNION ALL
  SELECT s.k, f.i, {", ".join(after)} FROM {relaxed("w")} s JOIN f ON f.k = s.k AND f.i = s.i + 1),
b AS (SELECT k, {least("y0", "y3")} AS best FROM {relaxed("(SELECT * FROM w QUALIFY i = max(i) OVER (PARTITION BY k))")}),
g AS (
  SELECT k, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps,
         count(*) FILTER (fault = '{BLANK}') AS blank, count(*) FILTER (fault = '{REPEATED}') AS duplicate,
         count(*) FILTER (fault = '{CUT}') AS truncated,
         count(*) FILTER (pair NOT IN ({", ".join(f"'{x}'" for x in sorted(LEGAL))})) AS illegal
  FROM p GROUP BY k)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, best.c AS cost, best.a AS audit,
       sha256(substr(best.t, 2)) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, k FROM d) c JOIN b ON b.k = c.k LEFT JOIN g ON g.k = c.k
"""


OP13_SQL = _op13_sql()
