"""Merkle dataset manifest: 16-ary trees over the rows of each source, kept as postorder append logs.

Builders are aligned: each takes a run of ``FANOUT ** LEVELS`` consecutive leaves of one tree,
appends every node to its log the moment it completes (leaf, then each parent it closes) and
returns the run's root. The roots are the leaves of the next tier, until a tree has one node.
The subroots of the sources are the leaves of one more tree, whose root names the dataset.

A node's place in a log follows from the sizes of the subtrees before it (``position``), so a
proof reads the sibling digests out of the logs without an index. Paths are extracted from the
top tier down: a run's path is read once and shared by its leaves.

Defined results: null columns are ``-`` in a leaf; null source is a source of its own and comes
first; rows of a source ascend by doc_id (null first), then by leaf digest, so repeated rows are
leaves each; a null doc_id is never tampered with; an empty table gives an empty result; columns
other than the five of ``LEAF_COLUMNS`` are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from kestrel.llm.common import crc32_sql, documents, local_uri, lower_ascii, shared_path, sorted_rows, store

LEAF_COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
FANOUT, LEVELS = 16, 3
TAMPER_EVERY = 5
DIGEST = 32


def node_digest(children: list[str]) -> str:
    return sha256("".join(children).encode()).hexdigest()


def leaf_digest(columns: list[Column]) -> Column:
    """SHA-256 of the columns in a row, each with its UTF-8 length; ``-`` for null."""
    texts = [c.cast("string") for c in columns]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts), 256)


# ---- the log of one run -------------------------------------------------------------

def _complete(leaves: int, fanout: int) -> int:
    """Nodes that are complete once ``leaves`` leaves are appended."""
    n = leaves
    while leaves:
        leaves //= fanout
        n += leaves
    return n


def position(level: int, index: int, leaves: int, fanout: int = FANOUT) -> int:
    """Place of node ``index`` of ``level`` in the postorder log of a run of ``leaves`` leaves."""
    end = (index + 1) * fanout ** level
    if end <= leaves:   # closed by its last leaf, after the lower nodes that this leaf closes
        return _complete(end - 1, fanout) + level
    short = 0           # closed at the end of the run, after the short nodes below it
    while leaves % fanout ** short == 0:
        short += 1
    return _complete(leaves, fanout) + level - short


def height(leaves: int, fanout: int = FANOUT) -> int:
    """Levels above the leaves of a whole tree."""
    h = 0
    while fanout ** h < leaves:
        h += 1
    return h


class RunBuilder:
    """Appends the nodes of one run to ``log`` in completion order."""

    def __init__(self, fanout: int, levels: int):
        self.fanout, self.levels = fanout, levels
        self.open: list[list[str]] = [[] for _ in range(levels + 1)]
        self.log = bytearray()
        self.leaves = 0

    def leaf(self, digest: str) -> None:
        self.leaves += 1
        self._append(digest, 0)

    def _append(self, digest: str, level: int) -> None:
        self.log += bytes.fromhex(digest)
        waiting = self.open[level]
        waiting.append(digest)
        if level < self.levels and len(waiting) == self.fanout:
            self.open[level] = []
            self._append(node_digest(waiting), level + 1)

    def root(self, levels: int) -> str:
        """Close the short nodes up to ``levels``; the run's root."""
        for level in range(levels):
            if self.open[level]:
                waiting, self.open[level] = self.open[level], []
                self._append(node_digest(waiting), level + 1)
        return self.open[levels][0]


# ---- building -----------------------------------------------------------------------

def _numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` (with ``tree``) sorted by tree and ``order``, with ``rank`` in the tree.

    A task numbers the rows of each tree it holds. Only the first tree of a task may have begun
    in tasks before: the rows before it are one number a task, broadcast.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, tree, n, first = TaskContext.get().partitionId(), (), 0, None
        for b in batches:
            ranks, firsts = [], []
            for t in b.column("tree").to_pylist():
                if tree != (t,):
                    tree, n, first = (t,), 0, first is None
                ranks.append(n)
                firsts.append(first)
                n += 1
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([task] * len(ranks), pa.int32()), pa.array(firsts, pa.bool_()), pa.array(ranks, pa.int64())],
                [*b.schema.names, "task", "first", "rank"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", task int, first boolean, rank long"
    ordered = sorted_rows(rows, [F.col("tree").asc_nulls_first(), *order])
    out = store(ordered.mapInArrow(run, schema), name)
    earlier = Window.partitionBy("tree").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = (out.groupBy("tree", "task").agg(F.count("*").alias("n"))
              .select("task", F.sum("n").over(earlier).alias("before")).filter("before > 0"))
    # At most one row a task.
    return (out.join(F.broadcast(before.withColumn("first", F.lit(True))), ["task", "first"], "left")
            .withColumn("rank", F.col("rank") + F.coalesce("before", F.lit(0))).drop("task", "first", "before"))


def _by_run(df: DataFrame, *last: str) -> DataFrame:
    return df.repartition("tree", "chunk").sortWithinPartitions("tree", "chunk", *last)


def _build_runs(nodes: DataFrame, path: str, fanout: int, levels: int) -> DataFrame:
    """Write the logs of ``nodes`` (tree, rank, digest); one row a run: tree, chunk, leaves, file, at, digest."""
    uri = local_uri(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, folder = fs.FileSystem.from_uri(uri)
        name = f"log-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex[:12]}"
        out, at, key, builder = None, 0, None, None

        def close():
            nonlocal out, at
            if out is None:
                system.create_dir(folder, recursive=True)
                out = system.open_output_stream(f"{folder}/{name}", compression=None)
            # A short first run is a whole tree: it ends where one node remains.
            root = builder.root(levels if key[1] else height(builder.leaves, fanout))
            out.write(bytes(builder.log))
            done.append((*key, builder.leaves, name, at, root))
            at += len(builder.log)

        def rows():
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate(schema.types)], names=schema.names)

        done = []
        for b in batches:
            done = []
            for k, digest in zip(zip(b.column("tree").to_pylist(), b.column("chunk").to_pylist()), b.column("digest").to_pylist()):
                if k != key:
                    if key is not None:
                        close()
                    key, builder = k, RunBuilder(fanout, levels)
                builder.leaf(digest)
            yield rows()
        if key is not None:
            done = []
            close()
            yield rows()
            out.close()

    ddl = "tree string, chunk long, leaves long, file string, at long, digest string"
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    keyed = nodes.select("tree", F.shiftright("rank", _shift(fanout, levels)).alias("chunk"), "rank", "digest")
    return store(_by_run(keyed, "rank").mapInArrow(run, ddl), "merkle-runs")


def _shift(fanout: int, levels: int) -> int:
    bits = fanout.bit_length() - 1
    if fanout != 1 << bits:
        raise ValueError("the fan-out must be a power of two")
    return bits * levels


def build_trees(nodes: DataFrame, path: str, fanout: int = FANOUT, levels: int = LEVELS) -> tuple[list[DataFrame], DataFrame]:
    """Tiers of runs over ``nodes`` (tree, rank, digest), lowest first, and the run that holds each tree's root (with its tier)."""
    tiers, tops, size = [], None, fanout ** levels
    while True:
        runs = _build_runs(nodes, f"{path}/tier{len(tiers)}", fanout, levels)
        later = runs.filter("chunk = 1").select(F.col("tree").alias("t"))
        single = runs.filter("chunk = 0").join(later, F.col("tree").eqNullSafe(F.col("t")), "left_anti")
        top = single.withColumn("tier", F.lit(len(tiers)))
        tops = top if tops is None else tops.unionByName(top)
        tiers.append(runs)
        # A full first run may be a whole tree too; a shorter one always is.
        whole = single.filter(F.col("leaves") == size).select(F.col("tree").alias("t"))
        rest = runs.filter((F.col("chunk") > 0) | (F.col("leaves") == size))
        rest = rest.join(whole, (F.col("chunk") == 0) & F.col("tree").eqNullSafe(F.col("t")), "left_anti")
        if rest.isEmpty():
            return tiers, tops
        nodes = rest.select("tree", F.col("chunk").alias("rank"), "digest")


# ---- proofs -------------------------------------------------------------------------

def _steps(read, rank: int, leaves: int, top: int, fanout: int) -> list[tuple[str, str]]:
    """Siblings left and right of leaf ``rank``'s node on every level below ``top``; ``read(position)`` gives a digest."""
    out = []
    for level in range(top):
        index, span = rank // fanout ** level, fanout ** level
        first = index - index % fanout
        end = min(first + fanout, -(-leaves // span))
        out.append(("".join(read(position(level, i, leaves, fanout)) for i in range(first, index)),
                    "".join(read(position(level, i, leaves, fanout)) for i in range(index + 1, end))))
    return out


def pack_path(steps: list[tuple[str, str]]) -> str:
    return "".join(f"{left}:{right}\n" for left, right in steps)


def unpack_path(path: str) -> list[tuple[str, str]]:
    return [tuple(x.split(":")) for x in path.splitlines()]


def proof_digest(steps: list[tuple[str, str]]) -> str:
    return sha256("".join(left + right for left, right in steps).encode()).hexdigest()


def fold(leaf: str, steps: list[tuple[str, str]]) -> str:
    """The root that follows from a leaf and its siblings."""
    for left, right in steps:
        leaf = sha256(f"{left}{leaf}{right}".encode()).hexdigest()
    return leaf


def _extract(nodes: DataFrame, runs: DataFrame, path: str, fanout: int, levels: int, finish, schema: str) -> DataFrame:
    """``finish(node row, its path's steps, its run's row)`` for all ``nodes`` (tree, rank, ...).

    ``runs`` holds the nodes' runs with ``path`` (upwards of the run) and ``subroot``. Runs and nodes
    share one shuffle; a run's row comes before its nodes, so one run is in memory at a time.
    """
    uri, size = local_uri(path), fanout ** levels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, folder = fs.FileSystem.from_uri(uri)
        opened, file, head, digest, above, top = None, None, None, None, [], 0
        for b in batches:
            out = []
            for row in b.to_pylist():
                if row["kind"] == 0:
                    head = row
                    if head["file"] != opened:
                        opened, file = head["file"], system.open_input_file(f"{folder}/{head['file']}")
                    file.seek(head["at"])
                    top = height(head["leaves"], fanout) if head["top"] else levels
                    log = file.read(DIGEST * (position(top, 0, head["leaves"], fanout) + 1))
                    digest = lambda p, log=log: log[DIGEST * p:DIGEST * p + DIGEST].hex()
                    above = unpack_path(head["path"])
                    continue
                steps = _steps(digest, row["rank"] % size, head["leaves"], top, fanout) + above
                out.append(finish(row, steps, head))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(out_schema.types)],
                                              names=out_schema.names)

    out_schema = to_arrow_schema(StructType.fromDDL(schema))
    heads = runs.select("tree", "chunk", F.lit(0).alias("kind"), "leaves", "file", "at", "path", "subroot", "top")
    keyed = nodes.withColumn("chunk", F.shiftright("rank", _shift(fanout, levels))).withColumn("kind", F.lit(1))
    return _by_run(heads.unionByName(keyed, allowMissingColumns=True), "kind", "rank").mapInArrow(run, schema)


_RUN_SCHEMA = "tree string, chunk long, leaves long, file string, at long, digest string, path string, subroot string"


def _run_with_path(row, steps, head):
    return (row["tree"], row["rank"], row["leaves_"], row["file_"], row["at_"], row["digest"], pack_path(steps), head["subroot"])


def _lowest_with_paths(tiers: list[DataFrame], tops: DataFrame, path: str, fanout: int, levels: int) -> DataFrame:
    """The runs of the lowest tier with their ``path``; ``tops`` has the path of each tree's root."""
    below = None
    for tier in range(len(tiers) - 1, -1, -1):
        runs = tops.filter(F.col("tier") == tier).withColumn("top", F.lit(True))
        runs = runs.select(*_RUN_SCHEMA.replace(",", " ").split()[::2], "top")
        if below is not None:
            runs = runs.unionByName(below.withColumn("top", F.lit(False)))
        if tier == 0:
            return runs
        whole = tops.filter(F.col("tier") == tier - 1).select(F.col("tree").alias("t"))
        lower = tiers[tier - 1].join(whole, F.col("tree").eqNullSafe(F.col("t")), "left_anti")
        nodes = lower.select("tree", F.col("chunk").alias("rank"), F.col("leaves").alias("leaves_"),
                             F.col("file").alias("file_"), F.col("at").alias("at_"), "digest")
        below = store(_extract(nodes, runs, f"{path}/tier{tier}", fanout, levels, _run_with_path, _RUN_SCHEMA), "merkle-paths")


class Manifest:
    """The trees of ``docs`` and their logs below ``path``; ``root`` is None for an empty table."""

    def __init__(self, docs: DataFrame, path: str, fanout: int = FANOUT, levels: int = LEVELS, altered: Column | None = None):
        self.path, self.fanout, self.levels = path, fanout, levels
        columns = [F.col(c) for c in LEAF_COLUMNS]
        rows = docs.select(F.col("source").cast("string").alias("tree"), F.col("doc_id").cast("long").alias("doc_id"),
                           leaf_digest(columns).alias("digest"), (F.lit(None).cast("string") if altered is None else altered).alias("altered"))
        self.leaves = _numbered(rows, [F.col("doc_id").asc_nulls_first(), F.col("digest")], "merkle-leaves")
        self.tiers, self.tops = build_trees(self.leaves, f"{path}/sources", fanout, levels)
        self.tops = store(self.tops, "merkle-subroots")
        tops = self.tops.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "chunk", F.col("leaves").alias("leaves_"),
                                F.col("file").alias("file_"), F.col("at").alias("at_"), "digest", "tier")
        self.subroots = _numbered(tops, [F.col("name").asc_nulls_first()], "merkle-sources")
        self.root_tiers, self.root_top = build_trees(self.subroots, f"{path}/root", fanout, levels)
        first = self.root_top.first()
        self.root = None if first is None else first["digest"]

    def proofs(self, finish, schema: str) -> DataFrame:
        """``finish(leaf row, its siblings up to the dataset's root, its run's row)`` for every leaf."""
        top = self.root_top.withColumn("path", F.lit("")).withColumn("subroot", F.lit(""))
        runs = _lowest_with_paths(self.root_tiers, top, f"{self.path}/root", self.fanout, self.levels)

        def source_top(row, steps, head):
            return (row["name"], 0, row["leaves_"], row["file_"], row["at_"], row["digest"], pack_path(steps), row["digest"], row["tier"])

        tops = store(_extract(self.subroots, runs, f"{self.path}/root/tier0", self.fanout, self.levels, source_top, _RUN_SCHEMA + ", tier long"),
                     "merkle-source-paths")
        runs = _lowest_with_paths(self.tiers, tops, f"{self.path}/sources", self.fanout, self.levels)
        return _extract(self.leaves, runs, f"{self.path}/sources/tier0", self.fanout, self.levels, finish, schema)


def tampered_leaf(every: int = TAMPER_EVERY) -> Column:
    """The leaf with its text in lower case where ``every`` divides the CRC of doc_id; else null."""
    columns = [lower_ascii(F.col(c)) if c == "text" else F.col(c) for c in LEAF_COLUMNS]
    hit = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(every)) == 0
    return F.when(hit, leaf_digest(columns))


def audit(docs: DataFrame, path: str, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """Each row's leaf, subroot, root, proof and the root that follows from its (tampered) leaf."""
    manifest = Manifest(docs, path, fanout, levels, tampered_leaf())
    root = manifest.root

    def finish(row, steps, head):
        folded = fold(row["altered"] or row["digest"], steps)
        return (row["doc_id"], row["digest"], head["subroot"], root, proof_digest(steps), folded, folded == root)

    return manifest.proofs(finish, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, "
                                   "folded_root string, verified boolean")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir), shared_path(spark, "merkle"))


def _tree_sql(name: str, leaves: str, levels: int) -> str:
    """Level tables ``name0..`` over ``leaves`` (tree, i, d): siblings ``l``, ``r`` and the level's size ``n``."""
    out = []
    for h in range(levels + 1):
        source = leaves if h == 0 else f"""(SELECT tree, i // {FANOUT} AS i, CASE WHEN any_value(n) = 1 THEN any_value(d)
              ELSE sha256(string_agg(d, '' ORDER BY i)) END AS d FROM {name}{h - 1} GROUP BY tree, i // {FANOUT})"""
        run = f"PARTITION BY tree, i // {FANOUT} ORDER BY i ROWS BETWEEN"
        out.append(f"""{name}{h} AS (SELECT *, count(*) OVER (PARTITION BY tree) AS n,
  coalesce(string_agg(d, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
  coalesce(string_agg(d, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {source})""")
    return ",\n".join(out)


def _op12_sql(levels: int = 5, source_levels: int = 3) -> str:
    def leaf(text: str) -> str:
        parts = [text if c == "text" else f"CAST({c} AS VARCHAR)" for c in LEAF_COLUMNS]
        return "sha256(" + " || ".join(f"coalesce(octet_length(encode({p}))::VARCHAR || ':' || {p}, '-')" for p in parts) + ")"

    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    hit = f"{crc32_sql('CAST(doc_id AS VARCHAR)')} % {TAMPER_EVERY} = 0"
    joins, proof = [], []
    for name, last in (("a", levels), ("b", source_levels)):
        for h in range(last + 1):
            key, i = ("t.tree", "t.i") if name == "a" else ("''", "s.i")
            joins.append(f"JOIN {name}{h} ON {name}{h}.tree = {key} AND {name}{h}.i = {i} // {FANOUT ** h}")
            proof.append(f"{name}{h}.l || {name}{h}.r")
    steps = [f"{n}{h}" for n, last in (("a", levels), ("b", source_levels)) for h in range(last + 1)]
    folds, previous = [], "p"
    for k, x in enumerate(steps):
        folds.append(f"f{k} AS (SELECT * REPLACE (CASE WHEN {x}_n > 1 THEN sha256({x}_l || folded || {x}_r) ELSE folded END AS folded) FROM {previous})")
        previous = f"f{k}"
    columns = ", ".join(f"{x}.n AS {x}_n, {x}.l AS {x}_l, {x}.r AS {x}_r" for x in steps)
    return f"""
WITH d AS (
  SELECT doc_id, coalesce('s' || source, '') AS tree, {leaf("text")} AS d,
         CASE WHEN {hit} THEN {leaf(lower)} END AS altered FROM documents),
t AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, d) - 1 AS i FROM d),
{_tree_sql("a", "(SELECT tree, i, d FROM t)", levels)},
s AS (SELECT tree AS source, d, row_number() OVER (ORDER BY tree) - 1 AS i FROM a{levels}),
{_tree_sql("b", "(SELECT '' AS tree, i, d FROM s)", source_levels)},
p AS (SELECT t.doc_id, t.d AS leaf, s.d AS subroot, (SELECT d FROM b{source_levels}) AS root,
             sha256({" || ".join(proof)}) AS proof_sha256, coalesce(t.altered, t.d) AS folded, {columns}
      FROM t JOIN s ON s.source = t.tree {" ".join(joins)}),
{", ".join(folds)}
SELECT doc_id, leaf, subroot, root, proof_sha256, folded AS folded_root, folded = root AS verified FROM {previous}
"""


# Enough levels for 16 ** 5 rows a source and 16 ** 3 sources.
OP12_SQL = _op12_sql()
