"""SimHash near-dedup with pigeonring filtering.

Fingerprint: majority vote over the XXH64 (seed 42) of every 3-word shingle, 64 bits.
Fingerprints link at ``max_bits`` or fewer differing bits; a component is what links reach.

Pigeonring: the fingerprint is a ring of ``SEGMENTS`` segments. Of two fingerprints within
``max_bits``, some segment starts a chain whose first l segments differ in at most
``floor(l * max_bits / SEGMENTS)`` bits for every l. With 4 segments and 3 bits the first
segment must be equal, which is the bucket key; the budgets 1, 2, 3 of the longer chains
prune inside a bucket, the last being the full Hamming check.

Distinct fingerprints only are compared. A bucket of more than ``BLOCK`` fingerprints is
split into blocks and every pair of blocks is a group of its own, so no task holds more
than two blocks; a group emits the links of a spanning forest, never all its pairs.
Components come from alternating large-star and small-star steps on those links.

Defined results: null, empty and blank texts have fingerprint zero and link like any
other; fewer than three words are one shingle; rows with a null doc_id get the component
of their fingerprint, but only non-null ids name a component (null if there is none);
repeated rows are kept; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm.common import HOT_SHARE, documents, join_by_hot_key, store

SHINGLE, MAX_BITS, SEGMENTS, SEGMENT_BITS, SEED = 3, 3, 4, 16, 42
BLOCK = 2048
SMALL_GROUP = 24


def fingerprint_text(text: str | None, shingle: int = SHINGLE) -> int:
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    n = max(1, len(words) - shingle + 1)
    last = (ends[shingle - 1:] if len(words) >= shingle else ends[-1:]) - 1
    hashes = np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, last.tolist())),
                         dtype=">u8", count=n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 4096):
        ones += np.unpackbits(hashes[i:i + 4096].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long), one row per input row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [fingerprint_text(t, shingle) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, fp long")


def _segments(fp: np.ndarray, start: int) -> list[np.ndarray]:
    """The ring's segments from ``start`` on, as unsigned numbers."""
    u = fp.view(np.uint64)
    return [(u >> np.uint64(SEGMENT_BITS * ((start + k) % SEGMENTS))) & np.uint64((1 << SEGMENT_BITS) - 1)
            for k in range(SEGMENTS)]


def _linked(a: np.ndarray, b: np.ndarray, start: np.ndarray | int, max_bits: int) -> np.ndarray:
    """Which of the aligned pairs keep every chain from ``start`` within its budget."""
    x = a.view(np.uint64) ^ b.view(np.uint64)
    ok, total = np.ones(x.shape, bool), np.zeros(x.shape, np.int64)
    for k in range(SEGMENTS):
        shift = (SEGMENT_BITS * ((start + k) % SEGMENTS))
        part = (x >> np.asarray(shift, np.uint64)) & np.uint64((1 << SEGMENT_BITS) - 1)
        total += np.bitwise_count(part)
        ok &= total <= (k + 1) * max_bits // SEGMENTS
    return ok


def _forest(fp: np.ndarray, start: int, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(root, member) links of the components inside one large group, by breadth-first search."""
    left = np.sort(fp)
    roots, members = [], []
    while len(left):
        root, left = left[:1], left[1:]
        queue = [root[0]]
        while queue and len(left):
            near = _linked(left, np.full(len(left), queue.pop()), start, max_bits)
            if near.any():
                found, left = left[near], left[~near]
                queue.extend(found)
                members.append(found)
                roots.append(np.repeat(root, len(found)))
    none = np.empty(0, np.int64)
    return np.concatenate([none, *roots]), np.concatenate([none, *members])


def _links_in_groups(max_bits: int, limit: int):
    """Rows sorted by group (start, seg, p, q), a group never split over tasks: its links."""
    def emit(key: np.ndarray, start: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        edge = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
        size = np.diff(np.r_[edge, len(key)])
        a, b = [], []
        small = np.repeat(size <= limit, size)
        group = np.repeat(np.arange(len(edge)), size)
        g, f, s = group[small], fp[small], start[small]
        for d in range(1, limit):
            if d >= len(g):
                break
            same = np.flatnonzero(g[d:] == g[:-d])
            if not len(same):
                break
            hit = same[_linked(f[same], f[same + d], s[same], max_bits)]
            a.append(f[hit])
            b.append(f[hit + d])
        for i in np.flatnonzero(size > limit):
            r, m = _forest(fp[edge[i]:edge[i] + size[i]], int(start[edge[i]]), max_bits)
            a.append(r)
            b.append(m)
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)
                             for c in ("start", "seg", "p", "q", "fp")], axis=1)
            rows = np.concatenate([*held, rows])
            if not len(rows):
                continue
            cut = len(rows)   # the last group may go on in the next batch
            differs = np.flatnonzero((rows[:, :4] != rows[-1, :4]).any(axis=1))
            cut = int(differs[-1]) + 1 if len(differs) else 0
            if cut:
                yield from emit(rows[:cut, :4], rows[:cut, 0], np.ascontiguousarray(rows[:cut, 4]))
            held = [rows[cut:]]
        if held and len(held[0]):
            rows = held[0]
            yield from emit(rows[:, :4], rows[:, 0], np.ascontiguousarray(rows[:, 4]))
    return run


def links(fps: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK, small: int = SMALL_GROUP) -> DataFrame:
    """(u, v) links that connect whatever is within ``max_bits``; ``fps`` holds distinct ``fp``."""
    if max_bits >= SEGMENTS:
        raise ValueError("the bucket key needs an error-free first segment: max_bits < SEGMENTS")
    seg = [F.shiftrightunsigned("fp", SEGMENT_BITS * i).bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1)).cast("int")
           for i in range(SEGMENTS)]
    keyed = fps.select("fp", F.posexplode(F.array(*seg)).alias("start", "seg"))
    # At most SEGMENTS * 2**SEGMENT_BITS keys exist, however many fingerprints.
    blocks = (keyed.groupBy("start", "seg").agg(F.count("*").alias("n")).filter(F.col("n") > block)
              .select("start", "seg", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    split = keyed.join(F.broadcast(blocks), ["start", "seg"], "left")
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    pairs = F.when(F.col("blocks").isNull(), F.array(F.struct(F.lit(0).alias("p"), F.lit(0).alias("q")))).otherwise(
        F.transform(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda y: y != mine),
                    lambda y: F.struct(F.least(mine, y).alias("p"), F.greatest(mine, y).alias("q"))))
    rows = split.select("start", "seg", "fp", F.explode(pairs).alias("b")).select("start", "seg", "b.p", "b.q", "fp")
    order = ["start", "seg", "p", "q"]
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = (rows.repartition(n, *order).sortWithinPartitions(*order)
             .mapInArrow(_links_in_groups(max_bits, small), "u long, v long"))
    return found.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node with a link; root is the smallest node of its component.

    Alternating large-star and small-star steps; every round's links are written to the shared folder.
    """
    edges = store(edges, "links")
    state = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.filter(F.col("v") > F.col("u")).join(low, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(down, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(down.select("u", F.col("m").alias("v"))).filter("u != v").distinct())
        edges = store(small, "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now
    raise RuntimeError("components did not settle")


def simhash_components(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable) and root (a fingerprint that names the
    component even where doc_ids repeat) for every row of ``docs``."""
    rows = store(fingerprints(docs, shingle), "fingerprints")
    n = rows.count()
    fps = store(rows.groupBy("fp").agg(F.count("*").alias("n_rows"), F.min("doc_id").alias("low")), "distinct-fp")
    comp = components(links(fps.select("fp"), max_bits))
    nodes = comp.select("node", "root").unionByName(
        comp.select(F.col("root").alias("node"), "root").distinct())
    labelled = (fps.join(nodes, fps["fp"] == nodes["node"], "left")
                .select("fp", "n_rows", "low", F.coalesce("root", "fp").alias("root")))
    labelled = store(labelled, "labelled-fp")
    # Sums over a component combine before the shuffle; the way back joins by a salted hot root.
    name = labelled.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("n_fp"))
    n_fp = labelled.count()
    named = join_by_hot_key(labelled, name, ["root"], F.col("n_fp") * HOT_SHARE > n_fp)
    return join_by_hot_key(rows, named.select("fp", "component_id", "root", "n_rows"), ["fp"],
                           F.col("n_rows") * HOT_SHARE > n).select("doc_id", "fp", "component_id", "root")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One document of each component: the row with the smallest doc_id, then fingerprint.

    Where a doc_id is on several rows, the fingerprint tells which of them is meant; of rows equal in
    both the least (by their columns in order) stays. Rows without a doc_id cannot be named and stay.
    """
    comp = store(simhash_components(docs.filter("doc_id IS NOT NULL"), shingle, max_bits), "near-groups")
    chosen = comp.groupBy("root").agg(F.min(F.struct("doc_id", "fp")).alias("x")).select("x.doc_id", "x.fp")
    repeated = store(comp.groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated-ids")
    once = docs.join(chosen.select("doc_id").distinct(), "doc_id", "left_semi").join(repeated, "doc_id", "left_anti")
    again = docs.join(repeated, "doc_id", "left_semi")
    tied = again.withColumn("__fp", fingerprint_of(shingle)(F.col("text"))).join(
        chosen.select(F.col("doc_id").alias("__id"), F.col("fp").alias("__chosen")),
        (F.col("doc_id") == F.col("__id")) & (F.col("__fp") == F.col("__chosen")), "left_semi")
    least = tied.groupBy("doc_id", "__fp").agg(F.min(F.struct(*docs.columns)).alias("__row")).select("__row.*")
    return once.select(*docs.columns).unionByName(least).unionByName(docs.filter("doc_id IS NULL"))


def fingerprint_of(shingle: int = SHINGLE):
    """Column function: text -> fingerprint as a signed long."""
    @F.arrow_udf("long")
    def run(text: pa.Array) -> pa.Array:
        return pa.array([fingerprint_text(t, shingle) for t in text.to_pylist()], pa.int64())
    return run


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_components(documents(spark, sf_dir))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
