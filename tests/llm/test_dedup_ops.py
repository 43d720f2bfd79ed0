"""Exact dedup, line dedup and SimHash against brute force and SQL."""

import hashlib
import re
import sys
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from kestrel.llm import exact_dedup as X  # noqa: E402
from kestrel.llm import line_dedup as L  # noqa: E402
from kestrel.llm import queries as Q  # noqa: E402
from kestrel.llm import simhash as S  # noqa: E402
from oracle_compare import compare, duck  # noqa: E402

SF = "/root/testdata/sf0.001"
BLANK = r"[\x20\x09-\x0D]"


@pytest.mark.parametrize("key", sorted(Q.ORACLE_SQL))
def test_sql_matches(spark, key):
    r = compare(spark, SF, key, Q.QUERIES[key], Q.ORACLE_SQL[key], duck(SF))
    assert r["ok"], r


def test_exact_dedup_cases(spark, make_docs):
    rows = ["a b", "ab", " a  b ", None, "", "\t\n", "é", "É", "ab"]
    got = {r.doc_id: r for r in X.exact_dedup(make_docs(rows), batches=3).collect()}
    assert {i: r.keep_id for i, r in got.items()} == {1: 3, 2: 3, 3: 3, 9: 3, 4: 6, 5: 6, 6: 6, 7: 7, 8: 8}
    assert got[2].group_size == 4 and got[4].group_size == 3
    assert got[4].text_sha256 == hashlib.sha256(b"").hexdigest()
    assert [i for i, r in sorted(got.items()) if r.kept] == [3, 6, 7, 8]


def test_exact_dedup_repeated_rows_null_ids_and_empty(spark, make_docs):
    twice = make_docs([(5, "x"), (5, "x"), (None, "x"), (None, "q")]).withColumn("kept", F.lit("clash"))
    got = X.exact_dedup(twice).collect()
    assert len(got) == 4 and sum(r.kept for r in got) == 2
    assert [r.keep_id for r in got if r.group_size == 3] == [5, 5, 5]
    assert X.exact_dedup(make_docs([])).collect() == []


def test_digest_index_appends_only_new_digests(spark, tmp_path):
    index = X.DigestIndex(spark, str(tmp_path / "index"), 4)
    batch = lambda rows: spark.createDataFrame(rows, "digest binary, doc_id long, n_chars int, rid long")
    index.append(batch([(b"a", 1, 3, 1), (b"a", 2, 9, 2), (b"b", 3, 1, 3)]))
    first = index.append(batch([(b"a", 4, 9, 4), (b"c", 5, 1, 5)]))
    assert sorted(bytes(r.digest) for r in first.collect()) == [b"a", b"b", b"c"]
    got = {bytes(r.digest): (r.group_size, r.keep_id) for r in index.groups().collect()}
    assert got == {b"a": (3, 2), b"b": (1, 3), b"c": (1, 5)}
    plan = index.groups()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    index.drop()


def test_a_later_session_finds_the_stored_index(spark, make_docs, tmp_path):
    path = str(tmp_path / "index")
    first = {r.doc_id: r for r in X.exact_dedup(make_docs([(1, "a b"), (2, "ab"), (3, "c")]), index_path=path).collect()}
    assert {i: (r.keep_id, r.group_size, r.kept) for i, r in first.items()} == {1: (1, 2, True), 2: (1, 2, False), 3: (3, 1, True)}
    later = spark.newSession()
    assert not [t for t in later.catalog.listTables() if t.name.startswith("digest_index_")]
    docs = later.createDataFrame([(7, "a  b longer no"), (8, "a   b"), (9, "d"), (10, "d "), (8, "c")], "doc_id long, text string")
    got = sorted(X.exact_dedup(docs, index_path=path).collect())
    # The longer copy of an earlier text does not displace what the first run kept.
    assert [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got] == [
        (7, 7, 1, True), (8, 1, 3, False), (8, 3, 2, False), (9, 10, 2, False), (10, 10, 2, True)]
    again = X.exact_dedup(make_docs([(11, "d")]), index_path=path).collect()
    assert [(r.keep_id, r.group_size, r.kept) for r in again] == [(10, 3, False)]
    index = X.DigestIndex(later, path, 999)
    assert index.buckets == 12 and index.run == 3 and index.groups().count() == 4
    assert "Exchange" not in index.groups()._jdf.queryExecution().executedPlan().toString()
    index.drop()


def brute_lines(docs, min_chars=40, min_docs=5):
    holders = defaultdict(set)
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in re.sub(f"^{BLANK}+|{BLANK}+$", "", x))
    for i, t in docs:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars:
                holders[key(x)].add(i)
    out = {}
    for i, t in docs:
        xs = (t or "").split("\n")
        kept = [x for x in xs if len(holders.get(key(x), ())) < min_docs or i == max(holders[key(x)])]
        out[i] = (len(xs), len(xs) - len(kept), "\n".join(kept))
    return out


def test_line_dedup_cases(spark, make_docs):
    common, other = "This line is long enough to count as boilerplate, É.", "x" * 40
    docs = [(i, "\n".join([f"own {i}", ("  " + common.upper().replace("É", "É") + "\t") if i % 2 else common, "tail\r"]))
            for i in range(1, 8)]
    docs += [(20 + i, f"{other}\n{other}\nend") for i in range(4)] + [(30, None), (31, ""), (32, "\n\n")]
    docs += [(40, f"{common}\n{common}")]
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text)
           for r in L.line_dedup(make_docs(docs).withColumn("n_lines", F.lit("clash"))).collect()}
    assert got == brute_lines(docs)
    assert got[40][1] == 0 and got[1][1] == 1 and got[20][1] == 0


@pytest.mark.parametrize("batches", [1, 3, 6])
def test_line_dedup_does_not_depend_on_batches(spark, make_docs, batches):
    rng = np.random.default_rng(1)
    pool = ["line %02d " % i + "abc" * 15 for i in range(12)]
    docs = [(int(i), "\n".join(rng.choice(pool, 3))) for i in rng.permutation(60)]
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in L.line_dedup(make_docs(docs), batches=batches).collect()}
    assert got == brute_lines(docs)


def test_line_dedup_null_ids_and_empty(spark, make_docs):
    line = "y" * 50
    got = L.line_dedup(make_docs([(None, line), (None, line), (1, line), (2, line), (2, line), (3, "z")]), counts=False)
    assert sorted((str(r.doc_id), r.text) for r in got.collect()) == [
        ("1", ""), ("2", line), ("2", line), ("3", "z"), ("None", ""), ("None", "")]
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert L.line_dedup(make_docs([])).collect() == []


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(ids, fps, bits=3):
    low = dict(zip(ids, ids))
    changed = True
    while changed:
        changed = False
        for i, a in zip(ids, fps):
            for j, b in zip(ids, fps):
                if bin(a ^ b).count("1") <= bits and low[j] < low[i]:
                    low[i], changed = low[j], True
    return low


def test_fingerprints_match_brute_force():
    for t in (None, "", " \n", "one", "One two", "A b c d A b c", "é É x y z " * 30, "w " * 500):
        assert S.fingerprint_text(t) & (1 << 64) - 1 == brute_fingerprint(t), t


def test_simhash_components_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    fps = {i: brute_fingerprint(t) for i, t in rows.items()}
    want = brute_components(list(fps), list(fps.values()))
    got = Q.QUERIES["op8_simhash"](spark, SF).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{fps[i]:016x}", want[i]) for i in fps}


@pytest.mark.parametrize("block,small", [(40, 6), (100000, 24), (100000, 2)])
def test_links_connect_like_all_pairs(spark, block, small):
    """Random flips around few centres, with blocks and groups small enough to take every path."""
    rng = np.random.default_rng(5)
    fps = set()
    for centre in rng.integers(0, 1 << 63, 4, dtype=np.int64).tolist():
        for _ in range(120):
            x = centre
            for b in rng.integers(0, 63, rng.integers(0, 7)):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps)
    edges = S.links(spark.createDataFrame([(x,) for x in fps], "fp long"), block=block, small=small)
    assert edges.filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) > 20).count() == 0
    got = {r.node: r.root for r in S.components(edges).collect()}
    assert {x: got.get(x, x) for x in fps} == brute_components(fps, fps)


def test_near_duplicates_keep_one(spark, make_docs):
    base = " ".join(f"word{i}" for i in range(400))
    docs = [(7, base), (3, base + " more"), (9, "entirely different text about nothing at all"), (9, "x"), (None, "lone"),
            (12, None), (11, "")]
    kept = sorted(str(r.doc_id) for r in S.keep_one(make_docs(docs)).collect())
    assert kept.count("None") == 1 and "11" in kept and "12" not in kept and "3" in kept and "7" not in kept
    assert S.keep_one(make_docs([])).collect() == []
    assert S.simhash_components(make_docs([])).collect() == []


def test_keep_one_where_doc_ids_repeat(spark, make_docs):
    a, b = " ".join(f"alpha{i}" for i in range(60)), " ".join(f"beta{i}" for i in range(60))
    rows = [(7, a), (7, b), (7, a), (8, b), (3, " ".join(f"gamma{i}" for i in range(60)))]
    got = sorted((r.doc_id, r.text) for r in S.keep_one(make_docs(rows).repartition(3)).collect())
    assert got == sorted([(7, a), (7, b), rows[-1]])
