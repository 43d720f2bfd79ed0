"""Merkle manifest, conversation repair and WARC index against brute force, and their odd inputs."""

import gzip
import hashlib
import io
import itertools
import random
import zlib

import pyarrow as pa
import pytest

from kestrel.llm import conversation_repair as cr
from kestrel.llm import merkle, warc
from kestrel.llm.common import shared_path


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


# ---- Merkle -----------------------------------------------------------------------------

def tree(leaves: list[str], fanout: int) -> list[list[str]]:
    levels = [leaves]
    while len(levels[-1]) > 1:
        x = levels[-1]
        levels.append([sha("".join(x[i:i + fanout])) for i in range(0, len(x), fanout)])
    return levels


@pytest.mark.parametrize("fanout", [2, 4, 16])
def test_positions_address_every_node(fanout):
    for n in [*range(1, 70), 255, 256, 257, 600]:
        leaves = [sha(str(i)) for i in range(n)]
        builder = merkle.RunBuilder(fanout, 12)
        for x in leaves:
            builder.leaf(x)
        top = merkle.height(n, fanout)
        levels = tree(leaves, fanout)
        assert builder.root(top) == levels[-1][0] and len(levels) == top + 1
        places = []
        for level, nodes in enumerate(levels):
            for i, digest in enumerate(nodes):
                p = merkle.position(level, i, n, fanout)
                places.append(p)
                assert builder.log[32 * p:32 * p + 32].hex() == digest
        assert sorted(places) == list(range(len(builder.log) // 32))


def merkle_by_hand(rows, fanout):
    def field(x):
        return "-" if x is None else f"{len(str(x).encode())}:{x}"

    def lower(x):
        return x and "".join(c.lower() if "A" <= c <= "Z" else c for c in x)

    by_source = {}
    for doc_id, text, lang, source, n_chars in rows:
        make = lambda t: sha("".join(map(field, (doc_id, source, lang, n_chars, t))))
        hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0
        by_source.setdefault(source, []).append((doc_id is not None, doc_id or 0, make(text), make(lower(text)) if hit else None, doc_id))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: (sorted(by_source[s], key=lambda r: r[:3]),) for s in order}
    levels = {s: tree([r[2] for r in trees[s][0]], fanout) for s in order}
    top = tree([levels[s][-1][0] for s in order], fanout)
    out = []
    for k, s in enumerate(order):
        for i, (_, _, leaf, altered, doc_id) in enumerate(trees[s][0]):
            proof, folded = "", altered or leaf
            for at, stack in ((i, levels[s]), (k, top)):
                for nodes in stack[:-1]:
                    run = at - at % fanout
                    left, right = "".join(nodes[run:at]), "".join(nodes[at + 1:run + fanout])
                    proof += left + right
                    folded = sha(left + folded + right)
                    at //= fanout
            out.append((doc_id, leaf, levels[s][-1][0], top[-1][0], sha(proof), folded, folded == top[-1][0]))
    return out


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("fanout,levels,n", [(2, 1, 21), (2, 2, 70), (4, 1, 64), (16, 3, 60)])
def test_audit_equals_the_definition(spark, fanout, levels, n):
    rng = random.Random(n)
    rows = [(i, rng.choice(["Text A", "b", "Ö Z", "", None]), rng.choice(["en", None]), rng.choice(["hot", "hot", "x", "é", "Z", None]), 3)
            for i in range(n)]
    rows += [(None, "Null id", "en", "hot", None), (5, "Twice", "en", "hot", 1), (5, "Twice", "en", "hot", 1), (5, "Other", "en", "hot", 1)]
    docs = spark.createDataFrame(rows, COLUMNS).repartition(5)
    got = merkle.audit(docs.selectExpr("*", "1 AS tree", "2 AS rank"), shared_path(spark, "merkle-test"), fanout, levels).collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(merkle_by_hand(rows, fanout), key=key)


def test_full_runs_and_empty_manifest(spark):
    # Exactly one full run is a whole tree; so is a run of runs.
    for n in (1, 4, 16, 64):
        rows = [(i, "T", "en", "s", 1) for i in range(n)]
        got = merkle.audit(spark.createDataFrame(rows, COLUMNS), shared_path(spark, "merkle-test"), 4, 1).collect()
        assert sorted(map(tuple, got)) == sorted(merkle_by_hand(rows, 4))
    empty = spark.createDataFrame([], COLUMNS)
    assert merkle.audit(empty, shared_path(spark, "merkle-test")).collect() == []


# ---- conversations ------------------------------------------------------------------------

def cheapest(codes):
    """The least cheapest audit, from the end; inserts are relaxed until nothing changes."""
    value = {}
    for i in range(len(codes), -1, -1):
        row = {}
        for state in range(4):
            options = [(0, "")] if i == len(codes) and state in (cr.START, cr.ASSISTANT) else []
            if i < len(codes):
                initial, fault = codes[i]
                after = lambda s: value[i + 1, s]
                options.append((after(state)[0] + 3, "D" + after(state)[1]))
                if fault in (cr.SOUND, cr.CUT):
                    cut = fault == cr.CUT
                    options.append((after(cr.EXPECTED[state])[0] + 2 + cut, "R" + after(cr.EXPECTED[state])[1]))
                    if (state, initial) in cr.KEEP:
                        kept = after(cr.KEEP[state, initial])
                        options.append((kept[0] + cut, "K" + kept[1]))
            row[state] = min([*options, (10 ** 9, "~")])
        for _ in range(3):
            for state in range(4):
                c, a = row[cr.EXPECTED[state]]
                row[state] = min(row[state], (c + 2, "I" + a))
        value.update({(i, s): v for s, v in row.items()})
    return value[0, cr.START]


def split_walk(codes, size):
    """The operator's way: matrices, checkpoints, then block by block."""
    blocks = [codes[i:i + size] for i in range(0, len(codes), size)]
    texts = ["".join(a + b for a, b in x) for x in blocks]
    ends = dict(cr.checkpoints([(i, cr.block_matrix(t)) for i, t in enumerate(texts)]))
    state, audit = cr.START, []
    for i, t in enumerate(texts):
        edits, state = cr.walk(t, tuple(ends[i]), state)
        audit += edits
    while state in (cr.SYSTEM, cr.USER):
        audit.append("I")
        state = cr.EXPECTED[state]
    return "".join(audit)


def test_walk_is_the_least_cheapest_at_every_block_size():
    turns = [(i, f) for i in "suax" for f in (cr.BLANK, cr.REPEATED, cr.CUT, cr.SOUND)]
    rng = random.Random(1)
    cases = [list(x) for n in range(3) for x in itertools.product(turns, repeat=n)]
    cases += [[rng.choice(turns) for _ in range(rng.randint(3, 40))] for _ in range(300)]
    for codes in cases:
        want = cheapest(codes)[1]
        assert {split_walk(codes, size) for size in (1, 2, 3, 7, 64)} == {want}


def by_hand(rows):
    """The contract on undamaged rows (conv_id, turn, role, text)."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = [(t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv]
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, codes = set(), []
        for _, role, text in mine:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = cr.BLANK if not bare else cr.REPEATED if (role, text) in seen else cr.CUT if bare[-1] not in ".!?" else cr.SOUND
            seen.add((role, text))
            codes.append((role[0] if role[:1] in ("s", "u", "a") else "x", fault))
        turns = [t for t, _, _ in mine if t is not None]
        cost, audit = cheapest(codes)
        lines, state, i = [], cr.START, 0
        for e in audit:
            if e in "IR":
                state = cr.EXPECTED[state]
            if e == "I":
                lines.append(f"{cr.ROLE[state]}:")
                continue
            _, role, text = mine[i]
            if e == "K":
                state = cr.KEEP[state, codes[i][0]]
                lines.append(f"{role}:{text}")
            elif e == "R":
                lines.append(f"{cr.ROLE[state]}:{text}")
            i += 1
        count = lambda f: sum(x[1] == f for x in codes)
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, count(cr.BLANK), count(cr.REPEATED), count(cr.CUT),
                     sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(codes)), cost, audit, sha("\n".join(lines)))
    return out


ROWS = "conv_id long, turn long, role string, text string"


def test_repair_equals_the_definition(spark):
    rng = random.Random(2)
    rows = [(rng.choice([1, 2, 3, None]) if rng.random() < 0.5 else 9, rng.choice([None, *range(12)]), rng.choice(["system", "user", "assistant", "tool", "", None]),
             rng.choice(["A b.", "no end", "", " \n", "Really?", "é!", None, "x" * 3])) for _ in range(400)]
    rows += [(9, 3, "user", "Same."), (9, 3, "user", "Same."), (77, None, "user", "Alone.")]
    df = spark.createDataFrame(rows, ROWS).selectExpr("*", "1 AS rid", "'z' AS codes", "2 AS block").repartition(6)
    got = {r[0]: tuple(r)[1:] for r in cr.repair(df).collect()}
    assert got == by_hand(rows)
    turns = {}
    for r in cr.repair(df, turns=True).orderBy("position").collect():
        turns.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert {c: sha("\n".join(x)) for c, x in turns.items()} == {c: x[-1] for c, x in got.items() if x[-1] != sha("")}


def test_damage_and_gone_conversations(spark):
    rows = [(c, t, "assistant", "Fine. Yes!") for c in range(40) for t in range(2)] + [(None, None, None, None)]
    damaged = cr.damage(spark.createDataFrame(rows, ROWS))
    want = []
    for c, t, r, x in rows:
        r, x = (" " if v is None else v for v in (r, x))
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        row = (c, t, "user" if kind == 4 else r, "" if kind == 1 else x.replace(".", "").replace("!", "") if kind == 2 else x)
        want += [] if kind == 0 else [row] * (2 if kind == 3 else 1)
    key = lambda r: tuple((v is not None, v) for v in r)
    assert sorted((tuple(r) for r in damaged.filter("NOT gone").drop("gone").collect()), key=key) == sorted(want, key=key)
    got = {r.conv_id: r for r in cr.repair(damaged).collect()}
    assert set(got) == {r[0] for r in rows}
    gone = set(got) - {r[0] for r in want}
    for c in gone:
        assert tuple(got[c])[1:] == (0, 0, 0, 0, 0, 0, "", sha(""))
    assert cr.repair(damaged.limit(0)).collect() == []


# ---- WARC -----------------------------------------------------------------------------------

def test_url_keys():
    assert warc.url_key("http://WWW.Example.com:80/A?b=C#d") == "com,example,www)/A?b=C"
    assert warc.url_key("https://u:p@a.b:8443") == "b,a:8443)/"
    assert warc.url_key("http://10.0.0.1/x") == "10.0.0.1)/x"
    assert warc.url_key("a.b?q=/") == "b,a)/?q=/" and warc.url_key(None) == "-" and "\t" not in warc.url_key("http://a/\t\n")


def test_shard_blocks_and_repeated_keys():
    out = io.BytesIO()
    writer = warc.ShardWriter(out, 3)
    lines = sorted([(warc.entry_key("k%02d" % (i // 2), i // 2), b"f %d 1" % i) for i in range(40)]
                   + [(warc.entry_key("k07", 7), b"g %d 1" % i) for i in range(9)])
    for k, v in lines:
        writer.add(k, v)
    writer.close()
    reader = warc.ShardReader(pa.BufferReader(out.getvalue()))
    for key in {k for k, _ in lines}:
        assert sorted(reader.lookup(key)) == sorted(v for k, v in lines if k == key)
    assert list(reader.lookup(warc.entry_key("absent", 1))) == []


PAGES = "page_id long, url string, html string"


def test_archives_read_back(spark):
    big, odd = "é" * 600, "<p>\r\n\r\nWARC/1.1\r\n</p>" * 60
    rows = [(1, "http://a.com/1", big), (2, "http://b.com/\t", big), (3, None, big), (None, "http://a.com/1", big),
            (5, "http://a.com/1", "short"), (6, "x", "short"), (7, "http://q/", None), (8, "http://q/", ""),
            (9, "http://a.com/\r\nX: y", odd), (9, "http://a.com/2", odd), (9, "http://a.com/2", odd), (4, "http://a.com/2", odd),
            (-3, "http://neg/", "y" * 1000), (10, "http://z/", "y" * 999), (11, "http://z/", "y" * 999)]
    rows += [(100 + i, f"http://h{i % 3}.org/{i}", "hot page " * 200) for i in range(60)]
    pages = spark.createDataFrame(rows, PAGES).selectExpr("*", "1 AS digest", "2 AS key").repartition(4)
    root = shared_path(spark, "warc-test")
    captures = warc.write_archives(pages, root + "/a")
    shards = warc.write_index(captures, root + "/i", lines_per_block=4)
    found = warc.find_captures(pages.select("url", "page_id"), shards, root + "/i")
    got = warc.read_captures(found, root + "/a", payload=True).collect()
    want = []
    for page_id, _, html in rows:
        payload = (html or "").encode()
        same = [r[0] for r in rows if (r[2] or "").encode() == payload and r[0] is not None]
        revisit = len(payload) >= 1000 and page_id != max(same)
        want.append((page_id, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if revisit else "response",
                     max(same) if revisit else None, None if revisit else payload))
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(None if x is None else bytes(x) if isinstance(x, bytearray) else x for x in r) for r in got), key=key) == sorted(want, key=key)


def test_archives_are_plain_gzip_and_damage_is_found(spark):
    data = warc.record(7, "http://a/", b"<html>", hashlib.sha1(b"<html>").hexdigest(), None, "2020-01-01T00:00:00Z")
    member = zlib.compressobj(6, zlib.DEFLATED, warc.GZIP)
    packed = member.compress(data) + member.flush()
    assert gzip.decompress(packed + packed) == data + data
    assert warc.parse(data)["payload"] == b"<html>"
    with pytest.raises(ValueError):
        warc.parse(data.replace(b"<html>", b"<hTml>"))
    with pytest.raises(ValueError):
        warc.parse(data[:-1])


def test_empty_pages(spark):
    empty = spark.createDataFrame([], PAGES)
    root = shared_path(spark, "warc-test")
    shards = warc.write_index(warc.write_archives(empty, root + "/a"), root + "/i")
    assert warc.read_captures(warc.find_captures(empty, shards, root + "/i"), root + "/a").collect() == []
