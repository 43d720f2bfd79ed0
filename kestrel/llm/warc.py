"""WARC archives with a two-level capture index.

Pages are written as gzip members, one record each, into archives. Of pages with one payload of at
least ``MIN_REVISIT`` bytes those with the largest page_id are responses, the others revisit records
that refer to it and hold no payload.

The index sorts captures by reversed-host URL key (``com,example,www)/path?query``), then page_id, into compressed
blocks of ``LINES_PER_BLOCK`` lines. A shard, one file a range of keys, ends with a sparse directory: the first
key of every block with its offset. The list of shards holds each shard's first key. A lookup
binary-searches the shards, then one shard's directory, reads one block and searches it, then reads
the record's bytes from its archive.

Defined results: null html is an empty payload, null url the key ``-``; a null page_id is smaller than any other; pages
that share the largest page_id of a payload are responses each; repeated rows are records each; an
empty table gives no archive and an empty result; only page_id, url and html are read.
"""

from __future__ import annotations

import base64
import datetime as dt
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from hashlib import sha1
from itertools import islice

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm.common import HOT_SHARE, local_uri, prepare, shared_path, sorted_rows, store

MIN_REVISIT = 1000
ARCHIVE_BYTES = 1 << 30
LINES_PER_BLOCK = 512
CAPTURES_A_BATCH = 4096
SEPARATOR = "\t"
GZIP = 31                    # zlib window bits for a gzip member
# Fixed value of the public WARC standard.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# ---- keys and records -----------------------------------------------------------------

def url_key(url: str | None) -> str:
    """Host labels reversed and lower-cased, port unless it is the scheme's, then path and query; no fragment."""
    if url is None:
        return "-"
    scheme, mark, rest = url.partition("://")
    if not mark:
        scheme, rest = "", url
    rest = rest.partition("#")[0]
    cut = min((i for i in (rest.find("/"), rest.find("?")) if i >= 0), default=len(rest))
    host, path = rest[:cut].rpartition("@")[2].lower(), rest[cut:]
    name, _, port = host.partition(":")
    labels = name.split(".")
    key = name if all(x.isdigit() for x in labels) else ",".join(reversed(labels))
    if port and (scheme.lower(), port) not in (("http", "80"), ("https", "443")):
        key += ":" + port
    path = path if path.startswith("/") else "/" + path
    return f"{key}){path}".replace("%", "%25").replace("\t", "%09").replace("\n", "%0A").replace("\r", "%0D")


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}:{digest}>"


def page_of(uri: str) -> int | None:
    page_id = uri.strip("<>").split(":")[2]
    return int(page_id) if page_id else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """One record: a response, or a revisit (HTTP header only) of the record ``refers_to``."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    target = "" if url is None else url.replace("\r", "%0D").replace("\n", "%0A")
    fields = [("WARC-Type", "revisit" if refers_to else "response"), ("WARC-Record-ID", record_id(page_id, digest)),
              ("WARC-Date", date), ("WARC-Target-URI", target),
              ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
              ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    if refers_to:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", refers_to)]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Fields of a record: page_id, record_type, payload_bytes, payload_digest, refers_to, payload (None for a revisit)."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines)
    block = rest[:int(fields["Content-Length"])]
    if version != "WARC/1.1" or len(block) != int(fields["Content-Length"]) or rest[len(block):] != b"\r\n\r\n":
        raise ValueError("not one whole WARC record")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != length or sha1(payload).hexdigest() != digest):
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} is damaged")
    return {"page_id": page_of(fields["WARC-Record-ID"]), "record_type": fields["WARC-Type"], "payload_bytes": length,
            "payload_digest": digest, "refers_to": page_of(fields["WARC-Refers-To"]) if revisit else None,
            "payload": None if revisit else payload}


# ---- archives ---------------------------------------------------------------------------

def _decided(pages: DataFrame, min_revisit: int) -> DataFrame:
    """page_id, url, html, digest and, for revisits, ``top``: the page_id of the response."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    seen = rows.filter(F.octet_length("html") >= min_revisit).groupBy("digest").agg(
        F.max("page_id").alias("top"), F.count("*").alias("n")).filter("n > 1")
    seen = store(seen, "warc-payloads")
    many = F.col("n") * HOT_SHARE > pages.count()       # fewer than HOT_SHARE digests
    hot = F.broadcast(seen.filter(many).select("digest", F.col("top").alias("hot_top"), F.lit(True).alias("is_hot")))
    cold = seen.filter(~many).select(F.col("digest").alias("key"), "top")
    # Rows of a hot digest need no second join; they are dealt out by page instead.
    rows = rows.join(hot, "digest", "left").withColumn("key", F.when(
        F.col("is_hot"), F.concat(F.lit("page "), F.coalesce(F.col("page_id").cast("string"), F.lit("")))).otherwise(F.col("digest")))
    rows = rows.join(cold, "key", "left")
    top = F.coalesce("hot_top", "top")
    return rows.select("page_id", "url", "html", "digest",
                       F.when(~F.col("page_id").eqNullSafe(top), top).alias("top"))


def write_archives(pages: DataFrame, path: str, min_revisit: int = MIN_REVISIT, date: str | None = None) -> DataFrame:
    """Write every page as a record; returns the captures: key, page_id, file, at, size."""
    uri = local_uri(path)
    date = date or dt.datetime.now(dt.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, folder = fs.FileSystem.from_uri(uri)
        out, name, at = None, None, 0
        for b in batches:
            found = []
            for page_id, url, html, digest, top in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "top"))):
                if out is None:
                    system.create_dir(folder, recursive=True)
                    name, at = f"pages-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex[:12]}.warc.gz", 0
                    out = system.open_output_stream(f"{folder}/{name}", compression=None)
                member = zlib.compressobj(6, zlib.DEFLATED, GZIP)
                data = record(page_id, url, html.encode(), digest, None if top is None else record_id(top, digest), date)
                data = member.compress(data) + member.flush()
                out.write(data)
                found.append((url_key(url), page_id, name, at, len(data)))
                at += len(data)
                if at >= ARCHIVE_BYTES:
                    out.close()
                    out = None
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate(types)], names)
        if out is not None:
            out.close()

    names = ["key", "page_id", "file", "at", "size"]
    types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    return store(_decided(pages, min_revisit).mapInArrow(run, "key string, page_id long, file string, at long, size long"), "warc-captures")


# ---- the index ---------------------------------------------------------------------------

def _page_text(page_id: int | None) -> str:
    """Page ids as text that sorts like them, null first."""
    return "" if page_id is None else f"{page_id + (1 << 63):020d}"


def entry_key(key: str, page_id: int | None) -> bytes:
    return f"{key}{SEPARATOR}{_page_text(page_id)}".encode()


class ShardWriter:
    """Writes sorted lines into compressed blocks, then the directory of the blocks and its length."""

    def __init__(self, out, lines_per_block: int):
        self.out, self.size = out, lines_per_block
        self.lines: list[bytes] = []
        self.directory: list[tuple[bytes, int, int]] = []
        self.at = 0

    def add(self, key: bytes, value: bytes) -> None:
        self.lines.append(key + SEPARATOR.encode() + value)
        if len(self.lines) == self.size:
            self._flush()

    def _flush(self) -> None:
        data = zlib.compress(b"\n".join(self.lines))
        first = self.lines[0].rsplit(b"\t", 1)[0]
        self.out.write(data)
        self.directory.append((first, self.at, len(data)))
        self.at += len(data)
        self.lines = []

    def close(self) -> None:
        if self.lines:
            self._flush()
        data = zlib.compress(json.dumps([(k.decode(), at, n) for k, at, n in self.directory]).encode())
        self.out.write(data)
        self.out.write(len(data).to_bytes(8, "little"))


class ShardReader:
    """Binary search in one shard: its directory, then one block at a time."""

    def __init__(self, file):
        end = file.size()
        file.seek(end - 8)
        size = int.from_bytes(file.read(8), "little")
        file.seek(end - 8 - size)
        directory = json.loads(zlib.decompress(file.read(size)))
        self.file, self.firsts, self.places = file, [k.encode() for k, _, _ in directory], [(at, n) for _, at, n in directory]
        self.block, self.lines, self.keys = None, [], []

    def _load(self, block: int) -> None:
        if block != self.block:
            at, n = self.places[block]
            self.file.seek(at)
            self.lines = zlib.decompress(self.file.read(n)).split(b"\n")
            self.keys = [x.rsplit(b"\t", 1)[0] for x in self.lines]
            self.block = block

    def lookup(self, key: bytes) -> Iterator[bytes]:
        """Values of all lines with ``key``; equal keys may go on in later blocks."""
        block = max(bisect_left(self.firsts, key) - 1, 0)     # equal keys may begin in the block before
        while block < len(self.firsts) and self.firsts[block] <= key:
            self._load(block)
            lo, hi = bisect_left(self.keys, key), bisect_right(self.keys, key)
            yield from [x.rsplit(b"\t", 1)[1] for x in self.lines[lo:hi]]
            block += 1


def write_index(captures: DataFrame, path: str, lines_per_block: int = LINES_PER_BLOCK) -> DataFrame:
    """Write the shards; returns their list: shard, first (key and page of its first line), last, lines."""
    uri = local_uri(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, folder = fs.FileSystem.from_uri(uri)
        out, writer, first, last, n = None, None, None, None, 0
        name = f"shard-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex[:12]}.idx"
        for b in batches:
            for key, page_id, file, at, size in zip(*(b.column(c).to_pylist() for c in ("key", "page_id", "file", "at", "size"))):
                if writer is None:
                    system.create_dir(folder, recursive=True)
                    out = system.open_output_stream(f"{folder}/{name}", compression=None)
                    writer, first = ShardWriter(out, lines_per_block), entry_key(key, page_id)
                last, n = entry_key(key, page_id), n + 1
                writer.add(last, f"{file} {at} {size}".encode())
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([first], pa.binary()), pa.array([last], pa.binary()),
                                              pa.array([n], pa.int64())], ["shard", "first", "last", "lines"])

    order = [F.col("key"), F.col("page_id").asc_nulls_first(), F.col("file"), F.col("at")]
    shards = sorted_rows(captures, order).mapInArrow(run, "shard string, first binary, last binary, lines long")
    return store(shards, "warc-shards")


class CaptureIndex:
    """All shards of an index, by their list; opens one shard at a time."""

    def __init__(self, shards: list[tuple[str, bytes, bytes]], uri: str):
        from pyarrow import fs

        self.shards = sorted(shards, key=lambda s: (s[1], s[2]))
        self.firsts, self.lasts = [s[1] for s in self.shards], [s[2] for s in self.shards]
        self.system, self.folder = fs.FileSystem.from_uri(uri)
        self.opened, self.reader = None, None

    def lookup(self, key: bytes) -> Iterator[tuple[str, int, int]]:
        """(file, at, size) of every capture of ``key``, an ``entry_key``."""
        for shard in range(bisect_left(self.lasts, key), bisect_right(self.firsts, key)):
            if shard != self.opened:
                self.opened = shard
                self.reader = ShardReader(self.system.open_input_file(f"{self.folder}/{self.shards[shard][0]}"))
            for x in self.reader.lookup(key):
                file, at, size = x.decode().split(" ")
                yield file, int(at), int(size)


def find_captures(queries: DataFrame, shards: DataFrame, path: str) -> DataFrame:
    """(url, page_id) rows looked up in the index: file, at, size of each capture."""
    uri = local_uri(path)
    # One row a shard: bounded by the number of partitions.
    held = [(r.shard, bytes(r.first), bytes(r.last)) for r in shards.select("shard", "first", "last").collect()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CaptureIndex(held, uri)
        asked = (q for b in batches for q in zip(b.column("key").to_pylist(), b.column("page_id").to_pylist()))
        found = (c for q in asked for c in index.lookup(entry_key(*q)))
        while some := list(islice(found, CAPTURES_A_BATCH)):
            yield pa.RecordBatch.from_arrays([pa.array([c[0] for c in some], pa.string()), pa.array([c[1] for c in some], pa.int64()),
                                              pa.array([c[2] for c in some], pa.int64())], ["file", "at", "size"])

    key = F.pandas_udf(_url_keys, "string")
    asked = queries.select(key("url").alias("key"), F.col("page_id").cast("long").alias("page_id")).distinct()
    near = asked.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id")
    return near.mapInArrow(run, "file string, at long, size long")


def _url_keys(urls):
    return urls.map(lambda u: url_key(u if isinstance(u, str) else None))


def read_captures(captures: DataFrame, path: str, payload: bool = False) -> DataFrame:
    """The records at (file, at, size): page_id, payload_bytes, payload_digest, record_type, refers_to
    and, with ``payload``, the payload (null for a revisit)."""
    uri = local_uri(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, folder = fs.FileSystem.from_uri(uri)
        opened, archive = None, None
        for b in batches:
            found = []
            for file, at, size in zip(*(b.column(c).to_pylist() for c in ("file", "at", "size"))):
                if file != opened:
                    opened, archive = file, system.open_input_file(f"{folder}/{file}")
                archive.seek(at)
                found.append(parse(zlib.decompress(archive.read(size), GZIP)))
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in found], t) for n, t in zip(names, types)], names)

    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    if payload:
        names, types, schema = [*names, "payload"], [*types, pa.binary()], schema + ", payload binary"
    return captures.repartitionByRange("file", "at").sortWithinPartitions("file", "at").mapInArrow(run, schema)


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = shared_path(spark, "warc")
    captures = write_archives(pages, f"{path}/archives")
    shards = write_index(captures, f"{path}/index")
    found = find_captures(pages.select("url", "page_id"), shards, f"{path}/index")
    return read_captures(found, f"{path}/archives")


OP11_SQL = f"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
  FROM pages),
t AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM p),
r AS (SELECT *, payload_bytes >= {MIN_REVISIT} AND page_id IS DISTINCT FROM top AS revisit FROM t)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN revisit THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN revisit THEN top END AS refers_to
FROM r
"""
