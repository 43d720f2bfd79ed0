"""Token-ID files: independent zstandard frames, a trailing seek table, per-frame checksums.

A file is one frame per document (its ids as little-endian unsigned 32-bit integers),
followed by the public seekable-format table: a skippable frame with the compressed size,
the decompressed size and the low 32 bits of the XXH64 of the content of every frame. A
reader needs the last bytes of a file to find any document and decompresses that frame only.

Documents are range-partitioned and sorted by doc_id, so files and frames in them ascend.
Every task writes a file under a name of its own attempt; the manifest, stored in the
shared folder, names only files of tasks that finished.

Defined results: null text is empty; an empty text is its end id alone; null doc_ids come
first; rows that share a doc_id are written each, ordered by a hash of their text; an empty
table gives no file and an empty result; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import io
import json
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kestrel.llm.common import documents, local_uri, shared_path, store

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
LEVEL = 3
# Memory bound of a worker's chunk cache, emptied when full: entries and code points an entry, under 200 MB.
CACHE_CHUNKS, LONGEST_CACHED = 600_000, 64
# Fixed values of the public zstandard and seekable formats.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80
ENTRY = struct.Struct("<III")
FOOTER = struct.Struct("<IBI")
HEADER = struct.Struct("<II")


# Chunks whose pieces are plain to see: Latin letters, signs that begin no contraction, single line ends.
_WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-ɏ]+)([.,;:!?%&$#*|=+<>()\[\]\"-]*)").fullmatch
_PIECE = re.compile(r"[A-Za-zÀ-ÖØ-öø-ɏ]+|[.,;:!?%&$#*|=+<>()\[\]\"-]+|\n")
_PLAIN = re.compile(r"(?:[A-Za-zÀ-ÖØ-öø-ɏ]++|[.,;:!?%&$#*|=+<>()\[\]\"-]++|\n(?=\S))++")   # possessive: no retries


class SeekableWriter:
    """Appends frames to a binary stream; ``close`` adds the seek table."""

    def __init__(self, out, level: int = LEVEL):
        import zstandard

        self.out, self.compress = out, zstandard.ZstdCompressor(level=level, write_content_size=True).compress
        self.entries: list[bytes] = []

    def append(self, content: bytes) -> int:
        from xxhash import xxh64_intdigest

        frame = self.compress(content)
        self.out.write(frame)
        self.entries.append(ENTRY.pack(len(frame), len(content), xxh64_intdigest(content) & 0xFFFFFFFF))
        return len(self.entries) - 1

    def close(self) -> None:
        size = ENTRY.size * len(self.entries) + FOOTER.size
        self.out.write(HEADER.pack(SKIPPABLE_MAGIC, size))
        self.out.write(b"".join(self.entries))
        self.out.write(FOOTER.pack(len(self.entries), CHECKSUM_FLAG, SEEKABLE_MAGIC))


class SeekableReader:
    """Random access to the frames of a seekable file (any object with seek, tell and read)."""

    def __init__(self, file):
        import zstandard

        self.file, self.decompress = file, zstandard.ZstdDecompressor().decompress
        file.seek(0, io.SEEK_END)
        end = file.tell()
        file.seek(end - FOOTER.size)
        n, flags, magic = FOOTER.unpack(file.read(FOOTER.size))
        if magic != SEEKABLE_MAGIC or not flags & CHECKSUM_FLAG:
            raise ValueError("no seek table with checksums at the end of the file")
        table = end - FOOTER.size - n * ENTRY.size
        file.seek(table)
        self.entries = np.frombuffer(file.read(n * ENTRY.size), "<u4").reshape(-1, 3).astype(np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.entries[:, 0])])
        self.starts = np.concatenate([[0], np.cumsum(self.entries[:, 1])])
        if self.offsets[-1] != table - HEADER.size:
            raise ValueError("the seek table does not fit the file")

    def read(self, frame: int) -> bytes:
        from xxhash import xxh64_intdigest

        self.file.seek(int(self.offsets[frame]))
        content = self.decompress(self.file.read(int(self.entries[frame, 0])),
                                  max_output_size=int(self.entries[frame, 1]) or 1)
        if len(content) != self.entries[frame, 1] or xxh64_intdigest(content) & 0xFFFFFFFF != self.entries[frame, 2]:
            raise ValueError(f"frame {frame} is damaged")
        return content


class _Known(dict):
    """Ids by string, made when first asked for; those of long strings are not kept."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key: str) -> bytes:
        ids = self.make(key)
        if len(key) <= LONGEST_CACHED:
            self[key] = ids
        return ids


class _Odd(Exception):
    """A chunk that is empty or has white space at an end."""


class ChunkEncoder:
    """Whole-text ids through a cache of chunks.

    The byte-level pre-tokenizer always starts a new piece at a blank that stands between
    two non-blank characters, so a text's ids are its chunks' ids in a row. With ``special``,
    the library's default, the string of an added token is that token: a text that holds one
    goes through the library whole. Otherwise such a string is ordinary text.
    """

    def __init__(self, tokenizer_json: str, special: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        if not special:
            self.tokenizer.encode_special_tokens = True
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()] if special else []
        self.added = re.compile("|".join(added)).search if added else None
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        self.char_of = {b: chr(256 + i) for i, b in enumerate(rest)}    # the other bytes stand for themselves
        self.blank, self.tokenize = self.char_of[32], self.tokenizer.model.tokenize
        self.cache = _Known(self._after_blank)   # ids of a chunk after a blank
        self.pieces = _Known(self._model)        # ids of a piece after anything else
        self.passing: dict[tuple[str, str], bytes] = {}   # of this call: text starts, long and odd chunks
        self.split = re.compile(r"(?<=\S) (?=\S)").split

    def _library(self, chunks: list[str]) -> list[bytes]:
        done = self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in done]

    def _model(self, piece: str, lead: str = "") -> bytes:
        """Ids of what the pre-tokenizer leaves in one piece."""
        if piece.isascii() and piece.isalpha():   # these bytes stand for themselves
            name = self.blank + piece if lead else piece
        else:
            name = (lead + piece).encode().decode("latin-1").translate(self.char_of)
        return array("I", [t.id for t in self.tokenize(name)]).tobytes()

    def _ids(self, chunk: str, lead: str) -> bytes:
        """Ids of a chunk after ``lead`` (a blank or nothing)."""
        known = self.cache if lead else self.pieces
        if word := _WORD(chunk):       # most chunks are: a word and signs behind it, one piece each
            letters, signs = word.groups()
            return known[letters] + self.pieces[signs] if signs else self._model(letters, lead)
        if _PLAIN.fullmatch(chunk):    # pieces too, the first with the blank
            first, *rest = _PIECE.findall(chunk)
            return b"".join([known[first], *map(self.pieces.__getitem__, rest)]) if rest else self._model(first, lead)
        return self._library([lead + chunk])[0]

    def _once(self, chunk: str, lead: str) -> bytes:
        """Ids of a chunk, kept for this call only."""
        ids = self.passing.get((chunk, lead))
        if ids is None:
            ids = self.passing[chunk, lead] = self._ids(chunk, lead)
        return ids

    def _after_blank(self, chunk: str) -> bytes:
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            raise _Odd
        return self._ids(chunk, " ") if len(chunk) <= LONGEST_CACHED else self._once(chunk, " ")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text as little-endian unsigned 32-bit integers."""
        whole = [i for i, t in enumerate(texts) if self.added(t)] if self.added else []
        if not whole:
            return self._encode(texts)
        # The empty text stands in for them.
        rest = list(texts)
        for i in whole:
            rest[i] = ""
        out = self._encode(rest)
        for i, ids in zip(whole, self._library([texts[i] for i in whole])):
            out[i] = ids
        return out

    def _encode(self, texts: list[str]) -> list[bytes]:
        if len(self.cache) + len(self.pieces) > CACHE_CHUNKS:
            self.cache.clear()
            self.pieces.clear()
        self.passing.clear()
        out, after_blank = [], self.cache.__getitem__
        for text in texts:
            head, *rest = text.split(" ")
            try:
                if not head or head[0].isspace() or head[-1].isspace():
                    raise _Odd
                ids = [self._once(head, ""), *map(after_blank, rest)]
            except _Odd:
                # A blank beside white space is no boundary: such texts are split at safe blanks only.
                head, *rest = self.split(text)
                ids = [self._once(head, ""), *(self._once(c, " ") if c[-1].isspace() else after_blank(c) for c in rest)]
            out.append(b"".join(ids))
        return out


@lru_cache(maxsize=1)
def _encoder(tokenizer_json: str) -> ChunkEncoder:
    return ChunkEncoder(tokenizer_json, special=True)


def write_token_files(docs: DataFrame, tokenizer_json: str, path: str, end_id: int = END_ID) -> DataFrame:
    """Write one file per range partition; returns the manifest: doc_id, file_no, file, frame, n_tokens."""
    spark = docs.sparkSession
    held, uri = spark.sparkContext.broadcast(tokenizer_json), local_uri(path)
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        out = writer = None
        number = TaskContext.get().partitionId()
        name = f"tokens-{number:05d}-{uuid.uuid4().hex[:12]}.zst"
        system, folder = fs.FileSystem.from_uri(uri)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                if not b.num_rows:
                    continue
                if writer is None:
                    system.create_dir(folder, recursive=True)
                    out = system.open_output_stream(f"{folder}/{name}", compression=None)
                    writer = SeekableWriter(out)
                ids = [x + end for x in _encoder(held.value).encode([t or "" for t in b.column("text").to_pylist()])]
                frames = [writer.append(x) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), pa.array([number] * len(ids), pa.int32()),
                     pa.array([name] * len(ids)), pa.array(frames, pa.int64()),
                     pa.array([len(x) // 4 for x in ids], pa.int64())],
                    ["doc_id", "file_no", "file", "frame", "n_tokens"])
        if writer is not None:
            writer.close()
            out.close()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    ordered = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return store(ordered.mapInArrow(run, "doc_id long, file_no int, file string, frame long, n_tokens long"),
                 "token-manifest")


def read_token_files(manifest: DataFrame, path: str) -> DataFrame:
    """manifest rows plus ``ids`` (array<long>), decompressing only the frames they name."""
    return _read(manifest, path, lambda x: pa.array(x, pa.list_(pa.int64())), "ids", "array<long>")


def _read(manifest: DataFrame, path: str, column, name: str, kind: str) -> DataFrame:
    uri = local_uri(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, folder = fs.FileSystem.from_uri(uri)
        opened, reader = None, None
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                start, found = [], []
                for file, frame in zip(b.column("file").to_pylist(), b.column("frame").to_pylist()):
                    if file != opened:
                        opened = file
                        reader = SeekableReader(system.open_input_file(f"{folder}/{file}"))
                    found.append(np.frombuffer(reader.read(frame), "<u4"))
                    start.append(int(reader.starts[frame]) // 4)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), b.column("file_no"), b.column("frame"), pa.array(start, pa.int64()),
                     pa.array([len(x) for x in found], pa.int64()), column(found)],
                    ["doc_id", "file_no", "frame", "start_in_file", "n_tokens", name])

    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = manifest.select("doc_id", "file_no", "file", "frame")
    return (rows.repartitionByRange(parts, "file_no", "frame").sortWithinPartitions("file_no", "frame")
            .mapInArrow(run, f"doc_id long, file_no int, frame long, start_in_file long, n_tokens long, {name} {kind}"))


def file_starts(manifest: DataFrame) -> DataFrame:
    """file_no and the ids of all files before it (one row per file)."""
    per_file = manifest.groupBy("file_no").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    return per_file.select("file_no", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("file_start"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path(TOKENIZER), encoding="utf-8") as f:
        spec = json.dumps(json.load(f))
    path = shared_path(spark, "token-files")
    manifest = write_token_files(documents(spark, sf_dir), spec, path)
    read = _read(manifest, path, lambda x: pa.array([zlib.crc32(v.tobytes()) for v in x], pa.int64()),
                 "ids_crc32", "long")
    # One row per file: bounded by the number of partitions.
    return (read.join(F.broadcast(file_starts(manifest)), "file_no")
            .select("doc_id", (F.col("file_start") + F.col("start_in_file")).alias("start"), "n_tokens", "ids_crc32"))
