"""Vendor files as a Spark data source (S2, S3, S8): ``spark.read.format("vendor_bars").load(folder)``.

A file is CSV (also compressed) with one header row of field names (Date, Open, High, Low, Close,
Volume, in any order and case), or with two, the second naming the symbol of every column; then one
file may hold many symbols, and a line gives one row for each. Without a second header row the symbol
is the option ``symbol`` or the file's name up to its first dot. Every file is one partition, read as
a stream in batches, so memory does not grow with it.

A file with any fault (no header, a missing field, a short line, a value that is no number or date,
bytes that do not decode) gives a single row with ``file``, ``line`` and ``error`` and no bars, and the
job goes on: it is read through once before its rows are handed over. Empty values are null, a
time of day and its zone are cut off the date; an empty file and a folder without files give no bars
(the empty file an error row). Names that begin with ``_`` or ``.`` are left out.
"""

from __future__ import annotations

import csv
import datetime as dt
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from kestrel.config import ship_package

FIELDS = ("date", "open", "high", "low", "close", "volume")
SCHEMA = ("file string, symbol string, date date, open double, high double, low double, close double, "
          "volume long, line long, error string")
_ARROW = pa.schema([("file", pa.string()), ("symbol", pa.string()), ("date", pa.date32()),
                    *((c, pa.float64()) for c in ("open", "high", "low", "close")),
                    ("volume", pa.int64()), ("line", pa.int64()), ("error", pa.string())])
BATCH = 8192


class BrokenFile(ValueError):
    def __init__(self, line: int, message: str):
        super().__init__(message)
        self.line = line


class VendorFile(InputPartition):
    def __init__(self, path: str):
        self.path = path


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def _value(field: str, text: str):
    text = text.strip()
    if not text:
        return None
    if field == "date":
        return dt.date.fromisoformat(text[:10])
    if field == "volume":
        return int(text) if re.fullmatch(r"[+-]?\d+", text) else int(float(text))
    return float(text)


def _columns(names: list[str], second: list[str] | None, symbol: str) -> tuple[int, dict[str, dict[str, int]]]:
    """Position of the date, and of every other field by symbol."""
    fields = [n.strip().lower() for n in names]
    if "date" not in fields:
        raise BrokenFile(1, f"no date column in {names}")
    date, by_symbol = fields.index("date"), {}
    for i, f in enumerate(fields):
        if f in FIELDS and i != date:
            s = second[i].strip() if second and i < len(second) else symbol
            by_symbol.setdefault(s, {}).setdefault(f, i)
    for s, at in by_symbol.items() or [(symbol, {})]:
        missing = [f for f in FIELDS[1:] if f not in at]
        if missing:
            raise BrokenFile(1, f"missing columns {missing} of {s!r}")
    return date, by_symbol


def parse(lines: Iterator[list[str]], symbol: str) -> Iterator[tuple]:
    """(symbol, date, open, high, low, close, volume, line) of every bar; ``BrokenFile`` at the first fault."""
    names = next(lines, None)
    if names is None:
        raise BrokenFile(1, "empty file")
    columns, at_line = None, 1
    for at_line, cells in enumerate(lines, 2):
        if columns is None:
            # The second header row has symbols where values would be, and no date.
            fields = [n.strip().lower() for n in names]
            second = cells if "date" in fields and len(cells) == len(names) and not cells[fields.index("date")].strip() else None
            columns = _columns(names, second, symbol)
            if second:
                continue
        if not cells:
            continue
        date, by_symbol = columns
        try:
            day = _value("date", cells[date])
            for s, at in by_symbol.items():
                yield (s, day, *(_value(f, cells[at[f]]) for f in FIELDS[1:]), at_line)
        except (ValueError, IndexError, OverflowError) as e:
            raise BrokenFile(at_line, f"{type(e).__name__}: {e}") from e
    if columns is None:
        _columns(names, None, symbol)


class VendorReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.symbol = options.get("symbol")

    def partitions(self):
        files, path = _filesystem(self.path)
        info = files.get_file_info(path)
        if info.type == fs.FileType.File:
            return [VendorFile(path)]
        found = files.get_file_info(fs.FileSelector(path, recursive=True))
        at = len(path.rstrip("/")) + 1
        names = sorted(f.path for f in found if f.type == fs.FileType.File
                       and not any(part.startswith(("_", ".")) for part in f.path[at:].split("/")))
        return [VendorFile(p) for p in names] or [VendorFile("")]

    def _bars(self, path: str) -> Iterator[tuple]:
        files, _ = _filesystem(self.path)
        symbol = self.symbol or path.rsplit("/", 1)[-1].split(".", 1)[0]
        with files.open_input_stream(path) as raw:
            yield from parse(csv.reader(io.TextIOWrapper(raw, encoding="utf-8-sig", newline="")), symbol)

    def read(self, partition: VendorFile):
        path = partition.path
        if not path:
            return
        try:
            for _ in self._bars(path):
                pass
        except BrokenFile as e:
            yield self._batch([(path, *[None] * 7, e.line, str(e))])
            return
        except (OSError, UnicodeDecodeError, csv.Error, EOFError) as e:
            yield self._batch([(path, *[None] * 7, None, f"{type(e).__name__}: {e}")])
            return
        rows: list[tuple] = []
        for bar in self._bars(path):
            rows.append((path, *bar, None))
            if len(rows) == BATCH:
                yield self._batch(rows)
                rows = []
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _ARROW)], schema=_ARROW)


class VendorBars(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vendor_bars"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return VendorReader(self.options)


def read_vendor(spark: SparkSession, path: str, symbol: str | None = None) -> DataFrame:
    """All rows of the folder's files: bars, and one row with an error per broken file."""
    ship_package(spark)
    spark.dataSource.register(VendorBars)
    reader = spark.read.format("vendor_bars")
    return (reader.option("symbol", symbol) if symbol else reader).load(path)


def vendor_bars(rows: DataFrame) -> DataFrame:
    """The bars, shaped for ``ingest_bars`` (with ``symbol``) and ``ingest_index``."""
    return rows.filter(F.col("error").isNull()).select("symbol", *FIELDS)


def failed_files(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("error").isNotNull()).select("file", "line", "error")


def write_vendor_files(bars: DataFrame, path: str, broken: DataFrame | None = None) -> None:
    """One file with two header rows per symbol (columns symbol and FIELDS) in ``path``/ticker=<symbol>.

    The symbols (column ``symbol``) of ``broken`` get files whose close column has a wrong name.
    """
    line = F.concat_ws(",", F.col("date").cast("string"), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in FIELDS[1:]))
    body = bars.select(F.col("symbol").alias("ticker"), F.lit(2).alias("part"), "date", line.alias("value"))
    symbols = bars.select("symbol").distinct().withColumn("fault", F.lit(False))
    if broken is not None:
        marks = broken.select("symbol").distinct().withColumn("marked", F.lit(True))
        symbols = symbols.join(marks, "symbol", "left").select("symbol", F.coalesce("marked", F.lit(False)).alias("fault"))
    close = F.when(F.col("fault"), "Last").otherwise("Close")
    names = F.concat_ws(",", F.lit("Date,Open,High,Low"), close, F.lit("Volume"))
    quoted = F.concat(F.lit('"'), F.replace(F.col("symbol"), F.lit('"'), F.lit('""')), F.lit('"'))
    none = F.lit(None).cast("date")
    heads = [symbols.select(F.col("symbol").alias("ticker"), F.lit(0).alias("part"), none.alias("date"), names.alias("value")),
             symbols.select(F.col("symbol").alias("ticker"), F.lit(1).alias("part"), none.alias("date"),
                            F.concat(F.lit(","), F.concat_ws(",", *[quoted] * 5)).alias("value"))]
    rows = body.unionByName(heads[0]).unionByName(heads[1])
    # By a hash of its own: over bucketed bars the union counts as partitioned by ticker, which its rows are not.
    (rows.repartition(F.xxhash64("ticker")).sortWithinPartitions("ticker", "part", "date").select("ticker", "value")
     .write.partitionBy("ticker").text(path))
