"""Vendor files through the Python data source."""

import datetime as dt
import gzip

from helpers import bars, series_dates
from kestrel.sources import ingest, vendor


def write(tmp_path, **files):
    folder = tmp_path / "files"
    for name, text in files.items():
        p = folder / name.replace("__", ".")
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(folder)


TWO = "Date,Close,Open,High,Low,Volume\n,^IDX,^IDX,^IDX,^IDX,^IDX\n2020-01-02 00:00:00+05:30,1.5,1,2,0.5,100\n2020-01-03,,1,2,0.5,1e3\n"
ONE = "date,OPEN,high,low,close,volume,extra\n2020-01-02,1,2,0.5,1.25,7,x\n"
MANY = "Date,Open,High,Low,Close,Volume,Open,High,Low,Close,Volume\n,A,A,A,A,A,B,B,B,B,B\n2021-02-03,1,2,3,4,5,6,7,8,9,10\n"


def test_headers_types_and_partitions(spark, tmp_path):
    path = write(tmp_path, idx__csv=TWO, TCK__csv=ONE, both__csv=MANY, _skip__csv="junk", zip__csv__gz=gzip.compress(ONE.encode()))
    rows = vendor.read_vendor(spark, path)
    assert rows.rdd.getNumPartitions() == 4
    assert vendor.failed_files(rows).collect() == []
    got = sorted(tuple(r) for r in vendor.vendor_bars(rows).collect() if r.close is not None)
    day = dt.date(2020, 1, 2)
    assert got == [("A", dt.date(2021, 2, 3), 1, 2, 3, 4, 5), ("B", dt.date(2021, 2, 3), 6, 7, 8, 9, 10),
                   ("TCK", day, 1, 2, 0.5, 1.25, 7), ("^IDX", day, 1, 2, 0.5, 1.5, 100), ("zip", day, 1, 2, 0.5, 1.25, 7)]
    null = vendor.vendor_bars(rows).filter("close IS NULL").collect()
    assert [(r.symbol, r.date, r.volume) for r in null] == [("^IDX", dt.date(2020, 1, 3), 1000)]
    # The ingest rules apply: a bar without a close is dropped, the index rows have no symbol.
    assert ingest.ingest_bars(vendor.vendor_bars(rows)).count() == 5
    index = vendor.vendor_bars(vendor.read_vendor(spark, path + "/idx.csv"))
    assert [r.close for r in ingest.ingest_index(index, day, dt.date(2020, 2, 1)).collect()] == [1.5]


def test_broken_files_are_reported_and_do_not_end_the_job(spark, tmp_path):
    good = "Date,Open,High,Low,Close,Volume\n" + "2020-01-02,1,2,0.5,1.25,7\n" * 20000
    path = write(tmp_path, good__csv=good, late__csv=good + "2020-01-03,x,2,0.5,1.25,7\n", short__csv=good + "2020-01-03,1\n",
                 day__csv=good + "2020-13-03,1,2,3,4,5\n", names__csv="Date,Open\n2020-01-02,1\n", nodate__csv="a,b\n1,2\n",
                 empty__csv="", bytes__csv=b"Date,Open,High,Low,Close,Volume\n\xff\xfe,1,2,3,4,5\n",
                 cut__csv__gz=gzip.compress(good.encode())[:-40], head__csv="Date,Open,High,Low,Close,Volume\n",
                 inf__csv="Date,Open,High,Low,Close,Volume\n2020-01-02,1,2,3,4,inf\n")
    rows = vendor.read_vendor(spark, path)
    failed = {r.file.rsplit("/", 1)[-1]: (r.line, r.error) for r in vendor.failed_files(rows).collect()}
    assert set(failed) == {"late.csv", "short.csv", "day.csv", "names.csv", "nodate.csv", "empty.csv", "bytes.csv", "cut.csv.gz", "inf.csv"}
    assert failed["late.csv"][0] == 20002 and "missing columns" in failed["names.csv"][1]
    assert {(r.symbol, r["count"]) for r in vendor.vendor_bars(rows).groupBy("symbol").count().collect()} == {("good", 20000)}


def test_an_empty_folder(spark, tmp_path):
    (tmp_path / "none").mkdir()
    rows = vendor.read_vendor(spark, str(tmp_path / "none"))
    assert rows.collect() == [] and rows.columns[0] == "file"


def test_files_written_from_a_bucketed_table(spark, tmp_path):
    rows = [(t, day, 1.0 + i) for i, day in enumerate(series_dates(30)) for t in ("A", "B", "C", "D", "E")]
    table = "vendor_bucketed"
    bars(spark, rows).write.bucketBy(8, "ticker").sortBy("ticker").option("path", str(tmp_path / "bars")).saveAsTable(table)
    raw = spark.table(table).withColumnRenamed("ticker", "symbol")
    vendor.write_vendor_files(raw, str(tmp_path / "out"))
    got = vendor.read_vendor(spark, str(tmp_path / "out"))
    assert vendor.failed_files(got).collect() == [] and vendor.vendor_bars(got).count() == 150
    spark.sql(f"DROP TABLE {table}")


def test_written_files_come_back(spark, tmp_path):
    prices = bars(spark, [("A, \"x\"", "2020-01-01", 1.1), ("B", "2020-01-01", 0.1 + 0.2), ("B", "2020-01-02", 1e-7)])
    raw = prices.withColumnRenamed("ticker", "symbol")
    path = f"file:{tmp_path / 'out'}"
    vendor.write_vendor_files(raw, path)
    rows = vendor.read_vendor(spark, path)
    want = sorted(prices.select(*ingest.PRICE_COLUMNS).collect())
    assert sorted(ingest.ingest_bars(vendor.vendor_bars(rows)).collect()) == want
    vendor.write_vendor_files(raw, path + "2", raw.filter("symbol = 'B'"))
    rows = vendor.read_vendor(spark, path + "2")
    summary = ingest.ingest_summary(ingest.ingest_bars(vendor.vendor_bars(rows)), prices.select("ticker").distinct()).collect()
    assert {r.ticker: (r.status, r.n_rows) for r in summary} == {"A, \"x\"": ("ok", 1), "B": ("failed", 0)}
    assert len(vendor.failed_files(rows).collect()) == 1
