"""Helpers shared by the core tests."""

import datetime as dt

SF_SMALL = "/root/testdata/sf0.001"


def d(s: str) -> dt.date:
    return dt.date.fromisoformat(s)


def bars(spark, rows):
    """rows: (ticker, 'YYYY-MM-DD', adj_close[, high, low, close, volume])."""
    out = []
    for r in rows:
        t, day, p = r[0], d(r[1]), r[2]
        high = r[3] if len(r) > 3 else (None if p is None else p * 1.01)
        low = r[4] if len(r) > 4 else (None if p is None else p * 0.99)
        close = r[5] if len(r) > 5 else p
        vol = r[6] if len(r) > 6 else 1000
        out.append((t, day, p, high, low, close, p, vol))
    return spark.createDataFrame(
        out, "ticker string, date date, open double, high double, low double, close double, "
             "adj_close double, volume bigint")


def series_dates(n, start="2020-01-01"):
    s = d(start)
    return [(s + dt.timedelta(days=i)).isoformat() for i in range(n)]
