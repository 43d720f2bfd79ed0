"""Column expressions reused by the operators (all JVM-side, codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from kestrel.config import CONFIDENCE_BUCKETS, REGIME_LABELS, RIGHT_CLOSED_BUCKETS


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def by_ticker(key: str = "ticker", order: str = "date") -> WindowSpec:
    """Per-key time order. A key holds one row per day, so a partition is bounded by the calendar."""
    return Window.partitionBy(key).orderBy(order)


def trailing(n: int, key: str = "ticker", order: str = "date") -> WindowSpec:
    return by_ticker(key, order).rowsBetween(-(n - 1), 0)


def running(key: str = "ticker", order: str = "date") -> WindowSpec:
    return by_ticker(key, order).rowsBetween(Window.unboundedPreceding, 0)


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den, NULL when den is NULL or 0 (ANSI division by zero raises)."""
    return F.when(den.isNotNull() & (den != 0), num / den)


def simple_return(p: Column, prev: Column) -> Column:
    return F.when(prev.isNotNull() & (prev != 0), (p - prev) / prev)


def log_return(p: Column, prev: Column) -> Column:
    return F.when(prev.isNotNull() & (prev > 0) & (p > 0), F.ln(p / prev))


def pct(c: Column, digits: int = 2) -> Column:
    return F.round(c * 100, digits)


def full_window(value: Column, c: Column, n: int, w: WindowSpec) -> Column:
    """pandas ``rolling(n)`` semantics: a value only when all n rows are non-null."""
    return F.when(F.count(c).over(w) == n, value)


def regime_label(c: str | Column) -> Column:
    c = col(c)
    out = None
    for code, label in REGIME_LABELS.items():
        out = (F.when(c == code, label) if out is None else out.when(c == code, label))
    return out


def label_to_code(c: str | Column) -> Column:
    c = col(c)
    out = None
    for code, label in REGIME_LABELS.items():
        out = (F.when(c == label, code) if out is None else out.when(c == label, code))
    return out


def confidence_tier(c: str | Column) -> Column:
    c = col(c)
    return F.when(c >= 0.70, "High").when(c >= 0.50, "Medium").otherwise("Low")


def confidence_bucket(c: str | Column) -> Column:
    """Left-closed SQL buckets: ``< .40``, ``< .50`` ... ``>= .70``."""
    c = col(c)
    out = None
    for edge, label in CONFIDENCE_BUCKETS:
        if edge is None:
            out = out.otherwise(label)
        else:
            out = F.when(c < edge, label) if out is None else out.when(c < edge, label)
    return out


def confidence_bucket_right_closed(c: str | Column) -> Column:
    """``pd.cut`` buckets ``(0,.4] (.4,.5] (.5,.6] (.6,.7] (.7,1]``; outside -> NULL."""
    c = col(c)
    out = F.when((c <= 0) | (c > RIGHT_CLOSED_BUCKETS[-1][0]), F.lit(None).cast("string"))
    for edge, label in RIGHT_CLOSED_BUCKETS:
        out = out.when(c <= edge, label)
    return out


def broadcast_if_small(df, max_bytes: int = 256 << 20, bound=None):
    """Broadcast ``df`` only when a counted bound on its size is under ``max_bytes``; otherwise
    leave the join strategy to Catalyst/AQE (shuffle join with skew splitting).

    The size is rows times 16 bytes and 8 a fixed-width column, 64 a string. ``bound`` is a
    relation whose row count bounds ``df`` (e.g. the bare table a dimension is derived from by
    inner joins and filters); counting a bare parquet table is answered from file footers.
    """
    n = (bound if bound is not None else df).count()
    width = 16 + sum(64 if f.dataType.typeName() in ("string", "binary") else 8 for f in df.schema.fields)
    return F.broadcast(df) if n * width <= max_bytes else df
