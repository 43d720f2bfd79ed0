"""Key -> (spark_fn, oracle_sql) for every registered operator/query.

``spark_fn(spark, base_dir)`` returns a DataFrame; :func:`finish` rounds its
DOUBLE columns to 6 decimals, which the oracle SQL mirrors with its ``rnd``
lists. A key registered with ``sql=None`` is checked on rows only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrel.plans.context import Market


@dataclass(frozen=True)
class Entry:
    fn: Callable[[Market], DataFrame]
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def register(key: str, sql: str | None):
    def deco(fn: Callable[[Market], DataFrame]):
        if key in REGISTRY:
            raise ValueError(f"duplicate key {key}")
        REGISTRY[key] = Entry(fn, sql)
        return fn
    return deco


def snap(c: F.Column) -> F.Column:
    """Round to 6 decimals, half to even; NULL, NaN, infinity and large values stay what they are.

    ``rint`` works on the double itself, where ``round`` goes through decimals. One
    reference to ``c`` lets CollapseProject merge this projection into the query's own,
    so top-k plans stay TakeOrderedAndProject.
    """
    return F.rint(c * 1e6) / 1e6


def finish(df: DataFrame) -> DataFrame:
    cols = [
        snap(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
        for f in df.schema.fields
    ]
    return df.select(*cols)


def spark_callable(key: str) -> Callable[[SparkSession, str], DataFrame]:
    entry = REGISTRY[key]

    def run(spark: SparkSession, base_dir: str) -> DataFrame:
        from kestrel.config import ship_package
        ship_package(spark)   # Python workers import kestrel wherever the driver runs
        return finish(entry.fn(Market(spark, base_dir)))
    run.__name__ = key
    return run


def load_all() -> dict[str, Entry]:
    # Importing the catalog modules fills REGISTRY.
    from kestrel.plans import catalog  # noqa: F401
    return REGISTRY
