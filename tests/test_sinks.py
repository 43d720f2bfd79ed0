import tempfile

from pyspark.sql import functions as F

from kestrel.sources import sinks


def test_versioned_full_refresh_and_pointer(spark):
    root = tempfile.mkdtemp(prefix="kestrel-sink-")
    a = spark.range(5).toDF("x")
    p1 = sinks.full_refresh(a, "t", root)
    assert sinks.read_current(spark, "t", root).count() == 5
    p2 = sinks.full_refresh(spark.range(3).toDF("x"), "t", root)
    assert p1 != p2 and sinks.current_path(spark, "t", root) == p2
    assert sinks.read_current(spark, "t", root).count() == 3
    assert spark.read.parquet(p1).count() == 5            # old version untouched for running readers


def test_upsert_updates_and_inserts(spark):
    old = spark.createDataFrame([("A", "a", "s1", "i1"), ("B", "b", "s2", "i2")],
                                "ticker string, company_name string, sector string, industry string")
    new = spark.createDataFrame([("B", "b2", "s9", "i9"), ("C", "c", "s3", "i3")],
                                "ticker string, company_name string, sector string, industry string")
    out = {r.ticker: r for r in sinks.upsert_dimension(old, new).collect()}
    assert out["A"].company_name == "a" and out["B"].sector == "s9" and out["C"].industry == "i3"


def test_store_builds_once_and_reads_bucketed(spark, tmp_path):
    from kestrel.sources import store
    base = tmp_path / "data"
    base.mkdir()
    src = spark.createDataFrame([("A", i) for i in range(5)], "ticker string, v int")
    src.write.parquet(str(base / "t.parquet"))
    calls = []

    def build():
        calls.append(1)
        return spark.read.parquet(str(base / "t.parquet")).withColumn("date", F.current_date())
    a = store.stored(spark, "unit", str(base), ("t",), build)
    b = store.stored(spark, "unit", str(base), ("t",), build)
    assert a.count() == 5 and b.count() == 5 and len(calls) == 1
    # A changed source file changes the signature: the relation is rebuilt.
    src.limit(2).write.mode("append").parquet(str(base / "t.parquet"))
    c = store.stored(spark, "unit", str(base), ("t",), build)
    assert c.count() == 7 and len(calls) == 2


def test_a_crash_before_the_switch_leaves_the_old_version(spark, monkeypatch):
    root = tempfile.mkdtemp(prefix="kestrel-sink-")
    sinks.full_refresh(spark.range(5).toDF("x"), "t", root)

    def crash(*a):
        raise OSError("killed")
    with monkeypatch.context() as m:
        m.setattr(sinks, "_set_current", crash)
        try:
            sinks.full_refresh(spark.range(3).toDF("x"), "t", root)
        except OSError:
            pass
    assert sinks.read_current(spark, "t", root).count() == 5


def test_the_pointer_is_replaced_by_one_rename_and_versions_expire(spark):
    import os
    root = tempfile.mkdtemp(prefix="kestrel-sink-")
    for i in range(1, 8):
        sinks.full_refresh(spark.range(i).toDF("x"), "t", root, keep=3)
    names = [n for n in os.listdir(f"{root}/t") if not n.startswith(".")]
    assert sum(n.startswith("v=") for n in names) == 3 and [n for n in names if n.startswith("_CURRENT")] == ["_CURRENT"]
    assert sinks.read_current(spark, "t", root).count() == 7


def test_a_new_session_registers_the_stored_files(spark, tmp_path):
    from kestrel.sources import store
    src = spark.createDataFrame([("A", i) for i in range(5)], "ticker string, date int")
    src.write.parquet(str(tmp_path / "t.parquet"))
    calls = []

    def build():
        calls.append(1)
        return spark.read.parquet(str(tmp_path / "t.parquet"))
    first = store.stored(spark, "again", str(tmp_path), ("t",), build)
    assert first.count() == 5
    for table in store._STORED.values():   # what a new process starts with: no tables, no memory
        if table.startswith("kestrel_again"):
            spark.sql(f"DROP TABLE {table}")
    store._STORED.clear()
    second = store.stored(spark, "again", str(tmp_path), ("t",), build)
    assert second.count() == 5 and len(calls) == 1
    assert "Bucketed: true" in second.groupBy("ticker").count()._jdf.queryExecution().executedPlan().toString()
