import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(autouse=True)
def shipped(spark):
    from kestrel.llm.common import prepare
    prepare(spark)


@pytest.fixture()
def make_docs(spark):
    """Documents from texts (ids 1, 2, ...) or (doc_id, text[, lang]) rows."""
    def make(rows):
        full = []
        for i, r in enumerate(rows, 1):
            doc_id, text, lang = (i, r, "en") if r is None or isinstance(r, str) else (*r, "en")[:3]
            full.append((doc_id, text, lang, "s", None if text is None else len(text)))
        return spark.createDataFrame(full, COLUMNS)
    return make


@pytest.fixture()
def write_docs(make_docs, tmp_path):
    """Write documents.parquet; returns the folder."""
    def write(rows, **tables):
        make_docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
        for name, df in tables.items():
            df.write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)
    return write
