import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make_docs(spark, tmp_path):
    """Documents as a Parquet table; texts by doc_id, or rows (doc_id, text)."""

    def make(rows, folder=None):
        rows = list(rows.items()) if isinstance(rows, dict) else rows
        full = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
        path = str(tmp_path / (folder or f"docs{len(list(tmp_path.iterdir()))}"))
        spark.createDataFrame(full, DOCS).repartition(2).write.parquet(path)
        return spark.read.parquet(path)

    return make
