import pytest
from pyspark.sql import functions as F

#: Columns that operators name too, among them ones they add.
CLASHES = ("id", "row", "run", "digest", "root", "item", "key", "text_key", "keep_id", "kept", "n_links", "score", "rank", "length", "task", "host", "html_text", "line", "template", "label2", "n_dropped")


@pytest.fixture
def extra():
    """A frame with more columns, whose names operators use inside."""
    return lambda df: df.withColumns({c: F.lit("x") for c in CLASHES if c not in df.columns})


@pytest.fixture
def documents(spark):
    """Documents from (id, text) pairs."""

    def make(rows):
        full = [(i, t, "en", None if i is None else f"s{i % 2}", len(t) if t else None) for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")

    return make
