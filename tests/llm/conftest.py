import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from texts, or from (doc_id, text, source)."""

    def make(*rows):
        full = [(i, r, "en", "s", len(r or "")) if not isinstance(r, tuple) else (r[0], r[1], "en", r[2], len(r[1] or "")) for i, r in enumerate(rows)]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd(docs_of):
    """Nulls, empty and very long texts, ties, repeated rows and a clashing column."""
    from pyspark.sql import functions as F

    rows = [(1, None, "a"), (2, "", None), (3, "  \n\t ", "b"), (4, "one", "b"), (5, "the same text of six words", "a"), (6, "the same text of six words", "a"), (6, "the same text of six words", "a"), (None, "the id is not there at all", "c"), (7, "word " * 40_000, "a"), (8, "x" * 300_000, None)]
    return docs_of(*rows).withColumns({"score": F.lit("clash"), "size": F.lit(1), "part": F.lit(None).cast("string"), "rule": F.lit("r"), "length": F.lit(0)})


@pytest.fixture(scope="session")
def empty(docs_of):
    return docs_of("x").limit(0)
