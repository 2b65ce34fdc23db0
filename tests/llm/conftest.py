import duckdb
import pytest

# Extra columns whose names the operators also use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, n long, grp int, `a.b` string, __row int"


@pytest.fixture(scope="session")
def make(spark):
    def docs(rows):
        """Documents from (doc_id, text) or (doc_id, text, source)."""
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src0", len(r[1] or ""), "k", 1, 2, "x", 3) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return docs


@pytest.fixture(scope="session")
def texts():
    """All documents of the smallest table set."""
    return duckdb.sql("select doc_id, text from '/root/testdata/sf0.001/documents.parquet' order by 1").fetchall()


@pytest.fixture(scope="session")
def odd():
    """Nulls, empties, ties, repeated rows, a very long text."""
    return [(1, None), (2, ""), (3, "  \n\t\n"), (None, "one two three four five"), (None, None), (4, "same text here"),
            (4, "same text here"), (4, "other text there"), (5, "word " * 30_000), (6, "é" * 9000 + " 漢字" * 50)]
