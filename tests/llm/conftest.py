import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs_of(spark):
    """A documents table from (doc_id, text) or (doc_id, text, lang), with further columns whose names operators use inside."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        from pyspark.sql import functions as F

        names = ("row", "fp", "key", "k1", "body", "__text", "score", "start", "digest", "node", "n")
        return df.withColumns({c: F.lit("clash") for c in names})

    return make
