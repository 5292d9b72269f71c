import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """A documents table from (doc_id, text) or (doc_id, text, source) rows, with columns whose names clash with inner ones."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, SCHEMA).repartition(3)
        return df.selectExpr("*", "'x' AS words", "'y' AS _id", "1 AS at", "'z' AS _text", "'k' AS size", "2 AS u")

    return make


#: Nulls, empty texts, blanks, ties and repeated rows.
ODD = [(None, "a null id"), (None, None), (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one"), (5, "one"), (6, "one two"), (7, "Ünïcode wörds, ß and 日本語 \U0001f600 here")]
