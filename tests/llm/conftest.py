import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, _key int, _row string, kept int, score int"


@pytest.fixture
def table(spark):
    """Documents with columns whose names the operators use themselves; rows are (doc_id, text[, lang, source])."""

    def make(*rows):
        full = [(*row, *[None] * (4 - len(row)), 0, "x", 1, "y", 2, 3) for row in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture
def awkward(table):
    """Nulls, empty and long texts, repeated rows and keys."""
    long = "many words go on and on " * 20_000
    return table(
        (1, None, None, None), (2, "", "en", "a"), (3, "\n \t", None, "a"), (4, "a", "en", None), (None, "Some text", None, "b"),
        (None, None, None, None), (5, long, "en", "a"), (6, long, "en", "b"), (7, "same row", "en", "b"), (7, "same row", "en", "b"),
        (7, "another text", "en", "b"), (8, "é" * 300 + "…", "fr", "c"),
    )
