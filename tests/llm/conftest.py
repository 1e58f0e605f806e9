import pytest

#: Names that operators use for columns of their own.
CLASHES = "id _id _h row hash digest start stop node comp component_id copy copies size target number n_words base more other digits pos p x key left_ doc k at changed rows label".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, score int, items string, null boolean, " + ", ".join(f"{c} int" for c in CLASHES)


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in every column, empty and long texts, repeated rows, an id with two texts, and columns that clash with results and helpers."""
    long = " ".join(f"wort{i} the of und" for i in range(20_000))
    rows = [
        (1, "The quick brown fox jumps over the lazy dog near the old river bank.", "en", "a"),
        (2, "Der schnelle braune Fuchs springt über den faulen Hund am alten Fluss.", "de", "b"),
        (3, None, "en", "a"),
        (4, "", None, None),
        (5, " \t\n\x0b ", "de", None),
        (6, "é😀漢字 Привет мир ß", None, "c"),
        (7, long, "en", "a"),
        (1, "The quick brown fox jumps over the lazy dog near the old river bank.", "en", "a"),
        (None, "The quick brown fox jumps over the lazy dog near the old river bank.", "en", "a"),
        (9, "12345 !!! ???", "de", "b"),
        (10, "x", None, "c"),
        (11, "one text of an id that has two", "en", "a"),
        (11, "and here is quite another text with the same number", "en", None),
        (None, "another row that has no number", "en", "a"),
    ]
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), "s", 1, "i", True, *range(len(CLASHES))) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
