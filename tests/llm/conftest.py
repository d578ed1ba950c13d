import pytest

#: Extra columns with names that the operators use themselves.
EXTRA = "id long, key string, size string, s string, hash string, gone string, root string, held_out string, score string, row string, `a.b` string"


def documents(spark, rows):
    """Rows of (doc_id, text, lang, source) with the other columns of `documents` and clashing extras."""
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), *[None] * 11) for r in rows], schema)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty, blank and very long texts, repeated rows, ties."""
    long = " ".join(f"word{i % 977} text{i % 31}." for i in range(15_000))
    rows = [
        (1, "Some plain words of a text.\nA second line of words.\nA third line of words.", "en", "a"),
        (1, "Some plain words of a text.\nA second line of words.\nA third line of words.", "en", "a"),
        (2, None, "en", "a"),
        (3, "", None, None),
        (4, " \n\t \n", "en", None),
        (None, "Some plain words of a text.\nA second line of words.\nA third line of words.", None, "b"),
        (None, None, None, None),
        (5, long, "en", "b"),
        (6, long + " end", "en", "b"),
        (7, "x" * 50_000, None, "c"),
        (8, "123 456 ### \U0001f600", "en", "c"),
        (9, "one", "en", "c"),
    ]
    return documents(spark, rows)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
