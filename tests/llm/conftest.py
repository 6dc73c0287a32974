import pytest

LONG = " ".join(f"word{i % 977}" for i in range(20_000))

#: doc_id, text: nulls, empty, very long, ties, repeated rows, odd characters.
ROWS = [
    (0, "Hello world, this is a first line.\nAnd a second line of text\nshort"),
    (1, "hello world, this is a first line.\nSomething else entirely here"),
    (2, None),
    (3, ""),
    (4, LONG),
    (5, LONG),
    (6, "Hello world, this is a first line.\nAnd a second line of text\nshort"),
    (6, "Hello world, this is a first line.\nAnd a second line of text\nshort"),
    (7, " \t \n\n  AND a second line of text \r\n 　x"),
    (8, "äöü ÄÖÜ ß İ ŉ 漢字 🙂 <|endoftext|> it's 3½"),
    (9, "\n\n\n"),
    (None, "a row without an identifier, of its own text"),
    (None, ""),
    (10, "Released under the MIT License. mit license MIT"),
    (11, "a b c"),
    (12, "a b c"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """With columns whose names the operators use themselves."""
    rows = [(i, t, "en", 1.0, True, 7) for i, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, kept boolean, n_lines int").repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def texts():
    return ROWS
