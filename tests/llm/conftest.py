import pytest

from tests.conftest import SF_CHECK, SF_SMALL

#: doc_id, text: nulls, empty and blank texts, ties, repeated rows and ids, a very long line.
EDGE = [
    (1, None), (2, ""), (3, " \t\n"), (None, "a null id with some words in this text here"),
    (4, "same words in both of these two rows here"), (4, "same words in both of these two rows here"),
    (4, "another text below the same document id, told apart by its words"),
    (5, "x" * 60_000), (6, "word " * 30_000), (7, "\n" * 5_000), (8, "Ünïcödé ẞtraße ØÆÅ " * 3),
    (9, "one two three"), (10, "ONE two\x0bthree"), (11, "a@b.co 1.2.3.4 +49 30 1234567 4111 1111 1111 1111"),
    (12, "<|endoftext|> inside <|startoftext|> text  with   gaps \x1c and   breaks"),
]
#: Extra columns whose names the operators use inside.
CLASH = ("id", "row", "th", "lines", "drop", "kept", "pos", "key", "n", "rep", "words", "w", "text_key", "label")


@pytest.fixture(scope="session")
def edge(spark):
    rows = [(i, t, "en", "src", 0, *("clash" for _ in CLASH)) for i, t in EDGE]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, "
              + ", ".join(f"{c} string" for c in CLASH))


@pytest.fixture(scope="session")
def small_docs(spark):
    return spark.read.parquet(f"{SF_SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF_CHECK}/documents.parquet")
