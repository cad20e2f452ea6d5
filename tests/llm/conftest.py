"""Documents with every odd case: nulls, empty and long texts, repeated rows, clashing extra columns."""

import pytest

LONG = "lorem ipsum dolor sit amet, " * 4000
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "fp", "start", "part", "n", "label", "score", "span"]


def odd_rows():
    texts = [(1, "The quick brown fox jumps over the lazy dog. " * 3), (2, "The quick brown fox jumps over the lazy dog. " * 3),
             (3, None), (4, ""), (5, " \t\n\x0b "), (6, LONG), (7, LONG + "end"), (None, "A text without an id, " * 9),
             (8, "it's 3 o'clock — Ünïcödé ſtraße 東京 <|endoftext|>"), (9, "x"), (9, "x"), (10, "\x00\x1c odd \x85 controls"),
             (2, "The quick brown fox jumps over the lazy dog. " * 3), (11, "a b c d e f g h i j k l m n o p")]
    return [(i, t, "en", "src1", 0, -1, -1, "p", 0, "l", 0.5, "s") for i, t in texts]


@pytest.fixture(scope="session")
def odd(spark):
    schema = ("doc_id long, text string, lang string, source string, n_chars long, fp long, start long, part string, "
              "n long, label string, score double, span string")
    return spark.createDataFrame(odd_rows(), schema)


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
