"""Small tables with every edge case of the operators."""

import pytest


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in any column, empty and very long texts, repeated rows, extra columns with the operators' own names."""
    rows = [
        (1, "the quick brown fox jumps over the lazy dog " * 5, "en", "s", 1, 0.5, "x"),
        (1, "the quick brown fox jumps over the lazy dog " * 5, "en", "s", 1, 0.5, "x"),
        (None, "a text without an id but with words enough to count as one of the documents here", None, None, None, None, None),
        (3, None, "en", "s", 0, None, None),
        (4, "", "en", "s", 0, 0.1, ""),
        (5, " \n\t \r\n ", "en", "s", 6, 0.1, ""),
        (6, "word " * 40_000, "en", "s", 200_000, 0.2, ""),
        (7, "x" * 300_000, "en", "s", 300_000, 0.2, ""),
        (8, "Ünïcödé   naïve <|endoftext|> 漢字 \U0001f600 tail  two  spaces\n\n", "fr", "s", 50, 0.3, ""),
        (9, "one", "en", "s", 3, 0.3, ""),
        (10, "One TWO", "en", "s", 7, 0.3, ""),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, component_id string").repartition(3)
