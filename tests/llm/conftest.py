"""Small tables with awkward rows."""

from __future__ import annotations

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and white-space texts, a long word, repeated rows, ties."""
    prose = "Plain words stand in this sentence and say nothing new about anything at all. " * 8
    rows = [
        (1, prose, "en", "a", len(prose)),
        (1, prose, "en", "a", len(prose)),
        (2, prose + "More.", "en", "a", len(prose)),
        (3, "", "en", "b", 0),
        (4, None, None, None, None),
        (5, " \n\t ", "fr", "b", 4),
        (None, "no id here", "de", "a", 10),
        (7, "x" * 50_000, "xx", "c", 50_000),
        (8, "日本語 テキスト é ü \U0001f600", "ja", "c", 12),
        (9, "a b", "en", "a", 3),
    ]
    return spark.createDataFrame(rows, DOCUMENTS)


@pytest.fixture(scope="session")
def extra(awkward):
    """The same rows with further columns whose names clash with results and, but for case, with the table's."""
    from pyspark.sql import functions as F

    more = {c: F.lit("extra") for c in ("score", "kept", "n_tokens", "ids", "fp", "row", "word", "copy", "rate", "page_id", "component_id")}
    return awkward.withColumns(more)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)
