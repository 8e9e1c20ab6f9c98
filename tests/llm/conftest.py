import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

ODD_TEXTS = [None, "", " ", "\n\t\r", "a", "word", "Ärger ñandú — 日本語 🙂", "x" * 30000, "ab cd ef gh " * 4000, "same text here", "same text here",
             "same text here", "tail <|endoftext|> mark", "0 1 2 3", "Zeile\r\nzwei drei"]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows and extra columns with clashing names."""
    rows = [(i if i != 4 else None, t, "en" if i % 2 else None, 7, "x") for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[5], rows[5]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, size int, _shard string").repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
