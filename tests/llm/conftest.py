import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from helpers import SCHEMA, odd_texts  # noqa: E402

@pytest.fixture(scope="session")
def odd(spark):
    """Columns whose names the operators use themselves, and one with a dot."""
    rows = [(d, t, lang, source, i, "s", 3, "r", "x") for i, (d, t, lang, source) in enumerate(odd_texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def tokenizer():
    from turnwise.llm.queries import tokenizer_file

    return tokenizer_file()
