import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from helpers_llm import make, text  # noqa: E402


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows."""
    rows = [(1, None, "a"), (2, "", "a"), (3, " \t\n", None), (4, "one", "b"), (5, text(5, 60), "b"), (5, text(5, 60), "b"), (6, text(5, 60), None), (None, text(7, 60), "a"), (8, text(8, 30000), "b"), (9, text(5, 59) + " odd", "c"), (10, "Ünï   tab\there\n\nline\nline", "c")]
    return make(spark, rows)


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter("false")
