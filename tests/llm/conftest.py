import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(40_000))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, equal
    ids, and extra columns whose names clash with the operators' own."""
    words = "the of and to in is that for it as was with be by on not".split()
    prose = [" ".join(words[(i * j + j) % 16] + str("abcdefgh"[(i + j) % 8]) for j in range(60)) for i in range(4)]
    rows = [(1, prose[0], "en", "a", 1), (1, prose[0], "en", "a", 1), (1, prose[1], "en", "a", 2), (2, None, None, None, None),
            (None, prose[2], "en", None, 3), (None, None, None, None, None), (3, "", "en", "b", 4), (4, " \n\t ", "en", "b", 5),
            (5, LONG, "en", "b", 6), (6, "x" * 150_000, "en", "c", 7), (7, "one two", "en", "c", 8), (8, prose[3], "de", "é", 9),
            (9, prose[3] + " end", "de", "é", 10)]
    rows = [r + (f"k{i}",) + tuple(f"{i}:{j}" for j in range(8)) for i, r in enumerate(rows)]
    schema = ("doc_id long, text string, lang string, source string, n_chars long, _row string, size string, score string, "
              "kept string, _d string, `key` string, `range` string, evidence string, n string")
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
