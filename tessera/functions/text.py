"""String expressions the span semantics need.

Offsets are code points and spans are half-open ``[begin, end)``; Spark's
``substring`` is 1-based, hence ``begin + 1``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: link prefix printed in front of a concept id.
URL_PREFIX = "https://www.ncbi.nlm.nih.gov/search/all/?term="


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# Fixed value: the characters Python's str.split()/strip() treat as space.
PY_WS = r"[\s\p{Z}\x{1C}-\x{1F}\x{85}]"


def py_strip(col) -> Column:
    """Python ``str.strip()``: strips all leading/trailing whitespace
    (Spark ``trim`` only strips spaces)."""
    return F.regexp_replace(_c(col), "^" + PY_WS + "+|" + PY_WS + "+$", "")


def py_split(col) -> Column:
    """Python ``str.split()`` (no argument): split on whitespace runs,
    dropping empty parts."""
    return F.filter(F.split(py_strip(col), PY_WS + "+"), lambda x: x != "")


def span_text(text, begin, end) -> Column:
    """``text[begin:end]``."""
    b, e = _c(begin), _c(end)
    return F.substring(_c(text), b + 1, e - b)


def contains_ci(haystack, needle) -> Column:
    """Lower-cased substring test with the needle stripped."""
    return F.lower(_c(haystack)).contains(F.lower(py_strip(_c(needle))))


def concept_url(cui) -> Column:
    return F.concat(F.lit(URL_PREFIX), _c(cui))


def concept_string(name, cui) -> Column:
    """``Name: …<TAB>CUI: …<TAB>Learn more at: …``."""
    return F.concat(F.lit("Name: "), _c(name), F.lit("\tCUI: "), _c(cui),
                    F.lit("\tLearn more at: "), concept_url(cui))


def pack_name(path, mode: str = "stem") -> Column:
    """Document name from a file path.

    ``stem``: basename without extension; ``cut4``: basename without its
    last four characters (``.txt``); ``full``: basename with extension.
    """
    base = F.element_at(F.split(_c(path), "/"), -1)
    if mode == "full":
        return base
    if mode == "cut4":
        return base.substr(F.lit(1), F.length(base) - 4)
    if mode == "stem":
        return F.regexp_replace(base, r"\.[^.]*$", "")
    raise ValueError(f"unknown pack-name mode {mode!r}")


def is_digits(col) -> Column:
    return _c(col).rlike(r"^[0-9]+$")


def last_dash_part(col) -> Column:
    """Text after the last ``-`` (whole string if none)."""
    return F.element_at(F.split(_c(col), "-"), -1)
