"""Scalar column helpers (all built-in Spark expressions, JVM side)."""

from tessera.functions.text import (  # noqa: F401
    py_strip, py_split, PY_WS, span_text, contains_ci, concept_string, concept_url,
    pack_name, is_digits, last_dash_part, URL_PREFIX,
)
