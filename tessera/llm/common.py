"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space that separates words, as a Java/DuckDB/Python character class body.
WS = r"\x20\x09-\x0D"
#: A word: a maximal run of other characters.
WORD = rf"[^{WS}]+"

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)          # odd, so it has an inverse mod 2**64
_BASE_INV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_IS_WS = np.zeros(256, dtype=bool)
_IS_WS[[9, 10, 11, 12, 13, 32]] = True
#: Longest stretch of bytes hashed at once; longer texts go word-aligned
#: stretch by stretch, so memory stays bounded by this and the longest word.
STRETCH = 1 << 18


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small_batches(spark, rows: int = 1000, size: str = "16m") -> None:
    """Bound what a Python worker holds of its input at once, unless the
    session asks for less: long texts make the default batches too large."""
    now = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000"))
    if now <= 0 or now > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def replace_columns(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """``df`` with the columns of ``new``; an input column of the same name
    (in any case, as Spark compares names) gives way."""
    taken = {n.lower() for n in new}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken],
                     *[c.alias(n) for n, c in new.items()])


def packed(df: DataFrame) -> DataFrame:
    """``df`` as one struct column ``_row``: whatever its columns are called,
    they cannot clash with an operator's own."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))


def unpacked(columns: list[str], new: dict[str, Column]) -> list[Column]:
    """The columns of ``_row`` named ``columns``, then those of ``new``; an
    input column of the name of a new one gives way in its place."""
    by_name = {n.lower(): n for n in new}
    here = [new[by_name[c.lower()]].alias(by_name[c.lower()]) if c.lower() in by_name else F.col(f"_row.`{c}`").alias(c)
            for c in columns]
    have = {c.lower() for c in columns}
    return here + [c.alias(n) for n, c in new.items() if n.lower() not in have]


def word_count(text: Column) -> Column:
    """Words of ``text`` (null: 0): one split, less the empty pieces that
    white space at either end leaves."""
    parts = F.split(F.coalesce(text, F.lit("")), rf"[{WS}]+")
    return F.transform(F.array(parts), lambda p: (
        F.size(p) - F.when(F.get(p, F.lit(0)) == "", 1).otherwise(0)
        - F.when((F.size(p) > 1) & (F.element_at(p, -1) == ""), 1).otherwise(0)).cast("long"))[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64, so that sums become even hashes."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base, n: int, cache: dict = {}) -> np.ndarray:  # noqa: B006 - a cache on purpose
    have = cache.get(int(base))
    if have is None or len(have) < n:
        size = max(n, STRETCH + 1)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 4 * STRETCH:
            cache[int(base)] = have
    return have


def _stretches(raw: bytes):
    """Slices of ``raw`` of about ``STRETCH`` bytes that end between words."""
    at = 0
    while len(raw) - at > STRETCH:
        window = np.frombuffer(raw, np.uint8, count=STRETCH, offset=at)
        gaps = np.flatnonzero(_IS_WS[window])
        if len(gaps):
            end = at + int(gaps[-1]) + 1
        else:  # one word longer than a stretch: up to its end
            rest = np.flatnonzero(_IS_WS[np.frombuffer(raw, np.uint8, offset=at)])
            end = at + int(rest[0]) + 1 if len(rest) else len(raw)
        yield raw[at:end]
        at = end
    yield raw[at:]


def word_hashes(raw: bytes) -> np.ndarray:
    """A uint64 hash of each word of the UTF-8 text ``raw``, in order. The
    hash depends on the word's bytes alone, so every machine agrees."""
    out = []
    for part in _stretches(raw):
        b = np.frombuffer(part, np.uint8)
        if not len(b):
            continue
        inside = ~_IS_WS[b]
        edge = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if not len(starts):
            continue
        total = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + _U(1)) * _powers(_BASE, len(b))[:len(b)], out=total[1:])
        h = (total[ends] - total[starts]) * _powers(_BASE_INV, len(b) + 1)[starts]
        out.append(mix64(h + (ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_hashes(words: np.ndarray, k: int = 5) -> np.ndarray:
    """A hash of each run of ``k`` words, in order (empty below ``k`` words)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * _U(0xC2B2AE3D27D4EB4F) + words[j:j + n]
    return mix64(h)
