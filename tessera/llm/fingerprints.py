"""Document fingerprints by winnowing, in DataFrame expressions only.

Words are hashed, runs of ``2**gram_levels`` words get a k-gram hash (hashes of
neighbouring runs are combined, doubling the run), and of each window of
``2**window_levels`` successive k-grams the smallest hash is kept, the
rightmost of equal ones. Any two texts that share a run of at least
``k + window - 1`` words therefore share a kept hash; positions are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import WS, packed, unpacked

#: Key layout (of a long, never negative): 36 bits of hash, then 27 bits that fall as the word position
#: rises, so that the smallest key is the smallest hash, rightmost first.
#: 2**27 words are more than an array of a row can hold.
POS_BITS = 27
POS_MASK = (1 << POS_BITS) - 1
HASH_MASK = (1 << 63) - (1 << POS_BITS)
#: Fixed block of the two-level search over the bucket limits.
STEP = 64


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, evaluated once (a plain
    projection would be inlined into every use)."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _shifted(a: str, by: int, op: str) -> str:
    return f"zip_with({a}, slice({a}, {by + 1}, greatest(size({a}) - {by}, 0)), (x, y) -> {op})"


def _doubled(a: str, levels: int, op: str) -> str:
    """Combine each element with those up to ``2**levels - 1`` places on."""
    expr = a
    for j in reversed(range(levels)):
        expr = _let(f"{a}{j + 1}", _shifted(a if j == 0 else f"{a}{j}", 1 << j, op), expr if j < levels - 1 else f"{a}{levels}")
    return expr


def winnow_expr(text: str, gram_levels: int = 2, window_levels: int = 3) -> str:
    """SQL expression: the kept keys (``array<bigint>``) of the SQL text
    expression ``text`` (null: empty), in text order. A text shorter than a
    k-gram is one gram; one with fewer grams than a window is one window."""
    k, w = 1 << gram_levels, 1 << window_levels
    words = rf"split(trim(BOTH ' \t\n\u000B\f\r' FROM coalesce({text}, '')), '[{WS}]+')".replace("\\x", "\\\\x")
    keys = f"transform(g, (x, i) -> (x & {HASH_MASK}L) | ({POS_MASK}L - i))"
    kept = _let("h", keys, f"slice({_doubled('h', window_levels, 'least(x, y)')}, 1, greatest(size(h) - {w - 1}, 1))")
    grams = _let("q", f"transform({words}, x -> xxhash64(x))",
                 f"slice({_doubled('q', gram_levels, 'xxhash64(x, y)')}, 1, greatest(size(q) - {k - 1}, 1))")
    return f"array_distinct({_let('g', grams, kept)})"


def fingerprint(docs: DataFrame, text: str = "text", gram_levels: int = 2, window_levels: int = 3) -> DataFrame:
    """``docs`` with ``fingerprint``: ``array<struct<pos int, hash bigint>>``,
    the kept k-grams by word position. Null, empty and blank texts all have
    the fingerprint of the empty text; equal texts have equal fingerprints.
    An input column ``fingerprint`` is replaced."""
    kept = packed(docs).select("_row", F.expr(winnow_expr(f"_row.`{text}`", gram_levels, window_levels)).alias("_kept"))
    pairs = F.expr(f"transform(_kept, x -> struct(cast({POS_MASK}L - (x & {POS_MASK}L) as int) as pos, "
                   f"shiftrightunsigned(x, {POS_BITS}) as hash))")
    return kept.select(*unpacked(docs.columns, {"fingerprint": pairs}))


def hash_set(kept: str) -> str:
    return f"array_distinct(transform({kept}, x -> shiftrightunsigned(x, {POS_BITS})))"


def likeness(a: str, b: str) -> str:
    """Jaccard likeness (0 to 1) of two hash sets, neither of them empty."""
    return _let("n", f"size(array_intersect({a}, {b}))", f"n / (size({a}) + size({b}) - n)")


def _bucket(limits: list[int], col: str) -> str:
    """Number of ``limits`` below ``col`` by a two-level search."""
    if not limits:
        return "0"
    lit = lambda xs: f"array({', '.join(f'{x}L' for x in xs)})"
    coarse = f"size(filter({lit(limits[::STEP])}, s -> s < {col}))"
    return _let("c", coarse, f"if(c = 0, 0, (c - 1) * {STEP} + size(filter(slice({lit(limits)}, (c - 1) * {STEP} + 1, {STEP}), "
                             f"s -> s < {col})))")


def with_next(docs: DataFrame, buckets: int | None = None, derive: dict[str, str] | None = None) -> DataFrame:
    """``docs`` (``doc_id``, ``text``) with ``next_<c>`` for ``text`` and each
    ``derive`` column (SQL expressions computed once per document): the value
    of the next document by ascending ``doc_id`` (nulls first, equal ids by
    hash of the text, then the text); the last is followed by the first.

    Documents go to ranges of ``doc_id`` (limits from approximate quantiles,
    at most ``buckets`` of them, by default eight per shuffle partition), so
    that one shuffle moves each text once; the first of a range is also sent
    to the range before it. Limits steer balance only, never the result.
    """
    spark = docs.sparkSession
    buckets = buckets or 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    shares = [i / buckets for i in range(1, buckets)]
    found = ids.agg(F.percentile_approx("doc_id", F.lit(shares) if shares else F.array(F.lit(0.5)), 10 * buckets)).first()[0]
    limits = sorted(set(found or []))
    where = _bucket(limits, "doc_id")
    # the first id of each range that has rows: at most one row per range
    firsts = sorted((r["b"], r["first"]) for r in ids.select(F.expr(where).alias("b"), "doc_id").groupBy("b").agg(
        F.min(F.struct(F.col("doc_id").isNotNull().alias("n"), "doc_id")).alias("m")).select(
            "b", F.col("m.doc_id").alias("first")).collect())
    before = {b: firsts[i - 1][0] for i, (b, _) in enumerate(firsts)}
    at = [(f"{before[b]}", "null" if f is None else f"{f}L", b) for b, f in firsts]
    guests = spark.createDataFrame([(b, f, before[b]) for b, f in firsts], "_b int, _first long, _before int")
    rows = docs.select("doc_id", "text", F.expr(where).alias("_own")) if at else docs.select("doc_id", "text", F.lit(0).alias("_own"))
    rows = (rows.join(F.broadcast(guests), F.expr("_own = _b"), "left")
            .withColumn("_to", F.explode(F.expr(
                "if(doc_id <=> _first, array(struct(_own as b, 0 as g), struct(_before as b, 1 as g)), "
                "array(struct(_own as b, 0 as g)))")))
            .select("doc_id", "text", F.col("_to.b").alias("_at"), F.col("_to.g").alias("_guest"))
            .repartition("_at")
            .selectExpr("*", *[f"{e} as `{c}`" for c, e in (derive or {}).items()]))
    order = Window.partitionBy("_at").orderBy("_guest", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
    for c in ["text", *(derive or {})]:
        rows = rows.withColumn(f"next_{c}", F.lead(c).over(order))
    return rows.filter("_guest = 0").drop("_at", "_guest")


def edited_likeness(docs: DataFrame, gram_levels: int = 2, window_levels: int = 3, buckets: int | None = None) -> DataFrame:
    """Fingerprints of each text and of its edited text (its last
    floor(n/2) code points replaced by the first as many of the next
    document's), with their likeness and that to the next document.

    Returns ``doc_id``, ``n_chars``, ``edited_text``, ``kept`` and
    ``edited_kept`` (key arrays as of :func:`winnow_expr`), ``near_edited``,
    ``near_next``. Null text: empty. One document only: it is its own next.
    Rows repeat as in the input; an empty table gives no rows; columns other
    than ``doc_id`` and ``text`` are not read.
    """
    clean = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(clean, buckets, {"kept": winnow_expr("text", gram_levels, window_levels)})
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    rows = rows.withColumn("edited_text", F.expr(
        "concat(substring(text, 1, cast(n_chars - n_chars div 2 as int)), substring(next_text, 1, cast(n_chars div 2 as int)))"))
    rows = rows.select("doc_id", "n_chars", "edited_text", "kept", "next_kept",
                       F.expr(winnow_expr("edited_text", gram_levels, window_levels)).alias("edited_kept"))
    near = _let("s", hash_set("kept"), "struct({} as e, {} as n)".format(
        _let("t", hash_set("edited_kept"), likeness("s", "t")), _let("t", hash_set("next_kept"), likeness("s", "t"))))
    return rows.select("doc_id", "n_chars", "edited_text", "kept", "edited_kept", F.expr(near).alias("_near")).select(
        "doc_id", "n_chars", "edited_text", "kept", "edited_kept",
        F.col("_near.e").alias("near_edited"), F.col("_near.n").alias("near_next"))


def printable(kept: str) -> str:
    """The kept k-grams as text: ``position:hash`` in hex, in text order."""
    return (f"array_join(transform({kept}, x -> concat(hex({POS_MASK}L - (x & {POS_MASK}L)), ':', "
            f"hex(shiftrightunsigned(x, {POS_BITS})))), ' ')")
