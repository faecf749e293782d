"""Mixing sources to target weights.

Each document gets a hash-random key; documents are range-sorted by it within
their source (key range -> bucket, then a sort inside the bucket), running
token counts are prefix sums in two levels (bucket totals, then inside the
bucket), and each source is cut at its exact budget; a budget above a source's
size repeats the source in epochs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import packed, unpacked, word_count

#: Documents aimed at per key range; a hot source gets more ranges, not larger ones.
RANGE_ROWS = 1_000


def source_targets(sizes: DataFrame, weights=(1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """``sizes``: one row per source (``source``, ``source_size``). Adds
    ``target``: the weighted share of all sizes, stopped at ``max_epochs``
    times the source, the excess reshared by weight until none is above.

    Sources take ``weights`` in code-point order (null last), repeating. Let
    the sources be sorted by cap / weight and let level_i be the share of one
    weight unit if all before i are full. The level rises while sources fill
    and falls after, so its maximum is the common level. The one window over
    all sources sorts one row per source, never documents.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]),
                     ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("_w", w.cast("long")).withColumn("_cap", F.col("source_size") * max_epochs)
    order = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").isNull(), F.col("source"))
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = ((F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0))).cast("double")
             / F.sum("_w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("_level", level)
    best = F.max("_level").over(every)
    return s.select("source", "source_size",
                    F.least(F.col("_cap").cast("double"), F.col("_w") * best).alias("target"))


def mix_sources(docs: DataFrame, weights=(1, 2, 3), max_epochs: int = 3, seed: str = "mix",
                size: Column | None = None, cut: str = "words",
                tie: Callable[[Column], list[Column]] | None = None) -> DataFrame:
    """``docs`` (``doc_id``, ``source``, ``text`` or a ``size``) with ``size``,
    ``source_size``, ``target`` and ``taken`` (words the mix takes of the
    document, repeats counted).

    ``size``: a column of token counts (default: words of ``text``).
    ``cut="words"``: the document at the cut gives just the words the budget
    lacks; ``cut="documents"``: it is taken whole if at least half of it fits.
    ``tie``: gives further columns of the row that order equal keys of equal
    size.

    Null text: size 0. A null source is a source of its own, the last. Null or
    repeated ``doc_id``: the key is that of the id's text, ties go by size, then ``tie``;
    rows equal in all of these are interchangeable, so reruns agree on the
    rows as a whole. Empty table: no rows. Input columns called ``size``,
    ``source_size``, ``target`` or ``taken`` are replaced.
    """
    if cut not in ("words", "documents"):
        raise ValueError(f"cut must be 'words' or 'documents', not {cut!r}")
    if not weights or any(int(x) <= 0 for x in weights):
        raise ValueError("weights must be positive")
    counted = packed(docs.withColumn("size", word_count(F.col("text")) if size is None else size.cast("long")))
    rows = counted.select("_row", F.col("_row.doc_id").alias("doc_id"), F.col("_row.source").alias("source"),
                          F.col("_row.size").alias("size"))
    stats = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    ranges = F.least(F.lit(65536), F.ceil(F.col("n") / RANGE_ROWS)).cast("int")
    targets = source_targets(stats.select("source", "source_size"), weights, max_epochs)
    per_source = (stats.select("source", ranges.alias("ranges")).alias("a")
                  .join(targets.alias("b"), F.expr("a.source <=> b.source"))
                  .select(F.col("a.source").alias("_source"), "ranges", "source_size", "target"))

    keyed = (rows.join(per_source, F.expr("source <=> _source")).drop("_source")
             .withColumn("key", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
                                      .cast("binary")))
             .withColumn("range", F.expr("cast(conv(substring(key, 1, 4), 16, 10) as int) * ranges div 65536")))
    # prefix sums, level 1: totals of the key ranges of each source
    totals = keyed.groupBy("source", "range").agg(F.sum("size").alias("total"))
    offsets = totals.select(
        F.col("source").alias("_source"), F.col("range").alias("_range"),
        F.coalesce(F.sum("total").over(Window.partitionBy("source").orderBy("range")
                                       .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    # level 2: inside a range, in key order
    inside = Window.partitionBy("source", "range").orderBy("key", "size", *(tie(F.col("_row")) if tie else []))
    run = keyed.withColumn("before", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    out = run.join(offsets, F.expr("source <=> _source and range = _range"), "left")
    start = F.coalesce(F.col("before"), F.lit(0)) + F.col("offset")
    budget = F.floor(F.col("target") + F.lit(0.5)).cast("long")
    whole = F.when(F.col("source_size") > 0, F.expr("cast(floor(target + 0.5) as bigint) div source_size")).otherwise(0)
    left = budget - whole * F.col("source_size") - start
    if cut == "words":
        part = F.greatest(F.lit(0), F.least(F.col("size"), left))
    else:
        part = F.when(left * 2 >= F.col("size"), F.col("size")).otherwise(0)
    return out.select(*unpacked(docs.columns, {"size": F.col("size"), "source_size": F.col("source_size"),
                                               "target": F.col("target"),
                                               "taken": (whole * F.col("size") + part).cast("long")}))


#: DuckDB: the contract's columns over ``documents``.
MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS k
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [1, 2, 3][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT] AS w
  FROM d GROUP BY source),
lv AS (
  SELECT *, ((sum(source_size) OVER ())::BIGINT
             - coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)::DOUBLE
            / (sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS level
  FROM s WINDOW o AS (ORDER BY (3 * source_size)::DOUBLE / w, source IS NULL, source)),
t AS (
  SELECT source, source_size, least((3 * source_size)::DOUBLE, w * max(level) OVER ()) AS target FROM lv),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS budget,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY k, d.size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0
            ELSE (budget // source_size) * size + greatest(0, least(size, budget % source_size - start)) END::BIGINT AS taken
FROM p
"""
