"""Classes of near copies, in DataFrame expressions only: sketches of the least
hashes of a text's word 4-grams, MinHash bands over them, likeness to a band's
least member, and connected components. Used where a stage must tell copies of one
text from different texts that share a passage, without Python."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import connected_components
from tessera.llm.fingerprints import hash_set, winnow_expr
from tessera.util import materialize

BANDS, ROWS, SKETCH = 8, 3, 64


def _alike(a: str, b: str, size: int) -> str:
    """Jaccard likeness of two sets by their ``size`` least hashes: the share
    of their union's least that both hold; exact for smaller unions."""
    return f"transform(array(slice(array_sort(array_union({a}, {b})), 1, {size})), u -> size(array_intersect(array_intersect(u, {a}), {b})) / size(u))[0]"


def copy_classes(docs: DataFrame, alike: float = 0.7, bands: int = BANDS, rows: int = ROWS, sketch: int = SKETCH) -> DataFrame:
    """``text_hash`` (``xxhash64`` of ``text``) and ``class`` of each different
    text of ``docs`` (``text``): texts are linked whose sketches of ``sketch``
    hashes have a likeness of at least ``alike`` to that of the least text they
    share a band with; classes are joined over such links. (A text of fewer
    4-grams is its own sketch; for others likeness is an estimate, off by
    about 0.05.)

    Texts equal in their sketches are one from the start. Null, empty and
    blank texts are copies of one another. Empty table: no rows. Other columns
    are not read. A band's members are compared with one of them, never with
    each other, so the work is linear however large a group is.
    """
    grams = hash_set(winnow_expr("text", window_levels=0))
    signed = docs.select(F.xxhash64("text").alias("text_hash"), F.expr(f"slice(sort_array({grams}), 1, {sketch})").alias("hashes"))
    signed = materialize(signed.withColumn("node", F.xxhash64("hashes")), "copy-sketches")
    sets = signed.groupBy("node").agg(F.first("hashes").alias("hashes"))
    least = ", ".join(f"array_min(transform(hashes, h -> xxhash64(h, b * {rows} + {j})))" for j in range(rows))
    keys = F.expr(f"transform(sequence(0, {bands - 1}), b -> xxhash64(b, {least}))")
    nodes = materialize(sets.select("node", F.explode(keys).alias("band")), "copy-bands")
    first = nodes.groupBy("band").agg(F.min("node").alias("v"), F.max("node").alias("last")).where("v < last").select("band", "v")
    met = nodes.join(first, "band").where("node <> v").select(F.col("node").alias("u"), "v").distinct()
    hashes = signed.select("node", "hashes").dropDuplicates(["node"])
    a = hashes.select(F.col("node").alias("u"), F.col("hashes").alias("a"))
    b = hashes.select(F.col("node").alias("v"), F.col("hashes").alias("b"))
    links = met.join(a, "u").join(b, "v").where(F.expr(f"{_alike('a', 'b', sketch)} >= {alike}")).select("u", "v")
    classes = connected_components(links, "copy-components")
    return (signed.select("text_hash", "node").distinct().join(classes, "node", "left")
            .select("text_hash", F.coalesce("component", "node").alias("class")))
