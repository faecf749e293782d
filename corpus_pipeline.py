"""Corpus pipeline: raw documents to token ids.

``STAGES`` holds ``(name, function)`` in order; a function takes ``(spark,
docs, sf_dir)`` and returns a DataFrame that is written as Parquet and read
again as the next one's ``docs``. All but the last return the columns of
``documents``, whatever they are called besides ``doc_id``, ``text`` and
``source`` (and ``n_chars``, which line dedup keeps true): the stages carry a
row as one struct past the operators' own columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, copy_classes, jaccard_join, line_templates, mixing, quality
from tessera.llm.common import packed, table, unpacked, word_count
from tessera.util import materialize


def _carried(docs: DataFrame, *columns: str) -> DataFrame:
    """``columns`` of ``docs`` and its rows as the struct ``_row``."""
    return packed(docs).select(*[F.col(f"_row.`{c}`").alias(c) for c in columns], "_row")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the boosted trees (fitted on the
    labels of ``sf_dir`` and their documents in ``docs``). Null, empty and
    blank texts fail the base rule and go. Repeated rows are judged alike and
    all stay or go; a null ``doc_id`` has no label and is judged like others.
    Empty table: no rows. Very long texts are judged whole."""
    forest = quality.fit(docs, table(spark, sf_dir, "labels"))
    judged = quality.apply_rules(_carried(docs, "text"), forest)
    return judged.where("kept").select(*unpacked(docs.columns, {}))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of recurring templates; ``n_chars`` follows
    where there is one. No document is left out; one may become empty. The
    members of a class of near copies count as one document, so what only they
    share stays for the next stage. Null text: stays null. Repeated rows are
    copies and are all rewritten alike. Empty table: no rows. DataFrame
    functions only."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    rows = docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(rest)]).alias("_rest"))
    out = line_templates.drop_recurring(rows, copies=copy_classes.copy_classes(rows))
    made = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.length("text").cast("long")}
    made |= {c: F.col(f"_rest._{i}") for i, c in enumerate(rest)}
    return out.select(*[made[c].alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of five-word-shingle similarity 0.8 or more:
    that of the least ``doc_id`` (null first, ties by hash of the text), once
    if its row repeats. Documents without a word stay, equal rows of them
    once. Empty table: no rows. Very long texts are compared whole."""
    return jaccard_join.one_per_class(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, repeated as their source's target asks; a null source
    is a source of its own. Documents without a word have no size to mix and
    go. Equal keys (null or repeated ids) go by size, then hash of the text,
    so reruns agree. Empty table: no rows."""
    rows = _carried(docs, "doc_id", "source").withColumn("_size", word_count(F.col("_row.text")))
    mixed = mixing.mix_sources(rows, size=F.col("_size"), cut="documents", tie=lambda row: [F.xxhash64(row["_row"]["text"])])
    times = F.when(F.col("size") > 0, F.expr("cast(taken div size as int)")).otherwise(0)
    return mixed.where(times > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1), times))).select(*unpacked(docs.columns, {}))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``n_tokens``, ``token_ids`` (packed little-endian uint32) of every
    document, and whether they decode to its text (``round_trip``); input
    columns of these names give way. Null text: encoded as the empty one, no
    tokens. Repeated rows are encoded alike. Empty table: no rows."""
    import public_tokenizers

    coded = bpe.encode(_carried(docs, "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decoded=True)
    return coded.select(*unpacked(docs.columns, {
        "n_tokens": F.col("n_tokens"), "token_ids": F.col("token_ids"),
        "round_trip": F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")}))


STAGES = [("quality", quality_rules), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("mix", mix),
          ("tokenize", tokenize)]

#: The trees of the first stage and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
