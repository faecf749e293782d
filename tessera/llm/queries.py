"""Driver queries of the llm operators: one ``opN_<name>`` each, over whole
tables, with oracle SQL where SQL expresses the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import (
    bpe,
    chat,
    fingerprints,
    hard_negatives,
    html_text,
    jaccard_join,
    line_templates,
    mixing,
    pii,
    quality,
    repair,
    suffix_repeats,
    toxicity,
)
from tessera.llm.common import table, word_count

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return add


@query("op1_chat_format", chat.CHAT_SQL)
def op1_chat_format(spark, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts hold control strings, rendered,
    encoded, masked and read back."""
    import public_tokenizers

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    turns = turns.unionByName(spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema))
    formatted = chat.format_conversations(turns, public_tokenizers.path("byte_bpe_50k.json"))
    return chat.read_back(formatted).drop("n_tokens", "loss_tokens")


@query("op2_jaccard_join", jaccard_join.JACCARD_SQL)
def op2_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate class and number of links of every document: five-word
    shingles, similarity 0.8 or more."""
    return jaccard_join.similar_classes(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "class_id", "n_links")


@query("op3_byte_bpe")
def op3_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Every whole text encoded and its ids decoded."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decoded=True)
    return coded.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op4_fingerprints")
def op4_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Winnowed fingerprints of every document and of its edited text."""
    out = fingerprints.edited_likeness(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"),
                      F.expr(fingerprints.printable("kept")).alias("fingerprint"),
                      F.expr(fingerprints.printable("edited_kept")).alias("edited_fingerprint"),
                      "near_edited", "near_next")


@query("op5_html_text")
def op5_html_text(spark, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")


@query("op6_line_templates", line_templates.LINES_SQL)
def op6_line_templates(spark, sf_dir: str) -> DataFrame:
    """Every document without the lines of recurring templates."""
    return line_templates.drop_recurring(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op7_pii_surrogates")
def op7_pii_surrogates(spark, sf_dir: str) -> DataFrame:
    """Every document with surrogates for personal data and secrets."""
    return pii.replace(table(spark, sf_dir, "documents").select("doc_id", "text"), key=b"a key of the deployment")


@query("op8_toxicity")
def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every document; labels of a fifth (by crc32 of the id) are held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    index = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held_out))
    return toxicity.score(docs, index).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score",
                                              "predicted", F.col("evidence.doc_id").alias("evidence"))


@query("op9_quality_rules")
def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    forest = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.apply_rules(docs, forest).drop("text", "score")


@query("op10_mix_sources", mixing.MIX_SQL)
def op10_mix_sources(spark, sf_dir: str) -> DataFrame:
    """All documents mixed to weights 1, 2, 3, repeating, by source."""
    from tessera.plans.util import materialize

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("words"))
    docs = materialize(docs, "mix-sizes")  # ids and counts only: the texts are read once
    return mixing.mix_sources(docs, size=F.col("words")).select("doc_id", "size", "source_size", "target", "taken")


@query("op11_structure_repair", repair.REPAIR_SQL)
def op11_structure_repair(spark, sf_dir: str) -> DataFrame:
    """Faults of every damaged conversation, its cheapest repair and audit."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = repair.audits(repair.damaged(turns)).withColumnRenamed("conv_id", "_conv")
    every = turns.select("conv_id").distinct().join(found, F.expr("conv_id <=> _conv"), "left")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return every.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers],
                        F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


@query("op12_suffix_dedup", suffix_repeats.REPEATS_SQL)
def op12_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document without the bytes of strings of 100 bytes seen before."""
    out = suffix_repeats.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


@query("op13_hard_negatives", hard_negatives.MINE_SQL)
def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector against all vectors."""
    vectors = hard_negatives.noisy(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    return hard_negatives.mine(vectors, F.col("vec_id") % 100 == 0)
