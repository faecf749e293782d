"""Driver queries for annotation selection, links, index files and readers on
disk: operators that the other plans use only in part."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.text import contains_ci
from tessera.operators.index import build_index, read_index, write_index
from tessera.operators.spans import (
    first_of_type, resolve_links, select_pack, select_type, union_annotations, with_ann_id,
)
from tessera.operators.tokens import split_sentences, tokenize
from tessera.plans import retrieval  # noqa: F401  (its oracle is used below)
from tessera.plans.corpus import bigint, docs
from tessera.plans.readers import pubtator_records
from tessera.plans.registry import ORACLES, register
from tessera.plans.sqlfrag import tokens_cte
from tessera.sources.readers import read_pubtator, split_bad_records
from tessera.util import scratch_path

TOK = tokens_cte("documents")


def _annotations(spark, sf):
    """Sentences and capitalised words as two passes of annotations."""
    d = docs(spark, sf)
    tok = tokenize(d)
    sents = split_sentences(tok).select("doc_id", F.lit("Sentence").alias("type"), F.lit("a").alias("component"), "begin", "end")
    caps = tok.where(F.col("token").rlike(r"^\p{Lu}")).select(
        "doc_id", F.lit("MedicalEntityMention").alias("type"), F.lit("b").alias("component"), "begin", "end")
    return d, tok, sents, caps


@register("annotation_select", sql=rf"""WITH {TOK},
c AS (SELECT doc_id, begin, "end" FROM tokens WHERE regexp_matches(token, '^\p{{Lu}}')),
f AS (SELECT doc_id, min(begin) AS begin, arg_min("end", (begin, "end")) AS "end", count(*) AS n FROM c GROUP BY doc_id)
SELECT f.doc_id, CAST(f.begin AS BIGINT) AS begin, CAST(f."end" AS BIGINT) AS "end", CAST(f.n AS BIGINT) AS n_mentions,
       contains(lower(d.text), 'the') AS has_the, starts_with(CAST(f.doc_id AS VARCHAR), '1') AS selected
FROM f JOIN documents d USING (doc_id)""")
def q_annotation_select(spark, sf):
    """Both passes of every document united, mentions by type
    and component, the first of each document, and whether its pack's name
    has the prefix."""
    d, _, sents, caps = _annotations(spark, sf)
    packs = select_pack(d.withColumn("pack_name", F.col("doc_id").cast("string")), regex="1")
    both = union_annotations(sents, caps)
    n = select_type(both, "MedicalEntityMention", component="b").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_mentions"))
    first = first_of_type(both, "MedicalEntityMention").join(n, "doc_id").join(d.select("doc_id", "text"), "doc_id")
    first = first.join(packs.select("doc_id", F.lit(True).alias("_in")), "doc_id", "left")
    return bigint(first.select("doc_id", "begin", "end", "n_mentions", contains_ci("text", F.lit(" The ")).alias("has_the"),
                               F.coalesce("_in", F.lit(False)).alias("selected")), "begin", "end", "n_mentions")


@register("resolved_links", sql=rf"""WITH {TOK},
c AS (SELECT doc_id, begin, "end", token, lead(begin) OVER w AS nb, lead("end") OVER w AS ne, lead(token) OVER w AS nt
      FROM tokens WHERE regexp_matches(token, '^\p{{Lu}}') WINDOW w AS (PARTITION BY doc_id ORDER BY begin))
SELECT doc_id, CAST(begin AS BIGINT) AS p_begin, token AS p_text, CAST(nb AS BIGINT) AS c_begin, nt AS c_text
FROM c WHERE nb IS NOT NULL""")
def q_resolved_links(spark, sf):
    """Links from each capitalised word to the next, resolved by id."""
    from pyspark.sql import Window
    tok = tokenize(docs(spark, sf)).where(F.col("token").rlike(r"^\p{Lu}"))
    anns = with_ann_id(tok.select("doc_id", F.lit("W").alias("type"), "begin", "end", F.col("token").alias("surface")))
    w = Window.partitionBy("doc_id").orderBy("begin")
    links = anns.select("doc_id", F.col("ann_id").alias("parent_id"), F.lead("ann_id").over(w).alias("child_id")).where(
        "child_id is not null")
    out = resolve_links(links, anns)
    return bigint(out.select("doc_id", "p_begin", "p_text", "c_begin", "c_text"), "p_begin", "c_begin")


@register("index_roundtrip")
def q_index_roundtrip(spark, sf):
    """K2: the index written, read and counted."""
    path = scratch_path(spark, "index-files")
    d = docs(spark, sf)
    write_index(build_index(tokenize(d), docs=d), path, d)
    idx = read_index(spark, path)
    out = idx.postings.groupBy("term").agg(F.sum("tf").alias("cf"), F.max("tf").alias("max_tf")).join(idx.term_stats, "term")
    return bigint(out.select("term", "df", "cf", "max_tf"), "df", "cf", "max_tf")


ORACLES["index_roundtrip"] = ORACLES["index_stats"]


@register("pubtator_files")
def q_pubtator_files(spark, sf):
    """S6 on disk: records with Windows line ends, many per file."""
    path = scratch_path(spark, "pubtator-files")
    rec = pubtator_records(docs(spark, sf)).select(F.concat(F.regexp_replace("record", "\n", "\r\n"), F.lit("\r\n\r\n")).alias("value"))
    rec.write.option("lineSep", "\r\n").text(path)
    pdocs, ments, _ = read_pubtator(spark, path)
    out = ments.join(pdocs.select("pack_name", F.length("text").alias("doc_len")), "pack_name")
    return bigint(out.select("pack_name", "begin", "end", "surface", "ner_type", "umls_link", "doc_len"), "begin", "end", "doc_len")


ORACLES["pubtator_files"] = ORACLES["pubtator_parse"]


@register("quarantine_rows", sql="""SELECT CAST(doc_id AS VARCHAR) AS file, md5(text) AS record_md5,
  CASE WHEN length(text) < 300 THEN 'short' ELSE 'markup' END AS reason
FROM documents WHERE length(text) < 300 OR contains(text, '|')""")
def q_quarantine_rows(spark, sf):
    """Rules with reasons, the first that holds names it."""
    d = docs(spark, sf)
    _, bad = split_bad_records(d, {"short": F.length("text") < 300, "markup": F.col("text").contains("|")},
                               file_col="doc_id", record_col="text")
    return bad.select("file", F.md5("record").alias("record_md5"), "reason")
