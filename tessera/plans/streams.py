"""Driver queries for the streaming jobs and the pack round trip. Inputs
are written from the given tables into a fresh folder under the shared
checkpoint folder; the oracle is the batch SQL of the same operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators.index import search
from tessera.operators.tokens import split_sentences, tokenize
from tessera.plans import retrieval as R
from tessera.plans import tagging as TG
from tessera.plans.corpus import bigint, docs
from tessera.plans.readers import NEWS_CONTENT_SQL, news_content, strip_sql
from tessera.plans.registry import ORACLES, register
from tessera.plans.sqlfrag import sentences_cte, tokens_cte
from tessera.util import materialize, plan_bytes, read_table, scratch_path
from tessera.sources.readers import parse_news
from tessera.sources.sinks import read_packs, write_packs
from tessera.streaming.jobs import (
    index_batch, merged_index, running_scores, stream_corpus, stream_index, stream_table,
)


LANDING_BYTES = 32 << 20  # of a landed file, by the size of what it is written from


def _files(df, batches):
    """Files that each of so many batches of ``df`` lands in."""
    return max(1, -(-plan_bytes(df) // (batches * LANDING_BYTES)))


RECORD = "\x1e"  # ends a record of the streamed news files


@register("packs_json", sql=f"""WITH {tokens_cte("documents")}, {sentences_cte()}
SELECT CAST(d.doc_id AS VARCHAR) AS pack_name, d.source, md5(d.text) AS text_md5,
       CAST(count(s.sent_idx) AS BIGINT) AS n_annotations, CAST(coalesce(sum(s."end" - s.begin), 0) AS BIGINT) AS covered
FROM documents d LEFT JOIN sentences s USING (doc_id) GROUP BY d.doc_id, d.source, d.text""")
def q_packs_json(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", "text", "source")
    sents = split_sentences(tokenize(d)).select(F.col("doc_id").cast("string").alias("pack_name"),
                                                F.lit("Sentence").alias("type"), "begin", "end")
    path = scratch_path(spark, "packs")
    write_packs(d.withColumn("pack_name", F.col("doc_id").cast("string")), sents, path, gzip=True)
    rd, ra = read_packs(spark, path)
    n = ra.groupBy("pack_name").agg(F.count(F.lit(1)).alias("n_annotations"),
                                    F.sum(F.col("end") - F.col("begin")).alias("covered"))
    out = rd.join(n, "pack_name", "left").select(
        "pack_name", "source", F.md5("text").alias("text_md5"),
        F.coalesce("n_annotations", F.lit(0)).alias("n_annotations"), F.coalesce("covered", F.lit(0)).alias("covered"))
    return bigint(out, "n_annotations", "covered")


@register("stream_news", sql=f"""
WITH c AS (SELECT doc_id, {NEWS_CONTENT_SQL} AS content FROM documents),
l AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(content || chr(10), '\\r\\n|\\r|\\n'), lambda x: {strip_sql('x')}),
                                 lambda x: x <> '' AND NOT starts_with(x, '--')) AS ls FROM c)
SELECT doc_id, md5(array_to_string(ls, chr(10))) AS text_md5, CAST(len(ls) AS BIGINT) AS n_lines FROM l""")
def q_stream_news(spark, sf):
    """Many documents per landing file, each record led by its id."""
    d = read_table(spark, sf, "documents").select("doc_id", "text", "source")
    src = scratch_path(spark, "news-in")
    named = news_content(d).withColumn("id", F.regexp_extract("file", r"([0-9]+)", 1))
    named.select(F.concat(F.lit("-- id="), "id", F.lit("\n"), "content").alias("value")).repartition(4).write.option(
        "lineSep", RECORD).text(src)

    def parse(batch):
        own = F.concat(F.regexp_extract("content", r"^-- id=([0-9]+)", 1), F.lit(".txt"))
        return parse_news(batch.where("content <> ''").withColumn("file", own))

    out = stream_corpus(spark, src, scratch_path(spark, "news-out"), scratch_path(spark, "news-ckpt"), parse,
                        max_files=1, record_sep=RECORD)
    return bigint(out.select(F.regexp_extract("file", r"^([0-9]+)", 1).cast("bigint").alias("doc_id"),
                             F.md5("text").alias("text_md5"), F.size(F.split("text", "\n")).alias("n_lines")),
                  "n_lines")


@register("stream_search")
def q_stream_search(spark, sf):
    idx = R._index(spark, sf)
    src = scratch_path(spark, "questions-in")
    R.questions(spark, sf).repartition(3).write.parquet(src)
    out = stream_table(spark, src, "question_id string, query string", scratch_path(spark, "search-out"),
                       scratch_path(spark, "search-ckpt"), lambda b: search(idx, b, R.TOP_K, R.SLOP))
    return bigint(out.select("question_id", "doc_id", "rank", F.round("score", 6).alias("score"), "width"),
                  "rank", "width")


ORACLES["stream_search"] = ORACLES["search"]


def _land(rows, path, batches=None):
    """Append ``rows`` to the folder of a stream, to arrive in so many batches
    (default: together, as many files as tasks); the files of a batch."""
    n = batches and _files(rows, batches)
    (rows.repartition(batches * n) if batches else rows).write.mode("append").parquet(path)
    return n


def _indexed(spark, src, landings):
    """The folder of :func:`index_batch` rows after each of ``landings``
    (``rows, batches``) has landed and was streamed."""
    out, ckpt = scratch_path(spark, "postings-out"), scratch_path(spark, "postings-ckpt")
    for rows, batches in landings:
        res = stream_table(spark, src, "doc_id bigint, text string", out, ckpt, index_batch, max_files=_land(rows, src, batches))
    return res


@register("stream_index")
def q_stream_index(spark, sf):
    """A tenth of the documents arrives first in an older version; the last
    batch of a document replaces what earlier batches said of it."""
    d = docs(spark, sf)
    src = scratch_path(spark, "docs-in")
    old = d.where(F.col("doc_id") % 10 == 0).withColumn("text", F.concat(F.lit("outdated words "), "text"))
    out = _indexed(spark, src, [(old, None), (d, 4)])
    idx = merged_index(out)
    res = idx.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"), F.max("tf").alias("max_tf"))
    return bigint(res.join(idx.term_stats.select("term", F.col("df").alias("_df")), "term").where("df = _df").drop("_df"),
                  "df", "cf", "max_tf")


@register("stream_doc_stats", sql=f"""WITH {tokens_cte("documents")}
SELECT d.doc_id, CAST(count(t.word_idx) AS BIGINT) AS n_tokens FROM documents d LEFT JOIN tokens t USING (doc_id) GROUP BY d.doc_id""")
def q_stream_doc_stats(spark, sf):
    """Document lengths of the incremental index."""
    d = docs(spark, sf)
    src = scratch_path(spark, "docs-in")
    old = d.where(F.col("doc_id") % 10 == 0).withColumn("text", F.lit("outdated"))
    out = _indexed(spark, src, [(old, None), (d, 2)])
    return bigint(merged_index(out).doc_stats, "n_tokens")


ORACLES["stream_index"] = ORACLES["index_stats"]


@register("stream_compacted")
def q_stream_compacted(spark, sf):
    """The incremental index over seven batches, compacted after every third:
    older versions of a tenth of the documents, documents that are taken out
    later, then the documents themselves."""
    d = docs(spark, sf).withColumn("removed", F.lit(False))
    src = scratch_path(spark, "docs-in")
    old = d.where(F.col("doc_id") % 10 == 0).withColumn("text", F.concat(F.lit("outdated words "), "text"))
    passing = d.where(F.col("doc_id") % 7 == 0).withColumn("doc_id", -F.col("doc_id") - 1)
    gone = passing.withColumn("removed", F.lit(True)).withColumn("text", F.lit(None).cast("string"))
    out, ckpt = scratch_path(spark, "postings-out"), scratch_path(spark, "postings-ckpt")
    for rows, batches in ((old, None), (passing, None), (gone, None), (d, 4)):
        idx = stream_index(spark, src, "doc_id bigint, text string, removed boolean", out, ckpt, max_files=_land(rows, src, batches),
                           compact_every=3)
    res = idx.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"), F.max("tf").alias("max_tf"))
    return bigint(res, "df", "cf", "max_tf")


ORACLES["stream_compacted"] = ORACLES["index_stats"]


def _batch_counts(spark, sf, landings, landed):
    """Match counts of each of ``landings`` (test documents, one batch each,
    streamed from the folder ``landed``) against the fitted tagger; the
    folder written."""
    from tessera.operators.evaluate import match_counts
    from tessera.operators.tags import bio_encode, fit_tagger, iob_decode, predict_tags
    from tessera.operators.tokens import with_sentence_idx
    lab, _ = TG.labelled(spark, sf)
    model = materialize(fit_tagger(lab.where(F.col("doc_id") % 5 != 0)), "model")

    def score(batch):
        tok = with_sentence_idx(tokenize(batch))
        r = TG.reference_runs(tok)
        pred = predict_tags(bio_encode(tok, r), model)
        ps = iob_decode(pred, label="pred", segment="sent_idx").select("doc_id", "begin", "end", "ner_type")
        return match_counts(r, ps).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("exact", "n_ref", "n_pred")])

    out, ckpt = scratch_path(spark, "counts-out"), scratch_path(spark, "counts-ckpt")
    for rows in landings:
        stream_table(spark, landed, "doc_id bigint, text string", out, ckpt, score, max_files=_land(rows, landed))
    return out


@register("stream_running_scores", sql=f"""WITH {TG.MODEL_SQL},
g AS (SELECT CAST(floor(doc_id / 5) AS BIGINT) % 4 AS batch, sum(exact) AS x, sum(n_ref) AS r, sum(n_pred) AS p FROM counts GROUP BY 1),
t AS (SELECT batch, CAST(sum(x) OVER w AS BIGINT) AS exact, CAST(sum(r) OVER w AS BIGINT) AS n_ref, CAST(sum(p) OVER w AS BIGINT) AS n_pred
      FROM g WINDOW w AS (ORDER BY batch))
SELECT batch, exact, n_ref, n_pred, round(CASE WHEN n_pred = 0 THEN 0.0 ELSE exact / n_pred END * 100, 6) AS precision,
       round(CASE WHEN n_ref = 0 THEN 0.0 ELSE exact / n_ref END * 100, 6) AS recall,
       round(CASE WHEN exact = 0 THEN 0.0 ELSE 2.0 * exact / (n_pred + n_ref) END * 100, 6) AS f1
FROM t""")
def q_stream_running_scores(spark, sf):
    """The tagger's score after each of four batches of test documents."""
    landed = scratch_path(spark, "test-docs-in")
    d = docs(spark, sf).where(F.col("doc_id") % 5 == 0)
    landings = [d.where(F.floor(F.col("doc_id") / 5) % 4 == g) for g in range(4)]  # one after the other
    r = running_scores(spark, _batch_counts(spark, sf, landings, landed), scratch_path(spark, "totals-out"), scratch_path(spark, "totals-ckpt"))
    return bigint(r.select("batch", "exact", "n_ref", "n_pred", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")]), "batch")


@register("stream_scores")
def q_stream_scores(spark, sf):
    from tessera.operators.evaluate import match_counts, prf
    from tessera.operators.tags import fit_tagger, iob_decode, predict_tags, bio_encode
    from tessera.operators.tokens import with_sentence_idx
    lab, runs = TG.labelled(spark, sf)
    model = materialize(fit_tagger(lab.where(F.col("doc_id") % 5 != 0)), "model")
    src = scratch_path(spark, "test-docs-in")
    n = _land(docs(spark, sf).where(F.col("doc_id") % 5 == 0), src, 4)

    def score(batch):
        tok = with_sentence_idx(tokenize(batch))
        r = TG.reference_runs(tok)
        pred = predict_tags(bio_encode(tok, r), model)
        ps = iob_decode(pred, label="pred", segment="sent_idx").select("doc_id", "begin", "end", "ner_type")
        return match_counts(r, ps)

    counts = stream_table(spark, src, "doc_id bigint, text string", scratch_path(spark, "scores-out"),
                          scratch_path(spark, "scores-ckpt"), score, max_files=n)
    totals = counts.groupBy("doc_id").agg(*[F.max(c).alias(c) for c in ("exact", "n_ref", "n_pred")])
    r = prf(totals)
    return r.select("exact", "n_ref", "n_pred", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


ORACLES["stream_scores"] = ORACLES["tagger_eval"]
