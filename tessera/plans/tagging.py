"""Driver queries for tag encoding/decoding, the lexicon tagger and scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.tokens import as_list


def _with_runs(tokens: DataFrame, key: str | list[str]) -> DataFrame:
    """Tokens with ``_cap`` (capitalised), ``_brk`` (starts a run, or is none)
    and ``run`` (running count of ``_brk``: the same for all of a run)."""
    w = Window.partitionBy(*as_list(key)).orderBy("tok_idx")
    t = tokens.withColumn("_cap", F.col("token").rlike(r"^\p{Lu}"))
    t = t.withColumn("_brk", F.when(F.col("_cap") & F.coalesce(F.lag("_cap").over(w), F.lit(False))
                                    & (F.lag("end").over(w) + 1 == F.col("begin")), 0).otherwise(1))
    return t.withColumn("run", F.sum("_brk").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def capital_runs(tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """Runs of capitalised tokens separated by exactly one space:
    ``key, begin, end, first_tok, last_tok, first_text``. Tokens that carry their ``run``
    (:func:`capital_labels`) are grouped as they are: only the capitalised
    ones are read and no token is sorted again."""
    cap = F.col("token").rlike(r"^\p{Lu}")
    t = tokens if "run" in tokens.columns else _with_runs(tokens, key)
    return (t.where(cap).groupBy(key, "run")
            .agg(F.min("begin").alias("begin"), F.max("end").alias("end"),
                 F.min("tok_idx").alias("first_tok"), F.max("tok_idx").alias("last_tok"),
                 F.min_by("token", "tok_idx").alias("first_text"))
            .drop("run"))


def capital_labels(tokens: DataFrame, key: str | list[str] = "doc_id") -> DataFrame:
    """BIO label of capitalised runs straight from the run-detection
    windows (same labels as ``bio_encode`` with the run spans, without the
    range join), and each token's ``run``: used to build the tagging fixtures."""
    w = Window.partitionBy(*as_list(key)).orderBy("tok_idx")
    t = _with_runs(tokens, key)
    t = t.withColumn("_first", F.last(F.when(F.col("_cap") & (F.col("_brk") == 1), F.col("token")), ignorenulls=True)
                     .over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    lab = (F.when(~F.col("_cap"), F.lit("O"))
           .when(F.col("_brk") == 1, F.concat(F.lit("B-"), run_type(F.col("token"))))
           .otherwise(F.concat(F.lit("I-"), run_type(F.col("_first")))))
    return t.withColumn("label", lab).drop("_cap", "_brk", "_first")


def run_type(first_text):
    """Entity type of a capitalised run by its initial letter (test rule)."""
    c = F.substring(first_text, 1, 1)
    return (F.when(c.between("A", "F"), "PER").when(c.between("G", "M"), "LOC")
            .when(c.between("N", "S"), "ORG").otherwise("MISC"))


# ---------------------------------------------------------------- queries

from tessera.operators.evaluate import (  # noqa: E402
    align_tokens, conll_eval, corpus_stats, match_counts, prf, type_distribution, missed_and_spurious,
)
from tessera.operators.tags import (  # noqa: E402
    bio_encode, build_vocab, chain_taggers, export_features, fit_tagger, group_sentences,
    index_tags, iob_decode, predict_tags,
)
from tessera.operators.tokens import tokenize, with_sentence_idx  # noqa: E402
from tessera.plans.registry import register  # noqa: E402
from tessera.plans.sqlfrag import sentences_cte, tokens_cte  # noqa: E402
from tessera.sources.sinks import (  # noqa: E402
    eval_report, load_tagger, load_vocab, save_tagger, save_vocab,
)
from tessera.util import materialize, materialize_by, read_table, scratch_path  # noqa: E402

CAP = "regexp_matches(token, '^\\p{Lu}')"
TYPE_SQL = """CASE WHEN substring({x}, 1, 1) BETWEEN 'A' AND 'F' THEN 'PER'
              WHEN substring({x}, 1, 1) BETWEEN 'G' AND 'M' THEN 'LOC'
              WHEN substring({x}, 1, 1) BETWEEN 'N' AND 'S' THEN 'ORG' ELSE 'MISC' END"""
SHAPE_SQL = """(CASE WHEN regexp_matches(substring({x}, 1, 1), '^\\p{{Lu}}$') THEN 'A'
       WHEN regexp_matches(substring({x}, 1, 1), '^\\p{{Ll}}$') THEN 'a'
       WHEN regexp_matches(substring({x}, 1, 1), '^\\p{{N}}$') THEN '0' ELSE substring({x}, 1, 1) END
  || CASE WHEN regexp_matches(substring({x}, 2), '\\p{{Lu}}') THEN 'A'
          WHEN regexp_matches(substring({x}, 2), '\\p{{N}}') THEN '0' ELSE 'a' END
  || CAST(least(length({x}), 5) AS VARCHAR))"""

LAB_SQL = f"""{tokens_cte("documents")}, {sentences_cte()},
caps AS (
  SELECT doc_id, min(begin) AS rb, max("end") AS re, arg_min(token, tok_idx) AS first_text, count(*) AS n_units FROM (
    SELECT *, sum(brk) OVER (PARTITION BY doc_id ORDER BY tok_idx) AS grp FROM (
      SELECT *, CASE WHEN {CAP} AND coalesce(lag({CAP}) OVER w, false) AND lag("end") OVER w + 1 = begin
                THEN 0 ELSE 1 END AS brk
      FROM tokens WINDOW w AS (PARTITION BY doc_id ORDER BY tok_idx)))
  WHERE {CAP} GROUP BY doc_id, grp),
runs AS (SELECT doc_id, rb AS begin, re AS "end", {TYPE_SQL.format(x="first_text")} AS ner_type, n_units FROM caps),
lab AS (
  SELECT t.doc_id, t.tok_idx, t.sent_idx, t.begin, t."end", t.token, {SHAPE_SQL.format(x="t.token")} AS shape,
         CASE WHEN r.begin IS NULL THEN 'O' WHEN r.begin = t.begin THEN 'B-' || r.ner_type ELSE 'I-' || r.ner_type END AS label
  FROM sentences_t t LEFT JOIN runs r ON r.doc_id = t.doc_id AND r.begin <= t.begin AND t."end" <= r."end")"""

MODEL_SQL = f"""{LAB_SQL},
train AS (SELECT * FROM lab WHERE doc_id % 5 <> 0),
test AS (SELECT * FROM lab WHERE doc_id % 5 = 0),
fbest AS (SELECT feature, tag FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY n DESC, tag) AS rn
          FROM (SELECT token AS feature, label AS tag, count(*) AS n FROM train GROUP BY 1, 2)) WHERE rn = 1),
sbest AS (SELECT feature, tag FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY n DESC, tag) AS rn
          FROM (SELECT shape AS feature, label AS tag, count(*) AS n FROM train GROUP BY 1, 2)) WHERE rn = 1),
pred AS (SELECT t.*, coalesce(f.tag, s.tag, 'O') AS pred FROM test t
         LEFT JOIN fbest f ON f.feature = t.token LEFT JOIN sbest s ON s.feature = t.shape),
pisl AS (
  SELECT *, sum(brk) OVER (PARTITION BY doc_id ORDER BY tok_idx) AS isl FROM (
    SELECT *, CASE WHEN lag(tok_idx) OVER w IS NULL OR substring(pred, 1, 1) IN ('O', 'B')
                     OR (substring(pred, 1, 1) = 'I' AND string_split(pred, '-')[-1] <> lag(string_split(pred, '-')[-1]) OVER w)
                     OR lag(sent_idx) OVER w <> sent_idx THEN 1 ELSE 0 END AS brk
    FROM pred WINDOW w AS (PARTITION BY doc_id ORDER BY tok_idx))),
pspans AS (
  SELECT doc_id, min(begin) AS begin, max("end") AS "end", string_split(arg_min(pred, tok_idx), '-')[-1] AS ner_type
  FROM pisl GROUP BY doc_id, isl HAVING string_split(arg_min(pred, tok_idx), '-')[-1] <> 'O'),
rspans AS (SELECT * FROM runs WHERE doc_id % 5 = 0),
counts AS (
  SELECT coalesce(r.doc_id, p.doc_id) AS doc_id, coalesce(x.exact, 0) AS exact, coalesce(r.n, 0) AS n_ref, coalesce(p.n, 0) AS n_pred
  FROM (SELECT doc_id, count(*) AS n FROM rspans GROUP BY doc_id) r
  FULL OUTER JOIN (SELECT doc_id, count(*) AS n FROM pspans GROUP BY doc_id) p ON r.doc_id = p.doc_id
  LEFT JOIN (SELECT a.doc_id, count(*) AS exact FROM (SELECT DISTINCT doc_id, begin, "end", ner_type FROM rspans) a
             SEMI JOIN (SELECT DISTINCT doc_id, begin, "end", ner_type FROM pspans) b
             ON a.doc_id = b.doc_id AND a.begin = b.begin AND a."end" = b."end" AND a.ner_type IS NOT DISTINCT FROM b.ner_type
             GROUP BY a.doc_id) x ON x.doc_id = coalesce(r.doc_id, p.doc_id))"""


def labelled(spark, sf):
    """Tokens with sentence ordinal, shape and the BIO label of capitalised
    runs (the reference annotation of the tagging queries)."""
    d = read_table(spark, sf, "documents").select("doc_id", "text")
    tok = capital_labels(with_sentence_idx(tokenize(d))).drop("is_end", "word_idx")
    # in buckets: decoding and runs need no exchange of tokens
    lab = materialize_by(tok, "doc_id", "labelled")
    runs = materialize(reference_runs(lab), "runs")
    return lab, runs


def reference_runs(tok):
    r = capital_runs(tok)
    return r.select("doc_id", "begin", "end", run_type(F.col("first_text")).alias("ner_type"),
                    (F.col("last_tok") - F.col("first_tok") + 1).alias("n_units"))


def _big(df, *cols):
    return df.select(*[F.col(c).cast("bigint").alias(c) if c in cols else F.col(c) for c in df.columns])


@register("bio_roundtrip", sql=f"""WITH {LAB_SQL},
isl AS (SELECT *, sum(brk) OVER (PARTITION BY doc_id ORDER BY tok_idx) AS g FROM (
  SELECT *, CASE WHEN lag(tok_idx) OVER w IS NULL OR substring(label, 1, 1) IN ('O', 'B')
                   OR (substring(label, 1, 1) = 'I' AND string_split(label, '-')[-1] <> lag(string_split(label, '-')[-1]) OVER w)
                   OR lag(sent_idx) OVER w <> sent_idx THEN 1 ELSE 0 END AS brk
  FROM lab WINDOW w AS (PARTITION BY doc_id ORDER BY tok_idx)))
SELECT doc_id, CAST(min(begin) AS BIGINT) AS begin, CAST(max("end") AS BIGINT) AS "end",
       string_split(arg_min(label, tok_idx), '-')[-1] AS ner_type, CAST(count(*) AS BIGINT) AS n_units
FROM isl GROUP BY doc_id, g HAVING string_split(arg_min(label, tok_idx), '-')[-1] <> 'O'""")
def q_bio_roundtrip(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", "text")
    tok = with_sentence_idx(tokenize(d))
    lab = bio_encode(tok, reference_runs(tok))
    sp = iob_decode(lab, segment="sent_idx")
    return _big(sp.select("doc_id", "begin", "end", "ner_type", "n_units"), "begin", "end", "n_units")


@register("vocab", sql=f"""WITH {LAB_SQL}
SELECT tag, CAST(row_number() OVER (ORDER BY n DESC, tag) - 1 AS BIGINT) AS id, CAST(n AS BIGINT) AS n
FROM (SELECT label AS tag, count(*) AS n FROM lab GROUP BY label)""")
def q_vocab(spark, sf):
    lab, _ = labelled(spark, sf)
    return _big(build_vocab(lab), "id", "n")


@register("features", sql=f"""WITH {LAB_SQL},
v AS (SELECT tag, row_number() OVER (ORDER BY n DESC, tag) - 1 AS id FROM (SELECT label AS tag, count(*) AS n FROM lab GROUP BY label)),
seq AS (SELECT l.doc_id, l.sent_idx, list(v.id ORDER BY l.tok_idx) AS ids FROM lab l JOIN v ON v.tag = l.label
        GROUP BY l.doc_id, l.sent_idx),
b AS (SELECT *, CAST(floor(sent_idx / 16) AS BIGINT) AS batch FROM seq),
m AS (SELECT *, max(len(ids)) OVER (PARTITION BY doc_id, batch) AS mx FROM b)
SELECT doc_id, CAST(sent_idx AS BIGINT) AS sent_idx, batch, CAST(len(ids) AS BIGINT) AS length,
       array_to_string(ids, ',') || repeat(',-100', CAST(mx - len(ids) AS BIGINT)) AS ids,
       array_to_string(list_transform(ids, lambda x: 1), ',') || repeat(',0', CAST(mx - len(ids) AS BIGINT)) AS mask
FROM m""")
def q_features(spark, sf):
    lab, _ = labelled(spark, sf)
    f = export_features(index_tags(lab, build_vocab(lab)), batch_size=16)
    return _big(f.select("doc_id", "sent_idx", "batch", "length", F.array_join("ids", ",").alias("ids"),
                         F.array_join("mask", ",").alias("mask")), "sent_idx", "batch", "length")


def _fit_predict(spark, sf):
    lab, runs = labelled(spark, sf)
    lab = lab.withColumn("_test", F.col("doc_id") % 5 == 0)
    # K4: fitted once, written, and read by every prediction
    path = scratch_path(spark, "tagger")
    save_tagger(fit_tagger(lab.where(~F.col("_test"))), path)
    model = load_tagger(spark, path)
    pred = predict_tags(lab.where(F.col("_test")), model)
    return lab, runs, model, pred


def _pred_spans(pred):
    """The decoded predictions, written once: scores read them several times."""
    spans = iob_decode(pred, label="pred", segment="sent_idx").select("doc_id", "begin", "end", "ner_type")
    return materialize(spans, "predicted-spans")


@register("tagger_fit_predict", sql=f"""WITH {MODEL_SQL}
SELECT doc_id, CAST(tok_idx AS BIGINT) AS tok_idx, token, label, pred FROM pred""")
def q_tagger_fit_predict(spark, sf):
    _, _, _, pred = _fit_predict(spark, sf)
    return _big(pred.select("doc_id", "tok_idx", "token", "label", "pred"), "tok_idx")


@register("match_counts", sql=f"""WITH {MODEL_SQL}
SELECT d.doc_id, CAST(coalesce(exact, 0) AS BIGINT) AS exact, CAST(coalesce(n_ref, 0) AS BIGINT) AS n_ref,
       CAST(coalesce(n_pred, 0) AS BIGINT) AS n_pred
FROM documents d LEFT JOIN counts c ON c.doc_id = d.doc_id""")
def q_match_counts(spark, sf):
    """Counts of the held-out spans; every document has its row."""
    _, runs, _, pred = _fit_predict(spark, sf)
    return match_counts(runs.where(F.col("doc_id") % 5 == 0), _pred_spans(pred), docs=read_table(spark, sf, "documents"))


@register("tagger_eval", sql=f"""WITH {MODEL_SQL},
s AS (SELECT CAST(sum(exact) AS BIGINT) AS exact, CAST(sum(n_ref) AS BIGINT) AS n_ref, CAST(sum(n_pred) AS BIGINT) AS n_pred FROM counts)
SELECT exact, n_ref, n_pred,
       round(CASE WHEN n_pred = 0 THEN 0.0 ELSE exact / n_pred END * 100, 6) AS precision,
       round(CASE WHEN n_ref = 0 THEN 0.0 ELSE exact / n_ref END * 100, 6) AS recall,
       round(CASE WHEN exact = 0 THEN 0.0 ELSE 2.0 * exact / (n_pred + n_ref) END * 100, 6) AS f1
FROM s""")
def q_tagger_eval(spark, sf):
    _, runs, _, pred = _fit_predict(spark, sf)
    r = prf(match_counts(runs.where(F.col("doc_id") % 5 == 0), _pred_spans(pred)))
    return r.select("exact", "n_ref", "n_pred", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@register("conll_eval", sql=f"""WITH {MODEL_SQL},
ex AS (SELECT a.* FROM (SELECT DISTINCT doc_id, begin, "end", ner_type FROM rspans) a
       SEMI JOIN (SELECT DISTINCT doc_id, begin, "end", ner_type FROM pspans) b
       ON a.doc_id = b.doc_id AND a.begin = b.begin AND a."end" = b."end" AND a.ner_type = b.ner_type),
rows AS (SELECT ner_type, 1 AS r, 0 AS p, 0 AS x FROM rspans UNION ALL SELECT ner_type, 0, 1, 0 FROM pspans
         UNION ALL SELECT ner_type, 0, 0, 1 FROM ex),
g AS (SELECT CASE WHEN grouping(ner_type) = 1 THEN 'Overall' ELSE ner_type END AS ner_type,
             sum(r) AS n_ref, sum(p) AS n_pred, sum(x) AS exact FROM rows GROUP BY GROUPING SETS ((ner_type), ())),
acc AS (SELECT sum(CASE WHEN label IS NOT DISTINCT FROM pred THEN 1 ELSE 0 END) * 100.0 / count(*) AS accuracy FROM pred)
SELECT ner_type, CAST(n_ref AS BIGINT) AS n_ref, CAST(n_pred AS BIGINT) AS n_pred, CAST(exact AS BIGINT) AS exact,
       round(CASE WHEN n_pred = 0 THEN 0.0 ELSE exact / n_pred END * 100, 6) AS precision,
       round(CASE WHEN n_ref = 0 THEN 0.0 ELSE exact / n_ref END * 100, 6) AS recall,
       round(CASE WHEN exact = 0 THEN 0.0 ELSE 2.0 * exact / (n_pred + n_ref) END * 100, 6) AS f1,
       round(accuracy, 6) AS accuracy
FROM g, acc""")
def q_conll_eval(spark, sf):
    lab, runs, _, pred = _fit_predict(spark, sf)
    aligned = align_tokens(lab.where(F.col("doc_id") % 5 == 0), pred)
    out = conll_eval(runs.where(F.col("doc_id") % 5 == 0), _pred_spans(pred), aligned)
    return out.select("ner_type", "n_ref", "n_pred", "exact",
                      *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "accuracy")])


@register("sentence_tag_report", sql=f"""WITH {LAB_SQL}, {sentences_cte("tokens", name="sents")}
SELECT s.doc_id, CAST(s.sent_idx AS BIGINT) AS sent_idx, md5(substring(d.text, s.begin + 1, s."end" - s.begin)) AS text_md5,
       coalesce(string_agg(substring(d.text, r.begin + 1, r."end" - r.begin) || '=' || r.ner_type, '|' ORDER BY r.begin), '') AS tags
FROM sents s JOIN documents d USING (doc_id)
LEFT JOIN runs r ON r.doc_id = s.doc_id AND s.begin <= r.begin AND r."end" <= s."end"
GROUP BY s.doc_id, s.sent_idx, s.begin, s."end", d.text""")
def q_sentence_tag_report(spark, sf):
    from tessera.operators.qa import sentence_tag_report
    d = read_table(spark, sf, "documents").select("doc_id", "text")
    tok = tokenize(d)
    from tessera.operators.tokens import split_sentences
    out = sentence_tag_report(d, split_sentences(tok), reference_runs(tok), attrs=("ner_type",))
    return _big(out, "sent_idx")


@register("chain_taggers", sql=f"""WITH {MODEL_SQL.replace("test AS (SELECT * FROM lab WHERE doc_id % 5 = 0)", "test AS (SELECT * FROM lab)")},
lk AS (SELECT doc_id, rb AS begin, re AS "end", 'L:' || lower(first_text) AS umls_link FROM caps)
SELECT coalesce(p.doc_id, l.doc_id) AS doc_id, CAST(coalesce(p.begin, l.begin) AS BIGINT) AS begin,
       CAST(coalesce(p."end", l."end") AS BIGINT) AS "end", p.ner_type, l.umls_link
FROM pspans p FULL OUTER JOIN lk l ON p.doc_id = l.doc_id AND p.begin = l.begin AND p."end" = l."end" """)
def q_chain_taggers(spark, sf):
    """Both taggers over every document."""
    lab, _, model, _ = _fit_predict(spark, sf)
    pred = predict_tags(lab, model)
    lk = capital_runs(lab).select("doc_id", "begin", "end",
                                  F.concat(F.lit("L:"), F.lower("first_text")).alias("umls_link"))
    out = chain_taggers(_pred_spans(pred), lk)
    return _big(out.select("doc_id", "begin", "end", "ner_type", "umls_link"), "begin", "end")


@register("error_listing", sql=f"""WITH {MODEL_SQL},
r AS (SELECT DISTINCT doc_id, begin, "end", ner_type FROM rspans), p AS (SELECT DISTINCT doc_id, begin, "end", ner_type FROM pspans)
SELECT 'missed' AS kind, doc_id, CAST(begin AS BIGINT) AS begin, CAST("end" AS BIGINT) AS "end", ner_type FROM (SELECT * FROM r EXCEPT SELECT * FROM p)
UNION ALL
SELECT 'spurious', doc_id, CAST(begin AS BIGINT), CAST("end" AS BIGINT), ner_type FROM (SELECT * FROM p EXCEPT SELECT * FROM r)""")
def q_error_listing(spark, sf):
    """U3 over the held-out spans: missed and spurious."""
    _, runs, _, pred = _fit_predict(spark, sf)
    missed, spurious = missed_and_spurious(runs.where(F.col("doc_id") % 5 == 0), _pred_spans(pred))
    out = missed.withColumn("kind", F.lit("missed")).unionByName(spurious.withColumn("kind", F.lit("spurious")))
    return _big(out.select("kind", "doc_id", "begin", "end", "ner_type"), "begin", "end")


@register("aligned_tags", sql=f"""WITH {MODEL_SQL}
SELECT coalesce(l.doc_id, p.doc_id) AS doc_id, CAST(coalesce(l.tok_idx, p.tok_idx) AS BIGINT) AS tok_idx, l.label, p.pred
FROM (SELECT doc_id, tok_idx, label FROM lab WHERE tok_idx % 7 <> 0) l
FULL OUTER JOIN (SELECT doc_id, tok_idx, pred FROM pred WHERE tok_idx % 5 <> 0) p ON l.doc_id = p.doc_id AND l.tok_idx = p.tok_idx""")
def q_aligned_tags(spark, sf):
    """J11 with units missing on both sides: every seventh has no reference,
    every fifth and every training document no prediction."""
    lab, _, _, pred = _fit_predict(spark, sf)
    out = align_tokens(lab.where(F.col("tok_idx") % 7 != 0), pred.where(F.col("tok_idx") % 5 != 0))
    return _big(out, "tok_idx")


@register("vocab_roundtrip", sql=f"""WITH {LAB_SQL}
SELECT l.doc_id, CAST(l.tok_idx AS BIGINT) AS tok_idx, CAST(v.id AS BIGINT) AS tag_id
FROM lab l JOIN (SELECT tag, row_number() OVER (ORDER BY n DESC, tag) - 1 AS id
                 FROM (SELECT label AS tag, count(*) AS n FROM lab GROUP BY label)) v ON v.tag = l.label""")
def q_vocab_roundtrip(spark, sf):
    """K3: the vocabulary written, read and applied."""
    lab, _ = labelled(spark, sf)
    path = scratch_path(spark, "vocab")
    save_vocab(build_vocab(lab), path)
    return _big(index_tags(lab, load_vocab(spark, path)).select("doc_id", "tok_idx", "tag_id"), "tok_idx", "tag_id")


@register("eval_report", sql=f"""WITH {MODEL_SQL}
SELECT CAST(doc_id AS VARCHAR) || ' ' || exact || ' ' || n_ref || ' ' || n_pred AS line FROM counts""")
def q_eval_report(spark, sf):
    """K6: the report written and read back line by line."""
    _, runs, _, pred = _fit_predict(spark, sf)
    counts = match_counts(runs.where(F.col("doc_id") % 5 == 0), _pred_spans(pred))
    path = scratch_path(spark, "eval-report")
    eval_report(counts, prf(counts), path)
    return spark.read.text(path + "/per_document").select(F.col("value").alias("line"))


@register("type_distribution", sql=f"""WITH {LAB_SQL}
SELECT ner_type, CAST(count(*) AS BIGINT) AS n, CAST((SELECT count(DISTINCT ner_type) FROM runs) AS BIGINT) AS n_classes
FROM runs GROUP BY ner_type""")
def q_type_distribution(spark, sf):
    _, runs = labelled(spark, sf)
    return _big(type_distribution(runs), "n", "n_classes")


@register("corpus_stats", sql=f"""WITH {MODEL_SQL},
e AS (SELECT doc_id, CAST(floor(sent_idx / 16) AS BIGINT) AS batch, CASE WHEN label = pred THEN 0.0 ELSE 1.0 END AS err FROM pred),
b AS (SELECT doc_id, batch, avg(err) AS e, count(*) AS w FROM e GROUP BY doc_id, batch),
seq AS (SELECT doc_id, sent_idx, count(*) AS length FROM lab GROUP BY doc_id, sent_idx)
SELECT CAST((SELECT count(*) FROM seq) AS BIGINT) AS n_examples, round((SELECT avg(length) FROM seq), 6) AS mean_length,
       round((SELECT sum(e * w) / sum(w) FROM b), 6) AS mean_error""")
def q_corpus_stats(spark, sf):
    lab, _, _, pred = _fit_predict(spark, sf)
    feats = export_features(index_tags(lab, build_vocab(lab)), batch_size=16)
    errs = pred.select("doc_id", F.floor(F.col("sent_idx") / 16).alias("batch"),
                       F.when(F.col("label") == F.col("pred"), 0.0).otherwise(1.0).alias("err"))
    out = corpus_stats(feats, errs)
    return out.select(F.col("n_examples").cast("bigint").alias("n_examples"),
                      F.round("mean_length", 6).alias("mean_length"), F.round("mean_error", 6).alias("mean_error"))


@register("group_sentences", sql=f"""WITH {tokens_cte("documents")}, {sentences_cte()}
SELECT doc_id, CAST(floor(sent_idx / 3) AS BIGINT) AS "group", CAST(min(begin) AS BIGINT) AS begin,
       CAST(max("end") AS BIGINT) AS "end", CAST(count(*) AS BIGINT) AS n_sentences
FROM sentences GROUP BY doc_id, floor(sent_idx / 3)""")
def q_group_sentences(spark, sf):
    from tessera.operators.tokens import split_sentences
    d = read_table(spark, sf, "documents").select("doc_id", "text")
    g = group_sentences(split_sentences(tokenize(d)), 3)
    return _big(g, "group", "begin", "end", "n_sentences")


@register("train_and_score", sql=f"""WITH {MODEL_SQL},
s AS (SELECT CAST(sum(exact) AS BIGINT) AS exact, CAST(sum(n_ref) AS BIGINT) AS n_ref, CAST(sum(n_pred) AS BIGINT) AS n_pred FROM counts),
a AS (SELECT avg(CASE WHEN label = pred THEN 1.0 ELSE 0.0 END) * 100 AS accuracy FROM pred)
SELECT exact, n_ref, n_pred,
       round(CASE WHEN n_pred = 0 THEN 0.0 ELSE exact / n_pred END * 100, 6) AS precision,
       round(CASE WHEN n_ref = 0 THEN 0.0 ELSE exact / n_ref END * 100, 6) AS recall,
       round(CASE WHEN exact = 0 THEN 0.0 ELSE 2.0 * exact / (n_pred + n_ref) END * 100, 6) AS f1,
       round(accuracy, 6) AS accuracy
FROM s, a""")
def q_train_and_score(spark, sf):
    from tessera.operators.tags import train_and_score
    lab, runs = labelled(spark, sf)
    test = F.col("doc_id") % 5 == 0
    r = train_and_score(lab.where(~test), lab.where(test), runs.where(test))
    return r.select("exact", "n_ref", "n_pred",
                    *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "accuracy")])
