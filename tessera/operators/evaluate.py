"""Set-based scoring of predicted spans against references (E1-E3, E5,
E6, J6, J11, U2, U3). Matching is on distinct (document, span, attribute)
tuples with null-safe attribute equality; raw counts keep duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _tuples(df: DataFrame, key: str, attr: str | None) -> DataFrame:
    cols = [key, "begin", "end"] + ([attr] if attr else [])
    return df.select(*cols).distinct()


def exact_match(ref: DataFrame, pred: DataFrame, key: str = "doc_id", attr: str | None = "ner_type") -> DataFrame:
    """Reference tuples matched by a predicted tuple (J6 / U2); each
    reference tuple matches at most once."""
    r, p = _tuples(ref, key, attr), _tuples(pred, key, attr)
    cond = (r[key] == p[key]) & (r["begin"] == p["begin"]) & (r["end"] == p["end"])
    if attr:
        cond = cond & r[attr].eqNullSafe(p[attr])
    return r.join(p, cond, "left_semi")


def missed_and_spurious(ref: DataFrame, pred: DataFrame, key: str = "doc_id", attr: str | None = "ner_type"):
    """Complement of the match (U3): (reference not predicted, predicted
    not in reference)."""
    r, p = _tuples(ref, key, attr), _tuples(pred, key, attr)
    return r.exceptAll(p), p.exceptAll(r)


def match_counts(ref: DataFrame, pred: DataFrame, key: str = "doc_id", attr: str | None = "ner_type",
                 docs: DataFrame | None = None) -> DataFrame:
    """Per document ``exact, n_ref, n_pred`` (E1). With ``docs`` every
    document has its row, ``0 0 0`` where neither side has a span."""
    ex = exact_match(ref, pred, key, attr).groupBy(key).agg(F.count(F.lit(1)).alias("exact"))
    nr = ref.groupBy(key).agg(F.count(F.lit(1)).alias("n_ref"))
    npred = pred.groupBy(key).agg(F.count(F.lit(1)).alias("n_pred"))
    out = nr.join(npred, key, "full_outer").join(ex, key, "left")
    if docs is not None:
        out = docs.select(key).distinct().join(out, key, "left")
    return out.select(key, *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("exact", "n_ref", "n_pred")])


def prf(counts: DataFrame, compat: bool = False) -> DataFrame:
    """Corpus precision / recall / F1 in percent (E2). Zero denominators
    give 0.0; ``compat`` reproduces the swapped names (Q10)."""
    s = counts.agg(*[F.sum(c).cast("bigint").alias(c) for c in ("exact", "n_ref", "n_pred")])
    return with_prf(s, compat)


def with_prf(totals: DataFrame, compat: bool = False) -> DataFrame:
    """Rows of totals ``exact, n_ref, n_pred`` with ``precision``, ``recall``
    and ``f1`` of each; other columns pass through."""
    p = F.coalesce(F.try_divide(F.col("exact").cast("double"), F.col("n_pred")), F.lit(0.0))
    r = F.coalesce(F.try_divide(F.col("exact").cast("double"), F.col("n_ref")), F.lit(0.0))
    if compat:
        p, r = r, p
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
    return totals.select("*", (p * 100).alias("precision"), (r * 100).alias("recall"), (f1 * 100).alias("f1"))


def align_tokens(ref_tags: DataFrame, pred_tags: DataFrame, key: str = "doc_id", unit: str = "tok_idx",
                 ref: str = "label", pred: str = "pred") -> DataFrame:
    """Reference and predicted tag per unit (J11): full outer join."""
    return ref_tags.select(key, unit, ref).join(pred_tags.select(key, unit, pred), [key, unit], "full_outer")


def conll_eval(ref_spans: DataFrame, pred_spans: DataFrame, aligned: DataFrame, key: str = "doc_id",
               ref: str = "label", pred: str = "pred") -> DataFrame:
    """Token accuracy and chunk P/R/F1 per type plus an ``Overall`` row
    (E3). ``ref_spans``/``pred_spans`` are decoded spans with ``ner_type``."""
    acc = aligned.agg((F.sum(F.col(ref).eqNullSafe(F.col(pred)).cast("int")) / F.count(F.lit(1)) * 100)
                      .alias("accuracy"))
    ex = exact_match(ref_spans, pred_spans, key, "ner_type")
    rows = (ref_spans.select("ner_type", F.lit(1).alias("r"), F.lit(0).alias("p"), F.lit(0).alias("x"))
            .unionByName(pred_spans.select("ner_type", F.lit(0).alias("r"), F.lit(1).alias("p"), F.lit(0).alias("x")))
            .unionByName(ex.select("ner_type", F.lit(0).alias("r"), F.lit(0).alias("p"), F.lit(1).alias("x"))))
    g = rows.cube("ner_type").agg(F.sum("r").alias("n_ref"), F.sum("p").alias("n_pred"), F.sum("x").alias("exact"),
                                  F.grouping("ner_type").alias("_g"))
    g = g.select(F.when(F.col("_g") == 1, F.lit("Overall")).otherwise(F.col("ner_type")).alias("ner_type"),
                 "n_ref", "n_pred", "exact")
    p = F.coalesce(F.try_divide(F.col("exact").cast("double"), F.col("n_pred")), F.lit(0.0))
    r = F.coalesce(F.try_divide(F.col("exact").cast("double"), F.col("n_ref")), F.lit(0.0))
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
    return g.crossJoin(F.broadcast(acc)).select(
        "ner_type", F.col("n_ref").cast("bigint").alias("n_ref"), F.col("n_pred").cast("bigint").alias("n_pred"),
        F.col("exact").cast("bigint").alias("exact"), (p * 100).alias("precision"), (r * 100).alias("recall"),
        (f1 * 100).alias("f1"), "accuracy")


def corpus_stats(features: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Examples, mean sequence length and (if given) the per-batch error
    rate averaged with batch-size weights (E5)."""
    out = features.agg(F.count(F.lit(1)).alias("n_examples"), F.avg("length").alias("mean_length"))
    if errors is not None:
        b = errors.groupBy("doc_id", "batch").agg(F.avg("err").alias("_e"), F.count(F.lit(1)).alias("_w"))
        w = b.agg((F.sum(F.col("_e") * F.col("_w")) / F.sum("_w")).alias("mean_error"))
        out = out.crossJoin(w)
    return out


def type_distribution(spans: DataFrame, exact: bool = True) -> DataFrame:
    """Instances per class and the number of classes."""
    n = spans.groupBy("ner_type").agg(F.count(F.lit(1)).alias("n"))
    k = spans.agg((F.countDistinct("ner_type") if exact else F.approx_count_distinct("ner_type")).alias("n_classes"))
    return n.crossJoin(F.broadcast(k))
