"""Tag sequences: BIO encode/decode, vocabulary, padded feature export, a
count-based lexicon tagger, chaining two taggers, sentence grouping
(A10-A15, E7).

Tagging units are any span table ``key, unit_idx, begin, end`` (A1 tokens
by default). Windows are partitioned by document (bounded by one document).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import last_dash_part


def bio_encode(units: DataFrame, mentions: DataFrame, attr: str = "ner_type",
               key: str = "doc_id", unit_idx: str = "tok_idx") -> DataFrame:
    """Per unit ``B-x`` / ``I-x`` / ``O`` from the mentions containing it.

    ``x`` is the mention's ``attr``; a null attribute gives ``O``. A unit in
    several mentions takes the one with the smallest ``(begin, -end)``.
    Output: units columns + ``label``.
    """
    # A mention inside an earlier one of the order (begin, -end) is never chosen;
    # of the others begins and ends rise together, so the one to choose is the
    # first that ends at or after the unit, if it begins early enough. Units and
    # mentions stay with their document: no pairs are made.
    wm = Window.partitionBy(key).orderBy("_b", F.desc("_e"))
    m = mentions.select(key, F.col("begin").alias("_b"), F.col("end").alias("_e"), F.col(attr).alias("_attr"))
    reach = F.max("_e").over(wm.rowsBetween(Window.unboundedPreceding, -1))
    m = m.withColumn("_reach", reach).where(F.col("_reach").isNull() | (F.col("_e") > F.col("_reach")))
    m = m.select(key, F.col("_e").alias("_at"), F.lit(0).alias("_ask"),
                 F.when(F.col(key).isNotNull(), F.struct("_b", "_e", "_attr")).alias("_m"))
    # the key stands outside the struct alone: the union then keeps the partitioning by it, and no unit is shuffled
    rest = [c for c in units.columns if c != key]
    u = units.select(key, F.col("end").alias("_at"), F.lit(1).alias("_ask"), F.struct(*rest).alias("_u"))
    both = u.unionByName(m, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(F.desc("_at"), "_ask").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumn("_m", F.last("_m", ignorenulls=True).over(w)).where("_ask = 1")
    found = F.when((F.col("_m._b") <= F.col("_u.begin")) & (F.col("_u.end") <= F.col("_m._e")), F.col("_m"))
    # units of one ordinal share the mention
    same = Window.partitionBy(key).orderBy(unit_idx).rangeBetween(Window.currentRow, Window.currentRow)
    out = both.select(key, "_u.*", found.alias("_m")).withColumn(
        "_m", F.min_by("_m", F.when(F.col("_m").isNotNull(), F.struct("_m._b", -F.col("_m._e")))).over(same))
    first = F.row_number().over(Window.partitionBy(key, "_m._b", "_m._e").orderBy(unit_idx)) == 1
    lab = (F.when(F.col("_m").isNull() | F.col("_m._attr").isNull(), F.lit("O"))
           .when(first, F.concat(F.lit("B-"), F.col("_m._attr")))
           .otherwise(F.concat(F.lit("I-"), F.col("_m._attr"))))
    return out.withColumn("label", lab).select(*units.columns, "label")


def iob_decode(units: DataFrame, key: str | list[str] = "doc_id", unit_idx: str = "tok_idx",
               label: str = "label", segment: str | None = None, compat: bool = False) -> DataFrame:
    """Mentions from unit labels (A12), gaps-and-islands.

    A unit starts a new span when it is the first (of the document or of
    its ``segment``, e.g. sentence), its label is null or follows a null,
    its prefix is ``O`` or ``B``, or its prefix is ``I`` and its type (text
    after the last ``-``) differs from the open span's type. Other prefixes
    never break. Spans of type ``O`` and null labels are dropped.
    Output: ``key, begin, end, ner_type, first_unit, last_unit, n_units``.

    ``compat=True`` keeps the quirks of older readers: a span still open at
    the end of the document is dropped (Q1) and, with ``segment=None``,
    spans run on across sentence ends (Q5).
    """
    keys = [key] if isinstance(key, str) else list(key)
    w = Window.partitionBy(*keys).orderBy(unit_idx)
    u = units.withColumn("_t", last_dash_part(label)).withColumn("_p", F.substring(label, 1, 1))
    opener = F.col(label).isNull() | F.col("_p").isin("O", "B", "I")
    open_type = F.last(F.when(opener, F.col("_t")), ignorenulls=True).over(
        w.rowsBetween(Window.unboundedPreceding, -1))
    prev_label = F.lag(label).over(w)
    first = F.lag(unit_idx).over(w).isNull()
    brk = (first | F.col(label).isNull() | (prev_label.isNull() & ~first)
           | F.col("_p").isin("O", "B") | ((F.col("_p") == "I") & (F.col("_t") != open_type)))
    if segment is not None:
        brk = brk | (F.lag(segment).over(w) != F.col(segment))
    u = u.withColumn("_brk", brk.cast("int"))
    u = u.withColumn("_isl", F.sum("_brk").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # a unit without a span that stands alone is dropped before units are grouped
    alone = (F.col("_brk") == 1) & (F.coalesce(F.lead("_brk").over(w), F.lit(1)) == 1)
    spanned = u.withColumn("_out", alone & (F.col(label).isNull() | (F.col("_t") == "O"))).where(~F.col("_out"))
    isl = spanned.groupBy(*keys, "_isl").agg(
        F.min_by(F.struct(F.col(label).alias("l"), F.col("_t").alias("t")), F.col(unit_idx)).alias("_h"),
        F.min("begin").alias("begin"), F.max("end").alias("end"),
        F.min(unit_idx).alias("first_unit"), F.max(unit_idx).alias("last_unit"),
        F.count(F.lit(1)).alias("n_units"))
    out = isl.where(F.col("_h.l").isNotNull() & (F.col("_h.t") != "O"))
    if compat:
        last = u.groupBy(*keys).agg(F.max(unit_idx).alias("_last"))
        out = out.join(last, keys).where(F.col("last_unit") < F.col("_last")).drop("_last")
    return out.select(*keys, "begin", "end", F.col("_h.t").alias("ner_type"), "first_unit", "last_unit", "n_units")


# ------------------------------------------------------------- vocabulary

def build_vocab(tags: DataFrame, tag: str = "label") -> DataFrame:
    """Distinct tags -> dense ids by frequency (desc) then name:
    ``tag, id, n``. Ids come from a distributed sort (no single-partition
    window), so a linking vocabulary of millions of entity tags is fine."""
    from tessera.util import dense_ids
    counts = tags.groupBy(F.col(tag).alias("tag")).agg(F.count(F.lit(1)).alias("n"))
    return dense_ids(counts.where(F.col("tag").isNotNull()), [F.col("n").desc(), F.col("tag")])


def index_tags(units: DataFrame, vocab: DataFrame, tag: str = "label") -> DataFrame:
    """Units with ``tag_id``; a tag absent from the vocabulary gets null
    (no unknown id: the caller routes those rows to quarantine)."""
    from tessera.util import maybe_broadcast
    v = maybe_broadcast(vocab.select(F.col("tag").alias("_tag"), F.col("id").alias("tag_id")))
    return units.join(v, units[tag] == v["_tag"], "left").drop("_tag")


# ------------------------------------------------------- padded features

def export_features(units: DataFrame, key: str = "doc_id", segment: str = "sent_idx",
                    unit_idx: str = "tok_idx", value: str = "tag_id", batch_size: int = 32,
                    pad: int = -100) -> DataFrame:
    """Per segment (sentence): the id sequence padded to the longest
    sequence of its batch, the mask and the true length (A14).

    Batches are ``batch_size`` consecutive segments *of one document*
    (``batch = sent_idx div batch_size``), so batching needs no global
    ordering. Output: ``key, segment, batch, length, ids, mask``.
    """
    seq = units.groupBy(key, segment).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(unit_idx, value))), lambda x: x[value]).alias("_ids"))
    seq = seq.withColumn("length", F.size(F.filter("_ids", lambda x: x != pad)).cast("int"))
    seq = seq.withColumn("batch", F.floor(F.col(segment) / batch_size).cast("int"))
    wb = Window.partitionBy(key, "batch")
    seq = seq.withColumn("_max", F.max(F.size("_ids")).over(wb))
    padn = F.col("_max") - F.size("_ids")
    return seq.select(
        key, segment, "batch", "length",
        F.concat("_ids", F.array_repeat(F.lit(pad), padn)).alias("ids"),
        F.concat(F.array_repeat(F.lit(1), F.size("_ids")), F.array_repeat(F.lit(0), padn)).alias("mask"))


# ------------------------------------------------------ lexicon tagger (A10/K4)

def shape(col) -> "F.Column":
    """Word shape: class of the first character, whether the rest holds an
    upper-case letter or digit, and a length class (1, 2, 3, 4, or 5 and
    more). The classes are the feature's definition; no word is left out."""
    c = F.col(col) if isinstance(col, str) else col
    first = F.substring(c, 1, 1)
    cls = (F.when(first.rlike(r"^\p{Lu}$"), "A").when(first.rlike(r"^\p{Ll}$"), "a")
           .when(first.rlike(r"^\p{N}$"), "0").otherwise(first))
    rest = F.substring(c, 2, 1 << 30)
    rcls = F.when(rest.rlike(r"\p{Lu}"), "A").when(rest.rlike(r"\p{N}"), "0").otherwise("a")
    return F.concat(cls, rcls, F.least(F.length(c), F.lit(5)).cast("string"))


def fit_tagger(units: DataFrame, form: str = "token", tag: str = "label") -> DataFrame:
    """Count-based tagger (A10 fit): for every form the most frequent tag,
    and the same per word shape as back-off. Output (the model table, K4):
    ``level, feature, tag, n`` with level ``form`` or ``shape``. The ranking
    window partitions the aggregated (feature, tag) counts, so a frequent
    form is a few rows, not its occurrences."""
    by_form = units.groupBy(F.lit("form").alias("level"), F.col(form).alias("feature"), F.col(tag).alias("tag")).agg(
        F.count(F.lit(1)).alias("n"))
    by_shape = units.groupBy(F.lit("shape").alias("level"), shape(form).alias("feature"), F.col(tag).alias("tag")).agg(
        F.count(F.lit(1)).alias("n"))
    c = by_form.unionByName(by_shape)
    w = Window.partitionBy("level", "feature").orderBy(F.col("n").desc(), F.col("tag"))
    return c.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def predict_tags(units: DataFrame, model: DataFrame, form: str = "token", default: str = "O",
                 out: str = "pred") -> DataFrame:
    """A10 predict: form lookup, else shape lookup, else ``default``."""
    mf = model.where(F.col("level") == "form").select(F.col("feature").alias("_f"), F.col("tag").alias("_tf"))
    ms = model.where(F.col("level") == "shape").select(F.col("feature").alias("_s"), F.col("tag").alias("_ts"))
    from tessera.util import maybe_broadcast
    u = units.withColumn("_shape", shape(form))
    # the form lexicon is broadcast when its size check passes (no shuffle of
    # the units on a hot form such as "the"); otherwise a shuffle join, where
    # AQE's skew handling splits the hot partition
    u = (u.join(maybe_broadcast(mf), u[form] == F.col("_f"), "left")
         .join(maybe_broadcast(ms), F.col("_shape") == F.col("_s"), "left"))
    return u.withColumn(out, F.coalesce("_tf", "_ts", F.lit(default))).drop("_f", "_tf", "_s", "_ts", "_shape")


# ------------------------------------------------------- chained taggers

def chain_taggers(a: DataFrame, b: DataFrame, key: str = "doc_id") -> DataFrame:
    """Two predictors' spans on the same documents: full outer join on
    ``(key, begin, end)``; each side contributes its own attribute."""
    return a.join(b, [key, "begin", "end"], "full_outer")


# ------------------------------------------------------- sentence regrouping

def group_sentences(sentences: DataFrame, n: int, key: str = "doc_id", ordinal: str = "sent_idx",
                    compat: bool = False) -> DataFrame:
    """Regroup consecutive sentences into units of ``n`` (E7):
    ``group = ordinal div n`` (``compat``: ``(ordinal + 1) div n``, a
    counter that starts at 1). Output: ``key, group, begin, end,
    n_sentences``."""
    g = F.floor((F.col(ordinal) + (1 if compat else 0)) / n).cast("int")
    return sentences.groupBy(key, g.alias("group")).agg(
        F.min("begin").alias("begin"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n_sentences"))


def train_and_score(train_units: DataFrame, valid_units: DataFrame, valid_ref: DataFrame,
                    key: str = "doc_id", segment: str = "sent_idx") -> DataFrame:
    """Fit on the training units, predict the validation units, decode
    and score against the validation reference spans: one row with
    ``exact, n_ref, n_pred, precision, recall, f1, accuracy`` (a count model
    has no epochs, so this is a single pass)."""
    from tessera.operators.evaluate import match_counts, prf
    model = fit_tagger(train_units)
    pred = predict_tags(valid_units, model)
    spans = iob_decode(pred, key=key, label="pred", segment=segment).select(key, "begin", "end", "ner_type")
    acc = pred.agg((F.avg((F.col("label") == F.col("pred")).cast("double")) * 100).alias("accuracy"))
    return prf(match_counts(valid_ref, spans, key)).crossJoin(acc)


def predict_with(units: DataFrame, fn, schema: str) -> DataFrame:
    """Extension slot for an external per-batch predictor (§2.13): ``fn``
    maps a pandas DataFrame of units to a pandas DataFrame of predictions
    (Arrow batches via ``mapInPandas``; Spark partitions the work)."""
    def run(batches):
        for pdf in batches:
            yield fn(pdf)
    return units.mapInPandas(run, schema)
