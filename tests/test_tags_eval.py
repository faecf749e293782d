"""BIO decode/encode (A11/A12), overlap removal (A8) and scoring."""

import pytest

from tessera.operators.evaluate import match_counts, prf
from tessera.operators.spans import drop_overlaps
from tessera.operators.tags import bio_encode, iob_decode


def _units(spark, labels, sents=None):
    rows = []
    pos = 0
    for i, lab in enumerate(labels):
        rows.append((1, i, pos, pos + 1, lab, (sents or [0] * len(labels))[i]))
        pos += 2
    return spark.createDataFrame(rows, "doc_id int, tok_idx int, begin int, end int, label string, sent_idx int")


def _spans(df):
    return sorted((r["first_unit"], r["last_unit"], r["ner_type"]) for r in df.collect())


@pytest.mark.parametrize("labels,sents,expected", [
    (["O", "I-PER", "I-PER", "I-LOC", "O"], None, [(1, 2, "PER"), (3, 3, "LOC")]),
    (["O", "B-LOC"], None, [(1, 1, "LOC")]),
    (["B-X", "B-X", "O"], None, [(0, 0, "X"), (1, 1, "X")]),
    (["B-X", "I-X", "O"], [0, 1, 1], [(0, 0, "X"), (1, 1, "X")]),
    (["B-X", None, "I-X", "O"], None, [(0, 0, "X"), (2, 2, "X")]),
])
def test_iob_decode(spark, labels, sents, expected):
    seg = "sent_idx" if sents else None
    assert _spans(iob_decode(_units(spark, labels, sents), segment=seg)) == expected


def test_bio_roundtrip(spark):
    units = _units(spark, ["O"] * 8).drop("label")
    ments = spark.createDataFrame([(1, 2, 7, "A"), (1, 10, 11, "B")], "doc_id int, begin int, end int, ner_type string")
    lab = bio_encode(units, ments)
    got = {r["tok_idx"]: r["label"] for r in lab.collect()}
    assert [got[i] for i in range(8)] == ["O", "B-A", "I-A", "I-A", "O", "B-B", "O", "O"]
    back = iob_decode(lab)
    assert sorted((r["begin"], r["end"], r["ner_type"]) for r in back.collect()) == [(2, 7, "A"), (10, 11, "B")]


def test_drop_overlaps(spark):
    df = spark.createDataFrame([(1, 0, 5, "a"), (1, 3, 9, "b"), (1, 5, 7, "c"), (2, 0, 5, "a"), (2, 0, 9, "b"),
                                (3, 2, 2, "z"), (3, 0, 4, "a")], "doc_id int, begin int, end int, type string")
    got = sorted((r["doc_id"], r["begin"], r["end"]) for r in drop_overlaps(df).collect())
    assert got == [(1, 0, 5), (1, 5, 7), (2, 0, 9), (3, 0, 4), (3, 2, 2)]


@pytest.mark.parametrize("ref,pred,counts,scores", [
    ([(0, 2, "A"), (5, 7, "B")], [(0, 2, "A"), (5, 7, "C"), (9, 9, "A")], (1, 2, 3), (33.333333, 50.0, 40.0)),
    ([(0, 2, None)], [(0, 2, None)], (1, 1, 1), (100.0, 100.0, 100.0)),
    ([(0, 2, "A"), (0, 2, "A")], [(0, 2, "A"), (0, 2, "A")], (1, 2, 2), (50.0, 50.0, 50.0)),
    ([], [(0, 2, "A")], (0, 0, 1), (0.0, 0.0, 0.0)),
])
def test_match_counts_prf(spark, ref, pred, counts, scores):
    sch = "doc_id int, begin int, end int, ner_type string"
    r = spark.createDataFrame([(1, *x) for x in ref], sch)
    p = spark.createDataFrame([(1, *x) for x in pred], sch)
    row = prf(match_counts(r, p)).first()
    assert (row["exact"], row["n_ref"], row["n_pred"]) == counts
    assert tuple(round(row[c], 5) for c in ("precision", "recall", "f1")) == tuple(round(s, 5) for s in scores)


def test_train_and_score_and_predictor_slot(spark):
    from tessera.operators.tags import predict_with, train_and_score
    rows = [(1, i, 2 * i, 2 * i + 1, t, lab, 0) for i, (t, lab) in enumerate(
        [("Paris", "B-LOC"), ("is", "O"), ("big", "O"), ("Rome", "B-LOC")])]
    sch = "doc_id int, tok_idx int, begin int, end int, token string, label string, sent_idx int"
    units = spark.createDataFrame(rows, sch)
    ref = spark.createDataFrame([(1, 0, 1, "LOC"), (1, 6, 7, "LOC")], "doc_id int, begin int, end int, ner_type string")
    r = train_and_score(units, units, ref).first()
    assert (r["exact"], r["n_ref"], r["n_pred"], r["accuracy"]) == (2, 2, 2, 100.0)
    out = predict_with(units.select("doc_id", "tok_idx", "token"),
                       lambda pdf: pdf.assign(pred=pdf.token.str.upper()), "doc_id int, tok_idx int, token string, pred string")
    assert sorted(x["pred"] for x in out.collect()) == ["BIG", "IS", "PARIS", "ROME"]


def test_split_bad_records(spark):
    from pyspark.sql import functions as F
    from tessera.sources.readers import split_bad_records
    lines = spark.createDataFrame([("f", "T1 A 0 5 x"), ("f", "T2"), ("f", "Tx A 1 2 y")], "file string, line string")
    parts = F.split("line", " ")
    good, bad = split_bad_records(lines, {"short": F.size(parts) < 4,
                                          "bad id": ~F.substring(F.element_at(parts, 1), 2, 9).rlike("^[0-9]+$")})
    assert [r["line"] for r in good.collect()] == ["T1 A 0 5 x"]
    assert sorted(r["reason"] for r in bad.collect()) == ["bad id", "short"]


def test_iob_decode_compat_drops_open_mention(spark):
    u = _units(spark, ["O", "B-LOC"])
    assert _spans(iob_decode(u, compat=True)) == []
    u2 = _units(spark, ["B-X", "I-X", "O"], [0, 1, 1])
    assert _spans(iob_decode(u2, compat=True)) == [(0, 1, "X")]  # runs on across the sentence end (Q5)


def test_bio_encode_makes_no_pairs(spark):
    """overlapping, nested, unlabelled and ownerless mentions as before,
    without a join of units with mentions."""
    units = _units(spark, ["O"] * 9).drop("label").unionByName(
        spark.createDataFrame([(None, 0, 0, 1, 0)], "doc_id int, tok_idx int, begin int, end int, sent_idx int"))
    ments = spark.createDataFrame(
        [(1, 0, 5, "A"), (1, 0, 3, "B"), (1, 2, 9, "C"), (1, 4, 7, "D"), (1, 10, 13, None), (1, 12, 15, "E"), (1, 15, 16, "F"),
         (None, 0, 1, "G"), (2, 0, 20, "H")], "doc_id int, begin int, end int, ner_type string")
    lab = bio_encode(units, ments)
    got = {(r["doc_id"], r["tok_idx"]): r["label"] for r in lab.collect()}
    assert [got[1, i] for i in range(9)] == ["B-A", "I-A", "I-A", "B-C", "I-C", "O", "O", "B-E", "O"]
    assert got[None, 0] == "O"
    assert lab.columns == [*units.columns, "label"]
    assert "Join" not in lab._jdf.queryExecution().executedPlan().toString()


def test_sentence_tag_report_keeps_texts_out_of_its_aggregates(spark):
    import re
    from hashlib import md5

    from tessera.operators.qa import sentence_tag_report
    docs = spark.createDataFrame([(1, "Ann met Bob. Fine."), (2, "No one."), (2, "Any one."), (None, "Ann.")], "doc_id int, text string")
    sents = spark.createDataFrame([(1, 0, 0, 12), (1, 1, 13, 18), (2, 0, 0, 7), (None, 0, 0, 4)], "doc_id int, sent_idx int, begin int, end int")
    ments = spark.createDataFrame([(1, 8, 11, "P"), (1, 0, 3, None), (2, 0, 2, "Q"), (None, 0, 3, "P")],
                                  "doc_id int, begin int, end int, ner_type string")
    out = sentence_tag_report(docs, sents, ments)
    dig = lambda x: md5(x.encode()).hexdigest()
    assert sorted(map(tuple, out.collect())) == sorted([
        (1, 0, dig("Ann met Bob."), "Ann|Bob=P"), (1, 1, dig("Fine."), ""),
        (2, 0, dig("No one."), "An=Q|No=Q"), (2, 0, dig("Any one"), "An=Q|No=Q")])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    lists = [x for x in plan.splitlines() if "Aggregate" in x and "i_begin" in x]
    assert lists and not [x for x in lists if re.search(r"\btext#", x)]


def test_labelled_tokens_carry_their_runs(spark):
    from tessera.operators.tokens import tokenize
    from tessera.plans.tagging import capital_labels, capital_runs
    docs = spark.createDataFrame([(1, "New York City is big. Ann  Lee met Bob Roy"), (2, "none"), (2, "A B")], "doc_id int, text string")
    tok = tokenize(docs)
    runs = capital_runs(capital_labels(tok))
    assert sorted(map(tuple, runs.collect())) == sorted(map(tuple, capital_runs(tok).collect()))
    assert (1, 0, 13, 0, 2, "New") in set(map(tuple, runs.collect()))
    # grouped as they stand: no window over the labelled tokens
    lab = spark.createDataFrame(capital_labels(tok).collect(), capital_labels(tok).schema)
    assert "Window" not in capital_runs(lab)._jdf.queryExecution().optimizedPlan().toString()


def test_decode_groups_no_lone_units_without_a_span(spark):
    units = _units(spark, ["O", "I-O", "I-PER", "X-PER", None, "O", "O", "B-O", "I-O", "B-A"])
    spans = iob_decode(units)
    assert _spans(spans) == [(2, 3, "PER"), (9, 9, "A")]
    plan = spans._jdf.queryExecution().optimizedPlan().toString()
    grouped = plan[plan.index("Aggregate"):].splitlines()
    assert "lead(_brk" in "".join(grouped)  # units are left out below the aggregate
