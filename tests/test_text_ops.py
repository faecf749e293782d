"""Span replacement and map-back (P2/P3), section spans (P7), tokens and
sentences (A1-A3) on literal rows."""

import pytest
from pyspark.sql import functions as F

from tessera.operators.edits import original_span, replace_spans
from tessera.operators.tokens import split_sentences, split_sentences_cautious, tokenize

TEXT = "The Original News Text Here"


def _replace(spark, ops, text=TEXT):
    d = spark.createDataFrame([(1, text)], "doc_id int, text string")
    o = spark.createDataFrame([(1, b, e, r) for b, e, r in ops] or [(1, 0, 0, None)],
                              "doc_id int, begin int, end int, replacement string")
    if not ops:
        o = o.limit(0)
    return replace_spans(d, o)


@pytest.mark.parametrize("ops,expected", [
    ([], TEXT),
    ([(4, 4, "New ")], "The New Original News Text Here"),
    ([(4, 12, "New")], "The New News Text Here"),
    ([(0, 4, ""), (17, 22, "")], "Original News Here"),
    ([(17, 22, ""), (0, 4, "")], "Original News Here"),
    ([(4, 12, "New"), (12, 13, " Shiny "), (22, 22, " Ends")], "The New Shiny News Text Ends Here"),
])
def test_replace_spans(spark, ops, expected):
    nd, _, q = _replace(spark, ops)
    assert nd.first()["text"] == expected
    assert q.count() == 0


@pytest.mark.parametrize("ops", [[(5, 8, "x"), (6, 10, "y")], [(5, 8, "x"), (6, 1000, "y")]])
def test_replace_spans_errors_go_to_quarantine(spark, ops):
    nd, _, q = _replace(spark, ops)
    assert nd.first()["text"] == TEXT  # unchanged
    assert q.count() > 0


MAP_CASES = [  # (span in new text) -> expected (relaxed, backward, forward)
    ((8, 15), (12, 14), None, None),
    ((5, 32), (4, 26), None, (12, 26)),
    ((0, 6), None, (0, 4), None),
    ((0, 7), None, None, (0, 12)),
    ((30, 30), (24, 24), (24, 24), (24, 24)),
]


def test_original_span_modes(spark):
    nd, segs, _ = _replace(spark, [(4, 12, "New"), (12, 13, " Shiny "), (22, 22, " Ends")])
    spans = spark.createDataFrame([(1, i, b, e) for i, ((b, e), *_r) in enumerate(MAP_CASES)],
                                  "doc_id int, span_id int, begin int, end int")
    got = {r["span_id"]: r for r in original_span(segs, spans).collect()}
    for i, ((b, e), rel, back, fwd) in enumerate(MAP_CASES):
        r = got[i]
        if rel:
            assert (r["begin_relaxed"], r["end_relaxed"]) == rel
        if back:
            assert (r["begin_backward"], r["end_backward"]) == back
        if fwd:
            assert (r["begin_forward"], r["end_forward"]) == fwd


def test_tokens_rebuild_text(spark):
    text = "Hello, wörld!  It's 3.5 km\nNew line."
    d = spark.createDataFrame([(7, text)], "doc_id long, text string")
    toks = tokenize(d).orderBy("tok_idx").collect()
    for t in toks:
        assert text[t["begin"]:t["end"]] == t["token"]
    # tokens + gaps rebuild the text
    rebuilt, pos = "", 0
    for t in toks:
        rebuilt += text[pos:t["begin"]] + t["token"]
        pos = t["end"]
    assert rebuilt + text[pos:] == text
    assert [t["token"] for t in toks][:3] == ["Hello", ",", "wörld"]


def test_sentences_and_cautious(spark):
    text = "A b. C d. E f."
    d = spark.createDataFrame([(1, text)], "doc_id int, text string")
    tok = tokenize(d)
    s = [(r["begin"], r["end"]) for r in split_sentences(tok).orderBy("sent_idx").collect()]
    assert s == [(0, 4), (5, 9), (10, 14)]
    m1 = spark.createDataFrame([(1, 0, 6)], "doc_id int, begin int, end int")
    c1 = [(r["begin"], r["end"]) for r in split_sentences_cautious(tok, m1).orderBy("sent_idx").collect()]
    assert c1 == [(0, 9), (10, 14)]
    m2 = spark.createDataFrame([(1, 0, 4)], "doc_id int, begin int, end int")
    c2 = [(r["begin"], r["end"]) for r in split_sentences_cautious(tok, m2).orderBy("sent_idx").collect()]
    assert c2 == [(0, 4), (5, 9), (10, 14)]


def test_surface_equals_substring(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    tok = tokenize(d)
    bad = tok.join(d, "doc_id").where(F.expr("substring(text, begin + 1, `end` - begin) <> token")).count()
    assert bad == 0
