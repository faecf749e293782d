"""Index, phrase slop, BM25 and question analysis on literal rows."""

from tessera.operators.index import index_documents, phrase_match, query_terms, search
from tessera.operators.qa import analyse_questions, build_query


def _idx(spark, docs):
    return index_documents(spark.createDataFrame(docs, "doc_id int, text string"))


def test_phrase_slop_monotone_and_exact(spark):
    docs = [(1, "a b c d"), (2, "a x x x x b"), (3, "b a"), (4, "c only")]
    idx = _idx(spark, docs)
    q = spark.createDataFrame([("q", "a b")], "question_id string, query string")
    qt = query_terms(q)
    w0 = {r["doc_id"]: r["width"] for r in phrase_match(idx, qt, 0).collect()}
    w5 = {r["doc_id"]: r["width"] for r in phrase_match(idx, qt, 5).collect()}
    assert w0 == {1: 0}
    assert w5 == {1: 0, 2: 4, 3: 2}
    assert set(w0) <= set(w5)


def test_search_ranks(spark):
    idx = _idx(spark, [(1, "cat sat"), (2, "cat sat on the cat mat sat"), (3, "dog")])
    q = spark.createDataFrame([("q", "cat sat")], "question_id string, query string")
    r = [(x["doc_id"], x["rank"]) for x in search(idx, q, 10, 0).orderBy("rank").collect()]
    assert {d for d, _ in r} == {1, 2} and [k for _, k in r] == [1, 2]


def test_question_analysis(spark):
    lex = spark.createDataFrame([("what", "WP", "what"), ("is", "VBZ", "be"), ("caused", "VBD", "cause")],
                                "form string, pos string, lemma string")
    qs = spark.createDataFrame([("a", "what caused liver injury"), ("b", "covid caused what"),
                                ("c", "covid caused fever"), ("d", "caused")], "question_id string, text string")
    parsed, bad = analyse_questions(qs, lex)
    got = {r["question_id"]: r for r in build_query(parsed).collect()}
    assert got["a"]["answer_is_arg0"] is True and got["a"]["query"] == "liver injury caused"
    assert got["b"]["answer_is_arg0"] is False and got["b"]["query"] == "covid caused"
    assert got["c"]["answer_is_arg0"] is None and got["c"]["query"] == "covid caused fever"
    assert got["a"]["verb_lemma"] == "cause"
    assert [r["file"] for r in bad.collect()] == ["d"]


def test_question_compat_last_verb(spark):
    lex = spark.createDataFrame([("is", "VBZ", "be"), ("caused", "VBD", "cause")], "form string, pos string, lemma string")
    # last verb "caused" has no right argument: default falls back to "is", compat quarantines
    qs = spark.createDataFrame([("a", "flu is bad caused")], "question_id string, text string")
    parsed, bad = analyse_questions(qs, lex)
    assert [r["predicate"] for r in parsed.collect()] == ["is"]
    parsed_c, bad_c = analyse_questions(qs, lex, compat=True)
    assert parsed_c.count() == 0 and bad_c.count() == 1


def test_relations_by_text_compat(spark):
    from tessera.operators.qa import relations
    rows = [(1, 0, 4, 6, "is", "ARG0", 0, 3, "flu"), (1, 0, 4, 6, "is", "ARG1", 7, 10, "bad"),
            (1, 0, 11, 13, "is", "ARG0", 7, 10, "bad"), (1, 0, 11, 13, "is", "ARG1", 14, 18, "here")]
    links = spark.createDataFrame(rows, "doc_id int, sent_idx int, p_begin int, p_end int, p_text string, "
                                        "arg_type string, a_begin int, a_end int, a_text string")
    by_span = sorted((r["x0"], r["x1"]) for r in relations(links).collect())
    assert by_span == [("bad", "here"), ("flu", "bad")]
    by_text = [(r["x0"], r["x1"]) for r in relations(links, by_text=True).collect()]
    assert by_text == [("bad", "here")]


def test_learned_part_of_speech(spark):
    from tessera.operators.qa import fit_pos, tag_pos_learned
    from tessera.operators.tokens import tokenize

    units = spark.createDataFrame([("Runs", "VBZ"), ("runs", "VBZ"), ("runs", "NNS"), ("cells", "NNS"), ("walls", "NNS"), ("is", "VBZ"),
                                   ("tie", "VB"), ("tie", "NN"), ("kept", None), (None, "JJ"), ("x", "SYM")], "word string, pos string")
    forms, suffixes = fit_pos(units)
    assert {r.form: (r.pos, r.n) for r in forms.collect()} == {
        "runs": ("VBZ", 2), "cells": ("NNS", 1), "walls": ("NNS", 1), "is": ("VBZ", 1), "tie": ("NN", 1), "x": ("SYM", 1)}
    ends = {r.suffix: (r.pos, r.n) for r in suffixes.collect()}
    assert ends["s"] == ("NNS", 3) and ends["lls"] == ("NNS", 2) and ends["uns"] == ("VBZ", 2) and "runs" not in ends
    docs = spark.createDataFrame([(1, "Runs bells guns kept tie, qqq x"), (2, None)], "doc_id int, text string")
    got = [(r.token, r.pos, r.pos_by) for r in tag_pos_learned(tokenize(docs), forms, suffixes).orderBy("tok_idx").collect()]
    assert got == [("Runs", "VBZ", "form"), ("bells", "NNS", "suffix"), ("guns", "VBZ", "suffix"), ("kept", "NN", "default"),
                   ("tie", "NN", "form"), (",", ",", "token"), ("qqq", "NN", "default"), ("x", "SYM", "form")]
    empty = fit_pos(units.limit(0))
    assert {r.pos_by for r in tag_pos_learned(tokenize(docs), *empty).collect()} == {"default", "token"}
