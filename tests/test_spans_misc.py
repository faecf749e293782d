"""Span selection, links, unions, set complements, sinks round trip and
sub-directory news reading."""

import os

from tessera.operators.evaluate import missed_and_spurious
from tessera.operators.spans import (
    covered_by, first_of_type, intersects, resolve_links, select_pack, select_type, union_annotations, with_ann_id,
)
from tessera.sources.readers import read_subdirs
from tessera.sources.sinks import load_vocab, read_packs, save_vocab, write_packs

ANN = "doc_id int, type string, component string, begin int, end int, surface string"


def test_select_type_subtypes_component_and_first(spark):
    a = spark.createDataFrame([(1, "MedicalEntityMention", "n1", 5, 9, "x"), (1, "EntityMention", "n2", 0, 3, "y"),
                               (1, "Title", None, 0, 10, "t"), (2, "WikiEntityMention", "n1", 2, 4, "z")], ANN)
    assert select_type(a, "EntityMention").count() == 3
    assert select_type(a, "EntityMention", component="n1").count() == 2
    f = {r["doc_id"]: (r["begin"], r["end"]) for r in first_of_type(a, "EntityMention").collect()}
    assert f == {1: (0, 3), 2: (2, 4)}


def test_select_pack_prefix_regex(spark):
    d = spark.createDataFrame([("passage_1",), ("passage_10",), ("query",)], "pack_name string")
    assert sorted(r[0] for r in select_pack(d, regex=r"passage_\d").collect()) == ["passage_1", "passage_10"]
    assert select_pack(d, name="query").count() == 1


def test_resolve_links_and_ids(spark):
    a = with_ann_id(spark.createDataFrame([(1, "Token", None, 0, 5, "cause"), (1, "Token", None, 6, 9, "flu")], ANN))
    ids = {r["surface"]: r["ann_id"] for r in a.collect()}
    links = spark.createDataFrame([(1, 1, ids["cause"], ids["flu"], "ARG1")],
                                  "doc_id int, link_id int, parent_id long, child_id long, arg_type string")
    r = resolve_links(links, a).first()
    assert (r["p_text"], r["c_text"], r["arg_type"]) == ("cause", "flu", "ARG1")


def test_union_overwrite(spark):
    a = spark.createDataFrame([(1, "M", "a", 0, 2, "x"), (1, "M", "a", 3, 4, "y")], ANN)
    b = spark.createDataFrame([(1, "M", "b", 0, 2, "x")], ANN)
    assert union_annotations(a, b).count() == 3
    got = sorted((r["begin"], r["component"]) for r in union_annotations(a, b, overwrite=True).collect())
    assert got == [(0, "b"), (3, "a")]


def test_range_joins_bins(spark):
    outer = spark.createDataFrame([(1, 0, 5000), (1, 4000, 4100)], "doc_id int, o_begin int, o_end int")
    inner = spark.createDataFrame([(1, 10, 20), (1, 4050, 4060), (1, 5000, 5000), (1, 4990, 5010)],
                                  "doc_id int, i_begin int, i_end int")
    pairs = sorted((r["o_begin"], r["i_begin"]) for r in covered_by(outer, inner).collect())
    assert pairs == [(0, 10), (0, 4050), (0, 5000), (4000, 4050)]
    a = spark.createDataFrame([(1, 0, 3000)], "doc_id int, a_begin int, a_end int")
    b = spark.createDataFrame([(1, 2047, 2049), (1, 3000, 3001), (1, 100, 5000)], "doc_id int, b_begin int, b_end int")
    assert sorted(r["b_begin"] for r in intersects(a, b).collect()) == [100, 2047]


def test_missed_and_spurious(spark):
    sch = "doc_id int, begin int, end int, ner_type string"
    ref = spark.createDataFrame([(1, 0, 2, "A"), (1, 5, 7, "B")], sch)
    pred = spark.createDataFrame([(1, 0, 2, "A"), (1, 5, 7, "C")], sch)
    missed, spurious = missed_and_spurious(ref, pred)
    assert [tuple(r) for r in missed.collect()] == [(1, 5, 7, "B")]
    assert [tuple(r) for r in spurious.collect()] == [(1, 5, 7, "C")]


def test_packs_and_vocab_roundtrip(spark, tmpdir_fresh):
    docs = spark.createDataFrame([("p1", "hello world", "s1"), ("p2", "x", "s2")], "pack_name string, text string, source string")
    anns = spark.createDataFrame([("p1", "Token", 0, 5), ("p1", "Token", 6, 11)], "pack_name string, type string, begin int, end int")
    path = os.path.join(tmpdir_fresh, "packs")
    write_packs(docs, anns, path, gzip=True)
    d, a = read_packs(spark, path)
    assert sorted((r["pack_name"], r["source"]) for r in d.collect()) == [("p1", "s1"), ("p2", "s2")]
    assert sorted((r["begin"], r["end"]) for r in a.collect()) == [(0, 5), (6, 11)]
    v = spark.createDataFrame([("O", 0), ("B-X", 1)], "tag string, id int")
    save_vocab(v, os.path.join(tmpdir_fresh, "vocab"))
    assert sorted(tuple(r) for r in load_vocab(spark, os.path.join(tmpdir_fresh, "vocab")).collect()) == [("B-X", 1), ("O", 0)]


def test_read_subdirs(spark, tmpdir_fresh):
    root = tmpdir_fresh
    os.makedirs(os.path.join(root, "a", "b"))
    for rel, body in [("top.txt", "-- h\nroot"), ("a/one.txt", "one"), ("a/b/two.txt", " two ")]:
        with open(os.path.join(root, rel), "w") as fh:
            fh.write(body)
    got = sorted((r["pack_name"], r["source"], r["text"]) for r in read_subdirs(spark, root).collect())
    assert got == [("one.txt", "a", "one"), ("two.txt", "b", "two")]
