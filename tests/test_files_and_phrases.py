"""Files on disk, long dictionary names, and phrases by brute force."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators.concepts import alias_trie, find_mentions, find_patterns
from tessera.operators.evaluate import match_counts
from tessera.operators.index import index_documents, materialize_index, phrase_match, query_terms
from tessera.operators.tokens import tokenize
from tessera.sources.readers import (
    document_spans, parse_links, read_conll_linked, read_papers, read_pubtator, read_standoff,
)
from tessera.sources.sinks import read_packs, write_packs
from tessera.util import materialize


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode())


def test_standoff_files_of_equal_name_stay_apart(spark, tmp_path):
    for folder, word in (("a", "alpha"), ("b", "betas")):
        put(tmp_path / folder / "x.txt", f"{word} here")
        put(tmp_path / folder / "x.ann", f"T1\tD 0 5\t{word}\nN1\tReference T1 UMLS:C1\tx\n")
    docs, mentions, bad = read_standoff(spark, str(tmp_path))
    rows = {r.path: r for r in mentions.collect()}
    assert docs.count() == 2 and len(rows) == 2 and bad.count() == 0
    assert {r.surface for r in rows.values()} == {"alpha", "betas"} and {r.pack_name for r in rows.values()} == {"x"}
    assert all(("alpha" in r.surface) == ("/a/" in r.path) for r in rows.values())
    assert {r.end for r in document_spans(docs, "path").collect()} == {10}


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_pubtator_records_by_any_line_ending(spark, tmp_path, end):
    lines = ["1|t|One", "1|a|Text one", "1\t0\t3\tOne\tT1\tC1", "", "2|t|Two", "2|a|Text two", "2\t0\t3\tTwo\tT2\tC2", "", ""]
    put(tmp_path / "c.txt", end.join(lines))
    docs, mentions, bad = read_pubtator(spark, str(tmp_path))
    assert {r.pack_name: r.text for r in docs.collect()} == {"1": "One\nText one\n", "2": "Two\nText two\n"}
    assert {(r.pack_name, r.surface) for r in mentions.collect()} == {("1", "One"), ("2", "Two")}


def test_broken_paper_goes_to_quarantine(spark, tmp_path):
    put(tmp_path / "good.json", json.dumps({"paper_id": "p", "metadata": {"title": "T"}, "abstract": [], "body_text": [{"text": "B"}]}))
    put(tmp_path / "bad.json", '{"paper_id": "q", ')
    docs, _, bad = read_papers(spark, str(tmp_path))
    assert [r.text for r in docs.collect()] == ["T\n\n\n\nB"]
    assert [r.reason for r in bad.collect()] == ["not valid JSON"] and "bad.json" in bad.first().file


def test_linked_column_files_pair_by_path(spark, tmp_path):
    for folder in "ab":
        put(tmp_path / folder / "x.conll", "-DOCSTART- O\n\nParis NN - B-LOC\nis VB - O\n")
        put(tmp_path / folder / "x.link.tsv", f"-DOCSTART- (1)\n0   Y_{folder}  http://w/{folder}\t7\n")
    units, links = read_conll_linked(spark, str(tmp_path))
    joined = units.join(links, (units.file == links.file) & (units.doc_ord == links.doc_ord)
                        & (units.tok_idx == links.token_idx)).collect()
    assert {(r.word, r.yago2_entity, r.wiki_id) for r in joined} == {("Paris", "Y_a", 7), ("Paris", "Y_b", 7)}


def test_link_blocks_without_the_empty_ones(spark):
    text = "-DOCSTART- (1)\n-DOCSTART- (2)\n0\tY\thttp://w\t7\n"
    files = spark.createDataFrame([("f", text)], "file string, content string")
    assert [r.doc_ord for r in parse_links(files).collect()] == [2]
    assert [r.doc_ord for r in parse_links(files, compat=True).collect()] == [1]


def test_packs_without_the_maker(spark, tmp_path):
    docs = spark.createDataFrame([("p", "text", "s")], "pack_name string, text string, source string")
    anns = spark.createDataFrame([("p", "T", "me", 0, 2)], "pack_name string, type string, component string, begin int, end int")
    for drop, want in ((False, "me"), (True, None)):
        write_packs(docs, anns, str(tmp_path / str(drop)), drop_record=drop)
        assert read_packs(spark, str(tmp_path / str(drop)))[1].first().component == want


def test_long_and_punctuated_names_match(spark):
    text = "Severe acute respiratory syndrome is caused by COVID-19. covid 19, il-6/il-8 and IL-6."
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    names = ["severe acute respiratory syndrome", "covid-19", "il-6", "il-6/il-8", "."]
    concepts = spark.createDataFrame([(n, n.upper(), f"C{i}") for i, n in enumerate(names)], "alias string, name string, cui string")
    got = sorted((r.begin, text[r.begin:r.end], r.cui) for r in find_mentions(tokenize(docs), concepts).collect())
    assert [(t.lower(), c) for _, t, c in got] == [
        ("severe acute respiratory syndrome", "C0"), ("covid-19", "C1"), (".", "C4"), ("il-6", "C2"), ("il-6/il-8", "C3"), ("il-6", "C2"),
        (".", "C4")]
    marks = find_patterns(tokenize(docs), [("NUM", "[0-9]+"), ("CAPS", "[A-Z]{2,}")]).collect()
    assert sorted((r.surface, r.ner_type) for r in marks) == sorted(
        [("19", "NUM"), ("19", "NUM"), ("6", "NUM"), ("8", "NUM"), ("6", "NUM"), ("COVID", "CAPS"), ("IL", "CAPS")])


def test_mentions_of_long_aliases_by_brute_force(spark):
    rng = random.Random(8)
    words = [[rng.choice("ab") if i % 3 else rng.choice("abcdef") for _ in range(rng.randint(0, 150))] for i in range(40)]
    names = sorted({" ".join(w[i:i + n]) for w in words for n in (1, 3, 4, 5, 8, 9, 13, 60, 61) for i in range(0, len(w) - n, 29)})
    names += ["a a a a a a a a a a a a a a a a a a a a c", "A  B", "", None]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(words)] + [(98, ""), (99, None)], "doc_id long, text string")
    concepts = spark.createDataFrame([(n, n, f"C{i}") for i, n in enumerate(names)], "alias string, name string, cui string")
    got = sorted((r.doc_id, r.begin, r.end, r.n, r.cui) for r in find_mentions(tokenize(docs), concepts).collect())
    want = []
    for i, w in enumerate(words):
        for c, name in enumerate(names):
            t = (name or "").lower().split()
            want += [(i, 2 * k, 2 * (k + len(t)) - 1, len(t), f"C{c}") for k in range(len(w)) if t and w[k:k + len(t)] == t]
    assert got == sorted(want) and max(r[3] for r in got) == 61
    edges, _ = alias_trie(concepts)
    assert edges.agg(F.max("size")).first()[0] == 4 and edges.agg(F.max("level")).first()[0] == 15
    assert find_mentions(tokenize(docs), concepts.limit(0)).count() == 0


def test_later_levels_of_long_aliases_read_no_tokens(spark, monkeypatch):
    from tessera.operators import concepts as module

    written = []
    monkeypatch.setattr(module, "materialize", lambda df, name: written.append((name, df)) or materialize(df, name))
    docs = spark.createDataFrame([(i, "x " * i + " ".join(f"w{j}" for j in range(30))) for i in range(20)], "doc_id long, text string")
    concepts = spark.createDataFrame([(" ".join(f"w{j}" for j in range(n)), "long", f"C{n}") for n in (9, 30)],
                                     "alias string, name string, cui string")
    found = find_mentions(tokenize(docs), concepts)
    assert sorted((r.doc_id, r.begin, r.n) for r in found.collect()) == sorted((i, 2 * i, n) for i in range(20) for n in (9, 30))
    places = [df for name, df in written if name == "trie-places"]
    scans = ["alias-tokens" in " ".join(df.inputFiles()) or "token-runs" in " ".join(df.inputFiles()) for df in places]
    assert len(scans) == 8 and sum(scans) == 2  # the first level, and the one that takes the tokens along


def test_dictionary_counts_no_runs_over_rare_tokens(spark, monkeypatch):
    from tessera.operators import concepts as module
    from tessera.plans.concepts_q import dictionary

    seen = []
    real = module.ngram_candidates
    monkeypatch.setattr(module, "ngram_candidates", lambda tok, n: seen.append(tok) or real(tok, n))
    docs = [(i, "the cat, sat the " + (f"rare{i} " if i else "odd. ") + "cat, sat") for i in range(100)] + [(200, None)]
    got = {(r.alias, r.cui) for r in dictionary(tokenize(spark.createDataFrame(docs, "doc_id long, text string"))).collect()}
    runs = ["the", "cat", "sat", "the cat", "sat the", "cat , sat", "the cat , sat", "cat , sat the"]
    n = lambda run: len(run.split())
    assert got == {(r, f"C{n(r) * 1000000 + 100:09d}-{r}") for r in runs}
    left = {r.token for r in seen[0].select("token").distinct().collect()}
    assert left == {"the", "cat", ",", "sat", ""}


def test_counts_name_every_document(spark):
    spans = spark.createDataFrame([(1, 0, 2, "A")], "doc_id long, begin int, end int, ner_type string")
    docs = spark.range(3).select(F.col("id").alias("doc_id"))
    got = {r.doc_id: (r.exact, r.n_ref, r.n_pred) for r in match_counts(spans, spans, docs=docs).collect()}
    assert got == {0: (0, 0, 0), 1: (1, 1, 1), 2: (0, 0, 0)}


def test_phrases_by_brute_force(spark):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice("a b c d e".split()) for _ in range(rng.randint(1, 14)))) for i in range(40)]
    queries = [("q1", "a b"), ("q2", "a a"), ("q3", "b a b"), ("q4", "c c c"), ("q5", "a b c d")]
    slop = 4
    want = set()
    for q, text in queries:
        terms = text.split()
        for d, words in docs:
            words = words.split()
            best = None
            for pick in itertools.product(*[[p for p, w in enumerate(words) if w == t] for t in terms]):
                if len(set(pick)) < len(pick):
                    continue
                adj = [p - i for i, p in enumerate(pick)]
                # the copies of a term are alike: they take positions in order
                if any(pick[i] > pick[j] for i in range(len(pick)) for j in range(i + 1, len(pick)) if terms[i] == terms[j]):
                    continue
                width = max(adj) - min(adj)
                best = width if best is None else min(best, width)
            if best is not None and best <= slop:
                want.add((q, d, best))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    index = materialize_index(index_documents(df), docs=df)
    terms = query_terms(spark.createDataFrame(queries, "question_id string, query string"))
    assert {(r.question_id, r.doc_id, r.width) for r in phrase_match(index, terms, slop).collect()} == want
