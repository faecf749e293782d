"""Blocks of the written index: bounds, pruning, bucketed joins, intersection."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.operators import index as I
from tessera.util import scratch_path


def corpus(n=3000, seed=4):
    rng = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    return [(i, " ".join(words[min(int(rng.expovariate(0.02)), 299)] for _ in range(rng.choice([3, 10, 40, 200])))) for i in range(n)]


@pytest.fixture(scope="module")
def written(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string").repartition(4)
    held, I.SEGMENT = I.SEGMENT, 8
    try:
        return docs, I.materialize_index(I.index_documents(docs), "block-test", docs)
    finally:
        I.SEGMENT = held


def asked(spark, queries):
    return I.query_terms(spark.createDataFrame(list(enumerate(queries)), "question_id long, query string"))


QUERIES = ["waa wba", "wzk wyk", "wal waa wbc", "nowhere waa", "nowhere", "wbb wbb wcc", "wal", ""]


def test_pruned_top_k_equals_the_exhaustive_one(spark, written):
    _, idx = written
    terms = asked(spark, QUERIES)
    for k in (1, 10, 5000):
        want = I.top_k(I.bm25_scores(idx, terms), k)
        key = lambda df: sorted((r.question_id, r["rank"], r.doc_id, round(r.score, 9)) for r in df.collect())
        assert key(I.bm25_topk(idx, terms, k)) == key(want)


def test_bounds_hold_and_prune(spark, written):
    _, idx = written
    terms, q = asked(spark, ["wzk wyk", "waa"]), "question_id"
    blocks, words = I._blocks(idx), I._asked(idx, terms, q)
    first, bounds = I._first_segments(blocks, words, terms, 5, q, I.BM25_K1, I.BM25_B)
    every = I._scores_in(idx, blocks, words, bounds.select(q, "seg"), q, I.BM25_K1, I.BM25_B)
    own = idx.blocks.select("seg", F.explode("keys").alias("doc_id")).distinct()
    over = every.join(own, "doc_id").join(bounds, [q, "seg"]).where(F.col("score") > F.col("bound") + 1e-9)
    assert over.count() == 0
    found = I._scores_in(idx, blocks, words, first, q, I.BM25_K1, I.BM25_B)
    rest = I._segments_left(bounds, first, found, "doc_id", 5, q)
    assert first.count() + rest.count() < 0.7 * bounds.count()


def test_no_exchange_of_the_block_table(spark, written):
    _, idx = written
    auto = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    held, I.is_small = I.is_small, lambda *a, **k: False
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        terms = asked(spark, QUERIES)
        words = I._asked(idx, terms, "question_id")
        segments = spark.createDataFrame([(0, 5)], "question_id long, seg long")
        for df in (I._segments(idx.blocks, words, "question_id", 1.2, 0.75, False),
                   I._in_segments(idx.blocks, words, segments, "question_id", ["keys"])):
            plan = df._jdf.queryExecution().executedPlan().toString()
            plan = plan[plan.index("SortMergeJoin"):]
            branch = plan[:plan.index("tessera_blocks_")].splitlines()
            join = max(i for i, line in enumerate(branch) if "SortMergeJoin" in line)
            assert "Bucketed: true" in plan and not any("Exchange" in line for line in branch[join:])
    finally:
        I.is_small = held
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", auto)


def test_documents_of_all_terms(spark, written):
    docs, idx = written
    texts = {r.doc_id: re.findall(r"\w+", r.text) for r in docs.collect()}
    want = {(i, d) for i, q in enumerate(QUERIES) if q for d, t in texts.items() if set(q.split()) <= set(t)}
    assert {tuple(r) for r in I.all_terms(idx, asked(spark, QUERIES)).collect()} == want
    # an index that is not written gives the same
    plain = I.index_documents(docs)
    assert {tuple(r) for r in I.all_terms(plain, asked(spark, QUERIES[:3])).collect()} == {w for w in want if w[0] < 3}


def test_search_against_brute_force(spark, written):
    docs, idx = written
    got = defaultdict(dict)
    for r in I.search(idx, spark.createDataFrame(list(enumerate(QUERIES)), "question_id long, query string"), 10_000, 0).collect():
        got[r.question_id][r.doc_id] = r.score
    texts = {r.doc_id: r.text.split() for r in docs.collect()}
    for i, q in enumerate(QUERIES):
        words = q.split()
        want = {d for d, t in texts.items() if words and any(t[j:j + len(words)] == words for j in range(len(t)))}
        assert set(got[i]) == want
    scores = {(r.question_id, r.doc_id): r.score for r in I.bm25_scores(idx, asked(spark, QUERIES)).collect()}
    assert all(abs(scores[i, d] - s) < 1e-9 for i, ds in got.items() for d, s in ds.items())


def test_string_keys_empty_corpus_and_reading_again(spark):
    docs = spark.createDataFrame([("x", "a b a"), ("y", ""), ("z", None)], "pack string, text string")
    path = scratch_path(spark, "block-files")
    I.write_index(I.index_documents(docs, "pack"), path, docs.select("pack"))
    idx = I.read_index(spark, path, "pack")
    assert {tuple(r) for r in idx.doc_stats.collect()} == {("x", 3), ("y", 0), ("z", 0)}
    terms = I.query_terms(spark.createDataFrame([("q", "a")], "question_id string, query string"))
    assert [(r.pack, r["rank"]) for r in I.bm25_topk(idx, terms, 3).collect()] == [("x", 1)]
    none = I.materialize_index(I.index_documents(docs.limit(0), "pack"), "empty", docs.limit(0).select("pack"))
    assert I.bm25_topk(none, terms, 3).count() == 0 and I.all_terms(none, terms).count() == 0
