"""Steps that must not make rows of occurrences or read whole inputs in one task."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import index as I
from tessera.operators.tokens import document_words, tokenize


def test_words_of_a_document_are_those_of_its_tokens(spark):
    texts = [(1, "İstanbul ΟΔΟΣ, a_b c. d\t\x0b1x"), (2, ""), (3, None), (4, "twice it is"), (4, "twice it is"), (5, "... !"), (None, "no key"),
             (6, None), (6, "one text")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    want = (tokenize(docs).where("word_idx is not null").groupBy("doc_id")
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("word_idx", F.lower("token").alias("t")))), lambda x: x["t"]).alias("w")))
    got = {r.doc_id: r.words for r in document_words(docs).collect() if r.words}
    assert got == {r.doc_id: r.w for r in want.collect()}
    index, old = I.index_documents(docs), I.build_index(tokenize(docs), "doc_id", docs)
    for name in ("postings", "doc_stats", "term_stats"):
        rows = lambda i: sorted(map(str, getattr(i, name).select(*sorted(getattr(old, name).columns)).collect()))  # noqa: E731, B023
        assert rows(index) == rows(old)


def test_blocks_run_on_over_batches(spark, monkeypatch):
    monkeypatch.setattr(I, "ROWS_AT_ONCE", 3)
    import pyarrow as pa
    rows = [(t, 0, s, 10 * s + k, k + 1, 9, list(range(k + 1))) for t, s, n in (("a", 1, 1), ("a", 2, 8), ("b", 2, 2), ("c", 0, 5)) for k in range(n)]
    cols = list(zip(*rows))
    types = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32())]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["term", "part", "seg", "key", "tf", "dl", "positions"])
    for size in (1, 2, 5, 100):
        out = [r for b in I._blocks_in_order(batch.slice(i, size) for i in range(0, len(rows), size)) for r in b.to_pylist()]
        assert [(r["term"], r["seg"], r["n"], r["max_tf"]) for r in out] == [("a", 1, 1, 1), ("a", 2, 8, 8), ("b", 2, 2, 2), ("c", 0, 5, 5)]
        assert [r["keys"] for r in out][1] == [20 + k for k in range(8)] and out[1]["positions"][2] == [0, 1, 2]


@pytest.mark.parametrize("join", [True, False])
def test_phrases_move_each_block_once(spark, join, monkeypatch):
    if not join:
        monkeypatch.setattr(I, "is_small", lambda *a, **k: False)
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, " ".join(rng.choice("abcd") for _ in range(60))) for i in range(40)] + [(None, "a b c")], "doc_id long, text string")
    q = spark.createDataFrame([(i, " ".join(rng.choice("abcd") for _ in range(3))) for i in range(30)] + [(None, "a b")], "question_id long, query string")
    idx = I.materialize_index(I.index_documents(docs), "moved-once", docs)
    hits = I.search(idx, q, 1000, 2)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "explode(positions" not in plan
    rows = hits.collect()
    assert rows and all(r.doc_id is not None and r.question_id is not None and 0 <= r.width <= 2 for r in rows)


def test_landed_rows_are_many_files_but_the_same_batches(spark, tmp_path, monkeypatch):
    from tessera.plans import streams as S
    monkeypatch.setattr(S, "LANDING_BYTES", 200)
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["red", "blue", "green."]) for _ in range(30)), "en", "s", 9) for i in range(80)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(str(tmp_path / "documents.parquet"))
    sf, seen = str(tmp_path), []
    real = S.stream_index
    monkeypatch.setattr(S, "stream_index", lambda spark, src, schema, out, *a, **k: seen.append((src, out)) or real(spark, src, schema, out, *a, **k))
    want = {(r.term, r.df, r.cf, r.max_tf) for r in S.R.q_index_stats(spark, sf).collect()}
    assert {(r.term, r.df, r.cf, r.max_tf) for r in S.q_stream_compacted(spark, sf).collect()} == want
    src, out = seen[-1]
    assert spark.read.parquet(out).select("batch").distinct().count() == 7
    assert spark.read.parquet(src).select(F.input_file_name()).distinct().count() > 7
    assert {(r.term, r.df, r.cf, r.max_tf) for r in S.q_stream_index(spark, sf).collect()} == want


def test_tokens_written_by_document_are_not_shuffled_again(spark):
    from pyspark.sql import Window

    from tessera.util import materialize_by
    docs = spark.createDataFrame([(i, "a b. c") for i in range(50)] + [(None, "x y"), (7, "again")], "doc_id long, text string")
    tok = tokenize(docs)
    held = materialize_by(tok, "doc_id", "tokens-test")
    assert sorted(map(str, held.collect())) == sorted(map(str, tok.collect())) and held.columns == tok.columns
    after = held.withColumn("n", F.lead("token").over(Window.partitionBy("doc_id").orderBy("tok_idx")))
    assert "Exchange" not in after._jdf.queryExecution().executedPlan().toString()
