"""Layer 3: invariants on the sf0.001 corpus."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators.evaluate import match_counts
from tessera.operators.index import index_documents, phrase_match, query_terms
from tessera.operators.spans import drop_overlaps
from tessera.operators.tokens import split_sentences_cautious, tokenize

SF = "/root/testdata/sf0.001"


def _docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")


def test_drop_overlaps_idempotent_and_disjoint(spark):
    rnd = random.Random(7)
    rows = []
    for d in range(5):
        for _ in range(40):
            b = rnd.randrange(0, 200)
            rows.append((d, b, b + rnd.randrange(0, 15), rnd.choice("abc")))
    df = spark.createDataFrame(rows, "doc_id int, begin int, end int, type string")
    once = drop_overlaps(df)
    twice = drop_overlaps(once)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))
    nz = [r for r in once.collect() if r["begin"] < r["end"]]
    by_doc = {}
    for r in nz:
        by_doc.setdefault(r["doc_id"], []).append((r["begin"], r["end"]))
    for spans in by_doc.values():
        spans.sort()
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_drop_overlaps_of_large_clusters(spark):
    """One cluster of 100,000 spans, one of 3,000 and small ones, against the plain loop."""
    rnd = random.Random(3)
    rows = [(0, i, i + rnd.randrange(2, 9), rnd.choice("abc")) for i in range(100_000)]
    rows += [(1, b, b + rnd.randrange(1, 60), rnd.choice("abc")) for b in (rnd.randrange(2_000) for _ in range(3_000))]
    rows += [(2 + d, b, b + rnd.randrange(0, 5), "a") for d in range(40) for b in (rnd.randrange(30) for _ in range(9))]
    want, last = [], {}
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[1] - r[2], r[3])):
        if r[1] == r[2] or r[1] >= last.get(r[0], 0):
            want.append(r)
            if r[1] != r[2]:
                last[r[0]] = r[2]
    df = spark.createDataFrame(rows, "doc_id int, begin int, end int, type string").repartition(8)
    assert sorted(map(tuple, drop_overlaps(df).collect())) == sorted(want)


def test_cautious_sentences_disjoint_and_respect_mentions(spark):
    d = _docs(spark)
    tok = tokenize(d)
    w = Window.partitionBy("doc_id").orderBy("tok_idx")
    ments = (tok.withColumn("_e2", F.lead("end", 2).over(w)).where(F.col("token") == ".")
             .select("doc_id", F.col("begin").alias("begin"), F.coalesce("_e2", F.col("end")).alias("end")))
    s = split_sentences_cautious(tok, ments)
    w2 = Window.partitionBy("doc_id").orderBy("sent_idx")
    overl = s.withColumn("_pe", F.lag("end").over(w2)).where(F.col("begin") <= F.col("_pe")).count()
    assert overl == 0
    inside = (s.alias("s").join(ments.alias("m"), "doc_id")
              .where((F.col("m.begin") <= F.col("s.end")) & (F.col("s.end") < F.col("m.end"))).count())
    assert inside == 0


def test_exact_at_most_min(spark):
    rnd = random.Random(3)
    sch = "doc_id int, begin int, end int, ner_type string"
    ref = spark.createDataFrame([(rnd.randrange(3), b, b + 2, rnd.choice("AB")) for b in range(0, 60, 3)], sch)
    pred = spark.createDataFrame([(rnd.randrange(3), b, b + 2, rnd.choice("AB")) for b in range(0, 60, 2)], sch)
    for r in match_counts(ref, pred).collect():
        assert r["exact"] <= min(r["n_ref"], r["n_pred"])


def test_phrase_hits_hold_all_terms(spark):
    d = _docs(spark)
    idx = index_documents(d)
    q = spark.createDataFrame([("q", "the of and")], "question_id string, query string")
    hits = phrase_match(idx, query_terms(q), 10)
    words = tokenize(d).where("word_idx IS NOT NULL").select("doc_id", F.lower("token").alias("t"))
    have = (hits.join(words, "doc_id").where(F.col("t").isin("the", "of", "and"))
            .groupBy("doc_id").agg(F.countDistinct("t").alias("n")))
    assert have.where("n < 3").count() == 0
    assert hits.count() == have.count()
