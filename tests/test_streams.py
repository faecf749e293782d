"""Incremental index with compaction and tombstones, running scores."""

from pyspark.sql import functions as F

from tessera.operators.index import build_index
from tessera.operators.tokens import tokenize
from tessera.streaming import jobs
from tessera.util import scratch_path

SCHEMA = "doc_id long, text string, removed boolean"


def land(spark, src, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)


def content(idx):
    return (sorted(map(tuple, idx.postings.select("term", "doc_id", "positions", "tf", "dl").collect())),
            sorted(map(tuple, idx.doc_stats.collect())), sorted(map(tuple, idx.term_stats.collect())))


def test_compaction_keeps_the_index_and_drops_history(spark):
    batches = [[(1, "a b", False), (2, "b c", False), (3, "c", False)], [(1, "a a", False)], [(2, None, True), (4, "", False)],
               [(5, "b", None), (3, "c d", False)], [(2, "z", False), (5, None, True)], [(5, None, True), (9, None, True)]]
    last = {}
    for b in batches:
        for d, t, gone in b:
            last[d] = None if gone else t
    live = [(d, t) for d, t in last.items() if t is not None]
    docs = spark.createDataFrame(live, "doc_id long, text string")
    want = content(build_index(tokenize(docs), docs=docs))
    for every in (1, 2, 4, 100):
        src, out, ckpt = (scratch_path(spark, n) for n in ("in", "out", "ckpt"))
        for b in batches[:3]:
            land(spark, src, b)
        jobs.stream_index(spark, src, SCHEMA, out, ckpt, compact_every=every)
        for b in batches[3:]:  # the stream goes on from its checkpoint
            land(spark, src, b)
        idx = jobs.stream_index(spark, src, SCHEMA, out, ckpt, compact_every=every)
        assert content(idx) == want
        if every <= 4:
            newest = jobs._newest_generation(spark, out)
            assert newest == {1: 5, 2: 5, 4: 3}[every]
            held = spark.read.parquet(f"{out}-generations/upto={newest}")
            assert held.where("term is null and dl is null").count() == 0
            assert held.where("term is null").groupBy("doc_id").count().where("count > 1").count() == 0
        # compacting again, also what is held already, changes nothing
        jobs.compact_index(spark, out, 5)
        jobs.compact_index(spark, out, 2)
        assert content(jobs.merged_index(jobs.index_rows(spark, out))) == want
        assert jobs.index_rows(spark, out).where("term is null").count() == len(live)


def test_a_generation_without_success_is_not_read(spark):
    src, out, ckpt = (scratch_path(spark, n) for n in ("in", "out", "ckpt"))
    land(spark, src, [(1, "a", False)])
    idx = jobs.stream_index(spark, src, SCHEMA, out, ckpt, compact_every=100)
    want = content(idx)
    spark.range(3).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{out}-generations/upto=7")
    assert jobs._newest_generation(spark, out) is None
    assert content(jobs.merged_index(jobs.index_rows(spark, out))) == want


def test_running_scores_go_on_after_a_restart(spark):
    counts, out, ckpt = (scratch_path(spark, n) for n in ("counts", "out", "ckpt"))
    rows, total, want = [(3, 5, 4), (0, 0, 0), (2, 2, 6), (1, 4, 1)], [0, 0, 0], []
    for i, r in enumerate(rows):
        spark.createDataFrame([r], "exact long, n_ref long, n_pred long").coalesce(1).write.parquet(f"{counts}/batch={i}")
        if i in (1, 3):  # two runs of two batches each
            got = jobs.running_scores(spark, counts, out, ckpt)
        total = [a + b for a, b in zip(total, r)]
        want.append((i, *total, round(100 * total[0] / total[2], 6), round(100 * total[0] / total[1], 6)))
    got = got.select("batch", "exact", "n_ref", "n_pred", F.round("precision", 6), F.round("recall", 6))
    assert sorted(map(tuple, got.collect())) == want
