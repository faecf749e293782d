"""Registered queries against DuckDB, and the pipeline against its parts."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
import corpus_pipeline
from tools.check import digest

SF = "/root/testdata/sf0.001"
NUMBERED = [f"op{i}_" for i in range(1, 14)]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark", "labels", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_each_operator_has_one_query():
    names = E.queries()
    assert "pipeline" in names and all(sum(n.startswith(p) for n in names) == 1 for p in NUMBERED)


@pytest.mark.parametrize("name", ["op1_chat_format", "op2_jaccard_join", "op6_line_templates", "op10_mix_sources",
                                  "op11_structure_repair", "op12_suffix_dedup", "op13_hard_negatives"])
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(E.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert digest(df.columns, rows)[0] == digest(cols, cur.fetchall())[0]


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
        if i < 4:
            assert docs.columns == columns
        if name in ("line_dedup", "near_duplicates"):
            assert docs.join(before.select("doc_id"), "doc_id", "left_anti").count() == 0
        if name == "line_dedup":
            assert docs.count() == before.count() and docs.where("n_chars != length(text)").count() == 0
    assert counts[1] < counts[0] and counts[3] < counts[2]
    assert docs.where(~F.col("round_trip")).count() == 0
    assert len(good) > 0
    empty = corpus_pipeline.STAGES[0][1](spark, before.limit(0), SF)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0


def test_stages_carry_clashing_columns(spark, odd, none):
    extra = {c: F.lit(f"own {c}") for c in ("copy", "target", "taken", "score", "base_failed", "_class", "_h", "text_hash", "a.b", "_copy")}
    docs = odd.withColumns(extra)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.columns[:len(columns)] == columns
        rows = out.collect()
        assert all(r[c] == f"own {c}" for r in rows for c in extra)
        if name == "quality":
            assert all(r.text for r in rows)
        if name == "line_dedup":
            assert len(rows) == docs.count() and sum(r.text is None for r in rows) == docs.where("text is null").count()
        if name == "mix":
            assert all(r["size"].endswith(":0") for r in rows)
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert out.columns == [*columns, "n_tokens", "token_ids", "round_trip"] and all(r.round_trip for r in rows)
