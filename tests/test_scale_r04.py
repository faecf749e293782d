"""Tokens stay with their document: no step of these queries shuffles or
writes them wide, and results are those of the plain definitions."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators.tags import bio_encode, iob_decode
from tessera.operators.tokens import tokenize, with_sentence_idx
from tessera.sources.readers import conll_documents, conll_units
from tessera.util import materialize_by, text_partitions

TEXTS = ["Anna met Bob Stone. He is 12 or 3!", "No caps here", "", "One. Two  Three\nFour 55", "A B. C D 7 e F"]


def documents(spark, path, extra=()):
    rng = random.Random(4)
    rows = [(i, rng.choice(TEXTS) + " " + rng.choice(TEXTS)) for i in range(60)] + list(extra)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(path / "documents.parquet"))
    return str(path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(str, df.collect()))


def test_text_partitions_grow_with_the_bytes(spark, tmp_path, monkeypatch):
    from tessera import util
    d = spark.read.parquet(f"{documents(spark, tmp_path)}/documents.parquet")
    least = text_partitions(spark)
    assert text_partitions(spark, d) == least
    size = util.input_bytes(d.where("doc_id > 3"))
    assert 0 < size < 1 << 20
    monkeypatch.setattr(util, "TASK_BYTES", max(size // (3 * least), 1))
    assert 3 * least <= text_partitions(spark, d) <= util.MOST_TIMES * least
    assert tokenize(d).rdd.getNumPartitions() == text_partitions(spark, d)
    monkeypatch.setattr(util, "TASK_BYTES", 1)
    assert text_partitions(spark, d) == min(size, util.MOST_TIMES * least)


def test_column_file_queries_move_no_unit(spark, tmp_path):
    from tessera.plans import readers as R
    sf = documents(spark, tmp_path, [(3, TEXTS[0]), (3, TEXTS[0]), (None, "No Key")])
    _, docs, ments = R._conll_parsed(spark, sf)
    for df in (docs, ments):
        assert "Exchange" not in plan(df)
    assert docs.count() and ments.count()


@pytest.mark.parametrize("twice", [False, True])
def test_units_of_whole_files_are_those_of_their_lines(spark, twice):
    from tessera.sources.readers import content_lines
    lines = ["x NN - O", "-DOCSTART- -X-", "", " EU NNP - B-ORG ", "# EU is no word", " call NN - O\u0085", "", "", "a\x1cb - -", "only", "  ",
             "é\U0001f600 N - O", "-DOCSTART- again", "-DOCSTART-", "", "last W - I-X", ""]
    files = spark.createDataFrame([("a", "\n".join(lines)), ("b", "\r\n".join(lines[3:])), ("c", "\r".join(lines[:5])), ("d", ""), (None, "no FILE"),
                                   ("e", None)], "file string, content string")
    if twice:  # the lines of two contents of one file are taken in turn
        files = files.unionAll(files.where("file = 'a'"))
        u = conll_units(files.where("file = 'a'"), ("word", "pos", None, "entity_label"))
        one = conll_units(files.where("file = 'a'").limit(1), ("word", "pos", None, "entity_label"))
        assert [r.word for r in u.orderBy("doc_ord", "tok_idx").collect()] == [
            r.word for r in one.orderBy("doc_ord", "tok_idx").collect() for _ in range(2)]
        return
    u = conll_units(files, ("word", "pos", None, "entity_label"))
    want = conll_units(content_lines(files), ("word", "pos", None, "entity_label"), lines_given=True).where("file is not null")
    assert rows(u.withColumn("sent_ord", F.col("sent_ord").cast("long"))) == rows(want.withColumn("sent_ord", F.col("sent_ord").cast("long")))
    assert "Window" not in plan(u)
    d, _ = conll_documents(u)
    assert plan(d).count("Exchange") <= 2  # by file, then by document: no third for a distinct count
    assert {(r.file, r.doc_ord): (r.n_tokens, r.n_sentences) for r in d.collect()}[("a", 1)] == (5, 3)


def test_labels_are_given_without_a_shuffle_of_units(spark, tmp_path):
    from tessera.plans.tagging import reference_runs
    d = spark.read.parquet(f"{documents(spark, tmp_path)}/documents.parquet")
    tok = with_sentence_idx(tokenize(d))
    lab = bio_encode(tok, reference_runs(tok))
    p = plan(iob_decode(lab, segment="sent_idx"))
    assert p.count("Exchange hashpartitioning") == p.count("REPARTITION_BY_NUM")  # the documents alone
    assert lab.columns == [*tok.columns, "label"]
    units = spark.createDataFrame([(1, 0, 0, 2), (None, 0, 0, 2)], "doc_id long, tok_idx int, begin int, end int")
    ments = spark.createDataFrame([(1, 0, 5, "A"), (None, 0, 5, "B")], "doc_id long, begin int, end int, ner_type string")
    assert {(r.doc_id, r.label) for r in bio_encode(units, ments).collect()} == {(1, "B-A"), (None, "O")}


def test_labelled_tokens_stay_in_their_buckets(spark, tmp_path):
    from tessera.plans import tagging as T
    lab, _ = T.labelled(spark, documents(spark, tmp_path))
    assert "Exchange" not in plan(iob_decode(lab, segment="sent_idx")) and "Exchange" not in plan(T.capital_runs(lab))


def test_buckets_are_written_as_the_rows_come(spark):
    tok = tokenize(spark.createDataFrame([(i, "a b. c") for i in range(50)], "doc_id long, text string"))
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    held = materialize_by(tok, "doc_id", "as-they-come")
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before
    assert rows(held) == rows(tok)


def test_long_aliases_walk_the_tokens_in_their_buckets(spark, monkeypatch):
    from tessera.operators import concepts as C
    docs = spark.createDataFrame([(i, "one two three four five six seven. one two") for i in range(20)], "doc_id long, text string")
    alias = spark.createDataFrame([("three four five six seven", "x", "C1"), ("one", "y", "C2")], "alias string, name string, cui string")
    real, seen = C.token_runs, []
    monkeypatch.setattr(C, "token_runs", lambda units, *a: seen.append(plan(real(units, *a))) or real(units, *a))
    got = C.find_mentions(tokenize(docs), alias)
    assert "Exchange" not in seen[0]
    assert {(r.begin, r.end, r.n, r.cui) for r in got.collect()} == {(0, 3, 1, "C2"), (35, 38, 1, "C2"), (8, 33, 5, "C1")} and got.count() == 60


def segment_rows(ops, length):
    """(new_begin, new_end, orig_begin, orig_end, replaced) of ops (begin, end, text)."""
    out, at, new = [], 0, 0
    for b, e, t in [*ops, (length, length, None)]:
        if b > at:
            out.append((new, new + b - at, at, b, False))
            new += b - at
        if t is not None:
            out.append((new, new + len(t), b, e, True))
            new += len(t)
        at = e
    return out, new


def test_original_span_is_that_of_the_nearest_segment(spark):
    from tessera.operators.edits import MODES, original_span
    rng = random.Random(8)
    segs, spans, want = [], [], {}
    for doc in range(40):
        length, at, ops = rng.randint(0, 30), 0, []
        while at < length and rng.random() < 0.8:
            b = rng.randint(at, length)
            e = rng.randint(b, min(length, b + 5))
            ops.append((b, e, "x" * rng.choice([0, 1, 4])))
            at = e + 1
        mine, total = segment_rows(ops, length)
        segs += [(doc, *s) for s in mine]
        for b in range(total + 2):
            for e in range(b, min(total + 2, b + 4)):
                spans.append((doc, b, e))
                got = []
                for x, end in ((b, False), (e, True)):
                    near = [s for s in mine if s[0] <= x <= s[1]]
                    best = [s for s in near if (x > s[0] if end else x < s[1])]
                    # all that may be chosen: several empty ones at a place are equally near
                    best = best or [s for s in near if s[0] == min(n[0] for n in near)]
                    vals = set()
                    for nb, ne, ob, oe, rep in best[:1] if best and (best[0][0] < best[0][1]) and len(best) == 1 else best:
                        exact = ob if x == nb else oe if x == ne else ob + x - nb
                        far = {"relaxed": oe if end else ob, "strict": None, "backward": ob, "forward": oe}
                        vals.add(tuple(far[m] if rep and nb < x < ne else exact for m in MODES))
                    got.append(vals or {(None,) * 4})
                want[doc, b, e] = got
    s = spark.createDataFrame(segs + [(None, 0, 9, 0, 9, False)], "doc_id long, new_begin int, new_end int, orig_begin int, orig_end int, replaced boolean")
    p = spark.createDataFrame(spans + spans[:5] + [(None, 1, 2)], "doc_id long, begin int, end int")
    out = original_span(s, p)
    assert out.columns == ["doc_id", "begin", "end"] + [f"{x}_{m}" for x in ("begin", "end") for m in MODES]
    found = out.collect()
    assert len(found) == len(spans) + 1  # equal rows are one
    for r in found:
        b, e = tuple(r[3:7]), tuple(r[7:11])
        if r.doc_id is None:
            assert b == e == (None,) * 4
        else:
            assert b in want[r.doc_id, r.begin, r.end][0] and e in want[r.doc_id, r.begin, r.end][1]


def test_original_span_shuffles_no_token(spark, tmp_path):
    from tessera.plans.corpus import q_original_span
    p = plan(q_original_span(spark, documents(spark, tmp_path)))
    assert p.count("Union") == 2 and "SortAggregate" not in p
    above = p[:p.index("Union")]
    assert "Exchange" not in above and "ENSURE_REQUIREMENTS" not in p[p.index("Union"):p.rindex("Generate posexplode")]


def test_next_tokens_come_by_distance(spark):
    from tessera.operators.concepts import ngram_candidates, token_runs
    tok = tokenize(spark.createDataFrame([(1, "A b-c D"), (2, "x"), (None, "y z"), (3, "")], "doc_id long, text string"))
    runs = {(r.doc_id, r.begin): [(x.token, x.end, x.word) for x in r.run] for r in token_runs(tok, 3).collect()}
    assert runs[1, 0] == [("a", 1, True), ("b", 3, True), ("-", 4, False)] and runs[1, 6] == [("d", 7, True)] and runs[None, 0][1][0] == "z"
    g = ngram_candidates(tok, 4)
    assert {(r.doc_id, r.begin, r.end, r.n, r.norm) for r in g.collect()} == {
        (1, 0, 1, 1, "a"), (1, 0, 3, 2, "a b"), (1, 0, 5, 4, "a b - c"), (1, 2, 3, 1, "b"), (1, 2, 5, 3, "b - c"), (1, 2, 7, 4, "b - c d"),
        (1, 4, 5, 1, "c"), (1, 4, 7, 2, "c d"), (1, 6, 7, 1, "d"), (2, 0, 1, 1, "x"), (None, 0, 1, 1, "y"), (None, 0, 3, 2, "y z"), (None, 2, 3, 1, "z")}
    assert "collect_list" not in plan(g) and "lambda" not in plan(g)


def test_overlaps_make_their_spans_once(spark):
    from tessera.operators.spans import drop_overlaps
    a = spark.createDataFrame([(1, 0, 5, "A"), (1, 2, 3, "B"), (1, 3, 3, "Z"), (1, 3, 3, "Z"), (1, 5, 6, "C"), (2, 0, 0, "Y"), (2, None, 4, "N"),
                               (None, 0, 2, "K"), (None, 1, 3, "L")], "doc_id long, begin int, end int, type string")
    out = drop_overlaps(a)
    assert "ExistingRDD" not in plan(out) and "LocalTableScan" not in plan(out)
    assert out.columns == a.columns
    assert sorted(r.type for r in out.collect()) == ["A", "C", "K", "Y", "Z", "Z"]


def test_hit_documents_are_cut_once(spark):
    from tessera.operators import qa
    from tessera.plans.qa import lexicon
    docs = spark.createDataFrame([(1, "Bad is smoke. Fire was hot."), (2, "Ice is smoke.")], "doc_id long, text string")
    parsed, _ = qa.analyse_questions(spark.createDataFrame([("q", "what is smoke")], "question_id string, text string"), lexicon(spark))
    parsed = spark.createDataFrame(parsed.collect(), parsed.schema)
    hits = spark.createDataFrame([("q", 1, 1)], "question_id string, doc_id long, rank int")
    out = qa.extract_answers(parsed, hits, docs, lexicon(spark))
    assert "hit-tokens" in plan(out) and "regexp_extract_all" not in plan(out)
    assert [(r.arg0, r.sentence) for r in out.collect()] == [("Bad", "Bad is smoke.")]
