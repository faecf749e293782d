"""Reader parsers on hand-written rows in the fixture formats."""

from pyspark.sql import functions as F

from tessera.sources.readers import (
    check_conll_args, conll_documents, conll_units, parse_links, parse_news, parse_papers, parse_pubtator,
    parse_standoff, read_news, PAPER_SCHEMA,
)
from tessera.operators.tags import iob_decode
import pytest


def test_news_inline(spark):
    f = spark.createDataFrame([("a/x.txt", "-- The redundant line \n The Original News Text Here")], "file string, content string")
    r = parse_news(f).first()
    assert r["text"] == "The Original News Text Here" and r["pack_name"] == "x.txt"


def test_news_invalid_utf8_and_headers(spark, tmpdir_fresh):
    import os
    with open(os.path.join(tmpdir_fresh, "n1.txt"), "wb") as fh:
        fh.write(b"-- title\n--\n body \xff line \n x -- y\n\n")
    with open(os.path.join(tmpdir_fresh, "n2.txt"), "wb") as fh:
        fh.write(b"-- only\n-- header\n")
    got = {r["pack_name"]: r["text"] for r in read_news(spark, tmpdir_fresh).collect()}
    assert got == {"n1.txt": "body  line\nx -- y", "n2.txt": ""}


def test_paper_sections(spark):
    rows = [("p/a.json", '{"paper_id": "a", "metadata": {"title": "T1"}, "abstract": [], '
                         '"body_text": [{"text": " b1"}, {"text": "b2"}]}')]
    f = spark.createDataFrame(rows, "file string, json string")
    papers = f.select("file", F.from_json("json", PAPER_SCHEMA).alias("j")).select("file", "j.*")
    docs, anns = parse_papers(papers)
    assert docs.first()["text"] == "T1\n\n\n\n b1b2"
    got = {r["type"]: (r["begin"], r["end"]) for r in anns.collect()}
    assert got == {"Title": (0, 2), "Abstract": (4, 4), "Body": (6, 11), "Document": (0, 11)}


def test_pubtator(spark):
    rec = ("1|t|Title x\n1|a|Abstract with | bar\n1\t0\t5\tTitle\tT1,T2\tC1\n1\t2\t3\tx\n"
           "1\t8\t16\tAbstract\tT3\tC2")
    docs, m, bad = parse_pubtator(spark.createDataFrame([("f", rec)], "file string, record string"))
    d = docs.first()
    assert d["text"] == "Title x\nAbstract with | bar\n" and d["pack_name"] == "1"
    got = sorted((r["begin"], r["end"], r["surface"], r["ner_type"], r["umls_link"]) for r in m.collect())
    assert got == [(0, 5, "Title", "T1,T2", "UMLS:C1"), (8, 16, "Abstract", "T3", "UMLS:C2")]


def test_standoff(spark):
    txt = spark.createDataFrame([("d1", "alpha beta gamma")], "name string, text string")
    ann = "\n".join([
        "T1\tA 0 5\talpha", "N1\tReference T1 UMLS:C1",
        "T2\tB 6 10\tbeta", "N2\tReference T1 UMLS:C9",   # names another T: ignored
        "T3\tC 11 16\tgamma", "N3\tReference T3 UMLS:cui_less", "N4\tReference T3 UMLS:C3",  # last N wins
        "Tx\tD 1 2\tl", "T4\tE 1 2;5 6\tbad", "N5\tReference T4 C4"])
    a = spark.createDataFrame([("d1", ann), ("d2", "")], "name string, content string")
    _, m, bad = parse_standoff(txt, a)
    got = sorted((r["t_id"], r["begin"], r["end"], r["surface"], r["umls_link"]) for r in m.collect())
    assert got == [("T1", 0, 5, "alpha", "UMLS:C1"), ("T2", 6, 10, "beta", None), ("T3", 11, 16, "gamma", "UMLS:C3")]
    assert sorted(r["reason"] for r in bad.collect()) == ["bad offsets", "no UMLS: link"]


CONLL = """-DOCSTART- -X- -X- O

EU NNP B-NP B-ORG
rejects VBZ B-VP O
German JJ B-NP B-MISC
call NN I-NP O
to TO B-VP O
boycott VB I-VP O
British JJ B-NP B-MISC
lamb NN I-NP O
. . O O
"""


def test_conll_worked_example(spark):
    f = spark.createDataFrame([("f1", CONLL)], "file string, content string")
    u = conll_units(f, ("word", "pos", None, "entity_label"))
    docs, sents = conll_documents(u)
    assert docs.first()["text"] == "EU rejects German call to boycott British lamb ."
    k = u.withColumn("doc_id", F.concat_ws("#", "file", F.col("doc_ord").cast("string")))
    got = sorted((r["begin"], r["end"], r["ner_type"]) for r in iob_decode(k, segment="sent_ord").collect())
    assert got == [(0, 2, "ORG"), (11, 17, "MISC"), (34, 41, "MISC")]


def test_conll_n_sentences(spark):
    content = "\n\n".join(f"w{i} O" for i in range(7)) + "\n"
    u = conll_units(spark.createDataFrame([("f", content)], "file string, content string"),
                    ("word", "entity_label"), doc_break=None, n_sent_per_doc=3)
    docs, _ = conll_documents(u)
    assert sorted(r["n_sentences"] for r in docs.collect()) == [1, 3, 3]


def test_conll_args():
    with pytest.raises(ValueError):
        check_conll_args(["word", "foo"], "-DOCSTART-", 0)
    with pytest.raises(ValueError):
        check_conll_args(["word", "word", "entity_label"], "-DOCSTART-", 0)
    with pytest.raises(ValueError):
        check_conll_args(["word"], "-DOCSTART-", 0)
    with pytest.raises(ValueError):
        check_conll_args(["word", "entity_label"], None, 0)


def test_links(spark):
    content = "-DOCSTART- (1)\n0\tY_a\thttp://a\t10\t/m/a\n2\t--NME--\n0\tY_b\thttp://b\t11\n"
    links = parse_links(spark.createDataFrame([("f", content)], "file string, content string"))
    got = {r["token_idx"]: (r["yago2_entity"], r["wiki_id"]) for r in links.collect()}
    assert got == {0: ("Y_b", 11), 2: (None, None)}


def test_conll_split_scan_matches_whole_file(spark, tmpdir_fresh):
    import os
    from tessera.sources.readers import read_conll
    blocks = []
    for d in range(40):
        sents = []
        for s_ in range(3):
            sents.append("\n".join(f"W{d}x{s_}x{i} NN - {'B-PER' if i == 0 else 'O'}" for i in range(6)))
        blocks.append("-DOCSTART- -X- -X- O\n\n" + "\n\n".join(sents))
    content = "\n\n".join(blocks) + "\n"
    path = os.path.join(tmpdir_fresh, "c")
    os.makedirs(path)
    with open(os.path.join(path, "big.conll"), "w") as fh:
        fh.write(content)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        u_split = read_conll(spark, path, ".conll", ("word", "pos", None, "entity_label"))
        split_rows = sorted((r["doc_ord"], r["sent_ord"], r["tok_idx"], r["begin"], r["word"]) for r in u_split.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    whole = conll_units(spark.createDataFrame([("big.conll", content)], "file string, content string"),
                        ("word", "pos", None, "entity_label"))
    whole_rows = sorted((r["doc_ord"], r["sent_ord"], r["tok_idx"], r["begin"], r["word"]) for r in whole.collect())
    assert len(split_rows) == 40 * 3 * 6
    assert [r[0] for r in split_rows] == [r[0] for r in whole_rows]
    assert [(r[2], r[3], r[4]) for r in split_rows] == [(r[2], r[3], r[4]) for r in whole_rows]


def test_conll_n_sentences_split_scan(spark, tmpdir_fresh):
    import os
    from tessera.sources.readers import read_conll
    sents = []
    for s_ in range(50):
        body = "\n".join(f"w{s_}x{i} {'B-X' if i == 0 else 'O'}" for i in range(5))
        sents.append(("# note\n" if s_ % 7 == 0 else "") + body)
    content = "\n\n\n".join(sents) + "\n"
    path = os.path.join(tmpdir_fresh, "n")
    os.makedirs(path)
    with open(os.path.join(path, "f.conll"), "w") as fh:
        fh.write(content)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        u = read_conll(spark, path, ".conll", ("word", "entity_label"), doc_break=None, n_sent_per_doc=10)
        docs, _ = conll_documents(u)
        got = sorted((r["doc_ord"], r["n_sentences"], r["n_tokens"]) for r in docs.collect())
        first = {r["doc_ord"]: r["text"].split(" ")[0] for r in docs.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == [(d, 10, 50) for d in range(5)]
    assert first == {d: f"w{10 * d}x0" for d in range(5)}


def test_mention_class_and_ends_of_the_linked_reader(spark):
    from tessera.sources.readers import conll_mentions

    words = [("EU", "B-ORG"), ("rejects", "O"), ("German", "B-MISC"), ("call", "O"), ("to", "O"), ("boycott", "O"), ("British", "B-MISC"),
             ("lamb", "O"), (".", "O")]
    content = "-DOCSTART-\n\n" + "\n".join(" ".join(w) for w in words) + "\n\n-DOCSTART-\n\nin O\nNew B-LOC\nYork I-LOC\n"
    units = conll_units(spark.createDataFrame([("f", content)], "file string, content string"), ("word", "entity_label"))
    key = lambda df: sorted((r.doc_ord, r.begin, r.end, r.ner_type, r.type) for r in df.collect())
    assert key(conll_mentions(units)) == [(1, 0, 2, "ORG", "EntityMention"), (1, 11, 17, "MISC", "EntityMention"),
                                          (1, 34, 41, "MISC", "EntityMention"), (2, 3, 11, "LOC", "EntityMention")]
    got = key(conll_mentions(units, "WikiEntityMention", linked_compat=True))
    assert [g[:3] for g in got] == [(1, 0, 3), (1, 11, 18), (1, 34, 42), (2, 3, 7)] and {g[4] for g in got} == {"WikiEntityMention"}


def test_conll_units_of_contents_cut_each_file_once(spark):
    """files given whole are dealt once and counted in one order (no join
    of every line with the counts); a blank marker line ends no sentence."""
    content = "A O\n-DOCSTART- O\n\n# c\nBb B-X\nc I-X\n\nd O\n-DOCSTART- O\n\n\te O \n"
    files = spark.createDataFrame([("f", content), (None, content), ("g", None)], "file string, content string")
    units = conll_units(files, ("word", "entity_label"))
    got = sorted(tuple(r) for r in units.select("file", "doc_ord", "sent_ord", "tok_idx", "begin", "end", "word", "label").collect())
    assert got == [("f", 0, 0, 0, 0, 1, "A", "O"), ("f", 1, 1, 0, 0, 2, "Bb", "B-X"), ("f", 1, 1, 1, 3, 4, "c", "I-X"),
                   ("f", 1, 2, 2, 5, 6, "d", "O"), ("f", 2, 1, 0, 0, 1, "e", "O")]
    plan = units._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1
