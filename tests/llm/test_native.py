"""Mixing, fingerprints and line templates: odd input, brute force, invariants."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm import fingerprints, line_templates, mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_mix_targets_and_cut(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("aaaaaabbbc") if i % 17 else None, " ".join("x" * rng.randint(0, 40)) or None) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix_sources(docs).collect()
    size = Counter()
    for _, s, t in rows:
        size[s] += len(WORD.findall(t or ""))
    names = sorted((s for s in size if s is not None)) + [None]
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    target, full = {}, set()
    while True:  # fill by weight, close those above their cap, again
        rest = sum(size.values()) - sum(3 * size[s] for s in full)
        unit = rest / sum(weight[s] for s in names if s not in full)
        over = {s for s in names if s not in full and weight[s] * unit > 3 * size[s]}
        if not over:
            break
        full |= over
    target = {s: 3 * size[s] if s in full else weight[s] * unit for s in names}
    taken = Counter()
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    for s in names:
        assert abs(taken[s] - target[s]) <= 1
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix_sources(docs.repartition(7)).collect()), key=str)


def test_mix_ranges_split_a_hot_source(spark, monkeypatch):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("hot").alias("source"),
                                   F.expr("repeat('a ', cast(id % 7 as int))").alias("text"))
    one = sorted(map(tuple, mixing.mix_sources(docs).collect()))
    monkeypatch.setattr(mixing, "RANGE_ROWS", 10)
    assert sorted(map(tuple, mixing.mix_sources(docs).collect())) == one


def test_mix_whole_documents_and_odd_rows(odd, none):
    got = mixing.mix_sources(odd, cut="documents").collect()
    assert len(got) == odd.count()
    for r in got:
        assert r["size"] == len(WORD.findall(r.text or "")) and (r["size"] == 0 or r.taken % r["size"] == 0)
        assert r["_row"].startswith("k") and ":" in r["key"] and ":" in r["range"]
    assert mixing.mix_sources(none).collect() == []
    with pytest.raises(ValueError):
        mixing.mix_sources(odd, cut="other")


def winnow(hashes, w):
    """Textbook: of each window the least, rightmost of equals."""
    kept = []
    for i in range(max(1, len(hashes) - w + 1)):
        window = list(enumerate(hashes[i:i + w], i))
        best = min(window, key=lambda x: (x[1], -x[0]))
        if not kept or kept[-1] != best:
            kept.append(best)
    return kept


def test_winnowing_is_the_textbook_one(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("ab cd ef gh ij kl".split()) for _ in range(n)) for n in (0, 1, 2, 3, 4, 5, 11, 12, 40, 300)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in fingerprints.fingerprint(docs).collect():
        words = r.text.split() or [""]
        got = [(p.pos, p.hash) for p in r.fingerprint]
        # every window's least must be there; read the k-gram hashes off a window of one
        every = fingerprints.fingerprint(docs.where(F.col("doc_id") == r.doc_id), window_levels=0).first().fingerprint
        hashes = [p.hash for p in every]
        assert [p.pos for p in every] == list(range(max(1, len(words) - 3)))
        assert got == winnow(hashes, 8)
        grams = Counter(tuple(words[i:i + 4]) for i in range(len(hashes)))
        assert len(set(hashes)) == len(grams)


def test_edited_text_next_document_and_ranges(spark):
    rng = random.Random(7)
    rows = [(10 * i, "".join(rng.choice("abc é😀\n") for _ in range(rng.randint(0, 60)))) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = {}
    for i, (d, t) in enumerate(rows):
        h, nxt = len(t) // 2, rows[(i + 1) % len(rows)][1]
        want[d] = t[:len(t) - h] + nxt[:h]
    for buckets in (1, 4, 200):
        got = fingerprints.edited_likeness(docs, buckets=buckets).collect()
        assert {r.doc_id: r.edited_text for r in got} == want and len(got) == len(rows)
        for r in got:
            assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and r.n_chars == len(dict(rows)[r.doc_id])


def test_shared_run_is_always_caught(spark):
    rng = random.Random(11)
    rows = []
    for i in range(60):
        run = " ".join(f"r{rng.randint(0, 10**6)}" for _ in range(11))
        pad = lambda: " ".join(f"p{rng.randint(0, 10**6)}" for _ in range(rng.randint(0, 30)))
        rows += [(2 * i, f"{pad()} {run} {pad()}"), (2 * i + 1, f"{pad()} {run} {pad()}")]
    fp = {r.doc_id: {p.hash for p in r.fingerprint}
          for r in fingerprints.fingerprint(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(fp[2 * i] & fp[2 * i + 1] for i in range(60))


def test_fingerprints_of_odd_rows(odd, none):
    got = fingerprints.edited_likeness(odd).collect()
    assert len(got) == odd.count() and all(r.kept for r in got)
    same = [r for r in got if r.doc_id == 1]
    assert len({tuple(r.kept) for r in same}) == 2
    assert fingerprints.edited_likeness(none).collect() == []
    alone = fingerprints.edited_likeness(odd.where("doc_id = 7")).first()
    assert alone.near_next == 1.0 and alone.edited_text == "one one"
    kept = fingerprints.fingerprint(odd)
    assert kept.columns == [*odd.columns, "fingerprint"] and kept.count() == odd.count()


def dropped(spark, texts, **options):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return {r.doc_id: r.text for r in line_templates.drop_recurring(docs, **options).collect()}


def test_templates_with_variable_fields_go(spark):
    own = [" ".join(f"{w}{i}x" for w in "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()) for i in range(5)]
    own = [re.sub(r"\d", lambda m: "abcdefgh"[int(m[0])], o) for o in own]
    names = ["anna", "bert", "carl", "dora", "emil"]
    texts = [f"{o}\nposted by the user {n} on {i} May in our forum" for i, (o, n) in enumerate(zip(own, names))]
    assert dropped(spark, texts) == dict(enumerate(own))
    # two documents are too few
    assert dropped(spark, texts[:2]) == dict(enumerate(texts[:2]))


def test_copies_stay_whole_and_short_lines_recur_by_equality(spark):
    copy = "one line of the text that is here\nanother line of the text that is there"
    texts = [copy] * 5 + [f"yes yes\n{w} is a line of its own for this one" for w in ("red", "blue", "green", "grey")]
    got = dropped(spark, texts, constant_share=1.0)
    assert all(got[i] == copy for i in range(5))
    assert all("yes yes" not in got[i] for i in range(5, 9))
    cookie = "we use cookies on this site and that is that for now"  # more than half of each document
    texts = [f"{cookie}\n{w} a {w}" for w in ("red", "blue", "green", "grey", "pink", "white")]
    assert dropped(spark, texts) == {i: t.split("\n")[1] for i, t in enumerate(texts)}


def test_lines_of_odd_rows(odd, none):
    got = line_templates.drop_recurring(odd)
    assert got.columns == [*odd.columns, "n_lines_dropped"]
    want = Counter((r.doc_id, r.text, r["_d"]) for r in odd.collect())
    assert Counter((r.doc_id, r.text, r["_d"]) for r in got.collect()) == want
    assert line_templates.drop_recurring(none).collect() == []


def words_of(i, n):
    return " ".join("abcdefghij"[(i * 7 + j * 3) % 10] + "abcdefghij"[(i + j) % 10] * (1 + (i + j * j) % 5) + "qrstuvwxyz"[i % 10] for j in range(n))


def test_recurring_lines_go_whatever_their_share(spark):
    foot = "this long footer line of the site is on every page of it and says very much about cookies"
    texts = [f"{words_of(i, 4)}\n{foot}" for i in range(4)] + [f"{words_of(9, 8)}\n{words_of(8, 9)}"] * 4
    want = {i: words_of(i, 4) for i in range(4)} | {i: texts[i] for i in range(4, 8)}
    assert dropped(spark, texts) == want


def test_pipeline_drops_lines_of_copies_and_of_short_documents(spark):
    import corpus_pipeline

    foot = "this long footer line of the site is on every page of it and says very much about cookies"
    body = "\n".join(words_of(i, 12) for i in range(10))
    texts = [f"{words_of(20 + i, 4)}\n{foot}" for i in range(4)] + [f"{body}\n{foot}"] * 3 + [f"{body} end{c}\n{foot}" for c in "abc"]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    # the near copies keep what only they share, and no document keeps the footer
    assert got == {i: t.removesuffix(f"\n{foot}") for i, t in enumerate(texts)}


def test_classes_of_copies_and_clashing_names(spark, odd, none):
    foot = "this long footer line of the site is on every page of it and says very much about cookies"
    docs = spark.createDataFrame([(i, f"{words_of(i, 4)}\n{foot}", "own") for i in range(4)], "doc_id long, text string, template string")

    def classes(*names):
        rows = [(r.h, n) for r, n in zip(docs.select(F.xxhash64("text").alias("h")).collect(), names) if n is not None]
        return spark.createDataFrame(rows, "text_hash long, class long")

    assert all(foot in r.text for r in line_templates.drop_recurring(docs, copies=classes(7, 7, 7, 8)).collect())
    assert not any(foot in r.text for r in line_templates.drop_recurring(docs, copies=classes(7, 7, None, None)).collect())
    got = line_templates.drop_recurring(odd, copies=classes(1, 2, 3, 4).limit(0))
    assert got.columns == [*odd.columns, "n_lines_dropped"] and got.count() == odd.count()
    assert line_templates.drop_recurring(none, copies=classes(1, 1, 1, 1)).count() == 0


def test_copy_classes(spark, odd, none):
    from tessera.llm.copy_classes import copy_classes

    rng = random.Random(8)
    words = [f"{a}{b}{c}" for a in "klmnp" for b in "aeiou" for c in "rstvx"]
    base = [rng.choice(words) for _ in range(200)]
    texts = [" ".join(base)] * 2
    for _ in range(8):
        near = list(base)
        for _ in range(3):
            near[rng.randrange(200)] = rng.choice(words)
        texts.append(" ".join(near))
    other = [" ".join(base[:60]) + " " + " ".join(rng.choice(words) for _ in range(140)) for _ in range(5)]  # a shared passage only
    docs = spark.createDataFrame([(t,) for t in texts + other + [None, ""]], "text string")
    by = {r.text_hash: r["class"] for r in copy_classes(docs).collect()}
    own = [by[r.h] for r in docs.select(F.xxhash64("text").alias("h")).collect()]
    assert len(set(own[:10])) == 1 and len(set(own[:15])) == 6
    got = copy_classes(odd)
    assert got.count() == odd.select("text").distinct().count()
    assert copy_classes(none).count() == 0
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()


def test_masking_is_linear_in_a_token(spark):
    docs = spark.createDataFrame([(i, "a" * 300_000 + " b c d") for i in range(3)], "doc_id long, text string")
    assert line_templates.drop_recurring(docs).count() == 3


def test_queries_run_without_python(spark):
    from tessera.llm.queries import QUERIES

    for name in ("op4_fingerprints",):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan
    assert hashlib  # digests are made by the JVM
