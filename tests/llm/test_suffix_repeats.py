"""Suffix-array dedup against brute force over all windows."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import suffix_repeats as sr


def brute(rows, length):
    """Removed byte ranges and kept bytes of each row; rows come in the documents' order."""
    first, out = set(), []
    for doc_id, raw in rows:
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - length + 1):
            x = raw[i:i + length]
            if x in first:
                gone[i:i + length] = True
            first.add(x)
        edge = np.flatnonzero(np.diff(gone.astype(int), prepend=0))
        out.append((doc_id, len(raw), tuple(zip(edge[::2].tolist(), edge[1::2].tolist())), bytes(b for b, g in zip(raw, gone) if not g)))
    return out


def result(df):
    return sorted(((r.doc_id, r.n_bytes, tuple((s.start, s.end) for s in r.spans), bytes(r.kept)) for r in df.collect()), key=str)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(min_size=6, max_size=40).map(lambda b: bytes(97 + x % 2 for x in b)), min_size=1, max_size=8), st.randoms())
def test_longest_previous_factor(contents, rng):
    rank = list(range(len(contents)))
    rng.shuffle(rank)
    got = sr.repeats(contents, np.array(rank), 6)
    seen = set()
    for j in sorted(range(len(contents)), key=rank.__getitem__):
        want = []
        for i in range(len(contents[j]) - 5):
            x = contents[j][i:i + 6]
            if x in seen:
                want.append(i)
            seen.add(x)
        assert got[j].tolist() == want


@settings(max_examples=100, deadline=None)
@given(st.binary(min_size=1, max_size=60).map(lambda b: bytes(97 + x % 2 for x in b)))
def test_factors_of_a_text(raw):
    b = np.frombuffer(raw, np.uint8)
    n = len(raw)
    order = np.array(sorted(range(n), key=lambda i: raw[i:]))
    agree = lambda i, j: next((k for k in range(n) if i + k >= n or j + k >= n or b[i + k] != b[j + k]), n)
    lcp = np.array([0] + [agree(i, j) for i, j in zip(order[:-1], order[1:])])
    want = [max([agree(i, j) for j in range(i)], default=0) for i in range(n)]
    assert sr.longest_previous_factor(order, np.arange(n), lcp).tolist() == want


def test_suffix_order_with_common_prefixes():
    raw = bytes(random.Random(1).choice(b"ab") for _ in range(700)) * 2
    start = np.arange(len(raw) - 99)
    order, lcp = sr.suffix_order(np.frombuffer(raw, np.uint8), start, 100)
    windows = [raw[i:i + 100] for i in start[order]]
    assert windows == sorted(windows)
    for x, y, n in zip(windows, windows[1:], lcp[1:]):
        assert x[:n] == y[:n] and (n == 100 or x[n] != y[n])


def test_units_hold_every_window_once_and_equal_windows_meet(monkeypatch):
    rng = random.Random(2)
    texts = [bytes(rng.choice(b"abc") for _ in range(rng.choice([0, 5, 9, 10, 300]))) for _ in range(60)] + [b"x" * 5000, b"xyz" * 900]
    for stretch in (1 << 18, 256):
        monkeypatch.setattr(sr, "STRETCH", stretch)
        u = sr.units(texts, 10, 4)
        where, grams = set(), {}
        for doc, a, m, more, h in zip(*(u[k].tolist() for k in ("doc", "a", "m", "more", "h"))):
            assert m + more > 0
            for i in range(a, a + m + more):
                assert (doc, i) not in where
                where.add((doc, i))
                assert i >= a + m or grams.setdefault(texts[doc][i:i + 10], h) == h
        assert where == {(d, i) for d, t in enumerate(texts) for i in range(len(t) - 9)}
        assert len(u["h"]) < 60 * 300


@pytest.mark.parametrize("case", ["plain", "big", "hot", "small stretches"])
def test_documents_against_brute_force(spark, monkeypatch, case):
    rng = random.Random(case)
    words = ["".join(rng.choice("abcdé漢") for _ in range(rng.randint(1, 4))) for _ in range(30)]
    rows = []
    for i in range(120):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))
        if rows and rng.random() < 0.6:  # a passage of an earlier text, or all of it
            old = rng.choice(rows)[1] or ""
            at = rng.randint(0, len(old))
            text = text[:20] + old[at:at + rng.randint(0, 80)] + text[20:] if rng.random() < 0.8 else old
        rows.append((rng.randint(0, 10 ** 6), text))
    rows = list(dict(rows).items())
    rows += [(-5, "x" * 3000), (10 ** 7, "xy" * 700), (10 ** 7 + 1, None), (10 ** 7 + 2, ""), (None, rows[3][1]), (10 ** 7 + 3, rows[5][1])]
    if case == "big":
        monkeypatch.setattr(sr, "BIG", 1)
    if case == "small stretches":
        monkeypatch.setattr(sr, "STRETCH", 64)
        monkeypatch.setattr(sr, "CHUNK", 100)
    if case == "hot":
        u = sr.units([(t or "").encode() for _, t in rows], 12, 5)
        monkeypatch.setattr(sr, "_hot_grams", lambda *a: np.unique(u["h"])[::2])
    df = spark.createDataFrame([(*r, "clash", "clash", 1, 2) for r in rows], "doc_id long, text string, d string, content string, h int, spans int")
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    want = brute([(i, (t or "").encode()) for i, t in order], 12)
    assert result(sr.remove_repeats(df, length=12, gram=5)) == sorted(want, key=str)


def test_learned_hot_grams_change_nothing(spark):
    same = "the passage that everybody quotes in full and at length "
    rows = [(i, f"{i * 7919 % 101} {same * 2}{i * 31 % 17}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    keyed, n, size = sr._keyed(df)
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "64")  # a gram of every document is too much for one of so many
        assert n == 300 and len(sr._hot_grams(keyed, n, size, 40, 16)) > 0
        want = brute([(i, t.encode()) for i, t in rows], 40)
        assert result(sr.remove_repeats(df, length=40, gram=16)) == sorted(want, key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)


def test_equal_ids_and_rows(spark, odd, none):
    got = result(sr.remove_repeats(odd))
    assert len(got) == odd.count() and sr.remove_repeats(none).count() == 0
    ones = {r for r in got if r[0] == 1}
    text = odd.where("doc_id = 1").first().text.encode()
    assert (1, len(text), ((0, len(text)),), b"") in ones  # the repeated row
    long = [r for r in got if r[0] == 6]
    assert long[0][1] == 150_000 and len(long[0][3]) < 150_000
    # in the documents' order: id, then hash of the text
    from pyspark.sql import functions as F
    rows = [(r.doc_id, (r.text or "").encode()) for r in odd.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit("")).cast("binary")).alias("x"))
            .orderBy(F.asc_nulls_first("doc_id"), "x").collect()]
    # brute force over the short ones only: the long texts share no string with them
    short = [r for r in rows if len(r[1]) < 100_000]
    want = [r for r in brute(short, 100)]
    assert sorted((r for r in got if r[1] < 100_000), key=str) == sorted(want, key=str)
