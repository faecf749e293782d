"""R-tree search and hard-negative mining against brute force."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import hard_negatives as hn


def brute(rows, positives=5, negatives=5, low=80, high=100, scale=256):
    live = []
    for vec_id, vector, label in rows:
        if label is None or vector is None or any(x is None or not np.isfinite(x) for x in vector):
            continue
        live.append((vec_id, [int(np.floor(scale * float(np.float32(x)))) for x in vector], label))
    key = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for i, (a, q, label) in enumerate(live):
        if a is None or a % 100:
            continue
        scores = [(sum(x * y for x, y in zip(q, v)), n, k) for j, (n, v, k) in enumerate(live) if j != i]
        same = sorted([s for s in scores if s[2] == label], key=key)[:positives]
        for ps, pid, _ in same:
            fit = sorted([s for s in scores if s[2] != label and low * ps <= 100 * s[0] <= high * ps], key=key)[:negatives]
            out += [(a, pid, r, s[1], ps, s[0]) for r, s in enumerate(fit, 1)]
    return sorted(out, key=str)


def rows_of(df):
    return sorted(map(tuple, df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=str)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 60), st.integers(1, 4), st.integers(1, 3), st.integers(0, 10_000), st.booleans())
def test_best_first_is_exact(n, d, n_labels, seed, same):
    rng = np.random.default_rng(seed)
    v, labels, ids = rng.integers(-4, 5, (n, d)), rng.integers(0, n_labels, n), rng.integers(0, 30, n)
    order, starts = hn.pack(labels, v, leaf=3)
    assert sorted(order.tolist()) == list(range(n))
    v, labels, ids = v[order].astype(float), labels[order], ids[order]
    tree = hn.Tree(ids, labels, v, starts)
    q = rng.integers(-4, 5, (2, d)).astype(float)
    intervals = [hn.bounds(q, box[0], box[1]) for box in tree.levels]
    floors, tops, k = [hn.LOWEST, 1, 3], [hn.HIGHEST, 4, 3], 3
    own = int(rng.integers(-1, n))
    got = hn.best_first(tree, intervals, 1, q[1], 0, own, floors, tops, k, same)
    for w in range(3):
        fit = [(int(s), int(i)) for j, (s, i, x) in enumerate(zip(v @ q[1], ids, labels))
               if j != own and (x == 0) == same and floors[w] <= s <= tops[w]]
        assert got[w] == sorted(fit, key=lambda x: (-x[0], x[1]))[:k]


def test_pruning_leaves_out_boxes(monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 8)) * 100
    v = np.floor(centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 8)))
    labels = np.zeros(4000, np.int64)
    order, starts = hn.pack(labels, v, leaf=50)
    tree = hn.Tree(np.arange(4000)[order], labels, v[order], starts)
    intervals = [hn.bounds(v[:1], box[0], box[1]) for box in tree.levels]
    seen = []
    monkeypatch.setattr(hn, "_may", lambda *a, f=hn._may: seen.append(1) or f(*a))
    found = hn.best_first(tree, intervals, 0, v[0], 0, -1, [hn.LOWEST], [hn.HIGHEST], 5, True)[0]
    assert [s for s, _ in found] == sorted((v @ v[0]).astype(int).tolist(), reverse=True)[:5]
    assert len(seen) < sum(len(b[0]) for b in tree.levels) * 0.8


@pytest.mark.parametrize("shard,block", [(8192, 512), (40, 3)])
def test_mining_odd_rows_in_many_shards(spark, monkeypatch, shard, block):
    monkeypatch.setattr(hn, "SHARD_ROWS", shard)
    monkeypatch.setattr(hn, "BLOCK", block)
    monkeypatch.setattr(hn, "PAGE", 2)
    rng = np.random.default_rng(11)
    rows = [(int(i), [float(x) for x in rng.normal(size=5).astype(np.float32)], int(rng.integers(0, 3))) for i in range(0, 900, 5)]
    rows += [(100, rows[20][1], 1), (100, rows[20][1], 1), (700, [0.5, 0.25], 0), (1100, [], 2), (1200, None, 1), (1300, [1.0, None], 1),
             (1400, [float("nan")] * 5, 1), (1500, [float("inf")] * 5, 0), (None, [0.3] * 5, 2), (None, [0.9] * 5, 0), (1600, [0.2] * 5, None),
             (1700, [0.1] * 5, 7), (1800, [-1.0] * 5, 0), (-300, [0.4] * 5, 0), (1900, [0.0] * 5, 1)]
    schema = "vec_id long, embedding array<float>, label int, kind string, shard string, v int, page int"
    df = spark.createDataFrame([(*r, "clash", "clash", 1, 2) for r in rows], schema)
    assert rows_of(hn.mine(df, F.col("vec_id") % 100 == 0)) == brute(rows)


def test_empty_single_and_other_parameters(spark):
    schema = "vec_id long, embedding array<float>, label int"
    df = spark.createDataFrame([(0, [1.0], 1), (1, [2.0], 1), (2, [1.7], 2), (3, [1.9], 2), (4, [2.0], 3)], schema)
    assert hn.mine(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert hn.mine(df.where("vec_id = 0"), F.col("vec_id") % 100 == 0).count() == 0
    got = rows_of(hn.mine(df, F.col("vec_id") % 100 == 0, positives=1, negatives=2, low=90, high=97))
    assert got == brute([tuple(r) for r in df.collect()], 1, 2, 90, 97)


def test_large_components(spark):
    schema = "vec_id long, embedding array<double>, label int"
    big = float(1 << 18)  # products beyond the doubles' 53 bits
    rows = [(0, [big, big + 1, 3.0], 1), (1, [big - 1, big, 5.0], 1), (2, [big - 3, big - 1, 1.0], 2), (3, [big - 3, big - 1, 2.0], 2)]
    assert rows_of(hn.mine(spark.createDataFrame(rows, schema), F.col("vec_id") % 100 == 0)) == brute(rows)
    rows = [(i, [1e30], i % 2) for i in range(4)]
    with pytest.raises(Exception, match="beyond 64 bits"):
        hn.mine(spark.createDataFrame(rows, schema), F.col("vec_id") % 100 == 0).count()
