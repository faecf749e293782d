"""Hard-negative mining over STR-packed R-trees, exactly.

Vectors are quantised to integers, range-sorted by label and first component
into shards, and each shard is packed into an R-tree by sort-tile-recursion.
A node's bounding box gives every coordinate of the inner product an interval,
so the node's scores lie in the sum of these intervals. A search takes nodes
best first from a queue and leaves out those whose interval misses all score
windows or lies strictly below the k-th score found.

The same bounds on the shards' boxes decide which shards a query visits: first
the most promising one, then every other that can still hold a better row.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import small_batches
from tessera.util import materialize

SHARD_ROWS, LEAF, FANOUT = 8192, 256, 8
#: Queries in one row, and shard boxes in one row.
BLOCK, PAGE = 512, 256
NONE = np.iinfo(np.int64).max     # stands for a null vec_id: last among ties
LOWEST, HIGHEST = -(1 << 62), 1 << 62


def _narrow(v: np.ndarray) -> np.ndarray:
    for kind in (np.int16, np.int32):
        if not v.size or (v.min() >= np.iinfo(kind).min and v.max() <= np.iinfo(kind).max):
            return v.astype(kind)
    return v


def _wide(raw: bytes, d: int, n: int) -> np.ndarray:
    """``[n, d]`` integers, as floats where their products are exact."""
    if not n * d:
        return np.zeros((n, d))
    v = np.frombuffer(raw, {2: np.int16, 4: np.int32, 8: np.int64}[len(raw) // (n * d)]).reshape(n, d)
    return v.astype(np.int64)


def _numbers(d: int, *parts: np.ndarray) -> list[np.ndarray]:
    """``parts`` in the type that holds all their inner products exactly."""
    most = max([float(np.abs(p.astype(np.float64)).max(initial=0)) for p in parts], default=0.0)
    if d * most * most < 1 << 53:
        return [p.astype(np.float64) for p in parts]
    if d * most * most >= 1 << 62:
        raise ValueError("components this large have inner products beyond 64 bits")
    return [p.astype(np.int64) for p in parts]


def tiles(v: np.ndarray, leaf: int = LEAF) -> list[np.ndarray]:
    """Row numbers of ``v`` in tiles of at most ``leaf`` rows: sort by the
    widest coordinate, cut into slabs, and tile each slab by the next."""
    spread = v.max(axis=0).astype(np.float64) - v.min(axis=0) if len(v) else np.zeros(v.shape[1])
    axes = np.argsort(-spread, kind="stable")[:3]

    def cut(rows: np.ndarray, axes: np.ndarray) -> list[np.ndarray]:
        n_leaves = ceil(len(rows) / leaf)
        if n_leaves <= 1 or not len(axes):
            return [rows[i:i + leaf] for i in range(0, len(rows), leaf)]
        rows = rows[np.argsort(v[rows, axes[0]], kind="stable")]
        slab = leaf * ceil(n_leaves / ceil(n_leaves ** (1 / len(axes))))
        return [t for i in range(0, len(rows), slab) for t in cut(rows[i:i + slab], axes[1:])]

    return cut(np.arange(len(v)), axes)


def pack(labels: np.ndarray, v: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows in their leaves, and where each leaf starts. Labels
    of a leaf or more rows have leaves of their own."""
    order, starts, at = [], [], 0
    by_label = np.argsort(labels, kind="stable")
    edges = np.flatnonzero(np.diff(labels[by_label], prepend=labels[by_label][:1] - 1)) if len(labels) else np.zeros(0, int)
    runs, small = [], []
    for rows in np.split(by_label, edges[1:]) if len(labels) else []:
        if len(rows) >= leaf:
            runs += [np.concatenate(small)] if small else []
            runs.append(rows)
            small = []
        else:
            small.append(rows)
            if sum(map(len, small)) >= leaf:
                runs.append(np.concatenate(small))
                small = []
    runs += [np.concatenate(small)] if small else []
    for run in runs:
        for t in tiles(v[run], leaf):
            order.append(run[t])
            starts.append(at)
            at += len(t)
    return (np.concatenate(order) if order else np.zeros(0, int)), np.array(starts, np.int64)


class Tree:
    """An R-tree over rows in leaf order; level 0 are the leaves, the last
    level is the root, and children are ``FANOUT`` consecutive nodes."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, starts: np.ndarray):
        self.ids, self.labels, self.v = ids, labels, v
        self.ends = np.append(starts[1:], len(ids))
        self.starts = starts
        box = [np.minimum.reduceat(v, starts), np.maximum.reduceat(v, starts),
               np.minimum.reduceat(labels, starts), np.maximum.reduceat(labels, starts)]
        self.levels = [box]
        while len(box[0]) > 1:
            at = np.arange(0, len(box[0]), FANOUT)
            box = [np.minimum.reduceat(box[0], at), np.maximum.reduceat(box[1], at),
                   np.minimum.reduceat(box[2], at), np.maximum.reduceat(box[3], at)]
            self.levels.append(box)


def bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each query (rows of ``q``) with
    points of each box: per coordinate the interval of ``q * [low, high]``."""
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    return up @ low.T + down @ high.T, up @ high.T + down @ low.T


def _may(label, low, high, same: bool):
    """Whether a box with labels ``low`` to ``high`` can hold such rows."""
    return (low <= label) & (label <= high) if same else (low != label) | (high != label)


def best_first(tree: Tree, intervals: list, i: int, q: np.ndarray, label: int, own: int, floors: list[int], tops: list[int],
               k: int, same: bool) -> list[list[tuple[int, int]]]:
    """For each window ``floors[w] <= score <= tops[w]`` the first ``k`` rows
    ``(score, vec_id)`` of the label (``same``) or of others, without row
    ``own``. ``intervals``: the bounds of each level; ``i``: the query's row."""
    windows = range(len(floors))
    floors = list(floors)
    best: list[list[tuple[int, int]]] = [[] for _ in windows]

    def wanted(low: float, high: float) -> bool:
        return any(high >= floors[w] and low <= tops[w] for w in windows)

    top = len(tree.levels) - 1
    queue = [(-intervals[top][1][i, 0], top, 0)]
    while queue:
        high, level, node = heappop(queue)
        if not wanted(intervals[level][0][i, node], -high):
            continue
        if level:
            low_of, high_of = intervals[level - 1][0][i], intervals[level - 1][1][i]
            box = tree.levels[level - 1]
            for child in range(node * FANOUT, min((node + 1) * FANOUT, len(box[0]))):
                if _may(label, box[2][child], box[3][child], same) and wanted(low_of[child], high_of[child]):
                    heappush(queue, (-high_of[child], level - 1, child))
            continue
        a, b = tree.starts[node], tree.ends[node]
        score = tree.v[a:b] @ q
        fits = (tree.labels[a:b] == label) if same else (tree.labels[a:b] != label)
        if a <= own < b:
            fits[own - a] = False
        fits &= score >= min(floors)
        if not fits.any():
            continue
        for w in windows:
            at = np.flatnonzero(fits & (score >= floors[w]) & (score <= tops[w]))
            if len(at):
                if len(at) > k:
                    at = at[np.lexsort((tree.ids[a:b][at], -score[at]))[:k]]
                found = best[w] + [(int(s), int(n)) for s, n in zip(score[at], tree.ids[a:b][at])]
                best[w] = sorted(found, key=lambda x: (-x[0], x[1]))[:k]
                if len(best[w]) == k:
                    floors[w] = max(floors[w], best[w][-1][0])
    return best


_QUERY = "struct<a_shard:long,a_slot:long,label:long,v:binary,seen:long,floors:array<long>,tops:array<long>>"


def _matrix(queries: list[dict], d: int) -> np.ndarray:
    return np.concatenate([_wide(x["v"], d, 1) for x in queries]) if queries else np.zeros((0, d), np.int64)


def build(vectors: DataFrame, anchors: Column, scale: int = 256) -> tuple[DataFrame, int]:
    """Written shards and queries of ``vectors``, and the dimension. Rows of
    ``kind`` 0 are trees, of ``kind`` 1 anchors."""
    x = "cast(x as double)"
    rows = (vectors.where("label is not null and embedding is not null")
            .where(F.expr(f"forall(embedding, x -> x is not null and not isnan({x}) and abs({x}) < double('infinity'))"))
            .select("vec_id", F.col("label").cast("long").alias("label"), F.coalesce(anchors, F.lit(False)).alias("anchor"),
                    F.expr(f"transform(embedding, x -> floor({scale} * {x}))").alias("v")))
    rows = materialize(rows, "vectors")
    n, d = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    d = max(d or 0, 1)
    dealt = rows.repartitionByRange(max(1, ceil(n / SHARD_ROWS)), F.col("label"), F.get("v", F.lit(0)), F.col("vec_id"), F.xxhash64("v"))
    dealt = dealt.sortWithinPartitions("label", F.get("v", F.lit(0)), "vec_id", F.xxhash64("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, held, size = TaskContext.get().partitionId() << 24, [], 0

        def close() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            ids = table["vec_id"].cast(pa.int64()).fill_null(int(NONE)).to_numpy().astype(np.int64)
            labels, marked = table["label"].to_numpy().astype(np.int64), table["anchor"].to_numpy()
            v = np.zeros((len(ids), d), np.int64)
            lists = table["v"].combine_chunks()
            lengths = np.diff(lists.offsets.to_numpy())
            place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            v[np.repeat(np.arange(len(ids)), lengths), place] = lists.flatten().to_numpy()
            order, starts = pack(labels, v)
            ids, labels, v, marked = ids[order], labels[order], v[order], marked[order]
            _numbers(d, v)
            own = np.flatnonzero(marked)
            out = [(0, shard, None, None, len(ids), ids.tobytes(), labels.tobytes(), _narrow(v).tobytes(), starts.tobytes(),
                    v.min(axis=0).tobytes(), v.max(axis=0).tobytes(), int(labels.min()), int(labels.max()))]
            out += [(1, shard, int(i), None if ids[i] == NONE else int(ids[i]), 1, None, None, v[i].tobytes(), None, None, None,
                     int(labels[i]), None) for i in own]
            kinds = [pa.int32(), *[pa.int64()] * 4, *[pa.binary()] * 6, pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

        for batch in batches:
            for at in range(0, batch.num_rows, SHARD_ROWS):
                held.append(batch.slice(at, SHARD_ROWS))
                size += held[-1].num_rows
                if size >= 2 * SHARD_ROWS:  # the ranges are estimates: a full partition makes several shards
                    yield close()
                    shard, held, size = shard + 1, [], 0
        if size:
            yield close()

    names = ["kind", "shard", "slot", "vec_id", "n", "ids", "labels", "v", "starts", "low", "high", "label_low", "label_high"]
    schema = ("kind int, shard long, slot long, vec_id long, n long, ids binary, labels binary, v binary, starts binary, low binary, high binary, "
              "label_low long, label_high long")
    return materialize(dealt.mapInArrow(run, schema), "vector-trees"), d


def _blocks(queries: DataFrame, by: str) -> DataFrame:
    """Queries in rows of about ``BLOCK`` or fewer, grouped by ``by``."""
    sizes = queries.groupBy(by).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_n")).withColumnRenamed(by, "_by")
    one = F.struct("a_shard", "a_slot", "label", "v", "seen", "floors", "tops")
    dealt = queries.join(sizes, F.col(by) == F.col("_by")).withColumn("_own", F.expr("pmod(xxhash64(a_shard, a_slot), _n)"))
    return dealt.groupBy(by, "_own").agg(F.collect_list(one).alias("queries"))


def _met(queries: DataFrame, pages: DataFrame, n_pages: int, d: int, same: bool, best: bool) -> DataFrame:
    """The shards that queries may visit by the bounds of their boxes: with
    ``best`` the most promising of a page for each query, else rows ``shard``,
    ``queries``."""
    blocks = _blocks(queries.withColumn("_group", F.floor(F.col("a_shard") / (16 << 24))), "_group")
    blocks = blocks.withColumn("page", F.explode(F.sequence(F.lit(0), F.lit(n_pages - 1)))).withColumnRenamed("_own", "own")
    pairs = blocks.join(pages, "page").select("queries", "boxes")
    pairs = pairs.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # work, not bytes, is what to spread

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q, boxes in zip(*(batch.column(i).to_pylist() for i in range(2))):
                low = np.stack([np.frombuffer(b["low"], np.int64) for b in boxes])
                high = np.stack([np.frombuffer(b["high"], np.int64) for b in boxes])
                v, low, high = _numbers(d, _matrix(q, d), low, high)
                least, most = bounds(v, low, high)
                label = np.array([x["label"] for x in q])[:, None]
                may = _may(label, np.array([b["label_low"] for b in boxes]), np.array([b["label_high"] for b in boxes]), same)
                shards = np.array([b["shard"] for b in boxes])
                may &= shards[None, :] != np.array([x["seen"] for x in q])[:, None]
                inside = np.zeros_like(may)
                for w in range(max(len(x["floors"]) for x in q)):
                    floor = np.array([x["floors"][w] if w < len(x["floors"]) else HIGHEST for x in q])[:, None]
                    top = np.array([x["tops"][w] if w < len(x["tops"]) else LOWEST for x in q])[:, None]
                    inside |= (most >= floor) & (least <= top)
                may &= inside
                if best:
                    most = np.where(may, most, -np.inf)
                    pick = most.argmax(axis=1)
                    rows = [(x["a_shard"], x["a_slot"], int(most[i, j]), int(shards[j])) for i, (x, j) in enumerate(zip(q, pick)) if may[i, j]]
                    cols = list(zip(*rows)) or [()] * 4
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a_shard", "a_slot", "bound", "shard"])
                else:
                    kind = batch.schema.field("queries").type
                    for j in np.flatnonzero(may.any(axis=0)):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([int(shards[j])], pa.int64()), pa.array([[q[i] for i in np.flatnonzero(may[:, j])]], kind)],
                            names=["shard", "queries"])

    return pairs.mapInArrow(run, "a_shard long, a_slot long, bound long, shard long" if best else f"shard long, queries array<{_QUERY}>")


def _visited(jobs: DataFrame, trees: DataFrame, d: int, k: int, same: bool) -> DataFrame:
    """Rows ``a_shard, a_slot, top, vec_id, score``: the first ``k`` of each
    query's windows in the shard of its job. Shards that many blocks visit are
    read by several tasks."""
    spark = jobs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    jobs = materialize(jobs, "vector-jobs")
    most = jobs.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    copies = max(1, ceil(most / 8))
    jobs = jobs.withColumn("g", F.expr(f"cast(pmod(xxhash64(queries[0].a_shard, queries[0].a_slot), {copies}) as int)"))
    trees = trees.select("shard", "n", "ids", "labels", "v", "starts", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("g"))
    work = (jobs.repartition(parts, "shard", "g").join(trees.repartition(parts, "shard", "g"), ["shard", "g"])
            .select("shard", "queries", "n", "ids", "labels", "v", "starts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tree = None, None
        for batch in batches:
            for r in range(batch.num_rows):
                shard, q, n, ids, labels, raw, starts = (batch.column(i)[r].as_py() for i in range(7))
                v, = _numbers(d, _wide(raw, d, n))
                if shard != now:
                    now, tree = shard, Tree(np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64), v, np.frombuffer(starts, np.int64))
                queries, tree.v, = _numbers(d, _matrix(q, d), _wide(raw, d, n))
                for box in tree.levels:
                    box[0], box[1] = box[0].astype(queries.dtype), box[1].astype(queries.dtype)
                intervals = [bounds(queries, box[0], box[1]) for box in tree.levels]
                out = []
                for i, x in enumerate(q):
                    own = x["a_slot"] if x["a_shard"] == shard else -1
                    found = best_first(tree, intervals, i, queries[i], x["label"], own, x["floors"], x["tops"], k, same)
                    out += [(x["a_shard"], x["a_slot"], t, None if n == NONE else n, s) for t, f in zip(x["tops"], found) for s, n in f]
                cols = list(zip(*out)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a_shard", "a_slot", "top", "vec_id", "score"])

    return work.mapInArrow(run, "a_shard long, a_slot long, top long, vec_id long, score long")


def search(queries: DataFrame, built: DataFrame, d: int, k: int, same: bool) -> DataFrame:
    """The first ``k`` rows (``vec_id``, ``score``, ``place`` from 1) of each
    window of ``queries`` (``a_shard``, ``a_slot``, ``label``, ``v``,
    ``floors``, ``tops``), of the query's label or of others."""
    trees = built.where("kind = 0")
    numbered = trees.select(F.floor(F.col("shard") / F.lit(1 << 24)).alias("part"), F.col("shard"), "low", "high", "label_low", "label_high")
    n_pages = max(1, ceil(((numbered.agg(F.max("part")).first()[0] or 0) + 1) / PAGE))
    boxes = F.collect_list(F.struct("shard", "low", "high", "label_low", "label_high")).alias("boxes")
    pages = materialize(numbered.groupBy(F.floor(F.col("part") / PAGE).cast("int").alias("page")).agg(boxes), "vector-boxes")
    queries = queries.withColumn("seen", F.lit(-1).cast("long"))
    key = ["a_shard", "a_slot"]

    best = _met(queries, pages, n_pages, d, same, best=True)
    target = best.groupBy(*key).agg(F.max(F.struct("bound", (-F.col("shard")).alias("shard"))).alias("b")).select(*key, (-F.col("b.shard")).alias("target"))
    first = materialize(queries.join(target, key), "vector-first")
    jobs = _blocks(first, "target").select(F.col("target").alias("shard"), "queries")
    found = materialize(_visited(jobs, trees, d, k, same), "vector-found")

    kth = (found.groupBy(*key, "top").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s")).where(F.col("n") >= k)
           .groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("top", "s"))).alias("kth")))
    rest = first.join(kth, key, "left").withColumn("floors", F.expr(
        "zip_with(floors, tops, (f, t) -> greatest(f, coalesce(try_element_at(kth, t), f)))")).withColumn("seen", F.col("target"))
    more = _visited(_met(rest, pages, n_pages, d, same, best=False), trees, d, k, same)
    w = Window.partitionBy(*key, "top").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.unionByName(materialize(more, "vector-more")).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def mine(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
         scale: int = 256) -> DataFrame:
    """Hard negatives of the rows of ``vectors`` (``vec_id`` integer,
    ``embedding`` array of numbers, ``label`` integer) marked by ``anchors``:
    ``anchor_id``, ``positive_id``, ``rank``, ``negative_id``,
    ``positive_score``, ``negative_score``.

    A component ``x`` counts as ``floor(scale * x)``; scores are inner
    products of these integers, exact to 64 bits (beyond, an error). An
    anchor's positives are its first ``positives`` other rows of its label;
    for each, the first ``negatives`` rows of other labels with ``low *
    positive <= 100 * negative <= high * positive`` are returned. Greater
    scores come first, then smaller ``vec_id`` (null last).

    Rows with a null label, a null vector or a component that is null or not
    finite take no part. Shorter vectors (and empty ones) count as if filled
    with zeros. Repeated rows are rows of their own: each is the other's
    positive, and each repeated anchor has its results. Rows without a
    ``vec_id`` take part, but are no anchors unless ``anchors`` says so. Empty
    table, or no positive or negative: no rows. Other columns are not read.
    """
    small_batches(vectors.sparkSession)
    built, d = build(vectors, anchors, scale)
    asked = built.where("kind = 1").select(F.col("shard").alias("a_shard"), F.col("slot").alias("a_slot"),
                                           F.col("vec_id").alias("anchor_id"), F.col("label_low").alias("label"), "v")
    every = asked.withColumn("floors", F.array(F.lit(LOWEST))).withColumn("tops", F.array(F.lit(HIGHEST)))
    nearest = materialize(search(every, built, d, positives, same=True).select(
        "a_shard", "a_slot", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), "place"), "positives")
    top = F.floor(F.col("positive_score") * F.lit(high).cast("decimal(20,0)") / 100).cast("long")
    floor = F.ceil(F.col("positive_score") * F.lit(low).cast("decimal(20,0)") / 100).cast("long")
    nearest = nearest.withColumn("top", top).withColumn("floor", floor)
    windows = (nearest.where("floor <= top").select("a_shard", "a_slot", "floor", "top").groupBy("a_shard", "a_slot", "top")
               .agg(F.min("floor").alias("floor")).groupBy("a_shard", "a_slot")
               .agg(F.collect_list(F.struct("top", "floor")).alias("w"))
               .select("a_shard", "a_slot", F.col("w.floor").alias("floors"), F.col("w.top").alias("tops")))
    hard = search(asked.join(windows, ["a_shard", "a_slot"]), built, d, negatives, same=False)
    own = asked.select("a_shard", "a_slot", "anchor_id")
    out = (nearest.join(hard.select("a_shard", "a_slot", "top", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"), "place")
                        .withColumnRenamed("place", "rank"), ["a_shard", "a_slot", "top"])
           # floors of one top differ by rounding at most; each positive has its own
           .where("negative_score >= floor").join(own, ["a_shard", "a_slot"]))
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def noisy(vectors: DataFrame) -> DataFrame:
    """The contract's label noise: where ``vec_id`` is divisible by 7, the
    label becomes ``(label + 1) % 10``."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return vectors.select("vec_id", "embedding", label.alias("label"))


#: DuckDB: all scores of the anchors, ranked.
MINE_SQL = r"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.r AS a, a.vec_id AS anchor_id, v.r, v.vec_id, a.label = v.label AS same,
         list_sum(list_transform(list_zip(a.e, v.e), lambda p: coalesce(p[1] * p[2], 0)))::BIGINT AS score
  FROM v AS a JOIN v ON a.vec_id % 100 = 0 AND a.r <> v.r),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id, r) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id,
       row_number() OVER (PARTITION BY p.a, p.r ORDER BY s.score DESC, s.vec_id, s.r)::INTEGER AS rank,
       s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON p.a = s.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
QUALIFY rank <= 5
"""
