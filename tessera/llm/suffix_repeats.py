"""Suffix-array dedup: every byte covered by a string of ``length`` bytes that
also starts earlier goes; the first occurrence stays.

Equal strings of ``length`` bytes hold equal grams at equal places, so also
the same least gram (by hash, the leftmost). Runs of neighbouring windows with
one least gram are a *unit*, and equal windows meet in the units of one gram:

1. each document is cut into units; only hashes and places are shuffled;
2. of units equal as a whole, all but the first repeat it: no more is needed;
3. units that share a gram but differ are read from the texts and brought
   together by gram. There a suffix array of their windows is built by prefix
   doubling, and the longest-previous-factor array from the previous and the
   next smaller position in suffix order; windows whose factor reaches
   ``length`` repeat an earlier one;
4. the repeats' windows, merged per document, are cut from its bytes.

Grams in too many units for one task are dealt by their single windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import _BASE, _BASE_INV, _U, _powers, mix64, small_batches
from tessera.util import materialize

LENGTH, GRAM = 100, 32
#: Bytes hashed at once; bytes of units sorted at once; units of a gram in one task.
STRETCH, CHUNK, BIG = 1 << 18, 1 << 22, 20_000
#: Documents from which grams too frequent for one task are learned (balance only).
SAMPLE = 20_000
_BYTE = np.random.default_rng(20240307).integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_NULL_ID = -(1 << 63)


class Hashes:
    """Hashes of any stretch of a buffer, from one running sum."""

    def __init__(self, b: np.ndarray):
        self.sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_BYTE[b] * _powers(_BASE, len(b))[:len(b)], out=self.sums[1:])

    def of(self, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * _powers(_BASE_INV, len(self.sums))[:len(self.sums)][start])

    def window(self, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of the windows at ``start``."""
        return self.of(start, start + length), self.of(start, start + max(1, length // 2)) ^ _U(0x5851F42D4C957F2D)


def _pieces(texts: list[bytes], length: int):
    """Groups of ``(document, offset, bytes)`` of about ``STRETCH`` bytes that
    hold every window of every text once; long texts overlap."""
    group, size = [], 0
    most = max(STRETCH // 2, length)
    for i, raw in enumerate(texts):
        for at in range(0, len(raw) - length + 1, most):
            part = raw[at:at + most + length - 1]
            if group and size + len(part) > STRETCH:
                yield group
                group, size = [], 0
            group.append((i, at, part))
            size += len(part)
    if group:
        yield group


def _units_of(group: list, length: int, gram: int, hot: np.ndarray) -> dict[str, np.ndarray]:
    lengths = np.array([len(p) for _, _, p in group])
    ends = np.cumsum(lengths)
    b = np.frombuffer(b"".join(p for _, _, p in group), np.uint8)
    bits = max(1, int(len(b)).bit_length())
    low = _U((1 << bits) - 1)
    hashes = Hashes(b)
    n = len(b) - gram + 1
    least = (hashes.of(slice(0, n), slice(gram, gram + n)) & ~low) | np.arange(n, dtype=np.uint64)
    width, have = length - gram + 1, 1
    while have < width:  # least of ever longer windows
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    place = (least & low).astype(np.int64)
    left = np.repeat(ends, lengths)[:len(place)] - np.arange(len(place))
    valid = left >= length
    new = valid.copy()
    new[1:] &= (place[1:] != place[:-1]) | ~valid[:-1]
    start = np.flatnonzero(new)
    stops = np.append(np.flatnonzero(new | ~valid), len(place))
    stop = stops[np.searchsorted(stops, start, side="right")]
    piece = np.searchsorted(ends, start, side="right")
    h, s = hashes.of(place[start], place[start] + gram), hashes.of(start, stop + length - 1)
    m = stop - start
    # equal neighbours (periodic text): the first is a unit, the others repeat it
    again = np.zeros(len(start), bool)
    again[1:] = (h[1:] == h[:-1]) & (s[1:] == s[:-1]) & (start[1:] == stop[:-1]) & (piece[1:] == piece[:-1])
    first = np.flatnonzero(~again)
    more = np.add.reduceat(np.where(again, m, 0), first) if len(first) else np.zeros(0, np.int64)
    start, m, h, s, piece = start[first], m[first], h[first], s[first], piece[first]
    if len(hot) and len(h):
        is_hot = hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h
        if is_hot.any():
            at = np.flatnonzero(is_hot)
            one = np.repeat(start[at], m[at]) + np.arange(m[at].sum()) - np.repeat(np.cumsum(m[at]) - m[at], m[at])
            tail = np.zeros(len(one), np.int64)
            tail[np.cumsum(m[at]) - 1] = more[at]
            hw, sw = hashes.window(one, length)
            cool = ~is_hot
            start, h, s = np.concatenate([start[cool], one]), np.concatenate([h[cool], hw]), np.concatenate([s[cool], sw])
            piece = np.concatenate([piece[cool], np.repeat(piece[at], m[at])])
            m, more = np.concatenate([m[cool], np.ones(len(one), np.int64)]), np.concatenate([more[cool], tail])
    own = np.array([i for i, _, _ in group])[piece]
    offset = np.array([at for _, at, _ in group])[piece] - np.append(0, ends[:-1])[piece]
    return {"doc": own, "a": start + offset, "m": m, "more": more, "h": h, "s": s}


def units(texts: list[bytes], length: int = LENGTH, gram: int = GRAM, hot: np.ndarray = np.zeros(0, np.uint64)) -> dict[str, np.ndarray]:
    """The units of ``texts``: number of the text, first window ``a``, windows
    ``m``, how many windows after them repeat them (``more``), hash of the
    gram ``h`` and of the unit's bytes ``s``. Units of a gram in ``hot`` (sorted)
    are given window by window."""
    parts = [_units_of(g, length, gram, hot) for g in _pieces(texts, length)]
    kinds = {"doc": np.int64, "a": np.int64, "m": np.int64, "more": np.int64, "h": np.uint64, "s": np.uint64}
    return {k: np.concatenate([p[k] for p in parts]).astype(t) if parts else np.zeros(0, t) for k, t in kinds.items()}


def smaller_before(position: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place of the suffix order, the nearest earlier place whose
    suffix starts at a smaller position (-1: none), and how far the two agree.
    ``lcp[i]``: how far the suffixes at places ``i - 1`` and ``i`` agree. By
    pointer jumping: a place found too large is replaced by what it points at."""
    n = len(position)
    at, common = np.arange(-1, n - 1), lcp.copy()
    open_ = np.flatnonzero(at >= 0)
    while True:
        open_ = open_[position[at[open_]] > position[open_]]
        if not len(open_):
            break
        over = at[open_]
        common[open_] = np.minimum(common[open_], common[over])
        at[open_] = at[over]
        open_ = open_[at[open_] >= 0]
    common[at < 0] = 0
    return at, common


def longest_previous_factor(order: np.ndarray, position: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For each suffix, the longest prefix that also starts at a smaller
    position: the better of the previous and the next smaller position in
    suffix order. ``order``: suffixes in order; ``lcp``: see
    :func:`smaller_before`."""
    ranked = position[order]
    _, before = smaller_before(ranked, lcp)
    _, after = smaller_before(ranked[::-1], np.append(lcp[1:], 0)[::-1].copy())
    out = np.zeros(len(order), np.int64)
    out[order] = np.maximum(before, after[::-1])
    return out


def suffix_order(b: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows of ``length`` bytes at ``start`` in order, and the common
    prefix of each with the one before it: ranks of 1, 2, 4, ... bytes by
    prefix doubling."""
    ranks, have = [(1, b.astype(np.int64))], 1
    while have * 2 <= length:
        r = ranks[-1][1]
        n = len(r) - have
        key = r[:n] * (int(r.max(initial=0)) + 1) + r[have:have + n]
        ranks.append((have * 2, np.unique(key, return_inverse=True)[1].astype(np.int64)))
        have *= 2
    top = ranks[-1][1]
    key = top[start] * (int(top.max(initial=0)) + 1) + top[start + length - have]
    order = np.argsort(key, kind="stable")
    x, y = start[order[:-1]], start[order[1:]]
    common = np.zeros(len(x), np.int64)
    for _ in range(2):  # of the remaining length the powers of two fit twice at most
        for size, r in reversed(ranks):
            fits = np.flatnonzero(common + size <= length)
            same = r[x[fits] + common[fits]] == r[y[fits] + common[fits]]
            common[fits[same]] += size
    return order, np.append(0, common) if len(order) else common


def repeats(contents: list[bytes], rank: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each unit the windows (numbers in it) that also start in an earlier
    unit or earlier in it; ``rank``: the units' order in the corpus."""
    sizes = np.array([len(c) for c in contents])
    base, windows = np.cumsum(sizes) - sizes, sizes - length + 1
    b = np.frombuffer(b"".join(contents), np.uint8)
    own = np.repeat(np.arange(len(contents)), windows)
    inner = np.arange(len(own)) - np.repeat(np.cumsum(windows) - windows, windows)
    order, lcp = suffix_order(b, base[own] + inner, length)
    position = rank[own] * (int(windows.max(initial=0)) + 1) + inner
    found = longest_previous_factor(order, position, lcp) >= length
    return np.split(inner[found], np.cumsum(np.bincount(own[found], minlength=len(contents)))[:-1])


def _hashed(docs: DataFrame, length: int, gram: int, hot: np.ndarray) -> DataFrame:
    """Slim rows of the units: ``h``, ``s``, ``d``, ``t``, ``at`` (first window
    and windows in one number) and ``more``. Rows of ``at`` without windows
    only say that the ``more`` windows from there repeat earlier ones."""
    span = 1 << (length - 1).bit_length()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, t = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            u = units(batch.column(2).to_pylist(), length, gram, hot)
            keep = np.ones(len(u["h"]), bool)
            m, more = u["m"], u["more"]
            if len(hot):  # windows of hot grams meet in the batch first
                order = np.lexsort((u["a"], t[u["doc"]], d[u["doc"]], u["s"], u["h"]))
                same = np.append(False, (u["h"][order][1:] == u["h"][order][:-1]) & (u["s"][order][1:] == u["s"][order][:-1]))
                m, more = m.copy(), more.copy()
                later = order[same]
                more[later] += m[later]
                m[later] = 0
                # neighbours that only repeat become one row
                by = np.lexsort((u["a"], u["doc"]))
                plain = m[by] == 0
                joins = np.append(False, plain[1:] & plain[:-1] & (u["doc"][by][1:] == u["doc"][by][:-1])
                                  & (u["a"][by][1:] == u["a"][by][:-1] + more[by][:-1]))
                heads = np.flatnonzero(~joins)
                sums = np.add.reduceat(np.where(plain, more[by], 0), heads) if len(heads) else np.zeros(0, np.int64)
                more[by[heads]] = np.where(plain[heads], sums, more[by[heads]])
                keep[by[joins]] = False
            cols = [u["h"].view(np.int64), u["s"].view(np.int64), d[u["doc"]], t[u["doc"]], u["a"] * span + m, more]
            # what only repeats is spread by its place
            cols[0] = np.where(m == 0, mix64((u["a"] + d[u["doc"]] * 31).astype(np.int64).view(np.uint64)).view(np.int64), cols[0])
            yield pa.RecordBatch.from_arrays([pa.array(c[keep], pa.int64()) for c in cols], names=names)

    names = ["h", "s", "d", "t", "at", "more"]
    return docs.select("d", "t", "content").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _cut(docs: DataFrame, refs: DataFrame, length: int) -> DataFrame:
    """Bytes of the units asked for: ``key``, ``s``, ``d``, ``t``, ``a``,
    ``content``; of units of big grams one row per window, without bytes."""
    span = 1 << (length - 1).bit_length()
    wanted = refs.groupBy("d", "t").agg(F.collect_list(F.struct("h", "at", "big")).alias("refs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, t = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            lists = batch.column(3)
            offsets, flat = lists.offsets.to_numpy(), lists.values
            h, at, big = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            out: list = [[], [], [], [], [], []]
            for i, raw in enumerate(batch.column(2)):
                raw, here = raw.as_py(), slice(offsets[i], offsets[i + 1])
                a, m = at[here] // span, at[here] % span
                for key, x, n in zip(h[here][~big[here]], a[~big[here]], m[~big[here]]):
                    for col, value in zip(out, (int(key), 0, d[i], t[i], int(x), raw[x:x + n + length - 1])):
                        col.append(value)
                for x, n in zip(a[big[here]], m[big[here]]):
                    start = np.arange(n)
                    keys, seconds = Hashes(np.frombuffer(raw[x:x + n + length - 1], np.uint8)).window(start, length)
                    for col, values in zip(out, (keys.view(np.int64).tolist(), seconds.view(np.int64).tolist(), [d[i]] * n, [t[i]] * n,
                                                 (x + start).tolist(), [None] * n)):
                        col.extend(values)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, [pa.int64()] * 5 + [pa.binary()])], names=names)

    names = ["key", "s", "d", "t", "a", "content"]
    joined = docs.join(wanted, ["d", "t"]).select("d", "t", "content", "refs")
    return joined.mapInArrow(run, "key long, s long, d long, t long, a long, content binary")


def _found(cut: DataFrame, length: int) -> DataFrame:
    """Windows that repeat, as rows ``d``, ``t``, ``a``, ``n``, from rows dealt by key."""
    dealt = cut.repartition(F.col("key")).sortWithinPartitions("key")

    def runs(d, t, a, windows):
        """Runs of consecutive windows, from lists of window numbers."""
        for i, w in enumerate(windows):
            if len(w):
                edge = np.flatnonzero(np.diff(w, prepend=w[0] - 2) != 1)
                for x, n in zip(w[edge], np.diff(np.append(edge, len(w)))):
                    yield int(d[i]), int(t[i]), int(a[i] + x), int(n)

    def solve(held: list[pa.RecordBatch]) -> list[tuple]:
        table = pa.Table.from_batches(held)
        key, s, d, t, a = (table[c].to_numpy() for c in ("key", "s", "d", "t", "a"))
        whole = ~table["content"].is_null().to_numpy()
        out = []
        at = np.flatnonzero(whole)
        if len(at):
            rank = np.empty(len(at), np.int64)
            rank[np.lexsort((a[at], t[at], d[at]))] = np.arange(len(at))
            out += runs(d[at], t[at], a[at], repeats(table["content"].filter(pa.array(whole)).to_pylist(), rank, length))
        at = np.flatnonzero(~whole)
        if len(at):
            at = at[np.lexsort((a[at], t[at], d[at], s[at], key[at]))]
            same = np.append(False, (key[at][1:] == key[at][:-1]) & (s[at][1:] == s[at][:-1]))
            out += [(int(d[i]), int(t[i]), int(a[i]), 1) for i in at[same]]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if size > CHUNK:  # up to the last key so far, which may go on in this batch
                last = held[-1].column(0)[held[-1].num_rows - 1].as_py()
                keys = batch.column(0).to_numpy()
                split = int(np.searchsorted(keys, last, side="right"))
                held.append(batch.slice(0, split))
                if split < batch.num_rows:
                    yield rows(solve(held))
                    held, size = [], 0
                batch = batch.slice(split)
                if not batch.num_rows:
                    continue
            held.append(batch)
            size += batch.nbytes
        if held:
            yield rows(solve(held))

    def rows(found: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*found)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["d", "t", "a", "n"])

    return dealt.mapInArrow(run, "d long, t long, a long, n long")


def _spans(marks: DataFrame, length: int) -> DataFrame:
    """The bytes that the windows of ``marks`` cover, merged per document."""
    per_doc = marks.groupBy("d", "t").agg(F.collect_list(F.struct("a", "n")).alias("marks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            counts, flat = np.diff(lists.offsets.to_numpy()), lists.flatten()
            own = np.repeat(np.arange(batch.num_rows), counts)
            a, n = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            order = np.lexsort((a, own))
            own, a, end = own[order], a[order], (a + n + length - 1)[order]
            far = own * (int(end.max(initial=0)) + 2)  # documents side by side, apart
            reach = np.maximum.accumulate(end + far)
            head = np.flatnonzero(np.append(True, (a + far)[1:] > reach[:-1])) if len(a) else np.zeros(0, np.int64)
            last = np.append(head[1:], len(a)) - 1
            spans = pa.StructArray.from_arrays([pa.array(a[head]), pa.array((reach - far)[last])], names=["start", "end"])
            offsets = np.append(0, np.cumsum(np.bincount(own[head], minlength=batch.num_rows)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans)],
                                             names=["d", "t", "spans"])

    return per_doc.mapInArrow(run, "d long, t long, spans array<struct<start:long,end:long>>")


def _hot_grams(docs: DataFrame, n_docs: int, n_bytes: int, length: int, gram: int) -> np.ndarray:
    """Grams whose units would fill a task by themselves, from a sample. Only
    the balance of the tasks depends on them, never the result."""
    share = min(1.0, SAMPLE / max(n_docs, 1))
    units_there = 2 * n_bytes * share / (length - gram + 2)
    limit = max(20, 3 * units_there / int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sample = docs if share == 1 else docs.sample(share, seed=7)
    counts = _hashed(sample, length, gram, np.zeros(0, np.uint64)).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    rows = counts.where(F.col("n") > limit).select("h").collect()  # at most a third of the number of partitions
    return np.sort(np.array([r.h for r in rows], np.int64).view(np.uint64))


def _keyed(docs: DataFrame) -> tuple[DataFrame, int, int]:
    """Documents as ``d``, ``t``, ``content``, ``copies``, in the order of
    ``d``, ``t``: the id alone orders them where it is unique, else the hash of
    the text goes second and equal rows are one."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("d"),
                       F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    n, least, n_bytes, most = (rows.groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).alias("b"))
                               .agg(F.sum("n"), F.min("d"), F.sum("b"), F.max("n")).first())
    if (most or 0) <= 1:
        return rows.select("d", F.lit(0).cast("long").alias("t"), "content", F.lit(1).cast("long").alias("copies")), n or 0, n_bytes or 0
    rows = rows.select("d", F.xxhash64("content").alias("t"), "content")
    return rows.groupBy("d", "t").agg(F.first("content").alias("content"), F.count(F.lit(1)).alias("copies")), n, n_bytes


def _kept(content: Column, spans: Column) -> Column:
    """``content`` without ``spans`` (sorted, apart)."""
    return F.expr(f"""cast(array_join(transform(sequence(0, size({spans})), i -> cast(substring({content},
        cast(if(i = 0, 0, {spans}[i - 1].end) as int) + 1,
        cast(if(i = size({spans}), length({content}), {spans}[i].start) - if(i = 0, 0, {spans}[i - 1].end) as int)) as string)), '') as binary)""")


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Documents (``doc_id`` integer, ``text``) as UTF-8 bytes without what
    repeats: ``doc_id``, ``n_bytes``, ``spans`` (removed, as sorted byte ranges
    apart from each other) and ``kept`` (the bytes left).

    A byte goes if a string of ``length`` bytes that covers it also starts
    earlier: in a document of smaller ``doc_id``, or earlier in the same one.
    Strings overlap freely, never cross documents and are judged on the
    input. A null ``doc_id`` comes first. Rows equal in ``doc_id`` go by a hash
    of their text; of equal rows the first stays and the others go whole, if
    ``length`` bytes long. Null text: empty, no bytes. Empty table: no rows.
    Other columns are not read. Equality is that of 128-bit hashes in steps 1
    and 2 (see above) and of grams too frequent for one task; else of bytes.

    Texts move once, to where their units are cut and their spans removed.
    """
    if not 2 <= gram <= length:
        raise ValueError("a gram has at least two bytes and at most the length of a repeat")
    spark = docs.sparkSession
    small_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    span = 1 << (length - 1).bit_length()
    keyed, n_docs, n_bytes = _keyed(docs)
    hot = _hot_grams(keyed, n_docs, n_bytes, length, gram)
    w = Window.partitionBy("h").orderBy("s", "d", "t", "at")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seen = (_hashed(keyed, length, gram, hot)
            .select("*", (F.lag("s").over(w) == F.col("s")).alias("same"), (F.first("s").over(whole) != F.last("s").over(whole)).alias("differ"),
                    F.count(F.lit(1)).over(whole).alias("units"))
            .withColumn("m", F.col("at") % span).withColumn("same", (F.col("m") == 0) | F.coalesce("same", F.lit(False))))
    flagged = materialize(seen.where("same or differ or more > 0").select(
        "h", "d", "t", "at", "m", "more", "same", (F.col("differ") & ~F.col("same")).alias("ref"), (F.col("units") > BIG).alias("big")), "repeat-units")
    start = F.floor(F.col("at") / span).cast("long")
    known = flagged.where("same or more > 0").select(
        "d", "t", F.when(F.col("same"), start).otherwise(start + F.col("m")).alias("a"),
        F.when(F.col("same"), F.col("m") + F.col("more")).otherwise(F.col("more")).alias("n"))
    texts = keyed.repartition(parts, "d", "t")
    found = _found(_cut(texts, flagged.where("ref"), length), length)
    spans = _spans(known.unionByName(found), length)
    none = F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")
    out = texts.join(spans, ["d", "t"], "left").select(
        F.nullif("d", F.lit(_NULL_ID)).cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.length("content").cast("long").alias("n_bytes"),
        "content", F.coalesce("spans", none).alias("spans"), F.explode(F.expr("sequence(1, copies)")).alias("copy"))
    gone = F.when(F.col("n_bytes") >= length, F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))).otherwise(none)
    out = out.withColumn("spans", F.when(F.col("copy") == 1, F.col("spans")).otherwise(gone))
    return out.select("doc_id", "n_bytes", "spans", F.when(F.size("spans") == 0, F.col("content")).otherwise(_kept("content", "spans")).alias("kept"))


#: DuckDB: every window of 100 bytes by its first place. Texts as hex digits, two a byte, in overlapping blocks.
REPEATS_SQL = r"""
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
b AS (SELECT doc_id, j, substr(x, 2 * j + 1, 998) AS y FROM t, unnest(range(0, greatest(length(x) // 2 - 99, 0), 400)) AS u(j)),
w AS (SELECT doc_id, j + i AS i, row_number() OVER (PARTITION BY md5(substr(y, 2 * i + 1, 200)) ORDER BY doc_id, j + i) > 1 AS again
      FROM b, unnest(range(0, length(y) // 2 - 99)) AS u(i)),
r AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100, true) AS head FROM w WHERE again),
g AS (SELECT doc_id, i, sum(head::INTEGER) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM r),
s AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM g GROUP BY doc_id, g),
k AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before,
             lead(a) OVER (PARTITION BY doc_id ORDER BY a) IS NULL AS final FROM s),
c AS (SELECT t.doc_id, string_agg(substr(x, 2 * k.before + 1, 2 * (k.a - k.before)), '' ORDER BY k.a)
               || max(CASE WHEN k.final THEN substr(x, 2 * k.b + 1) ELSE '' END) AS kept,
             sum(k.b - k.a) AS n_removed, count(*) AS n_spans
      FROM t JOIN k ON t.doc_id = k.doc_id GROUP BY t.doc_id)
SELECT t.doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(c.kept, t.x))) AS kept_sha256
FROM t LEFT JOIN c ON t.doc_id = c.doc_id
"""
