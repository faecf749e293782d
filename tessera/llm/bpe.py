"""Byte-level BPE encoding and decoding by given merge ranks.

A piece (one match of the split pattern) is encoded on a segment tree over its
byte positions: leaf ``i`` holds the rank of the pair that starts at byte ``i``
and the root the leftmost pair of least rank. A merge joins two live
neighbours and updates three leaves on their way to the root. Short pieces of
a batch share one numpy array of trees and merge side by side; a long piece
has a tree of its own. Ids are packed as little-endian unsigned 32-bit
integers, as token files hold them.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import packed, replace_columns, small_batches, unpacked

#: Unicode White_Space, the tokenizer's ``\s``.
SPACE = (r"\t-\r \x85\xa0" + "".join(map(chr, (0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
         + f"{chr(0x2000)}-{chr(0x200A)}")
#: A run without white space, with the one space before it, or white space.
#: No match of the split pattern crosses these.
CHUNK = re.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]")
NONE = 1 << 62
#: Widest piece (bytes) that shares an array of trees.
WIDE = 64
#: Characters of texts handled at once, and of chunks remembered per worker.
GROUP_CHARS, CACHE_CHARS = 500_000, 1_500_000  # of each of two generations
#: Largest vocabulary file sent to the executors.
MAX_RANKS_BYTES = 64 << 20


class Coder:
    """Encoder and decoder for one vocabulary; one per Python worker."""

    def __init__(self, ranks_file: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines()) if a}
        self.pattern = regex.compile(pattern)
        # trees hold rank * width + position
        self.kind = np.int32 if (max(self.ranks.values()) + 1) * WIDE < 1 << 31 else np.int64
        self.byte_id = np.array([self.ranks[bytes([i])] for i in range(256)], self.kind)
        pairs = {}
        for t, r in self.ranks.items():
            for i in range(1, len(t)):
                a, b = self.ranks.get(t[:i]), self.ranks.get(t[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = r
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.vals = np.array([pairs[k] for k in self.keys.tolist()], self.kind)
        tokens = {r: t for t, r in self.ranks.items()}
        self.width = np.zeros(max(tokens) + 1, np.int64)
        for r, t in tokens.items():
            self.width[r] = len(t)
        self.place = np.cumsum(self.width) - self.width
        self.flat = np.frombuffer(b"".join(tokens.get(r, b"") for r in range(len(self.width))), np.uint8)
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.cached = 0

    # one tree of its own
    def _long(self, piece: bytes) -> list[int]:
        n = len(piece)
        size = 1 << (n - 1).bit_length()
        ids = self.byte_id[np.frombuffer(piece, np.uint8)].tolist()
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        get, none = self.pairs.get, NONE

        def leaf(i: int) -> int:
            j = nxt[i]
            r = get(ids[i] << 32 | ids[j]) if j < n else None
            return none if r is None else r * size + i

        tree = [none] * (2 * size)
        tree[size:size + n] = [leaf(i) for i in range(n)]
        for i in range(size - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def put(i: int, v: int) -> None:
            i += size
            tree[i] = v
            while i > 1:
                i >>= 1
                m = min(tree[2 * i], tree[2 * i + 1])
                if tree[i] == m:
                    return
                tree[i] = m

        while tree[1] < none:
            rank, i = divmod(tree[1], size)
            gone = nxt[i]
            ids[i], nxt[i] = rank, nxt[gone]
            if nxt[i] < n:
                prv[nxt[i]] = i
            put(gone, none)
            put(i, leaf(i))
            if prv[i] >= 0:
                put(prv[i], leaf(prv[i]))
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = nxt[i]
        return out

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys.take(at) == key) & (a >= 0) & (b >= 0), self.vals.take(at), -1)

    # pieces of up to w bytes (a power of two), an array of trees
    def _side_by_side(self, pieces: list[bytes], w: int) -> list[bytes]:
        count = len(pieces)
        none = np.iinfo(self.kind).max
        n = np.array([len(p) for p in pieces])[:, None]
        where = np.arange(w + 1, dtype=self.kind)  # column w: no neighbour
        live = where < n
        ids = np.full((count, w + 1), -1, self.kind)
        ids[live] = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        nxt = np.where(where + 1 < n, where + 1, self.kind(w))
        prv = np.tile(np.concatenate([[w], where[:-1]]).astype(self.kind), (count, 1))
        tree = np.full((count, 2 * w), none, self.kind)
        rank = self._rank(ids[:, :w], np.take_along_axis(ids, nxt[:, :w], 1))
        tree[:, w:] = np.where(rank >= 0, rank * w + where[:w], none)
        k = w // 2
        while k:
            tree[:, k:2 * k] = np.minimum(tree[:, 2 * k:4 * k:2], tree[:, 2 * k + 1:4 * k:2])
            k //= 2
        ids, nxt, prv, live, tree = (x.reshape(-1) for x in (ids, nxt, prv, live, tree))
        row = np.arange(count)
        while True:
            top = tree.take(row * (2 * w) + 1)
            go = top < none
            row, top = row[go], top[go]
            if not len(row):
                break
            rank, i = np.divmod(top, self.kind(w))
            at, base = row * (w + 1), row * (2 * w)
            gone = nxt.take(at + i)
            after, before = nxt.take(at + gone), prv.take(at + i)
            ids[at + i], nxt[at + i], prv[at + after], live[at + gone] = rank, after, i, False
            right, left = self._rank(rank, ids.take(at + after)), self._rank(ids.take(at + before), rank)
            # node 0 is in no tree
            node = np.concatenate([i + w, gone + w, np.where(before == w, 0, before + w)]).astype(np.int64)
            base = np.concatenate([base, base, base])
            tree[base + node] = np.concatenate([np.where(right >= 0, right * w + i, none), np.full(len(row), none, self.kind),
                                                np.where(left >= 0, left * w + before, none)])
            for _ in range(w.bit_length() - 1):
                node >>= 1
                below = base + 2 * node
                tree[base + node] = np.minimum(tree.take(below), tree.take(below + 1))
        flat = ids[live].astype("<u4").tobytes()
        ends = np.cumsum(live.reshape(count, w + 1).sum(axis=1)).tolist()
        return [flat[4 * a:4 * b] for a, b in zip([0, *ends], ends)]

    def _pieces(self, pieces: list[bytes]) -> list[bytes]:
        out: list[bytes] = [b""] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for k, p in enumerate(pieces):
            r = self.ranks.get(p)
            if r is not None:  # a piece that is a token is that token
                out[k] = r.to_bytes(4, "little")
            elif len(p) > WIDE:
                out[k] = np.array(self._long(p), "<u4").tobytes()
            else:
                by_width.setdefault(max(2, 1 << (len(p) - 1).bit_length()), []).append(k)
        for w, group in by_width.items():
            step = (1 << 18) // w
            for at in range(0, len(group), step):
                part = group[at:at + step]
                for k, x in zip(part, self._side_by_side([pieces[k] for k in part], w)):
                    out[k] = x
        return out

    def _learn(self, chunks: list[str]) -> None:
        """Encode the chunks into the cache. Letters alone are one piece."""
        cache = self.cache
        split = [[c] if c.isalpha() or (c[0] == " " and c[1:].isalpha()) else self.pattern.findall(c) for c in chunks]
        new = list({p for ps in split for p in ps if p not in cache})
        known = self._pieces([p.encode("utf-8", "replace") for p in new])
        known = dict(zip(new, known))
        for c, ps in zip(chunks, split):
            cache[c] = known[c] if c in known else b"".join([known[p] if p in known else cache[p] for p in ps])
            self.cached += len(c)

    def encode_group(self, texts: list[str]) -> list[bytes]:
        parts = [CHUNK.findall(t) for t in texts]
        if self.cached > CACHE_CHARS:  # the last generation stays until the next
            self.old, self.cache, self.cached = self.cache, {}, 0
        cache, old, new = self.cache, self.old, []
        for c in set().union(*parts):
            if c not in cache:
                if c in old:
                    cache[c] = old[c]
                    self.cached += len(c)
                else:
                    new.append(c)
        if new:
            self._learn(new)
        get = cache.__getitem__
        return [b"".join(map(get, p)) for p in parts]

    def encode(self, texts: list[str]) -> list[bytes]:
        out, at, chars = [], 0, 0
        for i, t in enumerate(texts):
            chars += len(t)
            if chars >= GROUP_CHARS:
                out += self.encode_group(texts[at:i + 1])
                at, chars = i + 1, 0
        return out + (self.encode_group(texts[at:]) if at < len(texts) else [])

    def decode(self, packed: bytes) -> bytes:
        ids = np.frombuffer(packed, "<u4")
        width = self.width[ids]
        ends = np.cumsum(width)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.place[ids] - ends + width, width) + np.arange(total)].tobytes()


_CODERS: dict[str, Coder] = {}


def _coder(ranks_file: bytes, pattern: str) -> Coder:
    name = hashlib.sha256(ranks_file + pattern.encode()).hexdigest()
    if name not in _CODERS:
        _CODERS.clear()
        _CODERS[name] = Coder(ranks_file, pattern)
    return _CODERS[name]


def _ranks(spark, path: str):
    with open(path, "rb") as f:
        raw = f.read()
    if len(raw) > MAX_RANKS_BYTES:
        raise ValueError(f"{path}: a vocabulary of more than {MAX_RANKS_BYTES} bytes")
    return spark.sparkContext.broadcast(raw)


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", decoded: bool = False) -> DataFrame:
    """``docs`` with ``token_ids`` (binary: packed ids of the whole text),
    ``n_tokens`` and, if asked for, ``decoded`` (the bytes the ids decode to,
    in the same pass); special tokens are never made, their strings are text.

    Null and empty texts have no tokens (empty binary). Rows repeat as in the
    input; an empty table gives no rows; input columns of these names are
    replaced. Memory holds one small Arrow batch, the tree of the longest
    piece and a bounded cache.
    """
    small_batches(docs.sparkSession, size="4m")
    ranks = _ranks(docs.sparkSession, ranks_path)

    @F.pandas_udf("struct<ids:binary,decoded:binary>")
    def coded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coder = _coder(ranks.value, pattern)
        for s in batches:
            ids = coder.encode(s.tolist())
            yield pd.DataFrame({"ids": ids, "decoded": [coder.decode(x) for x in ids] if decoded else None}, dtype=object)

    out = packed(docs).select("_row", coded(F.coalesce(F.col(f"_row.`{text}`"), F.lit(""))).alias("_c"))
    new = {"token_ids": F.col("_c.ids"), "n_tokens": (F.octet_length("_c.ids") / 4).cast("long")}
    return out.select(*unpacked(docs.columns, new | ({"decoded": F.col("_c.decoded")} if decoded else {})))


def decode(coded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``coded`` with ``decoded``: the bytes of ``token_ids`` (null: empty)."""
    small_batches(coded.sparkSession, size="4m")
    ranks = _ranks(coded.sparkSession, ranks_path)

    @F.pandas_udf("binary")
    def bytes_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = _coder(ranks.value, pattern)
        for s in batches:
            yield pd.Series([coder.decode(x) for x in s.tolist()], dtype=object)

    return replace_columns(coded, {"decoded": bytes_of(F.coalesce("token_ids", F.lit(b"")))})


def id_lists(coded: DataFrame) -> DataFrame:
    """``coded`` with ``ids``: the packed ids as an array column."""

    @F.pandas_udf("array<long>")
    def unpack(s: pd.Series) -> pd.Series:
        return s.map(lambda x: np.frombuffer(x, "<u4").astype(np.int64))

    return replace_columns(coded, {"ids": unpack("token_ids")})
