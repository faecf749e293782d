"""Toxicity by nearest labelled examples.

Texts are TF-IDF vectors over all terms of the labelled examples; a term
weighs the more, the more it speaks for the toxic label (the lower bound of its
log odds ratio over labelled examples), and never nothing. The document
frequencies count all documents. The nearest examples by exact cosine come
from an inverted index whose postings carry block maxima: the blocks of
greatest bound are read first, then all others whose bound reaches the last of
the nearest so far. Votes weighted by distance are calibrated on the examples
themselves, each left out in turn, and the nearest examples are the evidence.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import packed, unpacked
from tessera.plans.util import materialize

_TERM, _ASCII = re.compile(r"[^\W\d_]+"), re.compile("[a-z]+")
#: Bounds of what the fit may hold, both parameters of ``fit``: labelled rows
#: that the weights are learned from, and those of them in the index.
MAX_EXAMPLES, MAX_INDEXED = 10_000, 1_500
#: Weight of a term that does not speak for the label, the standard errors the
#: bound lies below the ratio, and examples a term must occur in to weigh more.
#: The ratio does not grow with the number of examples.
FLOOR, ERRORS, MIN_DF = 0.1, 1.64, 4
#: Terms in more than this share of the examples are held as dense rows too.
DENSE = 0.25
BLOCK, NEAREST, EPS, PREFIX = 64, 15, 0.05, 4


def words_of(text: str) -> list[str]:
    """The lower-case words (runs of letters) of a text."""
    low = text.lower()
    return (_ASCII if low.isascii() else _TERM).findall(low)


def terms(text: str) -> Counter:
    """Counts of the lower-case words (runs of letters) of the whole text and
    of the first ``PREFIX`` letters (``abcd*``) of the longer ones, which
    stand for a stem with changing endings."""
    words = Counter(words_of(text))
    out = Counter(words)
    for w, n in words.items():
        if len(w) > PREFIX:
            out[f"{w[:PREFIX]}*"] += n
    return out


def split_vocabulary(vocabulary: dict) -> tuple[dict, dict]:
    """The words of a vocabulary and its prefixes (without ``*``)."""
    return ({t: i for t, i in vocabulary.items() if not t.endswith("*")},
            {t[:-1]: i for t, i in vocabulary.items() if t.endswith("*")})


class WordTerms(dict):
    """Of each word asked for, the numbers of its terms in a vocabulary (the
    word's and its prefix's); at most ``most`` words are kept."""

    def __init__(self, vocabulary: dict, most: int = 500_000):
        super().__init__()
        self.words, self.prefixes = split_vocabulary(vocabulary)
        self.most = most

    def __missing__(self, word: str) -> tuple:
        found = (self.words.get(word), self.prefixes.get(word[:PREFIX]) if len(word) > PREFIX else None)
        if len(self) >= self.most:
            self.clear()
        self[word] = found = tuple(t for t in found if t is not None)
        return found


def known_terms(words: set, known: tuple[frozenset, frozenset]) -> tuple[set, set]:
    """Of ``words`` those in ``known[0]`` and of their prefixes (see ``terms``)
    those in ``known[1]``, as two sets."""
    return words & known[0], {w[:PREFIX] for w in words if len(w) > PREFIX} & known[1]


def odds_bound(n, a, positives: int, total: int, log, sqrt):
    """Lower bound of the smoothed log odds ratio of the toxic label with and
    without a term of ``n`` examples, ``a`` of them toxic."""
    cells = (a + 0.5, positives - a + 0.5, n - a + 0.5, total - positives - n + a + 0.5)
    ratio = log(cells[0]) - log(cells[1]) - log(cells[2]) + log(cells[3])
    return ratio - ERRORS * sqrt(1 / cells[0] + 1 / cells[1] + 1 / cells[2] + 1 / cells[3])


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least-squares rising steps of ``y`` over ``x`` (pool adjacent
    violators): mean ``x`` and value of each pool."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # sum x, sum y, rows
    for a, b, w in pd.DataFrame({"x": x[order], "y": y[order]}).groupby("x")["y"].agg(["sum", "count"]).itertuples():
        pools.append([a * w, b, w])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last)]
    return np.array([p[0] / p[2] for p in pools]), np.array([(p[1] + 0.5 * 0.02) / (p[2] + 0.02) for p in pools])


def _spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, one range after the other, and their sizes."""
    size = hi - lo
    ends = np.cumsum(size)
    return np.repeat(lo - ends + size, size) + np.arange(ends[-1] if len(ends) else 0), size


@dataclass
class Index:
    """Examples' unit vectors as postings by term, examples in blocks."""

    vocabulary: dict[str, int]
    idf: np.ndarray
    labels: np.ndarray
    ids: list
    starts: np.ndarray      # of each term's postings
    examples: np.ndarray    # posting: example, rising within a term
    weights: np.ndarray     # posting: weight
    cell_starts: np.ndarray  # of each term's blocks
    cell_block: np.ndarray
    cell_max: np.ndarray    # largest weight of the term in the block
    cell_from: np.ndarray   # first posting of the block; the next cell's is the end
    empty_rate: float = 0.0
    knots: tuple = (np.zeros(1), np.zeros(1))
    id_type: str = "bigint"
    dense_row: np.ndarray = None  # of each term: its row, or -1
    dense: np.ndarray = None      # weights of the frequent terms in all examples
    known: WordTerms = None       # the vocabulary by word

    def vector(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers and unit TF-IDF weights."""
        t = np.fromiter(counts, np.int64, len(counts))
        if not len(t):
            return t, np.zeros(0)
        order = np.argsort(t)
        t, n = t[order], np.fromiter(counts.values(), float, len(counts))[order]
        w = (1 + np.log(n)) * self.idf[t]
        return t, w / np.sqrt((w * w).sum())

    def count(self, text: str) -> dict[int, int]:
        if self.known is None:  # in each worker by itself, nothing to send
            self.known = WordTerms(self.vocabulary)
        out, known = {}, self.known
        for w, n in Counter(words_of(text)).items():
            for t in known[w]:
                out[t] = out.get(t, 0) + n
        return out

    def nearest(self, counts: dict[int, int], k: int = NEAREST, leave: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` examples of greatest cosine above 0 (ties: the earlier
        example), exactly, by block bounds; ``leave``: one example to skip."""
        t, q = self.vector(counts)
        n_blocks = (len(self.labels) + BLOCK - 1) // BLOCK
        row = self.dense_row[t]
        frequent = np.zeros(len(self.dense))
        frequent[row[row >= 0]] = q[row >= 0]
        base = frequent @ self.dense
        t, q = t[row < 0], q[row < 0]
        cells, size = _spread(self.cell_starts[t], self.cell_starts[t + 1])
        weight, block = np.repeat(q, size), self.cell_block[cells]
        bound = base.reshape(n_blocks, BLOCK).max(1) if n_blocks else np.zeros(0)
        bound = bound + np.bincount(block, weight * self.cell_max[cells], n_blocks)
        best_e, best_s = np.zeros(0, np.int64), np.zeros(0)
        first = np.zeros(n_blocks, bool)
        first[np.argsort(-bound, kind="stable")[:-(-2 * k // BLOCK) + 1]] = True
        for round_two in (False, True):
            wanted = first & (bound > 0)
            if round_two:
                wanted = ~first & (bound > 0)
                if len(best_s) == k:
                    wanted &= bound >= best_s[-1] - 2e-9
            if not wanted.any():
                continue
            mine = np.flatnonzero(wanted[block])
            postings, size = _spread(self.cell_from[cells[mine]], self.cell_from[cells[mine] + 1])
            total = base + np.bincount(self.examples[postings], np.repeat(weight[mine], size) * self.weights[postings], len(base))
            # once there are k, only what reaches the last of them can enter
            least = best_s[-1] - 2e-9 if len(best_s) == k else 0
            e = np.flatnonzero((total.reshape(n_blocks, BLOCK) > max(least, 0)) & wanted[:, None])
            if leave >= 0:
                e = e[e != leave]
            s, e = np.concatenate([best_s, total[e]]), np.concatenate([best_e, e])
            top = np.lexsort((e, -np.round(s, 9)))[:k]
            best_e, best_s = e[top], s[top]
        return best_e, best_s

    def vote(self, found: tuple[np.ndarray, np.ndarray]) -> float:
        """Share of toxic among the neighbours, each weighing 1 / distance;
        one vote at the rate of texts without a term stands beside them."""
        e, s = found
        w = 1 / (1 - np.minimum(s, 1) + EPS)
        return float(((w * self.labels[e]).sum() + self.empty_rate) / (w.sum() + 1))

    def calibrated(self, vote: float) -> float:
        return float(np.clip(np.interp(vote, *self.knots), 0, 1))


def build(vocabulary: list[str], df: dict[str, int], n_docs: int, examples: list[tuple],
          strength: dict[str, float] | None = None) -> Index:
    """Index of ``examples`` (``(counts by term, label, id)``); ``df``
    counts documents with a term among ``n_docs``, ``strength`` is what a term
    weighs beside (1 without it). Examples are sorted by their strongest terms,
    so that blocks hold like examples."""
    number = {t: i for i, t in enumerate(vocabulary)}
    idf = np.log((n_docs + 1) / (np.array([df.get(t, 0) for t in vocabulary], float) + 1)) + 1 if vocabulary else np.zeros(0)
    if strength is not None and vocabulary:
        idf = idf * np.array([strength.get(t, FLOOR) for t in vocabulary])
    rows = []
    for counts, label, name in examples:
        c = {number[t]: k for t, k in counts.items() if t in number}
        rows.append((sorted(c, key=lambda i: (-idf[i], i))[:20], c, label, name))
    none = [r[2] for r in rows if not r[0]]
    rows = sorted((r for r in rows if r[0]), key=lambda r: (r[0], sorted(r[1].items()), r[2]))
    index = Index(number, idf, np.array([r[2] for r in rows], float), [r[3] for r in rows], *[np.zeros(0, np.int64)] * 7)
    vectors = [index.vector(r[1]) for r in rows]
    t = np.concatenate([v[0] for v in vectors]) if vectors else np.zeros(0, np.int64)
    w = np.concatenate([v[1] for v in vectors]) if vectors else np.zeros(0)
    e = np.repeat(np.arange(len(vectors)), [len(v[0]) for v in vectors]) if vectors else np.zeros(0, np.int64)
    order = np.lexsort((e, t))
    t, w, e = t[order], w[order], e[order]
    index.starts = np.searchsorted(t, np.arange(len(vocabulary) + 1))
    index.examples, index.weights = e, w
    cell = t * ((len(rows) + BLOCK - 1) // BLOCK + 1) + e // BLOCK
    first = np.flatnonzero(np.diff(cell, prepend=-1)) if len(cell) else np.zeros(0, np.int64)
    index.cell_from = np.append(first, len(t))
    index.cell_block = e[first] // BLOCK
    index.cell_max = np.maximum.reduceat(w, first) if len(first) else np.zeros(0)
    index.cell_starts = np.searchsorted(t[first], np.arange(len(vocabulary) + 1))
    index.dense_row = np.full(len(vocabulary), -1)
    often = np.flatnonzero(np.diff(index.starts) > DENSE * len(rows))
    index.dense_row[often] = np.arange(len(often))
    index.dense = np.zeros((len(often), -(-len(rows) // BLOCK) * BLOCK))
    for r, i in enumerate(often.tolist()):
        p = slice(index.starts[i], index.starts[i + 1])
        index.dense[r, e[p]] = w[p]
    index.empty_rate = (sum(none) + 0.01) / (len(none) + 1)
    # every example with terms is left out in turn; those without stand for themselves
    votes = np.array([index.vote(index.nearest(r[1], leave=i)) for i, r in enumerate(rows)] + [index.empty_rate] * len(none))
    truth = np.array([r[2] for r in rows] + none, float)
    if len(votes):
        index.knots = isotonic(votes, truth)
    return index


def fit(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES, max_indexed: int = MAX_INDEXED) -> Index:
    """Weights learned from at most ``max_examples`` labelled documents and an
    index of at most ``max_indexed`` of them (those of least hash of
    ``doc_id``; the bounds are what may reach the driver: the counted terms of
    each). ``labels``: ``doc_id`` (of any type), ``toxic`` 0/1, already without
    the held-out rows; a null in either is no label, of several labels of a
    document the greatest counts. Document frequencies are counted over all
    of ``docs``. Without labels every score is the same."""
    chosen = (labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("_y"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples))
    sample = materialize(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
                         .join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]), "toxicity-examples")
    total, positives = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("_y"), F.lit(0))).first()

    def term_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n, a = Counter(), Counter()
            for text, y in zip(b["text"], b["_y"]):
                have = terms(text).keys()
                n.update(have)
                if y:
                    a.update(have)
            yield pd.DataFrame({"term": list(n), "n": list(n.values()), "n_toxic": [a[t] for t in n]})

    n, a = F.col("n").cast("double"), F.col("n_toxic").cast("double")
    bound = odds_bound(n, a, positives, total, F.log, F.sqrt)
    counts = (sample.mapInPandas(term_counts, "term string, n long, n_toxic long").groupBy("term")
              .agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("n_toxic"))
              .select("term", bound.alias("bound"), "n").where((F.col("n") >= MIN_DF) & (F.col("bound") > 0)).toPandas())
    strength = {t: FLOOR + b for t, b in zip(counts["term"], counts["bound"])}

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [terms(x) for x in b["text"]]
            yield pd.DataFrame({"terms": [list(c) for c in found], "counts": [list(c.values()) for c in found],
                                "y": b["_y"], "name": b["doc_id"]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = (sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_indexed)
            .mapInPandas(vectors, f"terms array<string>, counts array<long>, y int, name {kind}").toPandas())
    examples = [(dict(zip(t, c)), int(y), i) for t, c, y, i in
                sorted(zip(rows["terms"], rows["counts"], rows["y"], rows["name"].tolist()), key=lambda r: r[3])]
    vocabulary = sorted({t for c, _, _ in examples for t in c})
    words, prefixes = split_vocabulary(dict.fromkeys(vocabulary))
    known = docs.sparkSession.sparkContext.broadcast((frozenset(words), frozenset(prefixes)))

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, of_prefix, n, have = Counter(), Counter(), 0, known.value
        for b in batches:
            for text in b["text"]:
                n += 1
                found = known_terms(set(words_of(text)), have)
                df.update(found[0])
                of_prefix.update(found[1])
        yield pd.DataFrame({"term": [*df, *[f"{p}*" for p in of_prefix], None], "n": [*df.values(), *of_prefix.values(), n]})

    counted = (docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInPandas(frequencies, "term string, n long")
               .groupBy("term").agg(F.sum("n").alias("n")).toPandas())
    df = {t: int(n) for t, n in zip(counted["term"], counted["n"]) if isinstance(t, str)}
    n_docs = int(counted["n"][counted["term"].isna()].sum())
    index = build(vocabulary, df, n_docs, examples, strength)
    index.id_type = kind
    return index


def score(docs: DataFrame, index: Index, evidence: int = 3) -> DataFrame:
    """``docs`` with ``score`` (0 to 1), ``predicted`` (1 from 0.5 on) and
    ``evidence`` (``array<struct<doc_id, similarity, toxic>>``, the nearest
    examples).

    Null, empty and term-free texts get the calibrated rate of such examples
    and no evidence. Equal texts score alike; rows repeat as in the input;
    an empty table gives no rows; input columns of these names are replaced.
    Only the text enters a score.
    """
    shared = docs.sparkSession.sparkContext.broadcast(index)
    schema = f"struct<score:double,evidence:array<struct<doc_id:{index.id_type},similarity:double,toxic:int>>>"

    @F.pandas_udf(schema)
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own, known = shared.value, {}
        for s in batches:
            out = []
            for text in s:
                key = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                if key not in known:
                    if len(known) > 50_000:
                        known.clear()
                    counts = own.count(text)
                    found = own.nearest(counts) if counts else (np.zeros(0, np.int64), np.zeros(0))
                    known[key] = (own.calibrated(own.vote(found)), [
                        {"doc_id": own.ids[e], "similarity": float(c), "toxic": int(own.labels[e])}
                        for e, c in zip(found[0][:evidence].tolist(), found[1][:evidence].tolist())])
                out.append(known[key])
            yield pd.DataFrame({"score": [x[0] for x in out], "evidence": [x[1] for x in out]})

    got = packed(docs).select("_row", scored(F.coalesce("_row.text", F.lit(""))).alias("_tox"))
    return got.select(*unpacked(docs.columns, {"score": F.col("_tox.score"), "predicted": (F.col("_tox.score") >= 0.5).cast("int"),
                                               "evidence": F.col("_tox.evidence")}))
