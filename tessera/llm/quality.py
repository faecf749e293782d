"""Quality rules: document statistics, a base rule, and gradient-boosted trees
over the statistics, flattened into node arrays and scored by numpy, with
monotonic constraints on the features whose direction is known.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import packed, shingle_hashes, unpacked, word_hashes

#: Frequent function words of English, German, French and Spanish (fixed values).
STOP_WORDS = (
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which "
    "der die und das den von zu mit ist im auf für nicht ein eine als auch es dem sich des "
    "le la les de des et un une du que qui dans pour pas sur au est par avec plus "
    "el los las y en que del se por con para una su al lo como más pero sus").split()
#: Feature names; the sign is the allowed direction of the score (0: free).
FEATURES = {"log_words": 0, "word_length": 0, "symbols_per_word": -1, "dup_line_share": -1, "repeat_share": -1,
            "distinct_share": 1, "upper_share": -1, "digit_share": 0, "stop_share": 1, "bang_share": -1, "bar_share": -1,
            "period_share": 0, "words_per_line": 0, "longest_run_share": -1}
#: Labelled rows the trees are fitted on at most (by hash of doc_id).
MAX_LABELLED = 20_000
WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 5, 10, 20

_STOP = np.unique(word_hashes(" ".join(sorted({*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)})).encode()))
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
_WS = (9, 10, 11, 12, 13, 32)


def statistics(text: str) -> tuple[list[int], list[float]]:
    """``([n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words],
    features)`` of one whole text."""
    raw = text.encode("utf-8", "replace")
    count = np.zeros(256, np.int64)
    for at in range(0, len(raw), 1 << 22):
        count += np.bincount(np.frombuffer(raw, np.uint8, count=min(1 << 22, len(raw) - at), offset=at), minlength=256)
    words = word_hashes(raw)
    n = len(words)
    word_chars = len(text) - int(count[list(_WS)].sum())
    symbols = int(count[_SYMBOLS].sum())
    seen, dup, lines = set(), 0, 0
    for line in text.split("\n"):
        if line.strip(" \t\r\x0b\x0c"):
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    repeat = distinct = run = 0
    if n >= WINDOW:
        grams = shingle_hashes(words, WINDOW)
        _, inverse, times = np.unique(grams, return_inverse=True, return_counts=True)
        again = times[inverse] > 1
        if again.any():
            edge = np.zeros(n + 1, np.int64)
            edge[:len(grams)] += again
            edge[WINDOW:WINDOW + len(grams)] -= again
            repeat = int((np.cumsum(edge[:n]) > 0).sum())
    if n:
        distinct = len(np.unique(words))
        change = np.flatnonzero(np.diff(words) != 0)
        run = int(np.diff(np.concatenate([[-1], change, [n - 1]])).max())
    base = [n, word_chars, symbols, dup, repeat]
    w, c = max(n, 1), max(word_chars, 1)
    upper = int(count[65:91].sum())
    letters = max(1, upper + int(count[97:123].sum()))
    return base, [np.log1p(n), word_chars / w, symbols / w, dup / max(lines, 1), repeat / w, distinct / w, upper / letters,
                  int(count[48:58].sum()) / c, (float(np.isin(words, _STOP).mean()) if n else 0.0), count[33] / w,
                  count[124] / w, count[46] / w, n / max(lines, 1), run / w]


@dataclass
class Forest:
    """Trees as flat node arrays; a leaf points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds for each row of ``x``; all rows go down all trees one
        level per step."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.bias + self.value[at].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of ``x``."""
        return 1 / (1 + np.exp(-self.margin(x)))


def fit_forest(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 60, depth: int = 3, rate: float = 0.2,
               bins: int = 48, min_rows: int = 10, ridge: float = 1.0) -> Forest:
    """Logistic boosting on quantile bins. A feature with sign s may only
    split so that the side it favours scores at least as high; children
    inherit the bounds, so the whole score is monotonic in that feature."""
    n, k = x.shape
    shares = np.linspace(0, 1, bins + 1)[1:-1] if n else []
    cuts = [np.unique(np.quantile(x[:, j], shares)) if n else np.zeros(0) for j in range(k)]
    code = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(k)], axis=1)
    rate_of = np.clip(y.mean(), 1e-3, 1 - 1e-3) if n else 0.5
    bias = float(np.log(rate_of / (1 - rate_of)))
    margin = np.full(n, bias)
    nodes: list[list] = []  # feature, threshold, left, right, value
    roots = []

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        me = len(nodes)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        nodes.append([0, np.inf, me, me, float(np.clip(-total_g / (total_h + ridge), low, high)) * rate])
        best = (1e-6, None)
        if level < depth and len(rows) >= 2 * min_rows:
            for j in range(k):
                width = len(cuts[j]) + 1
                if width < 2:
                    continue
                cg = np.cumsum(np.bincount(code[rows, j], g[rows], width))[:-1]
                ch = np.cumsum(np.bincount(code[rows, j], h[rows], width))[:-1]
                cn = np.cumsum(np.bincount(code[rows, j], minlength=width))[:-1]
                a = np.clip(-cg / (ch + ridge), low, high)
                b = np.clip(-(total_g - cg) / (total_h - ch + ridge), low, high)
                gain = -(cg * a + (ch + ridge) * a * a / 2) - ((total_g - cg) * b + (total_h - ch + ridge) * b * b / 2)
                ok = (cn >= min_rows) & (len(rows) - cn >= min_rows) & (signs[j] * (b - a) >= 0)
                gain = np.where(ok, gain, -np.inf)
                i = int(np.argmax(gain))
                if gain[i] > best[0]:
                    best = (float(gain[i]), (j, i, float(a[i]), float(b[i])))
            here = float(np.clip(-total_g / (total_h + ridge), low, high))
            if best[1] and best[0] > -(total_g * here + (total_h + ridge) * here * here / 2) + 1e-6:
                j, i, a, b = best[1]
                mid = (a + b) / 2
                go = code[rows, j] <= i
                bounds = {1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid)), 0: ((low, high), (low, high))}[signs[j]]
                nodes[me][0], nodes[me][1] = j, float(cuts[j][i])
                nodes[me][2] = grow(rows[go], g, h, level + 1, *bounds[0])
                nodes[me][3] = grow(rows[~go], g, h, level + 1, *bounds[1])
        return me

    everything = np.arange(n)
    for _ in range(trees if n and 0 < y.sum() < n else 0):
        p = 1 / (1 + np.exp(-margin))
        first = len(nodes)
        roots.append(grow(everything, p - y, p * (1 - p), 0, -np.inf, np.inf))
        f, t, lo, hi, v = (np.array(c) for c in zip(*nodes[first:]))
        margin += Forest(f, t, lo - first, hi - first, v, np.array([0]), depth, 0.0).margin(x)
    cols = list(zip(*nodes)) if nodes else [[0], [np.inf], [0], [0], [0.0]]
    return Forest(np.array(cols[0]), np.array(cols[1]), np.array(cols[2]), np.array(cols[3]), np.array(cols[4]),
                  np.array(roots or [0]), depth, bias)


_BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_RULE = "struct<n_words:long,word_chars:long,n_symbols:long,n_dup_lines:long,n_repeat_words:long,score:double>"


def _frame(texts: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    got = [statistics(t) for t in texts]
    return (np.array([b for b, _ in got], np.int64).reshape(-1, len(_BASE)),
            np.array([f for _, f in got], float).reshape(-1, len(FEATURES)))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, **options) -> Forest:
    """Trees fitted on at most ``max_labelled`` labelled documents (those of
    least hash of ``doc_id``; the bound is what may reach the driver, a few
    numbers a row). ``labels``: ``doc_id``, ``quality`` 0/1; null in either
    is no label, of several labels of a document the least counts. Without
    labels of both kinds there are no trees: all that pass the base rule stay."""
    chosen = (labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("_y"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled))

    @F.pandas_udf("array<double>")
    def features(s: pd.Series) -> pd.Series:
        return pd.Series(list(_frame(s)[1]), dtype=object)

    rows = (docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_t")).join(F.broadcast(chosen), "doc_id")
            .select(features("_t").alias("x"), "_y", "doc_id").toPandas().sort_values("doc_id", kind="stable"))
    x = np.array(rows["x"].tolist(), float).reshape(-1, len(FEATURES))
    order = np.lexsort(x.T[::-1]) if len(x) else []
    y = rows["_y"].to_numpy(float)
    return fit_forest(x[order], y[order], list(FEATURES.values()), **options)


def apply_rules(docs: DataFrame, forest: Forest, threshold: float = 0.5) -> DataFrame:
    """``docs`` with the five base statistics, ``base_failed``, ``score`` (of
    the trees) and ``kept``: base passed and score at least ``threshold``.

    Null text: no words, so the base rule fails it, as it does an empty one.
    Rows repeat as in the input; an empty table gives no rows; input columns
    of these names are replaced. One text at a time is in memory besides its
    Arrow batch.
    """
    @F.pandas_udf(_RULE)
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            base, x = _frame(s)
            out = pd.DataFrame(base, columns=_BASE)
            out["score"] = forest.score(x) if len(x) else np.zeros(0)
            yield out

    got = packed(docs).select("_row", judge(F.coalesce("_row.text", F.lit(""))).alias("_rule"))
    new: dict[str, Column] = {c: F.col(f"_rule.{c}") for c in _BASE}
    failed = (F.col("_rule.n_words") < MIN_WORDS) | (100 * F.col("_rule.n_repeat_words")
                                                     > MAX_REPEAT_PERCENT * F.col("_rule.n_words"))
    new |= {"base_failed": failed, "score": F.col("_rule.score"), "kept": ~failed & (F.col("_rule.score") >= threshold)}
    return got.select(*unpacked(docs.columns, new))
