"""N-gram Jaccard join by MinHash bands and exact verification.

Each document's set of word n-grams gets one label (a row of MinHash values)
per tree. Documents that share a label's prefix meet. One similarity for all
documents makes one prefix length right: the longest that finds the target
share of pairs at the threshold, computed before data is read; so a tree is a
band of that length and no trie is kept. What meets is verified exactly on
the n-gram sets. Copies (equal sets) are one
representative from the start and never form pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import packed, shingle_hashes, unpacked, word_hashes
from tessera.llm.components import connected_components
from tessera.plans.util import materialize

TREES, LABEL, RECALL = 24, 10, 0.9999
#: Representatives aimed at in a block of the verification.
BLOCK = 128
_SEED = np.random.default_rng(20240229)
_A = (_SEED.integers(0, 1 << 32, TREES * LABEL, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _SEED.integers(0, 1 << 32, TREES * LABEL, dtype=np.uint64).astype(np.uint32)


def recall_of(prefix: int, similarity: float, trees: int = TREES) -> float:
    """Share of pairs of ``similarity`` that share a prefix in some tree."""
    return 1 - (1 - similarity ** prefix) ** trees


def matched_prefix(similarity: float, recall: float = RECALL, trees: int = TREES, label: int = LABEL) -> int:
    """The longest prefix that reaches the recall: the full label, shortened
    value by value. (One similarity for all documents makes it one length.)"""
    prefix = label
    while prefix > 1 and recall_of(prefix, similarity, trees) < recall:
        prefix -= 1
    return prefix


def ngram_set(text: str, n: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word n-grams; a text of
    fewer words has its whole word sequence as its one gram, one without a
    word none."""
    words = word_hashes(text.encode("utf-8", "replace"))
    return np.unique(shingle_hashes(words, min(n, len(words)))) if len(words) else np.zeros(0, np.uint64)


def labels_of(grams: np.ndarray, prefix: int, trees: int = TREES) -> np.ndarray:
    """MinHash values ``[tree, place]`` of the first ``prefix`` places."""
    pick = np.arange(trees * LABEL).reshape(trees, LABEL)[:, :prefix].ravel()
    a, b = _A[pick][:, None], _B[pick][:, None]
    low = np.full(len(pick), 0xFFFFFFFF, np.uint32)
    base = (grams >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(base), 2048):
        h = base[None, at:at + 2048] * a + b
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        np.minimum(low, h.min(axis=1), out=low)
    return low.reshape(trees, prefix)


def _signed(docs: DataFrame, n: int, prefix: int) -> DataFrame:
    """``doc_id``, ``text_hash``, ``gram_set`` (digest of the n-gram set, null
    without a word), ``n_grams`` and ``labels`` of each document."""
    @F.pandas_udf("struct<gram_set:binary,n_grams:int,labels:binary>")
    def sign(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            out = []
            for text in s:
                grams = ngram_set(text, n)
                out.append((hashlib.md5(grams.tobytes()).digest(), len(grams), labels_of(grams, prefix).tobytes())
                           if len(grams) else (None, 0, None))
            yield pd.DataFrame(out, columns=["gram_set", "n_grams", "labels"])

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), sign(F.coalesce("text", F.lit(""))).alias("s")).select(
        "doc_id", "text_hash", "s.*")


def verify(ids: list[int], sets: list[np.ndarray], weights: np.ndarray, left: np.ndarray, right: np.ndarray,
           similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Exact links between the documents marked ``left`` and those marked
    ``right``: for each document the summed weight of its partners, and the
    least id it is connected with here."""
    grams = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    first = np.concatenate([[True], grams[1:] != grams[:-1]])
    column = np.cumsum(first) - 1
    shared = np.bincount(column)[column] > 1
    column, owner = column[shared], owner[shared]
    common = np.zeros((len(sets), len(sets)), np.float32)
    if len(column):
        column = np.cumsum(np.concatenate([[True], column[1:] != column[:-1]])) - 1
        for at in range(0, int(column[-1]) + 1, 8192):
            here = (column >= at) & (column < at + 8192)
            m = np.zeros((len(sets), min(8192, int(column[-1]) + 1 - at)), np.float32)
            m[owner[here], column[here] - at] = 1
            common += m @ m.T
    size = np.array([len(s) for s in sets])
    linked = common >= similarity * (size[:, None] + size[None, :] - common) - 1e-6
    np.fill_diagonal(linked, False)
    linked &= (left[:, None] & right[None, :]) | (right[:, None] & left[None, :])
    root = np.array(ids, np.int64)
    while True:
        lower = np.minimum(root, np.where(linked, root[None, :], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max))
        if (lower == root).all():
            break
        root = lower
    return linked @ weights, root


def similar_classes(docs: DataFrame, n: int = 5, similarity: float = 0.8, recall: float = RECALL) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``): ``doc_id``,
    ``text_hash``, ``class_key`` (one value per class), ``class_id`` (least ``doc_id`` of the documents it is
    connected with through links of at least ``similarity``, itself
    included) and ``n_links`` (other documents linked to it, copies too).

    A text without a word (null, empty) has no links and a null
    ``class_key``; a text of under ``n`` words links to its copies. Repeated
    rows are copies of one another. Rows without a ``doc_id`` take part;
    their class is null if no other member has one. Empty table: no rows.
    Columns other than ``doc_id`` and ``text`` are not read.

    Jobs: (1) sets and labels, written slim; (2) copies collapse to
    representatives; (3) each trie node links its members to its least one
    and the candidate groups are the components of these links, so rows stay
    linear in documents; (4) the n-gram sets of candidates, and no others,
    are dealt to blocks of their group by size band and hash, and pairs of
    blocks that the sizes allow are verified, each in its own task slot; per
    document and pair of blocks one row comes back, never a row per pair.
    """
    prefix = matched_prefix(similarity, recall)
    signed = materialize(_signed(docs, n, prefix), "ngram-sets")
    reps = materialize(
        signed.where("gram_set is not null").groupBy("gram_set", "n_grams", "labels")
        .agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("least"))
        .select(F.monotonically_increasing_id().alias("rep"), "*"), "ngram-reps")

    width = 4 * prefix
    nodes = reps.select("rep", F.explode(F.expr(
        f"transform(sequence(0, {TREES - 1}), t -> xxhash64(t, substring(labels, t * {width} + 1, {width})))")).alias("node"))
    least = nodes.groupBy("node").agg(F.min("rep").alias("v"), F.max("rep").alias("last")).where("v < last").select("node", "v")
    met = nodes.join(least, "node").where("rep <> v").select(F.col("rep").alias("u"), "v")
    groups = connected_components(met, "ngram-candidates").select(F.col("node").alias("rep"), F.col("component").alias("g"))

    # blocks: size bands such that partners are in the same or the next band, then hash
    band = F.floor(F.log(F.col("n_grams").cast("double")) / F.lit(-np.log(similarity)) + 1e-9).cast("int")
    members = materialize(groups.join(reps.select("rep", "gram_set", "n_grams", "copies", "least", band.alias("band")), "rep"),
                          "ngram-members")
    blocks = members.groupBy("g", "band").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("n_blocks"))
    following = blocks.select("g", (F.col("band") - 1).alias("band"), F.col("n_blocks").alias("n_next"))
    before = blocks.select("g", (F.col("band") + 1).alias("band"), F.col("n_blocks").alias("n_before"))
    blocks = blocks.join(following, ["g", "band"], "left").join(before, ["g", "band"], "left").na.fill(0)
    dealt = members.join(blocks, ["g", "band"]).withColumn("own", F.expr("cast(pmod(xxhash64(rep), n_blocks) as int)"))
    # pairs of blocks (band, own) x (band or the next, other); side 0: in both, 1: left, 2: right
    dealt = dealt.withColumn("jobs", F.expr("""concat(
        transform(sequence(0, n_blocks - 1), o -> struct(band as lb, least(own, o) as l, band as rb, greatest(own, o) as r,
                  if(o = own, 0, if(own < o, 1, 2)) as side)),
        if(n_next = 0, array(), transform(sequence(0, n_next - 1), o -> struct(band as lb, own as l, band + 1 as rb, o as r, 1 as side))),
        if(n_before = 0, array(), transform(sequence(0, n_before - 1), o -> struct(band - 1 as lb, o as l, band as rb, own as r, 2 as side))))"""))

    @F.pandas_udf("struct<gram_set:binary,grams:binary>")
    def grams(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            sets = [ngram_set(t, n) for t in s]
            yield pd.DataFrame({"gram_set": [hashlib.md5(x.tobytes()).digest() for x in sets], "grams": [x.tobytes() for x in sets]})

    held = (docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).alias("a")
            .join(dealt.select("rep", "g", "gram_set", "copies", "least", "jobs").alias("b"), F.expr("a.doc_id <=> b.least"))
            .select("rep", "g", "copies", "jobs", F.col("b.gram_set").alias("_set"), grams("text").alias("s"))
            .where(F.col("s.gram_set") == F.col("_set")).select("rep", "g", "copies", "jobs", "s.grams")
            .dropDuplicates(["rep"]))
    work = held.select("rep", "g", "copies", "grams", F.explode("jobs").alias("j")).select("g", "j.*", "rep", "copies", "grams")
    work = work.repartition("g", "lb", "l", "rb", "r").sortWithinPartitions("g", "lb", "l", "rb", "r", "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                yield from zip(*(b.column(i).to_pylist() for i in range(b.num_columns)))

        out: list = [[], [], []]
        for _, group in groupby(rows(), key=lambda r: r[:5]):
            group = list(group)
            side = np.array([r[5] for r in group])
            if len(group) > 1 and (side != 1).any() and (side != 2).any():
                ids = [r[6] for r in group]
                links, root = verify(ids, [np.frombuffer(r[8], np.uint64) for r in group], np.array([r[7] for r in group], np.int64),
                                     side != 2, side != 1, similarity)
                some = np.flatnonzero(links)
                out[0] += [ids[i] for i in some]
                out[1] += links[some].tolist()
                out[2] += root[some].tolist()
            if len(out[0]) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["rep", "links", "root"])
                out = [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["rep", "links", "root"])

    found = materialize(work.mapInArrow(run, "rep long, links long, root long"), "ngram-links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    classes = connected_components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")), "ngram-classes")
    named = (classes.join(reps.select(F.col("rep").alias("node"), "least"), "node").groupBy("component")
             .agg(F.min("least").alias("class_id")))
    linked = (classes.join(named, "component").join(links, F.col("node") == F.col("rep"))
              .select(F.col("node").alias("rep"), "component", "class_id", "links"))
    per_set = (reps.select("rep", "gram_set", "copies", "least").join(linked, "rep", "left")
               .select("gram_set", F.coalesce("component", "rep").alias("class_key"), F.coalesce("class_id", "least").alias("class_id"),
                       (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    return signed.select("doc_id", "text_hash", "gram_set").join(per_set, "gram_set", "left").select(
        "doc_id", "text_hash", "class_key",
        F.when(F.col("gram_set").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def one_per_class(docs: DataFrame, n: int = 5, similarity: float = 0.8, recall: float = RECALL) -> DataFrame:
    """``docs`` without near-duplicates: of each class of
    :func:`similar_classes` the document of least ``doc_id`` (nulls first,
    then least hash of the text) stays, once. Documents without a word stay,
    all of them. All columns pass through."""
    classes = materialize(similar_classes(docs.select("doc_id", "text"), n, similarity, recall), "ngram-classes-of-documents")
    stays = (classes.where("class_key is not null").groupBy("class_key", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("rows"))
             .groupBy("class_key").agg(F.min(F.struct("doc_id", "text_hash", "rows")).alias("s")).select("s.*"))
    wordless = classes.where("class_key is null").select("doc_id", "text_hash", F.lit(1).cast("long").alias("rows")).distinct()
    chosen = materialize(stays.unionByName(wordless).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_h"),
                                                            F.col("rows").alias("_rows")), "ngram-kept")
    rows = packed(docs).select("_row", F.xxhash64("_row.text").alias("_own"))
    kept = rows.join(chosen, F.expr("_row.doc_id <=> _id and _own = _h"))
    # only rows that occur more than once need another look
    repeated = kept.where("_rows > 1").dropDuplicates(["_id", "_h"])
    return kept.where("_rows = 1").unionByName(repeated).select(*unpacked(docs.columns, {}))


#: DuckDB: the same by an inverted list of whole n-grams and a recursive closure.
JACCARD_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS gram
      FROM w, unnest(range(1, greatest(len(words) - 3, 2))) AS r(i) WHERE len(words) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id <> b.doc_id
      GROUP BY ALL),
l AS (SELECT p.a, p.b FROM p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id
      WHERE p.common >= 0.8 * (x.n + y.n - p.common) - 1e-6),
c(node, root) AS (SELECT a, a FROM l UNION SELECT l.b, c.root FROM c JOIN l ON l.a = c.node)
SELECT d.doc_id, coalesce(least(d.doc_id, k.root), d.doc_id) AS class_id, coalesce(m.links, 0)::BIGINT AS n_links
FROM documents d LEFT JOIN (SELECT node, min(root) AS root FROM c GROUP BY node) k ON d.doc_id = k.node
LEFT JOIN (SELECT a, count(*) AS links FROM l GROUP BY a) m ON d.doc_id = m.a
"""
