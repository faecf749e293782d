"""Inverted index, BM25 ranking and sloppy-phrase matching.

Layout: ``postings(term, doc_id, positions, tf)`` built from A1 word tokens
(lower-cased, position = word ordinal), ``doc_stats(doc_id, n_tokens)`` and
``term_stats(term, df)``. Queries are tables: many questions are answered in
one job, and the (small, size-checked) query-term table is the only side that
is ever broadcast.

Written postings are *blocks*: the documents are dealt to segments of about
``SEGMENT`` documents of similar length, and a block holds what one term has in
one segment, with its greatest ``tf`` and least length. Block bounds add up per
(question, segment), so ranking scores the best segments first and then only
those whose bound reaches the k-th score (block-max pruning). Documents that
hold every term come from intersecting the blocks of a segment, rarest first;
phrases are fitted where a segment's blocks of all asked terms meet, once. The block table is bucketed by
``(term, part)``, a term's segments being spread over ``PARTS`` parts, so joins
with query terms need no exchange of it and a frequent term is no hot task.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from hashlib import md5

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.tokens import document_words, tokenize
from tessera.util import is_small, materialize, scratch_path

# BM25 parameters and the phrase slop of the question search.
BM25_K1 = 1.2
BM25_B = 0.75
DEFAULT_SLOP = 10
DEFAULT_SIZE = 1000


#: Documents aimed at in a segment, and parts over which a term's segments are spread.
SEGMENT = 128
PARTS = 8
#: Whole documents that go to a Python worker at once.
DOCS_PER_BATCH = 1000
#: Postings made into blocks at once, at least.
ROWS_AT_ONCE = 20_000
#: Documents scored before the threshold is set, per document asked for.
AHEAD = 8
#: What rounded scores may hide: blocks are left out only if they are further below.
SLACK = 1e-5


@dataclass
class Index:
    postings: DataFrame   # term, <key>, positions ARRAY<INT>, tf INT
    doc_stats: DataFrame  # <key>, n_tokens INT
    term_stats: DataFrame  # term, df BIGINT
    key: str = "doc_id"
    blocks: DataFrame | None = None  # term, part, seg, n, max_tf, min_dl, keys, tfs, dls, positions


def build_index(tokens: DataFrame, key: str = "doc_id", docs: DataFrame | None = None) -> Index:
    """R1 over A1 tokens. The group keys contain ``key``, so when the tokens
    are still hash-partitioned on it (as :func:`tokenize` leaves them) the
    aggregations and the doc-length join need no new exchange. Postings carry
    the document length ``dl`` so ranking never joins the document table.
    Documents without a word get ``n_tokens = 0`` when ``docs`` is given."""
    words = tokens.where(F.col("word_idx").isNotNull()).select(
        key, F.lower("token").alias("term"), F.col("word_idx").alias("pos"))
    postings = words.groupBy(key, "term").agg(
        F.sort_array(F.collect_list("pos")).alias("positions"),
        F.count(F.lit(1)).cast("int").alias("tf"))
    postings = postings.withColumn("dl", F.sum("tf").over(Window.partitionBy(key)).cast("int"))
    doc_stats = postings.groupBy(key).agg(F.first("dl").alias("n_tokens"))
    if docs is not None:
        doc_stats = (docs.select(key).join(doc_stats, key, "left")
                     .select(key, F.coalesce("n_tokens", F.lit(0)).alias("n_tokens")))
    term_stats = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return Index(postings.select("term", key, "positions", "tf", "dl"), doc_stats, term_stats, key)


def index_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Index:
    """R1 over documents: what :func:`build_index` gives for their tokens, from
    one row per document, so no token is sorted or aggregated as a row."""
    words = document_words(docs, key, text)
    conf = docs.sparkSession.conf  # whole documents: fewer to a batch
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > DOCS_PER_BATCH:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(DOCS_PER_BATCH))
    kind = docs.schema[key].dataType.simpleString()
    postings = words.mapInArrow(lambda batches: map(_postings_in_batch, batches),
                                f"term string, `{key}` {kind}, positions array<int>, tf int, dl int")
    doc_stats = docs.select(key).join(words.select(key, F.size("words").alias("n_tokens")), key, "left").select(
        key, F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"))
    return Index(postings, doc_stats, postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")), key)


def _postings_in_batch(batch):
    """The postings of documents: ``key, words`` -> ``term, key, positions, tf, dl``."""
    import numpy as np
    import pyarrow as pa

    keys, words = batch.column(0), batch.column(1)
    lengths = words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    codes = words.flatten().dictionary_encode()
    doc = np.repeat(np.arange(len(lengths)), lengths)
    pos = np.arange(len(doc)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    code = codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    own = doc * max(1, len(codes.dictionary)) + code
    order = np.argsort(own, kind="stable")
    first = np.flatnonzero(np.diff(own[order], prepend=-1))
    edges = np.append(first, len(own)).astype(np.int32)
    at = order[first]
    positions = pa.ListArray.from_arrays(pa.array(edges), pa.array(pos[order].astype(np.int32)))
    return pa.RecordBatch.from_arrays(
        [codes.dictionary.take(pa.array(code[at])), keys.take(pa.array(doc[at])), positions, pa.array(np.diff(edges)),
         pa.array(lengths[doc[at]].astype(np.int32))], names=["term", batch.schema.names[0], "positions", "tf", "dl"])


def block_postings(postings: DataFrame, key: str, n_docs: int, n_buckets: int | None = None) -> DataFrame:
    """Postings as blocks, one row per term and segment. A segment is a class
    of document lengths and a hash of the key, so that its least length is
    near all of its lengths and block bounds are tight."""
    spread = max(1, -(-n_docs // (8 * SEGMENT)))
    seg = F.floor(4 * F.log2(F.col("dl") + 1)) * F.lit(1 << 32) + F.pmod(F.xxhash64(key), F.lit(spread))
    rows = postings.select("term", key, "positions", "tf", "dl", seg.cast("long").alias("seg"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("seg"), F.lit(PARTS)).cast("int"))
    rows = rows.repartition(n_buckets, "term", "part") if n_buckets else rows.repartition("term", "part")
    # a block's rows stand together, by key; most comparisons end at the hash
    rows = rows.sortWithinPartitions(F.xxhash64("term", "seg"), "term", "seg", key).select("term", "part", "seg", key, "tf", "dl", "positions")
    kind = postings.schema[key].dataType.simpleString()
    return rows.mapInArrow(_blocks_in_order, f"term string, part int, seg bigint, n bigint, max_tf int, min_dl int, keys array<{kind}>, "
                           "tfs array<int>, dls array<int>, positions array<array<int>>")


def _blocks_in_order(batches):
    """Postings whose blocks stand together -> one row per block. Only the
    last block of what was read waits for the rows that follow."""
    import numpy as np
    import pyarrow as pa

    def edges_of(rows):
        term = rows.column(0).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        seg = rows.column(2).to_numpy(zero_copy_only=False)
        return np.concatenate([[0], np.flatnonzero((np.diff(term) != 0) | (np.diff(seg) != 0)) + 1, [len(seg)]])

    def blocks(rows, edges):
        rows, first, at = rows.slice(0, edges[-1]), edges[:-1], pa.array(edges.astype(np.int32))
        tf, dl = rows.column(4).to_numpy(zero_copy_only=False), rows.column(5).to_numpy(zero_copy_only=False)
        lists = [pa.ListArray.from_arrays(at, rows.column(i)) for i in (3, 4, 5, 6)]
        return pa.RecordBatch.from_arrays(
            [rows.column(i).take(pa.array(first)) for i in (0, 1, 2)] + [pa.array(np.diff(edges)), pa.array(np.maximum.reduceat(tf, first)),
             pa.array(np.minimum.reduceat(dl, first))] + lists,
            names=["term", "part", "seg", "n", "max_tf", "min_dl", "keys", "tfs", "dls", "positions"])

    held, n, enough = [], 0, ROWS_AT_ONCE
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= enough:
            rows = pa.concat_batches(held)
            edges = edges_of(rows)
            if len(edges) > 2:
                yield blocks(rows, edges[:-1])
            held = [rows.slice(edges[-2])]
            n = held[0].num_rows
            enough = max(ROWS_AT_ONCE, 2 * n)
    if n:
        rows = pa.concat_batches(held)
        yield blocks(rows, edges_of(rows))


def _postings_of(blocks: DataFrame, key: str) -> DataFrame:
    zipped = F.explode(F.arrays_zip("keys", "positions", "tfs", "dls")).alias("e")
    return blocks.select("term", zipped).select("term", F.col("e.keys").alias(key), F.col("e.positions").alias("positions"),
                                                F.col("e.tfs").alias("tf"), F.col("e.dls").alias("dl"))


def _block_table(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The block files of ``path`` as a bucketed table of this session."""
    layout = json.loads(spark.read.text(path + "/layout").first()[0])
    name = "tessera_blocks_" + md5(path.encode()).hexdigest()[:16]
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({layout['columns']}) USING parquet CLUSTERED BY (term, part) SORTED BY (term, seg) "
              f"INTO {layout['buckets']} BUCKETS LOCATION '{path}/blocks'")
    # joins on (term, part, seg) may use the buckets of (term, part)
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return spark.table(name)


def write_index(index: Index, path: str, docs: DataFrame | None = None) -> None:
    """Inverted index to files (K2): the bucketed block table, its layout and
    the two stats tables, which are derived from the written blocks, so the
    corpus is tokenized once. With ``docs`` documents without a word get
    length 0."""
    spark, key = index.postings.sparkSession, index.key
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_docs = (docs if docs is not None else index.doc_stats).count()
    name = "tessera_write_" + md5(path.encode()).hexdigest()[:16]
    rows = block_postings(index.postings, key, n_docs, buckets)
    (rows.write.mode("overwrite").format("parquet")
     .bucketBy(buckets, "term", "part").sortBy("term", "seg").option("path", path + "/blocks").saveAsTable(name))
    spark.sql(f"DROP TABLE {name}")  # external: the files stay
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    spark.createDataFrame([(json.dumps({"buckets": buckets, "parts": PARTS, "columns": columns}),)], "value string").coalesce(1).write.mode(
        "overwrite").text(path + "/layout")
    blocks = spark.read.schema(rows.schema).parquet(path + "/blocks")
    doc_stats = index.doc_stats
    if docs is not None:
        lengths = blocks.select(F.explode(F.arrays_zip("keys", "dls")).alias("_e"))  # no positions are read for these
        doc_stats = lengths.groupBy(F.col("_e.keys").alias(key)).agg(F.first("_e.dls").alias("n_tokens"))
        doc_stats = docs.select(key).join(doc_stats, key, "left").select(key, F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"))
    doc_stats.write.mode("overwrite").parquet(path + "/doc_stats")
    blocks.groupBy("term").agg(F.sum("n").alias("df")).write.mode("overwrite").parquet(path + "/term_stats")


def read_index(spark, path: str, key: str = "doc_id") -> Index:
    blocks = _block_table(spark, path, key)
    return Index(_postings_of(blocks, key), spark.read.parquet(path + "/doc_stats"), spark.read.parquet(path + "/term_stats"), key, blocks)


def materialize_index(index: Index, name: str = "index", docs: DataFrame | None = None) -> Index:
    """Write the index once to the shared checkpoint folder and read it back
    (cuts lineage; survives lost executors)."""
    spark = index.postings.sparkSession
    path = scratch_path(spark, name)
    write_index(index, path, docs)
    return read_index(spark, path, index.key)


def query_terms(queries: DataFrame, qkey: str = "question_id", qtext: str = "query") -> DataFrame:
    """Query strings -> ``qkey, q_pos, term`` (same analyser as the index)."""
    t = tokenize(queries.select(qkey, qtext), qkey, qtext)
    return t.where(F.col("word_idx").isNotNull()).select(
        qkey, F.col("word_idx").alias("q_pos"), F.lower("token").alias("term"))


def _corpus_stats(index: Index) -> DataFrame:
    return index.doc_stats.agg(F.count(F.lit(1)).alias("_N"), F.avg("n_tokens").alias("_avgdl"))


def _tf_norm(tf, dl, k1: float, b: float):
    return (F.col(tf) * (k1 + 1)) / (F.col(tf) + k1 * (1 - b + b * F.col(dl) / F.col("_avgdl")))


def _asked(index: Index, qterms: DataFrame, qkey: str) -> DataFrame:
    """The different indexed terms of each question: ``qkey, term, _at`` (its
    query positions), ``_idf, _avgdl, _small``."""
    per = qterms.groupBy(qkey, "term").agg(F.sort_array(F.collect_list("q_pos")).alias("_at"))
    per = F.broadcast(per) if is_small(qterms) else per
    idf = F.log(1 + (F.col("_N") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return (per.join(index.term_stats, "term").crossJoin(F.broadcast(_corpus_stats(index)))
            .select(qkey, "term", "_at", idf.alias("_idf"), "_avgdl"))


def _blocks(index: Index) -> DataFrame:
    """The written blocks, or those of an index that is not written."""
    return index.blocks if index.blocks is not None else block_postings(index.postings, index.key, 1)


def _side(rows: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(rows) if small else rows


def _segments(blocks: DataFrame, asked: DataFrame, qkey: str, k1: float, b: float, small: bool) -> DataFrame:
    """Bounds per question and segment, off the blocks' heads: ``qkey, seg,
    bound`` (of any document's score), ``n`` (documents that hold one of
    the terms, at least) and ``terms`` (how many have a block there)."""
    parts = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    heads = blocks.select("term", "part", "seg", "n", "max_tf", "min_dl").join(_side(parts, small), ["term", "part"])
    return heads.groupBy(qkey, "seg").agg(F.sum(F.col("_idf") * _tf_norm("max_tf", "min_dl", k1, b)).alias("bound"),
                                          F.max("n").alias("n"), F.count(F.lit(1)).alias("terms"))


def _in_segments(blocks: DataFrame, asked: DataFrame, segments: DataFrame, qkey: str, columns: list[str], more=()) -> DataFrame:
    """The blocks (only ``columns`` are read) of the asked terms in the given
    (question, segment) pairs, with the terms' columns and ``more``."""
    part = F.pmod(F.xxhash64("seg"), F.lit(PARTS)).cast("int")
    wanted = segments.select(qkey, "seg", part.alias("part"), *more).join(_side(asked, is_small(asked)), qkey)
    return blocks.select("term", "part", "seg", *columns).join(wanted, ["term", "part", "seg"])


def _scores_in(index: Index, blocks: DataFrame, asked: DataFrame, segments: DataFrame, qkey: str, k1: float, b: float) -> DataFrame:
    """BM25 of the documents of the given (question, segment) pairs."""
    hits = _in_segments(blocks, asked, segments, qkey, ["keys", "tfs", "dls"])
    hits = hits.select(qkey, "_idf", "_avgdl", F.explode(F.arrays_zip("keys", "tfs", "dls")).alias("_e")).select(
        qkey, F.col("_e.keys").alias(index.key), (F.col("_idf") * _tf_norm("_e.tfs", "_e.dls", k1, b)).alias("_part"))
    return hits.groupBy(qkey, index.key).agg(F.sum("_part").alias("score"))


def bm25_scores(index: Index, qterms: DataFrame, qkey: str = "question_id",
                k1: float = BM25_K1, b: float = BM25_B) -> DataFrame:
    """BM25 of every (question, document) sharing a term: ``qkey, key,
    score``. ``idf = ln(1 + (N - df + 0.5) / (df + 0.5))``; a term repeated
    in the question counts once."""
    asked = _asked(index, qterms, qkey)
    tp = index.postings.select("term", index.key, "tf", "dl").join(_side(asked, is_small(qterms)), "term")
    return tp.groupBy(qkey, index.key).agg(F.sum(F.col("_idf") * _tf_norm("tf", "dl", k1, b)).alias("score"))


def _holding_all(index: Index, qterms: DataFrame, qkey: str, k1: float, b: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Blocks, asked terms, and ``qkey, seg, _docs``: the documents of each
    segment that hold every term of the question. Segments where a term has no
    block fall out by their heads; in the others the blocks' documents are
    intersected from the shortest block on. A segment bounds all arrays."""
    blocks, asked = _blocks(index), _asked(index, qterms, qkey)
    need = qterms.groupBy(qkey).agg(F.countDistinct("term").alias("_terms"))
    small = is_small(qterms)
    full = _segments(blocks, asked, qkey, k1, b, small).join(_side(need, small), qkey).where("terms = _terms").select(qkey, "seg")
    lists = (_in_segments(blocks, asked, full, qkey, ["n", "keys"]).groupBy(qkey, "seg")
             .agg(F.sort_array(F.collect_list(F.struct("n", "term", "keys"))).alias("_l")))
    docs = F.aggregate(F.slice("_l", 2, F.greatest(F.size("_l") - 1, F.lit(1))), F.col("_l")[0]["keys"],
                       lambda have, x: F.when(F.size(have) == 0, have).otherwise(F.array_intersect(have, x["keys"])))
    held = lists.select(qkey, "seg", docs.alias("_docs")).where(F.size("_docs") > 0)
    return blocks, asked, held


def all_terms(index: Index, qterms: DataFrame, qkey: str = "question_id") -> DataFrame:
    """Documents holding every query term (J10, relational division):
    ``qkey, key``."""
    _, _, held = _holding_all(index, qterms, qkey, BM25_K1, BM25_B)
    return held.select(qkey, F.explode("_docs").alias(index.key))


def top_k(scored: DataFrame, k: int, qkey: str = "question_id", key: str = "doc_id",
          score: str = "score", digits: int = 6) -> DataFrame:
    """``rank`` 1..k per question by ``(round(score) desc, key)``. The
    ``row_number() <= k`` filter lets Spark insert a partial per-partition
    group limit before the exchange, so a question hitting every document
    never ships more than k rows per map task."""
    w = Window.partitionBy(qkey).orderBy(F.round(score, digits).desc(), F.col(key))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def bm25_topk(index: Index, qterms: DataFrame, k: int = 10, qkey: str = "question_id",
              k1: float = BM25_K1, b: float = BM25_B) -> DataFrame:
    """R2: ``qkey, key, score, rank`` of the first ``k`` documents, by
    block-max pruning in two steps: each question's segments of greatest
    bound, until they hold ``AHEAD * k`` documents, are scored first; of the others
    only those whose bound reaches the k-th score found (every score is at
    most its segment's bound, so nothing is lost)."""
    blocks, asked = _blocks(index), _asked(index, qterms, qkey)
    first, bounds = _first_segments(blocks, asked, qterms, k, qkey, k1, b)
    found = materialize(_scores_in(index, blocks, asked, first, qkey, k1, b), "first-scores")
    rest = _segments_left(bounds, first, found, index.key, k, qkey)
    more = _scores_in(index, blocks, asked, rest, qkey, k1, b)
    return top_k(found.unionByName(more), k, qkey, index.key)


def _first_segments(blocks: DataFrame, asked: DataFrame, qterms: DataFrame, k: int, qkey: str, k1: float,
                    b: float) -> tuple[DataFrame, DataFrame]:
    """The segments to score first, and the bounds of all."""
    bounds = materialize(_segments(blocks, asked, qkey, k1, b, is_small(qterms)), "segment-bounds")
    w = Window.partitionBy(qkey).orderBy(F.desc("bound"), "seg")
    best = bounds.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= AHEAD * k)  # each holds a document at least
    before = F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return best.withColumn("_before", before).where(F.col("_before") < AHEAD * k).select(qkey, "seg"), bounds


def _segments_left(bounds: DataFrame, first: DataFrame, found: DataFrame, key: str, k: int, qkey: str) -> DataFrame:
    """The other segments that may hold one of the first ``k`` documents."""
    kth = top_k(found, k, qkey, key).where(F.col("rank") == k).select(qkey, F.col("score").alias("_kth"))
    rest = bounds.join(first, [qkey, "seg"], "left_anti").join(kth, qkey, "left")
    return rest.where(F.col("_kth").isNull() | (F.col("bound") >= F.col("_kth") - SLACK)).select(qkey, "seg")


def _phrase_hits(index: Index, qterms: DataFrame, slop: int, qkey: str, k1: float, b: float) -> DataFrame:
    """Documents where the phrase fits: ``qkey, key, score, width``.

    A segment's blocks of all asked terms meet in one task, once, with the
    questions whose terms all have a block there; no block is copied per
    question and no occurrence becomes a row. A segment bounds the memory. An
    occurrence of a document without a key is no hit."""
    blocks, asked, key = _blocks(index), _asked(index, qterms, qkey), index.key
    small = is_small(qterms)
    need = qterms.groupBy(qkey).agg(F.countDistinct("term").alias("_terms"))
    full = _segments(blocks, asked, qkey, k1, b, small).join(_side(need, small), qkey).where("terms = _terms").select(qkey, "seg")
    of_question = asked.groupBy(qkey).agg(F.collect_list("term").alias("_ts"), F.collect_list("_at").alias("_ats"),
                                          F.collect_list("_idf").alias("_idfs"), F.first("_avgdl").alias("_avgdl"))
    wanted = full.join(_side(of_question, small), qkey)
    parts = qterms.select("term").distinct().withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    met = blocks.join(_side(parts, small), ["term", "part"], "left_semi").select(
        F.col("seg").alias("_seg"), "term", "keys", "tfs", "dls", F.transform("positions", lambda p: F.size(p)).alias("sizes"),
        F.flatten("positions").alias("positions"))

    def fit(met, wanted):
        return _phrases_in_segment(met, wanted, qkey, key, slop, k1, b)

    types = {f.name: f.dataType.simpleString() for f in qterms.schema} | {key: blocks.schema["keys"].dataType.elementType.simpleString()}
    return met.groupBy("_seg").cogroup(wanted.groupBy("seg")).applyInArrow(
        fit, f"`{qkey}` {types[qkey]}, `{key}` {types[key]}, score double, width int")


def _phrases_in_segment(met, wanted, qkey: str, key: str, slop: int, k1: float, b: float):
    """The hits of one segment, all its documents at a time. A position is
    ``document * far + word``, with ``far`` beyond what a window spans, so
    one binary search answers for all documents and never crosses them."""
    import numpy as np
    import pyarrow as pa

    flat = lambda name: met[name].combine_chunks().flatten()
    names, entries = met["term"].to_pylist(), flat("keys").dictionary_encode()
    doc = entries.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    spans = np.concatenate([[0], np.cumsum(met["keys"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    row = {t: i for i, t in enumerate(names)}
    n_docs, real = len(entries.dictionary), doc >= 0
    at_term = np.repeat(np.arange(len(names)), np.diff(spans))
    tfs, dls = np.zeros((len(names), n_docs), np.int32), np.zeros(n_docs, np.int64)
    tfs[at_term[real], doc[real]] = flat("tfs").to_numpy(zero_copy_only=False)[real]
    dls[doc[real]] = flat("dls").to_numpy(zero_copy_only=False)[real]
    words, sizes = flat("positions").to_numpy(zero_copy_only=False).astype(np.int64), flat("sizes").to_numpy(zero_copy_only=False)
    last_q = max((p for ats in wanted["_ats"].to_pylist() for at in ats for p in at), default=0)
    far = int(words.max(initial=0)) + last_q + 2 * slop + 2
    places, edges = np.repeat(doc, sizes) * far + words, np.concatenate([[0], np.cumsum(sizes)])
    sorted_places: dict = {}

    def places_of(i):
        if i not in sorted_places:
            own = places[edges[spans[i]]:edges[spans[i + 1]]]
            sorted_places[i] = np.unique(own[own >= 0])
        return sorted_places[i]

    found_q, found_d, scores, widths = [], [], [], []
    for n, (ts, ats, idfs, avgdl) in enumerate(zip(*[wanted[c].to_pylist() for c in ("_ts", "_ats", "_idfs", "_avgdl")])):
        if any(len(set(at)) < len(at) for at in ats) or not all(t in row for t in ts):
            continue  # no two copies of a term take one query position
        rows = [row[t] for t in ts]
        held = (tfs[rows] > 0).all(axis=0)
        if not held.any():
            continue
        terms = sorted(((places_of(i), sorted(at)) for i, at in zip(rows, ats)), key=lambda x: len(x[0]))
        rare = terms[0][0]
        near = rare[held[rare // far]] - terms[0][1][0]  # of the rarest term: windows lie around these
        for own, at in terms:
            for q in at:
                first = np.searchsorted(own, near - slop + q)
                near = near[(first < len(own)) & (own[np.minimum(first, len(own) - 1)] <= near + slop + q)]
        starts = []
        for own, at in terms:
            for q in at:
                lo, hi = np.searchsorted(own, near - slop + q), np.searchsorted(own, near + q, "right")
                many = hi - lo
                starts.append(own[np.repeat(lo - np.cumsum(many) + many, many) + np.arange(many.sum())] - q)
        start = np.unique(np.concatenate(starts))
        top, where = start.copy(), np.zeros(len(start), np.int64)
        for own, at in terms:
            before = np.full(len(start), -1)
            for q in at:  # the copies of a term take its places in order, each the first that is free
                before = np.maximum(np.searchsorted(own, start + q), before + 1)
                place = own[np.minimum(before, len(own) - 1)]
                fits = (before < len(own)) & (place - q <= start + slop)
                start, before, place = start[fits], before[fits], place[fits]
                top, where = np.maximum(top[fits], place - q), place // far
        if len(start):
            new = np.flatnonzero(np.diff(where, prepend=-1))
            hit = where[new]
            tf = tfs[np.ix_(rows, hit)].astype(float)
            part = (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * dls[hit] / avgdl))
            found_q.append(np.full(len(hit), n))
            found_d.append(hit)
            scores.append((np.array(idfs)[:, None] * part).sum(axis=0))
            widths.append(np.minimum.reduceat(top - start, new))
    join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
    return pa.table({qkey: wanted[qkey].combine_chunks().take(pa.array(join(found_q, np.int64))),
                     key: entries.dictionary.take(pa.array(join(found_d, np.int64))),
                     "score": join(scores, np.float64), "width": join(widths, np.int32)})


def phrase_match(index: Index, qterms: DataFrame, slop: int = DEFAULT_SLOP,
                 qkey: str = "question_id") -> DataFrame:
    """Documents where the query positions fit in a window of spread
    ``<= slop``: ``qkey, key, width``. The width is the smallest spread of
    ``pos - q_pos`` over the windows that start at an occurrence. The copies of
    a term repeated in the query take positions of their own, in order."""
    return _phrase_hits(index, qterms, slop, qkey, BM25_K1, BM25_B).drop("score")


def search(index: Index, queries: DataFrame, size: int = DEFAULT_SIZE, slop: int = DEFAULT_SLOP,
           qkey: str = "question_id", qtext: str = "query", k1: float = BM25_K1,
           b: float = BM25_B) -> DataFrame:
    """Phrase filter, BM25 rank, top ``size`` per question:
    ``qkey, key, score, rank, width``."""
    qt = query_terms(queries, qkey, qtext)
    return top_k(_phrase_hits(index, qt, slop, qkey, k1, b), size, qkey, index.key)
