"""Streaming jobs.

Per-file parsers keep windows inside one document, which streaming
aggregations cannot order; so each micro-batch is processed with the batch
operators inside ``foreachBatch``. Writes are keyed by the batch id
(``overwrite`` of ``batch=<id>``), so a replayed batch after a failure
replaces its own output instead of duplicating it. Running totals are a
streaming aggregate over what the batches wrote, kept in the state store;
the incremental index is compacted into generations, each named by the last
batch it holds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.evaluate import with_prf
from tessera.operators.index import Index, index_documents


def _batch_sink(out_path: str, fn: Callable[[DataFrame], DataFrame]):
    def run(batch: DataFrame, batch_id: int) -> None:
        fn(batch).write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")
    return run


def run_available(stream: DataFrame, out_path: str, checkpoint: str,
                  fn: Callable[[DataFrame], DataFrame]) -> None:
    """Process everything available now, then stop."""
    q = (stream.writeStream.foreachBatch(_batch_sink(out_path, fn))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def stream_corpus(spark: SparkSession, src_dir: str, out_path: str, checkpoint: str,
                  parser: Callable[[DataFrame], DataFrame], ext: str = ".txt",
                  max_files: int | None = None, record_sep: str | None = None) -> DataFrame:
    """Files landing in ``src_dir`` are parsed as they arrive (``file,
    content``: one row per file, or per record where ``record_sep`` ends
    one, so that a file may hold many documents); returns the accumulated
    result table."""
    whole = ("lineSep", record_sep) if record_sep else ("wholetext", "true")
    r = (spark.readStream.format("text").option(*whole)
         .option("pathGlobFilter", "*" + ext).option("recursiveFileLookup", "true"))
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    s = r.load(src_dir).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("content"))
    run_available(s, out_path, checkpoint, parser)
    return spark.read.parquet(out_path)


def stream_table(spark: SparkSession, src_dir: str, schema: str, out_path: str, checkpoint: str,
                 fn: Callable[[DataFrame], DataFrame], max_files: int | None = 1) -> DataFrame:
    """A parquet stream (questions, documents) processed batch by
    batch with ``fn`` (stream-static joins happen inside ``fn``)."""
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    run_available(r.parquet(src_dir), out_path, checkpoint, fn)
    return spark.read.parquet(out_path)


def running_scores(spark: SparkSession, counts_path: str, out_path: str, checkpoint: str) -> DataFrame:
    """The score after every batch. ``counts_path`` is what
    :func:`stream_table` wrote, one row ``exact, n_ref, n_pred`` per batch; a
    second stream sums it in the state store (three numbers, whatever the
    history) and emits the totals so far with precision, recall and F1:
    ``batch, exact, n_ref, n_pred, precision, recall, f1``. Restarted on the
    same checkpoint it goes on from the stored totals."""
    schema = "exact bigint, n_ref bigint, n_pred bigint, batch int"
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(counts_path)
    totals = rows.groupBy().agg(F.max("batch").alias("last"), *[F.sum(c).alias(c) for c in ("exact", "n_ref", "n_pred")])
    q = (totals.writeStream.outputMode("complete").foreachBatch(_batch_sink(out_path, with_prf))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out_path).drop("batch").withColumnRenamed("last", "batch")


def index_batch(batch: DataFrame, key: str = "doc_id") -> DataFrame:
    """T4, one batch: its postings, and one row without a term per document
    that carries the document's length (so that a document without words
    still replaces its older version)."""
    idx = index_documents(batch, key)
    posts = idx.postings.select(key, "term", "positions", "tf", "dl")
    heads = idx.doc_stats.select(key, F.lit(None).cast("string").alias("term"), F.array().cast("array<int>").alias("positions"),
                                 F.lit(0).alias("tf"), F.col("n_tokens").cast("int").alias("dl"))
    return posts.unionByName(heads)


def removed_batch(batch: DataFrame, key: str = "doc_id") -> DataFrame:
    """T4, documents taken out: a tombstone each, a row of
    :func:`index_batch` without a term or a length."""
    return batch.select(key, F.lit(None).cast("string").alias("term"), F.array().cast("array<int>").alias("positions"),
                        F.lit(0).alias("tf"), F.lit(None).cast("int").alias("dl")).distinct()


def _generations(path: str) -> str:
    return path.rstrip("/") + "-generations"


def _newest_generation(spark: SparkSession, path: str) -> int | None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(_generations(path))
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return None
    done = [int(f.getPath().getName().removeprefix("upto=")) for f in fs.listStatus(folder)
            if f.getPath().getName().startswith("upto=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
    return max(done, default=None)


def _live(rows: DataFrame, key: str) -> DataFrame:
    """Of each document the rows of its last batch, less tombstones."""
    heads = rows.where("term is null")
    last = heads.groupBy(key).agg(F.max(F.struct("batch", "dl")).alias("_l")).select(
        key, F.col("_l.batch").alias("batch"), F.col("_l.dl").alias("_dl")).where("_dl is not null")
    return rows.join(last.drop("_dl"), [key, "batch"])


def index_rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows that :func:`merged_index` needs of an incremental index: the
    newest complete generation and the batches after it. A read costs the
    live data and what came since, not the history."""
    batches = spark.read.parquet(path)
    newest = _newest_generation(spark, path)
    if newest is None:
        return batches
    held = spark.read.schema(batches.schema).parquet(f"{_generations(path)}/upto={newest}")
    return held.unionByName(batches.where(F.col("batch") > newest))


def compact_index(spark: SparkSession, path: str, upto: int, key: str = "doc_id") -> None:
    """T4: merge the newest generation and the batches after it, up to
    ``upto``, into the generation of that name: replaced versions and
    tombstones are left behind. Batches up to ``upto`` and older generations
    are not read again and may be deleted. Repeated after a failure it writes
    the same generation again; readers see it once it is complete."""
    newest = _newest_generation(spark, path)
    if newest is not None and newest >= upto:
        return
    rows = index_rows(spark, path).where(F.col("batch") <= upto)
    _live(rows, key).select(*rows.columns).write.mode("overwrite").parquet(f"{_generations(path)}/upto={upto}")


def stream_index(spark: SparkSession, src_dir: str, schema: str, out_path: str, checkpoint: str, key: str = "doc_id",
                 max_files: int | None = 1, compact_every: int = 16) -> Index:
    """T4: documents (``key``, ``text``; where ``schema`` has ``removed``, true
    takes the document out) indexed as they arrive, compacted after every
    ``compact_every`` batches; the index they add up to."""
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    stream = r.parquet(src_dir)

    def rows_of(batch: DataFrame) -> DataFrame:
        if "removed" not in batch.columns:
            return index_batch(batch, key)
        gone = F.coalesce("removed", F.lit(False))
        return index_batch(batch.where(~gone), key).unionByName(removed_batch(batch.where(gone), key))

    write = _batch_sink(out_path, rows_of)

    def run(batch: DataFrame, batch_id: int) -> None:
        write(batch, batch_id)
        if (batch_id + 1) % compact_every == 0:
            compact_index(spark, out_path, batch_id, key)

    q = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return merged_index(index_rows(spark, out_path), key)


def merged_index(rows: DataFrame, key: str = "doc_id") -> Index:
    """The index that all batches of :func:`index_batch` add up to (``rows``
    with their ``batch``): of each document only its last batch counts, and a
    document whose last row is a tombstone is gone."""
    now = _live(rows, key)
    postings = now.where("term is not null").select("term", key, "positions", "tf", "dl")
    return Index(postings, now.where("term is null").select(key, F.col("dl").alias("n_tokens")),
                 postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")), key)
