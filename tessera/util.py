"""Plan helpers shared by operators and queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Largest side, in bytes of the plan's own statistics, for an explicit broadcast.
BROADCAST_MAX_BYTES = 32 << 20


def plan_bytes(df: DataFrame) -> int:
    """Size of ``df`` by the optimizer's statistics. Files and local rows
    count as they are; filters and aggregates at most as their input; joins
    as the product, so an estimate errs on the large side."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def is_small(df: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES) -> bool:
    return plan_bytes(df) <= max_bytes


def maybe_broadcast(df: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Broadcast ``df`` only if its size in bytes is bounded by the plan's
    statistics (no job runs for it); otherwise the planner shuffles, and AQE
    may still broadcast or split on measured sizes."""
    return F.broadcast(df) if is_small(df, max_bytes) else df


def read_table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch_path(spark, name: str) -> str:
    """A fresh folder under the shared checkpoint folder for written
    intermediate tables."""
    import uuid

    from tessera.session import checkpoint_dir

    return f"{checkpoint_dir(spark).rstrip('/')}/tessera/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet under the shared checkpoint folder and read
    it back: cuts lineage (replays survive lost executors, and later
    self-joins see a plain scan)."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


#: Bytes of stored input behind one task of a text exchange, and how many times
#: the session's shuffle partitions there may be for it.
TASK_BYTES = 1 << 20
MOST_TIMES = 64


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files and local rows that ``df`` is made of (those of
    unknown size, such as streams, count as none)."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    sizes = (int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return sum(x for x in sizes if x < 1 << 50)


def text_partitions(spark, rows: DataFrame | None = None) -> int:
    """Partition count for the one document exchange: the session's
    ``spark.sql.shuffle.partitions``, or more if ``rows`` are made of so many
    bytes that a task would get more than :data:`TASK_BYTES` (the tokens of
    stored text take over a hundred times its bytes where steps sort them). Given
    explicitly so AQE does not merge the text shuffle into a few tasks: text
    work is heavy per byte."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if rows is None or rows.isStreaming:
        return least
    return max(least, min(-(-input_bytes(rows) // TASK_BYTES), least * MOST_TIMES))


def materialize_by(df: DataFrame, key: str, name: str, buckets: int | None = None) -> DataFrame:
    """:func:`materialize` for rows that are hash-partitioned on ``key``
    already: written in buckets of it (as many as ``df`` has partitions:
    ``buckets``, or those of its text exchange), so later windows, joins and
    aggregates by ``key`` need no exchange. Whole numbers are written as
    differences: offsets and ordinals take a few bits each."""
    from hashlib import md5

    spark = df.sparkSession
    # joins on more than the key take the buckets as they are
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    path, buckets = scratch_path(spark, name), buckets or text_partitions(spark, df)
    table = "tessera_by_" + md5(path.encode()).hexdigest()[:16]
    whole = {f"parquet.enable.dictionary#{c}": "false" for c, kind in df.dtypes if kind in ("int", "bigint")}
    writers = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(writers)
    spark.conf.set(writers, "2")  # a task has one bucket: its rows are written as they come, not sorted by bucket first
    try:
        (df.write.format("parquet").bucketBy(buckets, key).options(**{"parquet.writer.version": "v2", "compression": "zstd", **whole})
         .option("path", path).saveAsTable(table))  # external: the files stay
    finally:
        spark.conf.set(writers, before)
    return spark.table(table)


def dense_ids(df: DataFrame, order: list, name: str = "id") -> DataFrame:
    """Consecutive ids ``0..n-1`` in the order of ``order`` (which must be a
    total order) without a single-partition window: a range-partitioned
    sort, one small count per partition, and each row's position inside
    its partition. Only the per-partition counts (one row per partition)
    are broadcast."""
    from pyspark.sql import Window

    s = df.orderBy(*order).withColumn("_pid", F.spark_partition_id()).withColumn(
        "_pos", F.monotonically_increasing_id())
    s = materialize(s, "dense-ids")  # fix partition membership and positions
    counts = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_c"), F.min("_pos").alias("_p0"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.withColumn("_off", F.coalesce(F.sum("_c").over(w), F.lit(0)))
    out = s.join(F.broadcast(offs.select("_pid", "_off", "_p0")), "_pid")
    return out.withColumn(name, (F.col("_off") + F.col("_pos") - F.col("_p0")).cast("int")).drop(
        "_pid", "_pos", "_off", "_p0")
