"""Run streams over what has arrived and read the result as a table."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.sources.scratch import scratch_path, stage


FILE_BYTES = 4 << 20
SMALL_WEIGHT, SLICE_WEIGHT = 1 << 24, 1 << 29
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def replay(df: DataFrame, keys: list[str], time: str, slices: int = 3, files: int = 2, closing: dict | None = None) -> DataFrame:
    """A table as a stream of files in time order: ``slices`` batches of at least ``files`` files each, more where the staged table is large, so that
    no task writes or reads more than some FILE_BYTES of it as Parquet. Rows are dealt by key and time, so a large key is spread too.

    ``closing`` is a last row with far later times (a heartbeat of the feed), sent twice: the first moves the watermark past the end, so that timers
    fire, and the second gives them a batch to fire in. It has columns by name; the others are null.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "feed")
    rows = scratch_path(spark, "feed-rows")
    df.write.parquet(rows)
    df = spark.read.schema(df.schema).parquet(rows)  # read once for each slice
    lo, hi = df.agg(F.min(time), F.max(time)).first()
    size = spark.read.format("binaryFile").load(rows).agg(F.sum("length")).first()[0] or 0  # lists the files, reads none
    files = max(files, -(-size // FILE_BYTES))
    step = (hi - lo) / slices
    for i in range(slices):
        part = df.filter(F.col(time) >= lo + step * i) if i else df
        part = part.filter(F.col(time) < lo + step * (i + 1)) if i < slices - 1 else part
        part.repartition(files, *keys, time).write.mode("append").parquet(path)
    for _ in range(2 if closing else 0):
        row = spark.range(1).select(*[F.lit(closing.get(f.name)).cast(f.dataType).alias(f.name) for f in df.schema.fields])
        row.repartition(files).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


def _cuts(weights: list[tuple], slices: int, most: int) -> list:
    """First times of the slices after the first one, for (time, weight) in the order of time: the cuts of ``replay`` where they have rows, and more, so that
    no slice is heavier than ``most``. A time is never cut, so a heavy one is a slice of its own."""
    cuts, full, bound = [], 0, 1
    step = (weights[-1][0] - weights[0][0]) / slices if weights else 0
    for n, (time, weight) in enumerate(weights):
        ahead = bound
        while bound < slices and time >= weights[0][0] + step * bound:
            bound += 1
        if n and (bound > ahead or full + weight > most):
            cuts.append(time)
            full = 0
        full += weight
    return cuts


def replay_built(df: DataFrame, keys: list[str], time: str, weight: Column, slices: int = 3) -> DataFrame:
    """``replay`` for rows that are built from a table row by row and take far more room than it, as growing hypotheses do. ``time`` is a count, of which
    few values differ; ``weight`` is the size of a row, and there are more slices where one would be heavier than SLICE_WEIGHT.

    No copy is staged and no row is shuffled: each slice is built from the table by the tasks that write it. So a slice has a file per task, with the rows of
    a key side by side, which compress well. Tasks without rows write none; empty files stand in for theirs, so that a batch is always one whole slice.

    Feeds up to SMALL_WEIGHT are left to ``replay``: there room does not matter, and what a stream gives for null keys depends on how rows are dealt to files.
    """
    spark = df.sparkSession
    every, df = df, df.filter(F.col(time).isNotNull())
    path, blank = scratch_path(spark, "feed"), scratch_path(spark, "feed-blank")
    with short_shuffles(spark):
        sizes = df.select(time, weight.alias("weight"), F.spark_partition_id().alias("task"))
        sizes = stage(sizes.groupBy(time).agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("weight"), F.max("task").alias("task")), "feed-sizes")
        sizes = sizes.orderBy(time).collect()
        if 0 < sum(w for _, w, _ in sizes) <= SMALL_WEIGHT:
            return replay(every, keys, time, slices)
        cuts = _cuts([(t, w) for t, w, _ in sizes], slices, SLICE_WEIGHT)
        files = 1 + max([n for *_, n in sizes], default=0)
        hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
        spark.createDataFrame([], df.schema).coalesce(1).write.option("compression", "zstd").parquet(blank)
        empty = hadoop.Path(spark.read.schema(df.schema).parquet(blank).inputFiles()[0])
        fs = empty.getFileSystem(conf)
        for i, (first, end) in enumerate(zip([None, *cuts], [*cuts, None])):
            part = df if first is None else df.filter(F.col(time) >= first)
            part = part if end is None else part.filter(F.col(time) < end)
            part.write.option("compression", "zstd").option("maxRecordsPerFile", 0).mode("append").parquet(path)
            there = len(spark.read.schema(df.schema).parquet(path).inputFiles())
            if there > files * (i + 1):
                raise RuntimeError(f"slice {i} has more than {files} files")
            for k in range(there, files * (i + 1)):
                hadoop.FileUtil.copy(fs, empty, fs, hadoop.Path(path, f"part-blank-{k}.parquet"), False, conf)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


@contextmanager
def short_shuffles(spark: SparkSession) -> Iterator[None]:
    """Writes and streams begun inside drop the files of their shuffles as soon as a write or a batch has ended, not when the driver's collector finds them."""
    old = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, old)


def drain(stream: DataFrame, mark: str | None = None) -> DataFrame:
    """Run an append-mode stream over all input, through a file sink with its checkpoint, and read the sink."""
    spark = stream.sparkSession
    out, mark = scratch_path(spark, "out"), mark or scratch_path(spark, "mark")
    with short_shuffles(spark):  # the stream keeps the settings it was started with
        q = (stream.writeStream.format("parquet").option("path", out).option("compression", "zstd").option("checkpointLocation", mark)
                   .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def drain_updates(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Run an update-mode aggregate and keep the newest row per key; each batch rewrites only its own folder."""
    spark = stream.sparkSession
    out, mark = scratch_path(spark, "out"), scratch_path(spark, "mark")

    def save(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/n={number}")

    q = (stream.writeStream.foreachBatch(save).option("checkpointLocation", mark)
               .outputMode("update").trigger(availableNow=True).start())
    q.awaitTermination()
    rows = spark.read.parquet(f"{out}/*")
    rest = [c for c in rows.columns if c not in keys and c != "_batch"]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("r")).select(*keys, "r.*")
