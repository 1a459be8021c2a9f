"""Byte ranges of files, so that one huge file is read by many tasks.

Spark lists the files (names and lengths only); each task then opens a file and reads just its range. Files are opened through Arrow's
file systems, which know local folders, S3, Google Cloud Storage and HDFS. In a store that only Spark can open, whole files are read by Spark
and cut afterwards, which limits a file to 2 GB there.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RANGE_BYTES = 4 << 20
TASK_BYTES = 64 << 20

#: Schemes of Spark's paths and what Arrow calls them.
SCHEMES = {"file": "file", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs", "hdfs": "hdfs"}


def open_file(path: str):
    """A file, given as Spark names it (scheme:/path or scheme://host/path, not percent-encoded), opened for reading at any place."""
    scheme, rest = path.split(":", 1)
    if scheme == "file":
        return fs.LocalFileSystem().open_input_file("/" + rest.lstrip("/"))
    bucket, name = rest.lstrip("/").split("/", 1)
    system, base = fs.FileSystem.from_uri(f"{SCHEMES[scheme]}://{bucket}/")
    return system.open_input_file(f"{base.rstrip('/')}/{name}" if base.strip("/") else name)


def _read(range_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, length, block in zip(*(c.to_pylist() for c in batch.columns)):
                start = block * range_bytes
                with open_file(name) as f:
                    data = f.read_at(min(range_bytes, length - start), start)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([block], pa.int64()), pa.array([data], pa.binary())], ["file", "block", "data"])
    return run


def read_ranges(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, names: str | None = None) -> DataFrame:
    """(file, block, data) of all files under a path: block n holds the bytes from n * range_bytes on. Empty files have no blocks.

    ``names`` is a pattern of file names to read.
    """
    given = spark.read.format("binaryFile")
    files = (given.option("pathGlobFilter", names) if names else given).load(path).where("length > 0")
    block = F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(length - 1) div {range_bytes}"))).alias("block")
    if files.where(~F.substring_index("path", ":", 1).isin(*SCHEMES)).limit(1).count():
        blocks = files.select(F.col("path").alias("file"), "content", block)
        at = (F.col("block") * range_bytes + 1).cast("int")
        return blocks.select("file", "block", F.substring("content", at, F.lit(range_bytes)).alias("data"))
    blocks = files.select(F.col("path").alias("file"), "length", block)
    total = files.agg(F.sum("length")).first()[0] or 0
    tasks = max(total // TASK_BYTES, min(total // range_bytes, spark.sparkContext.defaultParallelism)) + 1
    return blocks.repartition(int(tasks), "file", "block").mapInArrow(_read(range_bytes), "file string, block bigint, data binary")
