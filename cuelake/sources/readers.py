"""Readers: files of the caption data model to tables (batch, or stream where noted)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from cuelake import schemas
from cuelake.functions import text as T, values as V
from cuelake.operators import scan

STRIDE_S = 0.08


def pcm_files(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Raw float32 little-endian mono chunk files; name ``<session>_<frame>.pcm``."""
    if stream:
        schema = "path string, modificationTime timestamp, length bigint, content binary"
        return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.pcm").load(path)
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pcm").load(path)


@F.pandas_udf(ArrayType(FloatType()))
def _samples(content: pd.Series) -> pd.Series:
    return content.map(lambda b: np.frombuffer(b[:len(b) // 4 * 4], dtype="<f4"))


def read_pcm_frames(files: DataFrame, rate: int = 16000, chunk_ms: int = 100) -> DataFrame:
    """Frames with samples and times; ``files`` has path and content (from ``pcm_files`` or a stream of them).

    A frame starts at its number times the nominal chunk length and lasts as long as its samples, so a short last file is in place.
    """
    name = F.regexp_extract("path", r"([^/]+)\.pcm$", 1)
    frame = F.element_at(F.split(name, "_"), -1).cast("bigint")
    f = files.select(F.regexp_extract(name, r"^(.*)_\d+$", 1).alias("session_id"), frame.alias("frame_no"),
                     _samples("content").alias("samples"))
    start = F.col("frame_no") * chunk_ms
    return f.select("session_id", "frame_no", start.alias("start_ms"),
                    (start + F.floor(F.size("samples") * 1000 / rate)).alias("end_ms"), F.lit(rate).alias("sample_rate"), "samples")


def read_hypotheses(spark: SparkSession, path: str) -> DataFrame:
    """Backend word output (JSON lines) to word rows; missing times come from frame offsets."""
    h = spark.read.schema(schemas.BACKEND_WORDS).json(path)
    w = h.select("session_id", "utterance_id", "step", F.posexplode("words").alias("pos", "w"))
    text = T.collapse_space(F.col("w.word"))
    start = F.coalesce("w.start", F.coalesce("w.start_offset", F.lit(0)) * STRIDE_S)
    end = F.coalesce("w.end", F.coalesce("w.end_offset", F.lit(0)) * STRIDE_S)
    ms = lambda c: F.round(c * 1000).cast("bigint")
    return w.filter(text != "").select("session_id", "utterance_id", "step", "pos",
                                       F.concat(F.lit(" "), text).alias("word"), ms(start).alias("start_ms"),
                                       ms(end).alias("end_ms"))


def read_packet_log_608(spark: SparkSession, path: str) -> DataFrame:
    log = spark.read.schema(schemas.PACKET_LOG_608).json(path)
    return log.select("ts", "text", F.posexplode("frames").alias("pos", "f")).select(
        "ts", "text", "pos", "f.b1", "f.b2", "f.note")


def read_packet_log_708(spark: SparkSession, path: str) -> DataFrame:
    """Packets with their bytes and exploded cc_data triples."""
    log = spark.read.schema(schemas.PACKET_LOG_708).json(path)
    raw = F.unhex(F.regexp_replace("raw_hex", " ", ""))
    return log.select("ts", "text", "raw_hex", raw.alias("packet"), F.posexplode("cc_data").alias("pos", "c")).select(
        "ts", "text", "raw_hex", "packet", "pos", "c.cc_type", "c.d1", "c.d2", "c.type_name")


def read_session_archive(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(sessions, cues) of archived session documents, one per line; ids other than letters and digits are refused.

    A long session is spread over several documents, each with the number of its first cue.
    """
    a = spark.read.schema(schemas.ARCHIVE).json(path).withColumn("first_cue", F.coalesce("first_cue", F.lit(1)))
    a = a.filter(F.col("id").rlike(r"^[\p{L}\p{N}]+$"))
    ms = lambda c: F.round(F.col(c) * 1000).cast("bigint")
    cues = a.select("id", "first_cue", F.posexplode("cues").alias("pos", "c")).select(
        F.col("id").alias("session_id"), (F.col("pos") + F.col("first_cue")).alias("cue_no"), ms("c.start").alias("start_ms"),
        ms("c.end").alias("end_ms"), "c.text")
    return a.filter("first_cue = 1").drop("cues", "records", "first_cue"), cues


def read_transcript_lines(spark: SparkSession, path: str, jsonl: bool = False, folders: bool = False) -> DataFrame:
    """(file, line_no, text): the lines of each transcript in order, from 0, blank lines skipped.

    With ``folders`` all files of a folder are one transcript, in the order of their names; ``file`` is then the folder. Spark reads large files in
    pieces by several tasks: lines are numbered within a piece (file, byte offset), and a row per piece is counted up.
    """
    lines = spark.read.text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("off"),
                         F.monotonically_increasing_id().alias("i"), "value").filter(F.trim("value") != "")
    text = F.from_json("value", "text STRING")["text"] if jsonl else F.array_join(T.space_words(F.col("value")), " ")
    folder = F.regexp_extract("file", r"^(.*)/[^/]*$", 1)
    piece = F.concat(F.substring_index("file", "/", -1), F.lit(":"), F.lpad(F.col("off").cast("string"), 20, "0"))
    t = lines.select((folder if folders else F.col("file")).alias("file"), piece.alias(scan.BLK), "i", F.coalesce(text, F.lit("")).alias("text"))
    t = scan.number_rows(t, ["file"], ["i"], "line_no")
    return t.select("file", (F.col("line_no") - 1).alias("line_no"), "text")


def read_transcript(spark: SparkSession, path: str, jsonl: bool = False, part_lines: int = 100_000, folders: bool = False) -> DataFrame:
    """Transcript per file (or folder), lines in order joined by one space, blank lines skipped.

    A row per part of at most ``part_lines`` lines, since a text of unlimited length cannot be one value; ``read_transcript_lines`` gives rows.
    """
    return scan.ordered_parts(read_transcript_lines(spark, path, jsonl, folders), ["file"], "line_no", "text", " ", "transcript", part_lines)


def read_gpu_samples(spark: SparkSession, path: str) -> DataFrame:
    """Telemetry lines of 12 comma-separated fields; unknown markers and bad numbers become null, lines of fewer fields are dropped."""
    fields = F.split("value", ",")
    lines = spark.read.text(path).select(fields.alias("f")).filter(F.size("f") >= len(schemas.GPU_COLUMNS))

    def number(t: Column) -> Column:
        return F.when(~t.isin(*V.NOT_AVAILABLE), t.try_cast("double"))

    at = {c: F.trim(F.get("f", F.lit(i))) for i, c in enumerate(schemas.GPU_COLUMNS)}
    return lines.select(*[(t if c == "name" else number(t)).alias(c) for c, t in at.items()]).withColumn("index", F.coalesce("index", F.lit(0.0)).cast("int"))


def cue_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Stream of committed cues from JSON-lines files."""
    schema = "session_id BIGINT, cue_no BIGINT, speaker STRING, text STRING, start_ms BIGINT, end_ms BIGINT"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def cue_stream_kafka(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """The same records from Kafka (needs the Kafka package on the class path)."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    schema = "session_id BIGINT, cue_no BIGINT, speaker STRING, text STRING, start_ms BIGINT, end_ms BIGINT"
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("c")).select("c.*")


LISTERS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def read_session_files(spark: SparkSession, path: str) -> DataFrame:
    """Text files of ``write_webvtt`` (session_id, name, value), a row per file. There is a folder per session, and Spark lists folders by a task each
    unless it is given fewer."""
    before = spark.conf.get(LISTERS)
    spark.conf.set(LISTERS, str(4 * spark.sparkContext.defaultParallelism))
    try:
        files = spark.read.text(path, wholetext=True)
    finally:
        spark.conf.set(LISTERS, before)
    return files.select("session_id", F.col("_metadata.file_name").alias("name"), "value")
