"""Round trips through the file formats: the given tables are written in a format and read with its reader."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from cuelake.operators import cues as Q, scoring as H, sessions as A
from cuelake.plans import packet_queries as K, views as v
from cuelake.plans.registry import query
from cuelake.plans.signal_queries import RMS
from cuelake.plans.text_queries import VTT
from cuelake.plans.view_sql import tok, with_views
from cuelake.sources import readers as R, writers as O
from cuelake.sources.scratch import scratch_path
from cuelake.streaming import jobs as J


def _pcm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"path": pdf["path"], "content": [
            np.asarray(x, dtype="<f4").tobytes() for x in pdf["embedding"]]})


@query("read_pcm_frames", """
SELECT CAST(vec_id % 10 AS VARCHAR) AS session_id, vec_id // 10 AS frame_no, (vec_id // 10) * 4 AS start_ms,
  (vec_id // 10) * 4 + len(e) // 16 AS end_ms, len(e) AS n, round(list_sum(list_transform(e, lambda x: CAST(x AS DOUBLE))), 5) AS total
FROM (SELECT *, CASE WHEN vec_id // 10 % 10 = 9 THEN embedding[1:32] ELSE embedding END AS e FROM embeddings)""")
def read_pcm_frames(spark, sf):
    """Vectors as raw sample bytes under file-like names, decoded by the reader; every tenth file of a session is short."""
    path = F.concat(F.lit("file:/pcm/"), F.col("vec_id") % 10, F.lit("_"), F.expr("vec_id div 10"), F.lit(".pcm"))
    short = F.expr("vec_id div 10 % 10 = 9")
    e = F.when(short, F.slice("embedding", 1, 32)).otherwise(F.col("embedding")).alias("embedding")
    files = v.table(spark, sf, "embeddings").select(path.alias("path"), e).mapInPandas(
        _pcm, "path string, content binary")
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return R.read_pcm_frames(files, chunk_ms=4).select("session_id", "frame_no", "start_ms", "end_ms", F.size("samples").alias("n"),
                                           F.round(total, 5).alias("total"))


@query("read_hypotheses", with_views("v_words", """
SELECT session_id, utterance_id, pos, ' ' || word AS word, pos * 400 AS start_ms, pos * 400 + 400 AS end_ms FROM v_words
WHERE pos % 10 <> 9"""))
def read_hypotheses(spark, sf):
    """Backend output with some blank words and some times given only as offsets."""
    w = v.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("utterance_id"), F.lit(1).alias("step"),
        F.lit(True).alias("ok"), F.transform(v.tokens(F.col("text")), lambda x, i: F.struct(
            F.when(i % 10 == 9, "  ").otherwise(x).alias("word"), F.when(i % 3 != 0, i * 0.4).alias("start"),
            F.when(i % 4 != 0, (i + 1) * 0.4).alias("end"), (i * 5).alias("start_offset"),
            ((i + 1) * 5).alias("end_offset"))).alias("words"))
    path = scratch_path(spark, "hypotheses")
    w.write.json(path)
    return R.read_hypotheses(spark, path).drop("step")


@query("read_packet_log_608", with_views("v_cues", f"""
SELECT CAST(session_id * 1000 + cue_no AS DOUBLE) AS ts, raw AS text,
  row_number() OVER (PARTITION BY session_id, cue_no ORDER BY pair_no) - 1 AS pos, b1, b2, {K.NOTE} AS note
FROM v_p608 JOIN v_lines USING (session_id, cue_no)""", extra=K.P608))
def read_packet_log_608(spark, sf):
    texts = K.lined(spark, sf).select("session_id", "cue_no", F.col("raw").alias("text"))
    ts = (F.col("session_id") * 1000 + F.col("cue_no")).cast("double")
    path = scratch_path(spark, "log608")
    O.write_lines(O.packet_log_608(K.pairs608(spark, sf), texts, ts), path)
    return R.read_packet_log_608(spark, path)


@query("read_packet_log_708", with_views("v_cues", f"""
SELECT CAST(session_id * 1000 + cue_no AS DOUBLE) AS ts, raw AS text, i AS pos, {K.HEX.format('packet')} AS raw_hex,
  len(packet) AS bytes, CASE WHEN i = 0 THEN 6 ELSE 7 END AS cc_type, packet[2 * i + 1] AS d1, coalesce(packet[2 * i + 2], 0) AS d2,
  CASE WHEN i = 0 THEN 'DTVCC_START' ELSE 'DTVCC_DATA' END AS type_name
FROM (SELECT *, unnest(range((len(packet) + 1) // 2)) AS i FROM v_p708)""", extra=K.P708))
def read_packet_log_708(spark, sf):
    path = scratch_path(spark, "log708")
    O.write_lines(O.packet_log_708(K.packets708(spark, sf), (F.col("session_id") * 1000 + F.col("cue_no")).cast("double")), path)
    return R.read_packet_log_708(spark, path).withColumn("bytes", F.length("packet")).drop("packet")


@query("packet_hex_dump", with_views("v_cues", f"""
SELECT session_id, cue_no, string_agg(printf('  %04d: %02X %02X', k, b1, b2) || '  [' || note || ']', chr(10) ORDER BY k) AS dump
FROM (SELECT *, row_number() OVER (PARTITION BY session_id, cue_no ORDER BY pair_no) - 1 AS k, {K.NOTE} AS note FROM v_p608)
GROUP BY 1, 2""", extra=K.P608))
def packet_hex_dump(spark, sf):
    return O.hex_dump_608(K.pairs608(spark, sf))


@query("packet_hex_dump_708", with_views("v_cues", f"""
SELECT session_id, cue_no, '  Packet header: seq=' || (packet[1] // 64) || ', size_code=' || (packet[1] % 64) || ' ('
  || (packet[1] % 64 + 1) * 2 || ' bytes)' || chr(10) || '  Raw: ' || {K.HEX.format('packet')} || chr(10) || '  cc_data tuples:'
  || chr(10) || array_to_string(list_transform(range((len(packet) + 1) // 2), lambda i:
     printf('  %04d: %02X %02X %02X', i, CASE WHEN i = 0 THEN 6 ELSE 7 END, packet[2 * i + 1], coalesce(packet[2 * i + 2], 0))
     || CASE WHEN i = 0 THEN '  [DTVCC_START]' ELSE '  [DTVCC_DATA]' END), chr(10)) AS dump FROM v_p708""", extra=K.P708))
def packet_hex_dump_708(spark, sf):
    return O.hex_dump_708(K.packets708(spark, sf))


def _archived(spark, sf):
    cues = v.cues(spark, sf)
    ids = cues.select(F.col("session_id").cast("string").alias("id")).distinct()
    return ids.select(
        F.when(F.col("id").cast("int") % 9 == 4, F.concat(F.lit("../"), "id")).otherwise(F.col("id")).alias("id"),
        F.lit("u").alias("url"), F.lit("").alias("video_id"), F.lit("stream").alias("source_type"),
        F.col("id").cast("double").alias("created_at"), F.lit("ended").alias("status"),
        F.lit(None).cast("double").alias("accuracy"), F.lit(0).alias("segment_count")), cues


@query("read_session_archive", with_views("v_cues", """
SELECT CAST(session_id AS VARCHAR) AS session_id, cue_no, start_ms, end_ms, text FROM v_cues WHERE session_id % 9 <> 4"""))
def read_session_archive(spark, sf):
    """Documents written by the archive writer; ids that are not plain are refused on reading."""
    s, cues = _archived(spark, sf)
    path, index = scratch_path(spark, "archive"), scratch_path(spark, "index")
    O.archive_sessions(s, cues, path, index)
    return R.read_session_archive(spark, path)[1]


@query("archive_sessions", with_views("v_cues", """
SELECT CAST(session_id AS VARCHAR) AS id, CAST(CASE WHEN session_id % 2 = 0 THEN session_id ELSE session_id + 10000 END AS DOUBLE) AS created_at,
  CASE WHEN session_id % 2 = 0 THEN 'ended' ELSE 'error' END AS status, CASE WHEN session_id % 2 = 0 THEN n ELSE 7 END AS cue_count
FROM (SELECT session_id, count(*) AS n FROM v_cues GROUP BY 1)"""))
def archive_sessions(spark, sf):
    """Index upsert: sessions with an odd id are in the current index with a newer date and win."""
    s, cues = _archived(spark, sf)
    s = s.withColumn("id", F.regexp_replace("id", "[./]", ""))
    odd = s.filter(F.col("id").cast("int") % 2 == 1).withColumn("created_at", F.col("created_at") + 10000).withColumn(
        "status", F.lit("error")).withColumn("cue_count", F.lit(7))
    path, index = scratch_path(spark, "archive"), scratch_path(spark, "index")
    O.archive_sessions(s, cues, path, index, odd)
    return spark.read.parquet(index).select("id", "created_at", "status", "cue_count")


@query("archive_stream", with_views("v_cues", """
SELECT CAST(session_id AS VARCHAR) AS id, CAST(CASE WHEN session_id % 2 = 0 THEN session_id ELSE session_id + 10000 END AS DOUBLE) AS created_at,
  CASE WHEN session_id % 2 = 0 THEN 'ended' ELSE 'error' END AS status, count(*) AS cue_count FROM v_cues GROUP BY session_id"""))
def archive_stream(spark, sf):
    """Ended sessions as a stream; sessions with an odd id end a second time, later."""
    s, cues = _archived(spark, sf)
    s = s.withColumn("id", F.regexp_replace("id", "[./]", ""))
    again = s.filter(F.col("id").cast("int") % 2 == 1).withColumn("created_at", F.col("created_at") + 10000).withColumn("status", F.lit("error"))
    path, index = scratch_path(spark, "archive"), scratch_path(spark, "index")
    feed = J.replay(s.unionByName(again), ["id"], "created_at")
    O.archive_stream(feed, cues, path, index, scratch_path(spark, "mark")).awaitTermination()
    return O.read_archive_index(spark, index).select("id", "created_at", "status", "cue_count")


#: Lines of a transcript joined into one value; a source of fewer lines is one row with its whole transcript.
PART_LINES = 100_000
TRANSCRIPTS = f"""
SELECT file, line_no // {PART_LINES} AS part_no, string_agg(text, ' ' ORDER BY line_no) AS transcript FROM ({{0}}) GROUP BY 1, 2"""


@query("read_transcript", with_views("v_words", TRANSCRIPTS.format("""
SELECT CAST(session_id % 4 AS VARCHAR) AS file, row_number() OVER (PARTITION BY session_id % 4 ORDER BY session_id, utterance_id) - 1 AS line_no,
  string_agg(word, ' ' ORDER BY pos) AS text FROM v_words GROUP BY session_id, utterance_id""")))
def read_transcript(spark, sf):
    """Conversations as the transcripts of four sources, each in numbered text files, a line per turn with blank lines between; read back as
    whole transcripts, in ordered parts where a source is long."""
    value = F.concat(F.regexp_replace("text", r"\s*\n\s*", " "), F.lit("\n\n"))
    return _source_transcripts(spark, sf, value, "transcripts")


@query("read_transcript_jsonl", with_views("v_words", TRANSCRIPTS.format("""
SELECT CAST(session_id % 4 AS VARCHAR) AS file, row_number() OVER (PARTITION BY session_id % 4 ORDER BY session_id, utterance_id) - 1 AS line_no,
  coalesce(string_agg(word, ' ' ORDER BY pos), '') AS text
FROM (SELECT conv_id AS session_id, turn AS utterance_id FROM conversations) LEFT JOIN v_words USING (session_id, utterance_id)
GROUP BY session_id, utterance_id""")))
def read_transcript_jsonl(spark, sf):
    value = F.to_json(F.struct(F.array_join(v.tokens(F.col("text")), " ").alias("text")))
    return _source_transcripts(spark, sf, value, "jsonl", jsonl=True)


def _source_transcripts(spark, sf, value, name, jsonl=False):
    """Turns range-sorted into as many numbered files per source as there are tasks, and read back in order."""
    c = v.table(spark, sf, "conversations").select((F.col("conv_id") % 4).alias("src"), "conv_id", "turn", value.alias("value"))
    path, order = scratch_path(spark, name), ["src", "conv_id", "turn"]
    c.repartitionByRange(*order).sortWithinPartitions(*order).select("src", "value").write.partitionBy("src").text(path)
    whole = R.read_transcript(spark, path, jsonl=jsonl, part_lines=PART_LINES, folders=True)
    return whole.select(F.regexp_extract("file", r"src=(\d+)", 1).alias("file"), "part_no", "transcript")


@query("read_gpu_samples", """
SELECT event_id % 100000 AS index, CASE WHEN event_id % 3 <> 0 THEN value END AS util_gpu, CASE WHEN event_id % 4 <> 1 THEN value END AS temp_c,
  CASE WHEN event_id % 6 <> 4 THEN CAST(event_id AS DOUBLE) END AS clock_mem_mhz FROM events WHERE event_id % 6 <> 5""")
def read_gpu_samples(spark, sf):
    """Telemetry lines with unknown markers, bad numbers, an empty last field, and short lines."""
    e, k = v.events(spark, sf), F.col("event_id")
    val = F.col("value").cast("string")
    parts = [(k % 100000).cast("string"), F.lit(" dev 1"), F.when(k % 3 == 0, " [N/A]").otherwise(val), F.lit("1"), F.lit("2"),
             F.lit("3"), F.when(k % 4 == 1, "12x").otherwise(val), F.lit("[Not Supported]"), F.lit("N/A"), F.lit(" 5 "), F.lit("6")]
    line = F.concat_ws(", ", *parts, F.when(k % 6 == 4, "").when(k % 6 != 5, k.cast("string")))
    path = scratch_path(spark, "gpu")
    e.select(line.alias("value")).write.text(path)
    return R.read_gpu_samples(spark, path).select("index", "util_gpu", "temp_c", "clock_mem_mhz")


@query("write_webvtt", with_views("v_cues", f"""
SELECT session_id, 'WEBVTT' || chr(10) || chr(10) || string_agg({VTT.format("regexp_replace(text, '\\s+', ' ', 'g')")}, chr(10) ORDER BY cue_no)
  || chr(10) AS document FROM v_cues GROUP BY session_id"""))
def write_webvtt(spark, sf):
    """The text of each session's files, read back whole in the order of their names."""
    c = v.cues(spark, sf).withColumn("text", F.regexp_replace("text", r"\s+", " "))
    path = scratch_path(spark, "webvtt")
    O.write_webvtt(c, path)
    files = R.read_session_files(spark, path)
    parts = F.array_sort(F.collect_list(F.struct("name", "value")))
    return files.groupBy(F.col("session_id").cast("bigint").alias("session_id")).agg(
        F.array_join(F.transform(parts, lambda x: x["value"]), "").alias("document"))


@query("write_packet_log", with_views("v_cues", "SELECT session_id * 1000 + cue_no AS ts, count(*) AS pairs FROM v_p608 GROUP BY 1",
                                      extra=K.P608))
def write_packet_log(spark, sf):
    """Append the log in two runs and count pairs per record."""
    texts = K.lined(spark, sf).select("session_id", "cue_no", F.col("raw").alias("text"))
    log = O.packet_log_608(K.pairs608(spark, sf), texts, (F.col("session_id") * 1000 + F.col("cue_no")).cast("double"))
    path = scratch_path(spark, "append")
    O.write_lines(log.filter("cue_no % 2 = 0"), path)
    O.write_lines(log.filter("cue_no % 2 = 1"), path)
    return R.read_packet_log_608(spark, path).groupBy(F.col("ts").cast("bigint").alias("ts")).agg(F.count("*").alias("pairs"))


@query("cue_stream", with_views("v_cues", "SELECT session_id, cue_no, text, end_ms FROM v_cues"))
def cue_stream(spark, sf):
    """JSON-lines cue feed read as a stream and drained."""
    path = scratch_path(spark, "cues")
    v.cues(spark, sf).write.json(path)
    return J.drain(R.cue_stream(spark, path, 100).select("session_id", "cue_no", "text", "end_ms"))


@query("push_feed", with_views("v_cues", "SELECT CAST(start_ms AS DOUBLE) / 1000 AS start, text FROM v_cues"))
def push_feed(spark, sf):
    """Push records streamed to a file sink and parsed again."""
    path, out = scratch_path(spark, "cues"), scratch_path(spark, "feed")
    v.cues(spark, sf).write.json(path)
    O.push_feed(R.cue_stream(spark, path, 100), out, scratch_path(spark, "mark")).awaitTermination()
    rec = F.from_json("value", "text STRING, start STRING")
    return spark.read.text(out).select(rec["start"].cast("double").alias("start"), rec["text"].alias("text"))


@query("on_cue", with_views("v_cues", "SELECT speaker, count(*) AS cues FROM v_cues GROUP BY 1"))
def on_cue(spark, sf):
    """A hook that appends each micro-batch to a table."""
    path, out = scratch_path(spark, "cues"), scratch_path(spark, "hook")
    v.cues(spark, sf).write.json(path)

    def hook(batch, number):
        batch.select("speaker").write.mode("overwrite").parquet(f"{out}/n={number}")

    O.on_cue(R.cue_stream(spark, path, 100), hook, scratch_path(spark, "mark")).awaitTermination()
    return spark.read.parquet(f"{out}/*").groupBy("speaker").agg(F.count("*").alias("cues"))


def _loud_words():
    """Scorer for the check: one word per frame, failing on quiet frames."""
    def score(samples):
        x = np.asarray(samples)
        if float(np.sqrt(np.mean(x * x))) < 0.01:
            raise ValueError("too quiet")
        return [{"text": "loud", "start_ms": 0, "end_ms": len(x)}]
    return score


@query("score_words", with_views("v_frames", f"SELECT session_id, frame_no, r >= 0.01 AS ok, CASE WHEN r >= 0.01 THEN 1 ELSE 0 END AS words "
                                 f"FROM (SELECT session_id, frame_no, {RMS} AS r FROM v_frames)"))
def score_words(spark, sf):
    return H.score_words(v.frames(spark, sf), _loud_words).select("session_id", "frame_no", "ok", F.size("words").alias("words"))


def _level():
    return lambda samples: {"Music": float(np.sqrt(np.mean(np.asarray(samples) ** 2)))}


@query("score_labels", with_views("v_frames", f"SELECT session_id, frame_no, true AS ok, round({RMS}, 6) AS music FROM v_frames"))
def score_labels(spark, sf):
    return H.score_labels(v.frames(spark, sf), _level).select(
        "session_id", "frame_no", "ok", F.round(F.col("scores")["Music"], 6).alias("music"))
