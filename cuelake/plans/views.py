"""Domain tables derived from the given tables: cues, words, hypotheses, frames, scores, samples, ..."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.functions.text import wer_tokens
from cuelake.operators import scan


SEGMENT = 60
TEXT_KEYS = {"conversations": "conv_id", "documents": "doc_id"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table. Text is expensive per row: a small text file that would be read by fewer tasks than there are
    cores is spread first (large inputs have more splits than cores and are left alone)."""
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in TEXT_KEYS and df.rdd.getNumPartitions() < cores:
        more = ["turn"] if name == "conversations" else []
        df = df.repartition(cores, TEXT_KEYS[name], *more)
    return df


def tokens(text) -> F.Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def cues(spark: SparkSession, sf: str) -> DataFrame:
    """A conversation is a session, a turn a cue; 400 ms per word, cues end to end."""
    c = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("session_id"), (F.col("turn") + 1).alias("cue_no"),
        F.col("role").alias("speaker"), "text", (F.size(tokens(F.col("text"))) * 400).cast("bigint").alias("dur"))
    timed = scan.prefix(scan.seq_blocks(c, "cue_no"), ["session_id"], ["cue_no"],
                        {"end_ms": ("sum", F.col("dur"))})
    return timed.select("session_id", "cue_no", "speaker", "text",
                        (F.col("end_ms") - F.col("dur")).alias("start_ms"), "end_ms")


def words(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    return c.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("utterance_id"),
                    F.posexplode(tokens(F.col("text"))).alias("pos", "word"))


def fragments(spark: SparkSession, sf: str) -> DataFrame:
    """Four words per fragment, 400 ms per word."""
    c = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("utterance_id"),
        tokens(F.col("text")).alias("w"))
    n = F.size("w")
    frag = F.explode(F.sequence(F.lit(0), F.floor((n - 1) / 4).cast("int"))).alias("frag_no")
    rows = c.filter(n > 0).select("session_id", "utterance_id", "w", frag)
    end = F.least(F.col("frag_no") * 4 + 4, n)
    return rows.select(
        "session_id", "utterance_id", "frag_no",
        F.array_join(F.slice("w", F.col("frag_no") * 4 + 1, F.lit(4)), " ").alias("text"),
        (F.col("frag_no") * 1600).cast("bigint").alias("start_ms"), (end * 400).cast("bigint").alias("end_ms"))


def session_fragments(spark: SparkSession, sf: str) -> DataFrame:
    """Fragments numbered and timed over the whole session: utterances follow each other with a one-second pause
    after every third one."""
    f = fragments(spark, sf)
    u = f.groupBy("session_id", "utterance_id").agg(
        F.max("end_ms").alias("len"), F.count("*").alias("n"))
    u = u.withColumn("len", F.col("len") + F.when(F.col("utterance_id") % 3 == 2, 1000).otherwise(0))
    base = scan.prefix(scan.seq_blocks(u, "utterance_id"), ["session_id"], ["utterance_id"],
                       {"off": ("sum", F.col("len")), "base": ("sum", F.col("n"))}, before=True)
    base = base.select("session_id", "utterance_id", F.coalesce("off", F.lit(0)).alias("off"),
                       F.coalesce("base", F.lit(0)).alias("base"))
    return f.join(base, ["session_id", "utterance_id"]).select(
        "session_id", "utterance_id", (F.col("base") + F.col("frag_no")).alias("frag_no"), "text",
        (F.col("start_ms") + F.col("off")).alias("start_ms"), (F.col("end_ms") + F.col("off")).alias("end_ms"))


def hypotheses(spark: SparkSession, sf: str, last_only: bool = False) -> DataFrame:
    """Growing hypotheses per utterance: three more words per step, an unstable last word on odd steps.

    Words are built once per utterance and cut to each step. ``last_only`` gives the last hypothesis of every utterance without building the others.
    """
    c = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("utterance_id"),
        tokens(F.col("text")).alias("w")).filter(F.size("w") > 0)
    item = F.transform("w", lambda x, i: F.struct(
        F.concat(x, F.lit("#"), i.cast("string")).alias("text"),
        (i * 400).cast("bigint").alias("start_ms"), ((i + 1) * 400).cast("bigint").alias("end_ms")))
    c = c.select("session_id", "utterance_id", item.alias("w"))
    n = F.size("w")
    last = F.ceil(n / 3).cast("int")
    steps = F.array(last) if last_only else F.sequence(F.lit(1), last)
    c = c.select("*", F.explode(steps).alias("step"))  # behind it Spark does not build the words again at each use
    m = F.least(F.col("step") * 3, n)
    end = F.get("w", m - 1)
    shaky = F.struct(F.concat(end["text"], F.lit("~")).alias("text"), end["start_ms"].alias("start_ms"), end["end_ms"].alias("end_ms"))
    words = F.when(F.col("step") % 2 == 1, F.concat(F.slice("w", F.lit(1), m - 1), F.array(shaky))).otherwise(F.slice("w", F.lit(1), m))
    return c.select("session_id", "utterance_id", "step", words.alias("words"),
                    (m * 400).cast("bigint").alias("buffer_end_ms"), (F.col("step") == last).alias("utterance_end"))


def frames(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    gain = F.when(F.col("label") >= 7, F.lit(1.0)).otherwise(0.001 * F.col("label"))
    frame = F.expr("vec_id div 10")
    return e.select((F.col("vec_id") % 10).alias("session_id"), frame.alias("frame_no"),
                    (frame * 100).alias("start_ms"), (frame * 100 + 100).alias("end_ms"),
                    F.transform("embedding", lambda x: x.cast("double") * gain).alias("samples"))


def utc(column: str) -> F.Column:
    """A zone-less timestamp read as UTC, whatever the zone of the session."""
    return F.timestamp_micros(F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column})"))


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("ts", utc("ts"))


def latency(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select(F.col("user_id").alias("session_id"), "ts", "event_id",
                                    F.col("value").alias("latency_ms"))


def gpu(spark: SparkSession, sf: str) -> DataFrame:
    util = F.when(F.col("event_type") != "error", F.least(F.col("value"), F.lit(100.0)))
    return events(spark, sf).select((F.col("user_id") % 4).alias("gpu"), "ts", "event_id", util.alias("util"))


def sounds(spark: SparkSession, sf: str) -> DataFrame:
    label = (F.when(F.col("event_type") == "click", "Clapping").when(F.col("event_type") == "purchase", "Applause")
              .when(F.col("event_type") == "view", "Music").when(F.col("event_type") == "signup", "Speech")
              .otherwise("Siren"))
    return (events(spark, sf)
            .groupBy((F.col("user_id") % 5).alias("session_id"),
                     F.expr("unix_seconds(ts) div 3600").alias("window_no"), label.alias("label"))
            .agg(F.max(F.least(F.col("value") / 100, F.lit(1.0))).alias("prob")))


def _heard(words: F.Column, first: F.Column | int = 0) -> F.Column:
    """A damaged copy of a word list that starts at place `first` of a text: drops, substitutions and insertions; a list of lists."""
    def said(w, at):
        i = at + first
        return F.when(i % 11 == 5, F.array().cast("array<string>")).when(i % 13 == 7, F.array(F.lit("zz"))).when(
            i % 17 == 9, F.array(w, F.lit("qq"))).otherwise(F.array(w))
    return F.transform(words, said)


def transcript_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Whole documents, and a damaged copy of their words."""
    d = table(spark, sf, "documents").withColumn("r", wer_tokens(F.col("text")))
    return d.select("doc_id", "lang", "source", F.col("text").alias("ref"), F.array_join(F.flatten(_heard(F.col("r"))), " ").alias("hyp"))


def segment_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Texts without punctuation in segments of SEGMENT words, each with its damaged copy: many short pairs, which SQL can score too. A text is cut once and
    a segment is damaged alone, so a row never holds more than its own words."""
    d = table(spark, sf, "documents")
    ref = tokens(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}\p{M}\s]", ""))
    last = F.greatest(F.lit(0), F.expr(f"cast((size(r) - 1) div {SEGMENT} as int)"))
    cut = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(F.col("r"), k * SEGMENT + 1, F.lit(SEGMENT)))
    rows = d.select("doc_id", "lang", "source", ref.alias("r")).select("doc_id", "lang", "source", F.posexplode(cut).alias("seg_no", "r"))
    return rows.select("doc_id", "seg_no", "lang", "source", F.array_join("r", " ").alias("ref"),
                       F.array_join(F.flatten(_heard(F.col("r"), F.col("seg_no") * SEGMENT)), " ").alias("hyp"))


def urls(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages")
    k = F.col("page_id")
    s = k.cast("string")
    url = (F.when(k % 5 == 0, F.concat(F.lit("https://www.youtube.com/watch?v=id%20"), s, F.lit("&t=3")))
            .when(k % 5 == 1, F.concat(F.lit("https://youtu.be/id"), s))
            .when(k % 5 == 2, F.concat(F.lit("RTMP://host/live/"), s))
            .when(k % 5 == 3, F.concat(F.lit("sdi://"), s)).otherwise(F.col("url")))
    dest = F.when(k % 7 == 0, F.concat(F.lit("rtmp://out/"), s)).otherwise(F.lit(""))
    return p.select("page_id", url.alias("url"), dest.alias("dest"))


def archive(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("seq"),
        F.unix_millis(utc("o_orderdate")).alias("created_at"),
        F.col("o_orderstatus").alias("status"))


def live_ids(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").filter(F.col("c_mktsegment") == "BUILDING").select(
        F.col("c_custkey").alias("id"))


def devices(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three enumeration tables (video in, audio in, video out) of a device fleet."""
    s = table(spark, sf, "supplier").select(
        (F.col("s_suppkey") % 7).alias("host"), F.col("s_suppkey").alias("idx"),
        F.concat(F.lit("p"), F.col("s_suppkey")).alias("persistent_id"), F.col("s_name").alias("label"),
        F.when(F.col("s_suppkey") % 4 == 0, "hdmi").alias("connection"))
    k = F.col("idx")
    return s.filter(k % 2 == 0), s.filter(k % 3 == 0), s.filter(k % 5 < 3)


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    """One session row per customer, with a source url and a status."""
    k = F.col("c_custkey")
    status = (F.when(k % 4 == 0, "live").when(k % 4 == 1, "starting").when(k % 4 == 2, "ended").otherwise("error"))
    kind = F.when(k % 3 == 0, "sdi").when(k % 3 == 1, "youtube").otherwise("stream")
    url = F.when(k % 3 == 0, F.concat(F.lit("sdi://"), (k % 40).cast("string"))).otherwise(
        F.concat(F.lit("http://h/"), k.cast("string")))
    return table(spark, sf, "customer").select(
        k.alias("session_id"), url.alias("url"), kind.alias("source_type"), status.alias("status"),
        (k * 1000).alias("started_ms"), (k % 7).alias("host"))


def polls(spark: SparkSession, sf: str) -> DataFrame:
    """Signal polls: an 'error' event is a poll without lock."""
    return events(spark, sf).select(F.col("user_id").alias("session_id"), "ts", "event_id",
                                    (F.col("event_type") != "error").alias("locked"))


def log_lines(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select(F.col("event_id").alias("seq"),
                                    F.concat_ws(" ", "event_type", F.col("value").cast("string")).alias("line"))
