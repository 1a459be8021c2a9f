"""Audio frames: energy, voice activity, utterances, sliding windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.operators import scan

S = ["session_id"]


def frame_energy(frames: DataFrame, samples: str = "samples") -> DataFrame:
    total = F.aggregate(samples, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    rms = F.sqrt(total / F.size(samples))
    return frames.withColumn("rms", rms).withColumn(
        "energy_db", 20 * F.log10(F.greatest(F.col("rms"), F.lit(1e-10))))


def vad(frames: DataFrame, threshold: float = 1e-4, hangover: int = 5, rows: int = scan.BLOCK_ROWS) -> DataFrame:
    """Speech if loud now or within the previous ``hangover`` frames (``frame_no`` consecutive per session).

    Needs ``rms`` only: leave the samples behind and join the result to them where they are needed.
    """
    f = scan.seq_blocks(frames, "frame_no", rows)
    f = scan.prefix(f, S, ["frame_no"], {"_loud": ("max", F.when(F.col("rms") >= threshold, F.col("frame_no")))})
    speech = F.coalesce(F.col("frame_no") - F.col("_loud") <= hangover, F.lit(False))
    return f.withColumn("is_speech", speech).drop("_loud", scan.BLK)


def utterances(frames: DataFrame, max_frames: int | None = None, rows: int = scan.BLOCK_ROWS) -> DataFrame:
    """Frames of speech with ``utterance_id`` (1-based) and ``piece_no`` (forced split of long utterances).

    Silent frames before and between utterances are dropped, as they are never forwarded.
    """
    f = scan.seq_blocks(frames, "frame_no", rows)
    f = scan.prefix(f, S, ["frame_no"], {"_prev": ("last", F.col("is_speech")), "_n": ("sum", F.lit(1))},
                    before=True, keep=True)
    start = F.col("is_speech") & ~F.coalesce("_prev", F.lit(False))
    n = F.coalesce("_n", F.lit(0))
    f = scan.prefix(f, S, ["frame_no"], {"utterance_id": ("sum", start.cast("bigint")),
                                         "_first": ("max", F.when(start, n))}, keep=True)
    piece = F.expr(f"(coalesce(_n, 0) - _first) div {max_frames}") if max_frames else F.lit(0).cast("bigint")
    return (f.withColumn("piece_no", piece).filter("is_speech")
             .drop("_prev", "_n", "_first", "is_speech", scan.BLK))


def utterance_spans(frames: DataFrame, **kw) -> DataFrame:
    u = utterances(frames, **kw)
    return u.groupBy("session_id", "utterance_id", "piece_no").agg(
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("frames"))


def silence_skip(frames: DataFrame) -> DataFrame:
    """Frames forwarded to scoring: those of utterances plus the first silent frame, which closes one."""
    f = scan.prefix(scan.seq_blocks(frames, "frame_no"), S, ["frame_no"],
                    {"_prev": ("last", F.col("is_speech"))}, before=True, keep=True)
    return f.filter(F.col("is_speech") | F.coalesce("_prev", F.lit(False))).drop("_prev", scan.BLK)


def sliding_windows(frames: DataFrame, ts: str, size: str, slide: str) -> DataFrame:
    """Rows with the window(s) they fall in; add ``withWatermark`` before for streams."""
    return frames.withColumn("window", F.window(ts, size, slide))
