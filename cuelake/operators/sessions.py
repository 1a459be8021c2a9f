"""Session attributes, lifecycle, archives and devices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.functions import text as T, values as V
from cuelake.operators import scan

S = ["session_id"]


def classify_source(sources: DataFrame) -> DataFrame:
    """``source_type``, ``video_id`` and the stream ``scheme`` (rtmp, rtsp, srt or empty) of a url."""
    low, video = F.lower("url"), T.youtube_id(F.col("url"))
    kind = (F.when(F.trim(F.coalesce("dest", F.lit(""))) != "", "relay").when(low.startswith("sdi://"), "sdi")
             .when(video != "", "youtube").otherwise("stream"))
    scheme = F.lit("")
    for s in V.STREAM_SCHEMES:
        scheme = F.when(low.startswith(s), s.split(":")[0]).otherwise(scheme)
    return (sources.withColumn("video_id", F.coalesce(video, F.lit(""))).withColumn("source_type", kind)
                   .withColumn("scheme", scheme))


def cue_stats(cues: DataFrame) -> DataFrame:
    """Cue count, last cue and newest caption time of sessions that have cues."""
    return cues.groupBy("session_id").agg(F.count("*").alias("cue_count"), F.max_by("text", "cue_no").alias("last_cue"),
                                          F.max("end_ms").alias("uptime_ms"))


def session_rollup(sessions: DataFrame, cues: DataFrame) -> DataFrame:
    """Sessions with their cue statistics; sessions without cues stay with count 0."""
    return sessions.join(cue_stats(cues), "session_id", "left").withColumn("cue_count", F.coalesce("cue_count", F.lit(0)))


def service_totals(rollup: DataFrame) -> DataFrame:
    one = lambda s: F.count_if(F.col("status") == s).alias(s)
    return rollup.agg(F.count("*").alias("session_count"), F.sum("cue_count").alias("total_cues"),
                      one("live"), one("starting"), one("ended"), one("error"))


def device_inventory(video_in: DataFrame, audio_in: DataFrame, video_out: DataFrame) -> DataFrame:
    """Devices per (host, idx) with what they can do; names come from video in, audio in, video out, in that order.

    A device that names no ``connection`` is an SDI one.
    """
    key = ["host", "idx"]
    link = lambda d: F.col("connection") if "connection" in d.columns else F.lit(None).cast("string").alias("connection")
    side = lambda d, n: d.select(*key, F.struct("persistent_id", "label", link(d)).alias(n))
    all_ = side(video_in, "v").join(side(audio_in, "a"), key, "full").join(side(video_out, "o"), key, "full")
    meta = F.coalesce("v", "a", "o")
    label = F.coalesce(meta["label"], F.concat(F.lit("Device "), F.col("idx").cast("string")))
    return all_.select(*key, meta["persistent_id"].alias("persistent_id"), label.alias("label"),
                       F.coalesce(meta["connection"], F.lit("sdi")).alias("connection"),
                       (F.col("v").isNotNull() | F.col("a").isNotNull()).alias("can_input"),
                       F.col("o").isNotNull().alias("can_output"))


def device_owner(devices: DataFrame, sessions: DataFrame) -> DataFrame:
    """Attach the newest starting or live SDI session per device; an owned input counts as locked."""
    n = F.regexp_extract("url", r"^[^:]*://\s*(\d+)\s*$", 1)
    s = sessions.filter((F.col("source_type") == "sdi") & F.col("status").isin("starting", "live") & (n != ""))
    own = s.groupBy("host", n.cast("bigint").alias("idx")).agg(F.max_by("session_id", "started_ms").alias("session_id"))
    locked = F.when(F.col("can_input") & F.col("session_id").isNotNull(), True)
    return devices.join(own, ["host", "idx"], "left").withColumn("signal_locked", locked)


def archive_not_live(index: DataFrame, live: DataFrame) -> DataFrame:
    """Archived sessions that are not live, newest first, undated last."""
    return index.join(live, "id", "left_anti").orderBy(F.coalesce("created_at", F.lit(0)).desc(), "id")


def upsert_index(current: DataFrame, fresh: DataFrame, key: str = "id", order=("created_at", "seq")) -> DataFrame:
    """One row per id, the newest wins. A combining aggregate, so an id with many versions is no hot spot."""
    both = current.unionByName(fresh)
    rest = [c for c in both.columns if c != key]
    new = F.max_by(F.struct(*rest), F.struct(*[F.col(c) for c in order])).alias("r")
    return both.groupBy(key).agg(new).select(key, "r.*")


def session_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Added, removed and status-changed sessions between two snapshots."""
    b = before.select("session_id", F.col("status").alias("was"))
    a = after.select("session_id", F.col("status").alias("now"))
    change = (F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("changed"))
    return b.join(a, "session_id", "full").filter(~F.col("was").eqNullSafe(F.col("now"))).withColumn("change", change)


def lifecycle_status(first_end: Column, went_live: Column) -> Column:
    return (F.when(first_end.isin("eos", "stop"), "ended").when(first_end.isNotNull(), "error")
             .when(went_live, "live").otherwise("starting"))


def session_lifecycle(events: DataFrame) -> DataFrame:
    """Status and error per session from (session_id, seq, kind, reason) events.

    ``kind`` is started, live or end. The first end decides; eos or stop means ended, other reasons are errors.
    """
    end = F.min_by("reason", F.when(F.col("kind") == "end", F.col("seq"))).alias("_end")
    e = events.groupBy("session_id").agg(end, F.max(F.col("kind") == "live").alias("_live"),
                                         F.min(F.when(F.col("kind") == "end", F.col("seq"))).alias("ended_seq"))
    status = lifecycle_status(F.col("_end"), F.col("_live"))
    message = F.when(status == "error", F.when(F.col("_end") == "error", "stream error").otherwise(F.col("_end")))
    return e.select("session_id", status.alias("status"), message.alias("error"), "ended_seq")


def signal_gaps(polls: DataFrame, timeout_ms: int = V.SIGNAL_TIMEOUT_MS, first_only: bool = True) -> DataFrame:
    """Polls without lock at or after the deadline: last lock (or the first poll) plus the timeout.

    ``polls``: session_id, ts, event_id, locked. The first one ends a session.
    """
    order = ["ts", "event_id"]
    ms = F.unix_millis("ts")
    p = scan.range_blocks(polls.withColumn("t_ms", ms), S, order)
    p = scan.prefix(p, S, order, {"_lock": ("max", F.when(F.col("locked"), F.col("t_ms"))),
                                  "_begun": ("max", -F.col("t_ms"))})
    begun = -F.col("_begun")
    gap = p.filter(~F.col("locked") & (F.col("t_ms") >= F.coalesce("_lock", begun) + timeout_ms))
    what = F.when(F.col("_lock").isNull(), "never acquired").otherwise("lost")
    gap = gap.select("session_id", "t_ms", "event_id", what.alias("what"))
    if not first_only:
        return gap
    return gap.groupBy("session_id").agg(F.min_by(F.struct("t_ms", "what"), F.struct("t_ms", "event_id")).alias(
        "g")).select("session_id", "g.t_ms", "g.what")


def resolve_failover(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """Words per (session_id, step): from the primary if it succeeded, else the fallback, else none."""
    key = ["session_id", "step"]
    p = primary.select(*key, F.col("ok").alias("_pok"), F.col("words").alias("_pw"))
    f = fallback.select(*key, F.col("ok").alias("_fok"), F.col("words").alias("_fw"))
    both = p.join(f, key, "full")
    pok, fok = F.coalesce("_pok", F.lit(False)), F.coalesce("_fok", F.lit(False))
    none = F.array().cast(primary.schema["words"].dataType)
    return both.select(*key, F.when(pok, F.col("_pw")).when(fok, F.col("_fw")).otherwise(none).alias("words"),
                       F.when(pok, "primary").when(fok, "fallback").otherwise("none").alias("backend"))
