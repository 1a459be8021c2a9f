"""Streaming twins, fed with the views as files in time order and drained; their SQL is that of the batch form."""

from datetime import datetime

from pyspark.sql import functions as F

from cuelake.functions import text as T
from cuelake.operators import agreement as A, cues as Q, frames as R, monitor as M, sounds as L
from cuelake.plans import packet_queries as K, signal_queries as G, views as v
from cuelake.plans.registry import ORACLE, query
from cuelake.plans.view_sql import with_views
from cuelake.streaming import jobs as J, processors as X


@query("local_agreement_stream", ORACLE["local_agreement"])
def local_agreement_stream(spark, sf):
    h = J.replay_built(v.hypotheses(spark, sf), ["session_id", "utterance_id"], "step", F.size("words"))
    return J.drain(X.local_agreement_stream(h, 0)).select(
        "session_id", "utterance_id", "n", "step", "text", "start_ms", "end_ms")


@query("late_words_stream", ORACLE["late_words"])
def late_words_stream(spark, sf):
    h = J.replay_built(v.hypotheses(spark, sf), ["session_id", "utterance_id"], "step", F.size("words"))
    return J.drain(X.late_words_stream(h, 0)).groupBy("session_id", "utterance_id", "step").agg(F.count("*").alias("late"))


@query("sound_events_stream", with_views("v_sounds", """
SELECT session_id, t AS window_no, t * 1000 AS time_ms, win AS caption, round(prob, 6) AS prob FROM v_state WHERE win IS NOT NULL""",
                                         recursive=True, extra=G.FIRED))
def sound_events_stream(spark, sf):
    w = J.replay(L.window_table(v.sounds(spark, sf)), ["session_id"], "window_no")
    return J.drain(X.sound_events_stream(w)).withColumn("prob", F.round("prob", 6))


#: The closing heartbeat of a replayed feed: a session of its own, far later than all others.
HEARTBEAT = {"session_id": -1, "ts": datetime(2100, 1, 1), "event_id": 1 << 60}


def others(df):
    return df.filter("session_id <> -1")


@query("paginate_stream", with_views("v_session_fragments", "SELECT session_id, start_ms, end_ms, length(text) AS chars FROM v_pages",
                                     recursive=True, extra=K.PAGES))
def paginate_stream(spark, sf):
    """All blocks, the last ones of each session too: the heartbeat moves the watermark past their pause."""
    f = v.session_fragments(spark, sf).withColumn("ts", F.timestamp_millis("end_ms"))
    closing = HEARTBEAT | {"frag_no": 0, "text": ".", "start_ms": 0, "end_ms": 0}
    s = J.replay(f, ["session_id"], "end_ms", closing=closing).withWatermark("ts", "1 day")
    return others(J.drain(X.paginate_stream(s))).select("session_id", "start_ms", "end_ms", "chars")


@query("rollup_encode_stream", with_views("v_session_fragments", """
SELECT session_id, frag_no, row_number() OVER (PARTITION BY session_id, frag_no ORDER BY pair_no) - 1 AS k, b1, b2 FROM v_rp""",
                                          recursive=True, extra=K.RPAIRS))
def rollup_encode_stream(spark, sf):
    f = J.replay(v.session_fragments(spark, sf), ["session_id"], "frag_no")
    return J.drain(X.rollup_encode_stream(f))


@query("lifecycle_stream", ORACLE["session_lifecycle"])
def lifecycle_stream(spark, sf):
    """Last status per session of the change stream."""
    e = J.replay(G.lifecycle_events(spark, sf), ["session_id"], "seq")
    c = J.drain(X.lifecycle_stream(e))
    last = c.groupBy("session_id").agg(F.max_by(F.struct("status", "error", "seq"), "seq").alias("r"))
    ended = F.when(F.col("r.status").isin("ended", "error"), F.col("r.seq"))
    return last.select("session_id", "r.status", "r.error", ended.alias("ended_seq"))


@query("signal_watchdog_stream", with_views("v_polls", """
SELECT session_id, d AS t_ms, CASE WHEN seen THEN 'lost' ELSE 'never acquired' END AS what FROM (
  SELECT session_id, ts, event_id, coalesce(max(CASE WHEN locked THEN t END) OVER w, min(t) OVER w) + 21600000 AS d,
    bool_or(locked) OVER w AS seen, lead(t) OVER w AS next_t, lead(locked) OVER w AS next_locked
  FROM (SELECT *, epoch_us(ts) // 1000 AS t FROM v_polls) WINDOW w AS (PARTITION BY session_id ORDER BY ts, event_id))
WHERE next_t IS NULL OR next_t > d OR next_t = d AND NOT next_locked
QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) = 1"""))
def signal_watchdog_stream(spark, sf):
    """With the silence timer: a session whose polls stop is reported at its deadline."""
    p = v.polls(spark, sf).withColumn("t_us", F.unix_micros("ts"))  # ids need not be in the order of time
    s = J.replay(p, ["session_id"], "t_us", closing=HEARTBEAT | {"locked": True}).withWatermark("ts", "2 days")
    return others(J.drain(X.signal_watchdog_stream(s, 21_600_000, 21_600_000, 3650 * X.DAY_MS)))


REPORTS = """v_reports AS (SELECT session_id, (w + 1) * 30000 AS window_end_ms, n, mean_ms,
    x[CAST(least(floor(len(x) * 0.95), len(x) - 1) AS INT) + 1] AS p95_ms, max_ms, CASE WHEN span > 0 THEN n / span ELSE 0 END AS rate
  FROM (SELECT session_id, ts, event_id, epoch_us(ts) // 30000000 AS w, row_number() OVER o AS n, avg(latency_ms) OVER r AS mean_ms,
      list_sort(list(latency_ms) OVER r) AS x, max(latency_ms) OVER r AS max_ms, (epoch_us(ts) - min(epoch_us(ts)) OVER o) / 1e6 AS span
    FROM v_latency WINDOW o AS (PARTITION BY session_id ORDER BY ts, event_id), r AS (PARTITION BY session_id ORDER BY ts, event_id ROWS 49 PRECEDING))
  QUALIFY row_number() OVER (PARTITION BY session_id, w ORDER BY ts DESC, event_id DESC) = 1)"""
ROUNDED = "round(mean_ms, 8) AS mean_ms, p95_ms, max_ms, round(rate, 9) AS rate"


def rounded(df):
    return df.withColumns({"mean_ms": F.round("mean_ms", 8), "rate": F.round("rate", 9)})


@query("latency_windows", with_views("v_latency", f"SELECT session_id, window_end_ms, n, {ROUNDED} FROM v_reports", extra=REPORTS))
def latency_windows(spark, sf):
    return rounded(M.latency_windows(v.latency(spark, sf)))


@query("streaming_latency", with_views("v_latency", f"""
SELECT session_id, window_end_ms, n, {ROUNDED} FROM v_reports UNION ALL
SELECT NULL, window_end_ms, count(*), round(avg(mean_ms), 8), max(p95_ms), max(max_ms), round(sum(rate), 9) FROM v_reports GROUP BY 2""",
                                       extra=REPORTS))
def streaming_latency(spark, sf):
    """Reports every 30 s per session, and of the fleet (no session)."""
    s = J.replay(v.latency(spark, sf), ["session_id"], "event_id", closing=HEARTBEAT | {"latency_ms": 0.0}).withWatermark("ts", "2 days")
    reports = others(J.drain(X.latency_stream(s, idle_ms=365 * X.DAY_MS)))
    fleet = M.fleet_windows(reports).withColumnRenamed("sessions", "n")
    return rounded(reports.unionByName(fleet, allowMissingColumns=True))


@query("windowed_latency", with_views("v_latency", """
SELECT session_id, epoch_us(ts) // 86400000000 AS day, count(*) AS n, round(sum(latency_ms), 4) AS total_ms, max(latency_ms) AS max_ms
FROM v_latency GROUP BY 1, 2"""))
def windowed_latency(spark, sf):
    """Daily windows with a watermark, update mode, newest row per window."""
    s = J.replay(v.latency(spark, sf), ["session_id"], "event_id").withWatermark("ts", "2 days")
    w = M.windowed_latency(s, "1 day")
    u = J.drain_updates(w, ["session_id", "w"])
    return u.select("session_id", F.expr("unix_seconds(w.start) div 86400").alias("day"), "n",
                    F.round("total_ms", 4).alias("total_ms"), "max_ms")


@query("vad_stream", with_views("v_frames", """
SELECT session_id, frame_no, is_speech, CASE WHEN is_speech THEN CAST(u AS BIGINT) END AS utterance_id FROM (
  SELECT *, sum(CAST(is_speech AND NOT prev AS INT)) OVER (PARTITION BY session_id ORDER BY frame_no) AS u
  FROM (SELECT *, lag(is_speech, 1, false) OVER (PARTITION BY session_id ORDER BY frame_no) AS prev FROM v_vad))""", extra=G.VAD))
def vad_stream(spark, sf):
    e = R.frame_energy(v.frames(spark, sf)).drop("samples")
    return J.drain(X.vad_stream(J.replay(e, ["session_id"], "frame_no"), 0.01, 2))


@query("sliding_windows_stream", ORACLE["sliding_windows"])
def sliding_windows_stream(spark, sf):
    e = R.frame_energy(v.frames(spark, sf)).drop("samples").withColumn("ts", F.timestamp_millis("start_ms"))
    s = J.replay(e, ["session_id"], "frame_no").withWatermark("ts", "10 seconds")
    w = R.sliding_windows(s, "ts", "2 seconds", "500 milliseconds").groupBy("session_id", "window").agg(
        F.count("*").alias("frames"), F.max("rms").alias("peak"))
    u = J.drain_updates(w, ["session_id", "window"])
    return u.select("session_id", F.unix_millis("window.start").alias("window_start_ms"), "frames", F.round("peak", 6).alias("peak"))


@query("live_captions", ORACLE["local_agreement"].replace(
    "SELECT session_id, utterance_id, i AS n, coalesce(k, last) AS step,",
    "SELECT session_id, utterance_id, count(*) AS words, count(DISTINCT step) AS fragments FROM (SELECT session_id, utterance_id, "
    "coalesce(k, last) AS step,", 1) + ") GROUP BY 1, 2")
def live_captions(spark, sf):
    """Chain of the live path: stable words by stream, then fragments and their clean text."""
    h = J.replay_built(v.hypotheses(spark, sf), ["session_id", "utterance_id"], "step", F.size("words"))
    with J.short_shuffles(spark):  # fragments are staged between scans
        frags = Q.dedupe_boundary(A.committed_fragments(J.drain(X.local_agreement_stream(h, 0))))
    shown = Q.drop_empty_captions(Q.wrap_caption(frags))
    return shown.groupBy("session_id", "utterance_id").agg(
        F.sum(F.size(T.space_words(F.col("raw")))).alias("words"), F.count("*").alias("fragments"))
