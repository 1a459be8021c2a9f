"""Queries over frames, hypotheses, sounds, latency, telemetry and sessions."""

from pyspark.sql import functions as F

from cuelake.functions import values as V
from cuelake.operators import (agreement as G, cues as Q, frames as R, monitor as M, sessions as A, sounds as L,
                               sync as Y)
from cuelake.plans import views as v
from cuelake.plans.registry import query
from cuelake.plans.view_sql import tok, with_views

RMS = "sqrt(list_sum(list_transform(samples, lambda x: x * x)) / len(samples))"
ENERGY = f"v_energy AS (SELECT session_id, frame_no, start_ms, end_ms, {RMS} AS rms FROM v_frames)"
VAD = ENERGY + """, v_vad AS (
  SELECT *, max(CAST(rms >= 0.01 AS INT)) OVER (PARTITION BY session_id ORDER BY frame_no
     ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 1 AS is_speech FROM v_energy)"""
UTT = VAD + """, v_utt AS (
  SELECT *, (rn - min(rn) OVER (PARTITION BY session_id, utterance_id)) // 10 AS piece_no FROM (
    SELECT *, sum(CAST(is_speech AND NOT prev AS INT)) OVER (PARTITION BY session_id ORDER BY frame_no) AS utterance_id,
           row_number() OVER (PARTITION BY session_id ORDER BY frame_no) AS rn
    FROM (SELECT *, lag(is_speech, 1, false) OVER (PARTITION BY session_id ORDER BY frame_no) AS prev FROM v_vad))
  WHERE is_speech)"""
P95 = "list_sort(list({0}))[1 + least(CAST(floor(count(*) * 0.95) AS INT), count(*) - 1)]"
LAT = """v_sum AS (
  SELECT t.session_id, n, mean_ms, p95_ms, max_ms, n / span AS rate FROM (
    SELECT session_id, count(*) AS n, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS span FROM v_latency GROUP BY 1) t
  JOIN (SELECT session_id, avg(latency_ms) AS mean_ms, max(latency_ms) AS max_ms, """ + P95.format("latency_ms") + """ AS p95_ms
    FROM (SELECT * FROM v_latency QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, event_id DESC) <= 50)
    GROUP BY 1) s ON t.session_id = s.session_id)"""


def energy(spark, sf):
    return R.frame_energy(v.frames(spark, sf)).drop("samples")


def voiced(spark, sf):
    return R.vad(energy(spark, sf), 0.01, 2)


@query("frame_energy", with_views("v_frames", "SELECT session_id, frame_no, round(rms, 6) AS rms, "
       "round(20 * log10(greatest(rms, 1e-10)), 6) AS energy_db FROM v_energy", extra=ENERGY))
def frame_energy(spark, sf):
    return energy(spark, sf).select("session_id", "frame_no", F.round("rms", 6).alias("rms"),
                                    F.round("energy_db", 6).alias("energy_db"))


@query("vad", with_views("v_frames", "SELECT session_id, frame_no, is_speech FROM v_vad", extra=VAD))
def vad(spark, sf):
    return voiced(spark, sf).select("session_id", "frame_no", "is_speech")


@query("utterances", with_views("v_frames", """
SELECT session_id, CAST(utterance_id AS BIGINT) AS utterance_id, CAST(piece_no AS BIGINT) AS piece_no,
  min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS frames FROM v_utt GROUP BY 1, 2, 3""", extra=UTT))
def utterances(spark, sf):
    return R.utterance_spans(voiced(spark, sf), max_frames=10)


@query("silence_skip", with_views("v_frames", """
SELECT session_id, frame_no FROM (SELECT *, lag(is_speech, 1, false) OVER (PARTITION BY session_id ORDER BY frame_no) AS p
  FROM v_vad) WHERE is_speech OR p""", extra=VAD))
def silence_skip(spark, sf):
    return R.silence_skip(voiced(spark, sf)).select("session_id", "frame_no")


@query("sliding_windows", with_views("v_frames", """
SELECT session_id, w AS window_start_ms, count(*) AS frames, round(max(rms), 6) AS peak
FROM v_energy, unnest(range(start_ms // 500 * 500 - 1500, start_ms // 500 * 500 + 1, 500)) AS u(w)
GROUP BY 1, 2""", extra=ENERGY))
def sliding_windows(spark, sf):
    e = energy(spark, sf).withColumn("ts", F.timestamp_millis("start_ms"))
    w = R.sliding_windows(e, "ts", "2 seconds", "500 milliseconds")
    return w.groupBy("session_id", F.unix_millis("window.start").alias("window_start_ms")).agg(
        F.count("*").alias("frames"), F.round(F.max("rms"), 6).alias("peak"))


@query("absolute_words", with_views("v_words", """
SELECT session_id, utterance_id, pos, word, 1000 * utterance_id + 400 * pos AS start_ms,
  1000 * utterance_id + 400 * pos + 400 AS end_ms FROM v_words"""))
def absolute_words(spark, sf):
    h = v.hypotheses(spark, sf, last_only=True).withColumn(
        "buffer_len_ms", F.col("buffer_end_ms")).withColumn("buffer_end_ms", F.col("buffer_end_ms") + 1000 * F.col("utterance_id"))
    w = G.absolute_words(h).select("session_id", "utterance_id", F.posexplode("words").alias("pos", "w"))
    return w.select("session_id", "utterance_id", F.col("pos").cast("bigint").alias("pos"),
                    F.regexp_replace("w.text", "#\\d+~?$", "").alias("word"), "w.start_ms", "w.end_ms")


AGREED = f"""
SELECT session_id, utterance_id, i AS n, coalesce(k, last) AS step,
  w[i + 1] || '#' || i || CASE WHEN k IS NULL AND last % 2 = 1 AND i = len(w) - 1 THEN '~' ELSE '' END AS text,
  400 * i AS start_ms, 400 * i + 400 AS end_ms
FROM (SELECT *, (SELECT min(k) FROM unnest(range(2, last + 1)) AS u(k)
                 WHERE i < 3 * (k - 1) - (CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END)
                   AND 400 * i + 400 <= 400 * least(3 * k, len(w)) - {{delay}}) AS k
      FROM (SELECT *, unnest(range(len(w))) AS i FROM (
        SELECT conv_id AS session_id, turn AS utterance_id, {tok('text')} AS w,
               CAST(ceil(len({tok('text')}) / 3.0) AS INT) AS last FROM conversations) WHERE len(w) > 0))"""


@query("local_agreement", AGREED.format(delay=0))
def local_agreement(spark, sf):
    return G.local_agreement(v.hypotheses(spark, sf), 0).select(
        "session_id", "utterance_id", "n", "step", "text", "start_ms", "end_ms")


@query("local_agreement_delayed", AGREED.format(delay=2000))
def local_agreement_delayed(spark, sf):
    return G.local_agreement(v.hypotheses(spark, sf), 2000).select(
        "session_id", "utterance_id", "n", "step", "text", "start_ms", "end_ms")


@query("late_words", f"""
SELECT session_id, utterance_id, step, count(*) AS late FROM (
  SELECT *, unnest(range(least(3 * step, len(w)))) AS i FROM (
    SELECT *, unnest(range(2, last + 1)) AS step FROM (
      SELECT conv_id AS session_id, turn AS utterance_id, {tok('text')} AS w,
             CAST(ceil(len({tok('text')}) / 3.0) AS INT) AS last FROM conversations) WHERE len(w) > 0))
WHERE 400 * i <= 400 * (CASE WHEN step = 2 THEN 0
    ELSE 3 * (step - 2) - (CASE WHEN (step - 1) % 2 = 0 THEN 1 ELSE 0 END) END) - 100
GROUP BY 1, 2, 3""")
def late_words(spark, sf):
    return G.late_words(v.hypotheses(spark, sf), 0).groupBy("session_id", "utterance_id", "step").agg(
        F.count("*").alias("late"))


@query("resolve_failover", f"""
WITH p AS (SELECT conv_id, turn, turn % 3 <> 0 AS ok, {tok('text')} AS w FROM conversations WHERE turn % 5 <> 4),
f AS (SELECT conv_id, turn, turn % 2 = 0 AS ok, list_reverse({tok('text')}) AS w FROM conversations)
SELECT f.conv_id AS session_id, f.turn AS step,
  CASE WHEN p.ok THEN 'primary' WHEN f.ok THEN 'fallback' ELSE 'none' END AS backend,
  CASE WHEN p.ok THEN array_to_string(p.w, ' ') WHEN f.ok THEN array_to_string(f.w, ' ') ELSE '' END AS words
FROM f LEFT JOIN p ON f.conv_id = p.conv_id AND f.turn = p.turn""")
def resolve_failover(spark, sf):
    c = v.table(spark, sf, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("step"),
                                                   v.tokens(F.col("text")).alias("words"))
    p = c.filter("step % 5 <> 4").withColumn("ok", F.col("step") % 3 != 0)
    f = c.withColumn("words", F.reverse("words")).withColumn("ok", F.col("step") % 2 == 0)
    return A.resolve_failover(p, f).withColumn("words", F.array_join("words", " "))


CAP = """CASE label WHEN 'Clapping' THEN 'APPLAUSE' WHEN 'Applause' THEN 'APPLAUSE' WHEN 'Music' THEN 'MUSIC'
    WHEN 'Siren' THEN 'SIREN' END"""
SCORED = f"""v_scored AS (
  SELECT session_id, window_no, {CAP} AS caption, max(prob) AS prob, max(speech) AS speech FROM (
    SELECT *, coalesce(max(CASE WHEN label = 'Speech' THEN prob END) OVER (PARTITION BY session_id, window_no), 0) AS speech
    FROM v_sounds) WHERE {CAP} IS NOT NULL AND prob > 0 GROUP BY 1, 2, 3)"""


@query("map_sound_labels", with_views("v_sounds", f"SELECT session_id, window_no, label, {CAP} AS caption, "
       f"round(prob, 6) AS prob FROM v_sounds WHERE {CAP} IS NOT NULL"))
def map_sound_labels(spark, sf):
    return L.map_sound_labels(v.sounds(spark, sf)).withColumn("prob", F.round("prob", 6))


@query("caption_scores", with_views("v_sounds", "SELECT session_id, window_no, caption, round(prob, 6) AS prob "
                                    "FROM v_scored", extra=SCORED))
def caption_scores(spark, sf):
    return L.caption_scores(v.sounds(spark, sf)).withColumn("prob", F.round("prob", 6))


@query("speech_arbitration", with_views("v_sounds", """
SELECT session_id, window_no, caption, round(prob, 6) AS prob, round(speech, 6) AS speech,
  speech >= 0.5 AND caption NOT IN ('MUSIC', 'APPLAUSE', 'CHEERING', 'CROWD NOISE') AS gated FROM v_scored""", extra=SCORED))
def speech_arbitration(spark, sf):
    return L.speech_arbitration(v.sounds(spark, sf)).withColumn("prob", F.round("prob", 6)).withColumn(
        "speech", F.round("speech", 6))


@query("top_sounds", with_views("v_sounds", """
SELECT session_id, window_no, caption, round(prob, 6) AS prob FROM v_scored
QUALIFY row_number() OVER (PARTITION BY session_id, window_no ORDER BY prob DESC, caption DESC) = 1""", extra=SCORED))
def top_sounds(spark, sf):
    return L.top_sounds(L.caption_scores(v.sounds(spark, sf))).select(
        "session_id", "window_no", "caption", F.round("prob", 6).alias("prob"))


def _ready(x: str, gate: str = "false") -> str:
    return f"coalesce(p{x} >= 0.45, false) AND NOT a{x} AND coalesce(t - f{x} >= 8, true) AND NOT {gate}"


def _next(x: str, name: str) -> str:
    return (f"CASE WHEN win = '{name}' THEN true WHEN p{x} < 0.25 AND c{x} + 1 >= 2 THEN false ELSE a{x} END AS a{x}, "
            f"CASE WHEN p{x} >= 0.45 THEN 0 WHEN p{x} < 0.25 THEN c{x} + 1 ELSE c{x} END AS c{x}, "
            f"CASE WHEN win = '{name}' THEN t ELSE f{x} END AS f{x}")


# The hysteresis of the three captions of the view, window by window, all sessions side by side.
FIRED = SCORED + f""", v_win AS (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY t) AS i FROM (
    SELECT session_id, window_no AS t, max(CASE WHEN caption = 'APPLAUSE' THEN prob END) AS pa,
      max(CASE WHEN caption = 'MUSIC' THEN prob END) AS pm, max(CASE WHEN caption = 'SIREN' THEN prob END) AS ps,
      max(speech) >= 0.5 AS gate FROM v_scored GROUP BY 1, 2)),
v_state AS (
  SELECT session_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS t, CAST(NULL AS VARCHAR) AS win, CAST(NULL AS DOUBLE) AS prob,
    false AS aa, 0 AS ca, CAST(NULL AS BIGINT) AS fa, false AS am, 0 AS cm, CAST(NULL AS BIGINT) AS fm,
    false AS "as", 0 AS cs, CAST(NULL AS BIGINT) AS fs FROM v_win WHERE i = 1
  UNION ALL
  SELECT session_id, i, t, win, CASE win WHEN 'SIREN' THEN ps WHEN 'MUSIC' THEN pm WHEN 'APPLAUSE' THEN pa END,
    {_next('a', 'APPLAUSE')}, {_next('m', 'MUSIC')}, {_next('s', 'SIREN')}
  FROM (SELECT *, CASE WHEN rs AND (NOT rm OR ps >= pm) AND (NOT ra OR ps >= pa) THEN 'SIREN'
        WHEN rm AND (NOT ra OR pm >= pa) THEN 'MUSIC' WHEN ra THEN 'APPLAUSE' END AS win
    FROM (SELECT *, {_ready('a')} AS ra, {_ready('m')} AS rm, {_ready('s', 'gate')} AS rs
      FROM (SELECT w.*, aa, ca, fa, am, cm, fm, "as", cs, fs FROM v_state s
        JOIN v_win w ON w.session_id = s.session_id AND w.i = s.i + 1))))"""
FIRED = FIRED.replace("NOT as ", 'NOT "as" ').replace("ELSE as END AS as", 'ELSE "as" END AS "as"')


@query("sound_events", with_views("v_sounds", """
SELECT session_id, greatest(t * 1000 - 2000, 0) AS start_ms, t * 1000 AS end_ms, '[' || win || ']' AS text, round(prob, 6) AS prob
FROM v_state WHERE win IS NOT NULL""", recursive=True, extra=FIRED))
def sound_events(spark, sf):
    return L.sound_events(v.sounds(spark, sf)).withColumn("prob", F.round("prob", 6))


LABELS = ", ".join("('{}')".format(n.replace("'", "''")) for n in [*V.SOUND_CAPTIONS, *V.SPEECH_LABELS])


@query("label_coverage", with_views("v_sounds", f"""
SELECT label FROM (VALUES {LABELS}) t(label) WHERE label NOT IN (SELECT label FROM v_sounds)"""))
def label_coverage(spark, sf):
    """All mapped labels that the scored windows never name."""
    return L.label_coverage(v.sounds(spark, sf).select("label").distinct()).select("label")


@query("latency_summary", with_views("v_latency", "SELECT session_id, n, round(mean_ms, 6) AS mean_ms, p95_ms, max_ms, "
                                     "round(rate, 9) AS rate FROM v_sum", extra=LAT))
def latency_summary(spark, sf):
    return M.latency_summary(v.latency(spark, sf)).withColumn("mean_ms", F.round("mean_ms", 6)).withColumn(
        "rate", F.round("rate", 9))


@query("fleet_metrics", with_views("v_latency", """
SELECT round_even(avg(mean_ms), 1) AS mean_ms, round_even(sum(mean_ms * n) / sum(n), 1) AS weighted_mean_ms,
  round_even(max(p95_ms), 1) AS p95_ms, round_even(max(max_ms), 1) AS max_ms, round_even(sum(rate), 3) AS rate,
  CAST(sum(n) AS BIGINT) AS total FROM v_sum""", extra=LAT))
def fleet_metrics(spark, sf):
    return M.fleet_metrics(M.latency_summary(v.latency(spark, sf)))


@query("latency_breaches", with_views("v_latency", "SELECT session_id, event_id, latency_ms FROM v_latency "
                                      "WHERE latency_ms > 100"))
def latency_breaches(spark, sf):
    return M.latency_breaches(v.latency(spark, sf), 100).select("session_id", "event_id", "latency_ms")


@query("rolling_latency", with_views("v_latency", f"""
SELECT session_id, event_id, round(avg(latency_ms) OVER w, 8) AS mean_ms, max(latency_ms) OVER w AS max_ms,
  list_sort(list(latency_ms) OVER w)[1 + least(CAST(floor((count(*) OVER w) * 0.95) AS INT), (count(*) OVER w) - 1)] AS p95_ms
FROM v_latency WINDOW w AS (PARTITION BY session_id ORDER BY ts, event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)"""))
def rolling_latency(spark, sf):
    return M.rolling_latency(v.latency(spark, sf)).select(
        "session_id", "event_id", F.round("mean_ms", 8).alias("mean_ms"), "max_ms", "p95_ms")


@query("rolling_gpu", with_views("v_gpu", """
SELECT gpu, event_id, util, last_value(a IGNORE NULLS) OVER (PARTITION BY gpu ORDER BY ts, event_id) / 10.0 AS util_avg
FROM (SELECT g.*, k.a FROM v_gpu g LEFT JOIN (
  SELECT event_id, s // (10 * n) + CASE WHEN 2 * (s % (10 * n)) > 10 * n THEN 1
      WHEN 2 * (s % (10 * n)) = 10 * n THEN s // (10 * n) % 2 ELSE 0 END AS a
  FROM (SELECT event_id, CAST(sum(CAST(round(util * 100) AS BIGINT)) OVER w AS BIGINT) AS s, count(*) OVER w AS n
    FROM v_gpu WHERE util IS NOT NULL
    WINDOW w AS (PARTITION BY gpu ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))) k ON g.event_id = k.event_id)"""))
def rolling_gpu(spark, sf):
    return M.rolling_gpu(v.gpu(spark, sf), "util").select("gpu", "event_id", "util", "util_avg")


@query("rolling_power", """
WITH p AS (SELECT user_id % 4 AS gpu, ts, event_id, CASE WHEN event_type <> 'error' THEN value END AS power_w,
  CASE WHEN event_id % 5 <> 0 THEN 250.0 END AS power_limit_w FROM events)
SELECT gpu, event_id, power_w_avg, round_even(100 * power_w_avg / power_limit_w, 1) AS power_pct_avg FROM (
  SELECT gpu, event_id, power_limit_w, last_value(a IGNORE NULLS) OVER (PARTITION BY gpu ORDER BY ts, event_id) / 10.0 AS power_w_avg
  FROM (SELECT g.*, k.a FROM p g LEFT JOIN (
    SELECT event_id, s // (10 * n) + CASE WHEN 2 * (s % (10 * n)) > 10 * n THEN 1
        WHEN 2 * (s % (10 * n)) = 10 * n THEN s // (10 * n) % 2 ELSE 0 END AS a
    FROM (SELECT event_id, CAST(sum(CAST(round(power_w * 100) AS BIGINT)) OVER w AS BIGINT) AS s, count(*) OVER w AS n
      FROM p WHERE power_w IS NOT NULL
      WINDOW w AS (PARTITION BY gpu ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))) k ON g.event_id = k.event_id))""")
def rolling_power(spark, sf):
    k = F.col("event_id")
    s = v.events(spark, sf).select((F.col("user_id") % 4).alias("gpu"), "ts", "event_id", F.when(F.col("event_type") != "error", F.col("value"))
                                   .alias("power_w"), F.when(k % 5 != 0, F.lit(250.0)).alias("power_limit_w"))
    return M.rolling_power(s).select("gpu", "event_id", "power_w_avg", "power_pct_avg")


@query("gpu_percentages", """
SELECT event_id, round_even(100 * m / nullif(t, 0), 1) AS mem_pct, round_even(100 * p / nullif(l, 0), 1) AS power_pct
FROM (SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN value END AS m, CAST(event_id % 4 * 100 AS DOUBLE) AS t, value / 3 AS p,
  CASE WHEN event_id % 5 <> 0 THEN 250.0 END AS l FROM events)""")
def gpu_percentages(spark, sf):
    k = F.col("event_id")
    s = v.events(spark, sf).select(
        "event_id", F.when(k % 9 != 0, F.col("value")).alias("mem_used_mb"), (k % 4 * 100).cast("double").alias("mem_total_mb"),
        (F.col("value") / 3).alias("power_w"), F.when(k % 5 != 0, F.lit(250.0)).alias("power_limit_w"))
    return M.gpu_percentages(s).select("event_id", "mem_pct", "power_pct")


@query("load_level", with_views("v_gpu", """
SELECT event_id, CASE WHEN util >= 85 THEN 'red' WHEN util >= 65 THEN 'amber' ELSE 'green' END AS load,
  CASE WHEN util >= 80 THEN 'red' WHEN util >= 70 THEN 'amber' ELSE 'green' END AS heat,
  round(least(greatest((util - 30) / 0.6, 0), 100), 6) AS gauge FROM v_gpu WHERE util IS NOT NULL"""))
def load_level(spark, sf):
    u = F.col("util")
    return v.gpu(spark, sf).filter("util IS NOT NULL").select(
        "event_id", M.load_level(u).alias("load"), M.temperature_level(u).alias("heat"),
        F.round(M.temperature_gauge(u), 6).alias("gauge"))


@query("check_video_spec", """
SELECT event_id, ok, CASE WHEN NOT ok THEN 'Source has ' || coalesce(w, 0) || 'x' || coalesce(h, 0)
  || CASE WHEN coalesce(f, 0) > 0 THEN '@' || CAST(round_even(f, 0) AS INT) || 'fps' ELSE '' END
  || ', over 1920x1080@60' END AS reason
FROM (SELECT *, NOT (coalesce(w > 1920, false) OR coalesce(h > 1080, false) OR coalesce(f > 60.5, false)) AS ok FROM (
  SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN 1280 + event_id % 5 * 320 END AS w, 720 + event_id % 3 * 360 AS h,
    CASE WHEN event_id % 11 <> 0 THEN 24.0 + event_id % 4 * 12.5 END AS f FROM events))""")
def check_video_spec(spark, sf):
    k = F.col("event_id")
    i = v.events(spark, sf).select(
        "event_id", F.when(k % 7 != 0, 1280 + k % 5 * 320).alias("width"), (720 + k % 3 * 360).alias("height"),
        F.when(k % 11 != 0, 24.0 + k % 4 * 12.5).alias("fps"))
    return M.check_video_spec(i).select("event_id", "ok", "reason")


@query("tail_rows", with_views("v_log", "SELECT seq, line FROM v_log ORDER BY seq DESC LIMIT 500"))
def tail_rows(spark, sf):
    return M.tail_rows(v.log_lines(spark, sf), 500)


@query("classify_source", with_views("v_urls", r"""
SELECT page_id, video_id, CASE WHEN dest <> '' THEN 'relay' WHEN lower(url) LIKE 'sdi://%' THEN 'sdi'
    WHEN video_id <> '' THEN 'youtube' ELSE 'stream' END AS source_type,
  CASE WHEN lower(url) LIKE 'rtmp://%' THEN 'rtmp' ELSE '' END AS scheme
FROM (SELECT *, CASE WHEN url LIKE 'https://youtu.be/%' THEN regexp_extract(url, 'youtu.be/(.*)$', 1)
    WHEN url LIKE 'https://www.youtube.com%' THEN url_decode(regexp_extract(url, '[?&]v=([^&]*)', 1)) ELSE '' END AS video_id FROM v_urls)"""))
def classify_source(spark, sf):
    return A.classify_source(v.urls(spark, sf)).select("page_id", "video_id", "source_type", "scheme")


ROLL = """v_roll AS (SELECT s.session_id, status, url, coalesce(n, 0) AS cue_count, last_cue, up AS uptime_ms FROM v_sessions s
  LEFT JOIN (SELECT session_id, count(*) AS n, max_by(text, cue_no) AS last_cue, max(end_ms) AS up FROM v_cues GROUP BY 1) c
  ON s.session_id = c.session_id)"""


@query("session_rollup", with_views("v_cues v_sessions", "SELECT * FROM v_roll", extra=ROLL))
def session_rollup(spark, sf):
    return A.session_rollup(v.sessions(spark, sf), v.cues(spark, sf)).select(
        "session_id", "status", "url", "cue_count", "last_cue", "uptime_ms")


@query("service_totals", with_views("v_cues v_sessions", """
SELECT count(*) AS session_count, CAST(sum(cue_count) AS BIGINT) AS total_cues, count(*) FILTER (status = 'live') AS live,
  count(*) FILTER (status = 'starting') AS starting, count(*) FILTER (status = 'ended') AS ended,
  count(*) FILTER (status = 'error') AS error FROM v_roll""", extra=ROLL))
def service_totals(spark, sf):
    return A.service_totals(A.session_rollup(v.sessions(spark, sf), v.cues(spark, sf)))


@query("device_inventory", with_views("v_devices", """
SELECT host, idx, persistent_id, label, CASE WHEN idx % 4 = 0 THEN 'hdmi' ELSE 'sdi' END AS connection, in_vsrc OR in_asrc AS can_input, in_vsink AS can_output FROM v_devices
WHERE in_vsrc OR in_asrc OR in_vsink"""))
def device_inventory(spark, sf):
    return A.device_inventory(*v.devices(spark, sf))


@query("device_owner", with_views("v_devices v_sessions", """
SELECT d.host, d.idx, d.can_input, o.session_id, CASE WHEN d.can_input AND o.session_id IS NOT NULL THEN true END AS signal_locked
FROM (SELECT host, idx, in_vsrc OR in_asrc AS can_input FROM v_devices WHERE in_vsrc OR in_asrc OR in_vsink) d
LEFT JOIN (SELECT host, CAST(regexp_extract(url, '//([0-9]+)$', 1) AS BIGINT) AS idx, max_by(session_id, started_ms) AS session_id
  FROM v_sessions WHERE source_type = 'sdi' AND status IN ('starting', 'live') GROUP BY 1, 2) o
ON d.host = o.host AND d.idx = o.idx"""))
def device_owner(spark, sf):
    return A.device_owner(A.device_inventory(*v.devices(spark, sf)), v.sessions(spark, sf)).select(
        "host", "idx", "can_input", "session_id", "signal_locked")


@query("archive_not_live", with_views("v_archive v_live", "SELECT id, seq, created_at FROM v_archive "
                                      "WHERE id NOT IN (SELECT id FROM v_live)"))
def archive_not_live(spark, sf):
    return A.archive_not_live(v.archive(spark, sf).select("id", "seq", "created_at"), v.live_ids(spark, sf))


@query("upsert_index", with_views("v_archive", """
SELECT id, max_by(seq, (created_at, seq)) AS seq, max(created_at) AS created_at,
  max_by(status, (created_at, seq)) AS status FROM v_archive GROUP BY id"""))
def upsert_index(spark, sf):
    a = v.archive(spark, sf)
    return A.upsert_index(a.filter("seq % 2 = 0"), a.filter("seq % 2 = 1"))


@query("session_diff", with_views("v_sessions", """
SELECT coalesce(b.session_id, a.session_id) AS session_id, was, now,
  CASE WHEN was IS NULL THEN 'added' WHEN now IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM (SELECT session_id, status AS was FROM v_sessions WHERE session_id % 5 <> 0) b
FULL JOIN (SELECT session_id, CASE WHEN session_id % 6 = 1 THEN 'ended' ELSE status END AS now FROM v_sessions
  WHERE session_id % 7 <> 0) a ON a.session_id = b.session_id WHERE was IS DISTINCT FROM now"""))
def session_diff(spark, sf):
    s = v.sessions(spark, sf).select("session_id", "status")
    after = s.filter("session_id % 7 <> 0").withColumn(
        "status", F.when(F.col("session_id") % 6 == 1, "ended").otherwise(F.col("status")))
    return A.session_diff(s.filter("session_id % 5 <> 0"), after)


def lifecycle_events(spark, sf):
    t = F.col("event_type")
    kind = F.when(t.isin("click", "signup"), "started").when(t == "view", "live").otherwise("end")
    reason = F.when(t == "purchase", F.when(F.col("event_id") % 2 == 0, "eos").otherwise("stop")).when(
        t == "error", F.when(F.col("event_id") % 2 == 0, "error").otherwise("too large"))
    return v.events(spark, sf).select((F.col("event_id") % 997).alias("session_id"), F.col("event_id").alias("seq"),
                                      kind.alias("kind"), reason.alias("reason"), "ts")


@query("session_lifecycle", """
SELECT session_id, CASE WHEN r IN ('eos', 'stop') THEN 'ended' WHEN r IS NOT NULL THEN 'error' WHEN live THEN 'live'
    ELSE 'starting' END AS status,
  CASE WHEN r NOT IN ('eos', 'stop') THEN CASE WHEN r = 'error' THEN 'stream error' ELSE r END END AS error, ended_seq
FROM (SELECT session_id, min_by(reason, event_id) FILTER (reason IS NOT NULL) AS r, bool_or(event_type = 'view') AS live,
        min(event_id) FILTER (reason IS NOT NULL) AS ended_seq
  FROM (SELECT *, event_id % 997 AS session_id, CASE WHEN event_type = 'purchase' THEN CASE WHEN event_id % 2 = 0 THEN 'eos' ELSE 'stop' END
    WHEN event_type = 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'error' ELSE 'too large' END END AS reason FROM events)
  GROUP BY 1)""")
def session_lifecycle(spark, sf):
    return A.session_lifecycle(lifecycle_events(spark, sf))


GAPS = """
SELECT session_id, epoch_us(ts) // 1000 AS t_ms, CASE WHEN lk IS NULL THEN 'never acquired' ELSE 'lost' END AS what FROM (
  SELECT *, max(CASE WHEN locked THEN epoch_us(ts) // 1000 END) OVER w AS lk, min(epoch_us(ts) // 1000) OVER w AS begun FROM v_polls
  WINDOW w AS (PARTITION BY session_id ORDER BY ts, event_id))
WHERE NOT locked AND epoch_us(ts) // 1000 >= coalesce(lk, begun) + 21600000
QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) = 1"""


@query("signal_gaps", with_views("v_polls", GAPS))
def signal_gaps(spark, sf):
    return A.signal_gaps(v.polls(spark, sf), 21_600_000)


# --- alignment ---

TICKS = """v_ticks AS (SELECT session_id, unnest(range(0, m + 9000, 2300)) AS t_ms FROM (
  SELECT session_id, max(end_ms) AS m FROM v_cues GROUP BY 1))"""


def ticks(spark, sf, cues=None, step: int = 2300, at_once: int = 4096):
    """Playhead times every ``step`` ms until nine seconds after the last cue, made range by range."""
    end, span = F.col("m") + 8999, step * at_once
    m = (cues if cues is not None else v.cues(spark, sf)).groupBy("session_id").agg(F.max("end_ms").alias("m"))
    ranges = m.select("session_id", "m", F.explode(F.expr(f"sequence(0L, (m + 8999) div {span})")).alias("r"))
    upto = F.least(end, (F.col("r") + 1) * span - 1)
    return ranges.select("session_id", F.explode(F.sequence(F.col("r") * span, upto, F.lit(step).cast("bigint"))).alias("t_ms"))


@query("replay_tail", with_views("v_cues", f"""
SELECT session_id, t_ms, coalesce(array_to_string(string_split(({{wrap}}), chr(10))[-2:], '|'), '') AS lines FROM (
  SELECT t.session_id, t.t_ms, string_agg(x, ' ' ORDER BY cue_no) AS txt FROM v_ticks t LEFT JOIN (
    SELECT n.session_id, n.cue_no AS upto, n.start_ms, p.cue_no, p.text AS x,
      coalesce(sum(length(p.text) + 1) OVER (PARTITION BY n.session_id, n.cue_no ORDER BY p.cue_no DESC
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - 1 AS joined
    FROM v_cues n JOIN v_cues p ON n.session_id = p.session_id AND p.cue_no <= n.cue_no) c
  ON c.session_id = t.session_id AND c.joined <= 80
    AND c.upto = (SELECT max(cue_no) FROM v_cues q WHERE q.session_id = t.session_id AND q.start_ms <= t.t_ms)
  GROUP BY 1, 2)""".replace("{wrap}", """list_reduce(list_filter(regexp_split_to_array(txt, '\\s+'), lambda w: w <> ''),
    lambda acc, x: CASE WHEN acc = '' THEN x
    WHEN length(regexp_extract(acc, '[^\\n]*$')) + 1 + length(x) <= 32 THEN acc || ' ' || x ELSE acc || chr(10) || x END, '')"""),
    extra=TICKS))
def replay_tail(spark, sf):
    return Y.replay_tail(ticks(spark, sf), v.cues(spark, sf)).select("session_id", "t_ms", F.array_join("lines", "|").alias("lines"))


@query("caption_lag", with_views("v_cues", """
SELECT session_id, clock_ms, (session_id % 3 * 2000 + clock_ms) - clock_ms AS lag_ms, round(in_budget, 6) AS in_budget, median_ms, p95_ms, worst_ms,
  clock_ms >= 20000 AS ready, CAST(least(99, floor(100 * clock_ms / 20000)) AS INT) AS percent
FROM (SELECT session_id, max_by(end_ms, cue_no) AS clock_ms, avg(CASE WHEN w <= 5000 THEN 1.0 ELSE 0.0 END) AS in_budget,
  quantile_disc(w, 0.5) AS median_ms, quantile_disc(w, 0.95) AS p95_ms, max(w) AS worst_ms FROM (SELECT *, 4000 + cue_no * 700 % 2100 AS w FROM v_cues) GROUP BY 1)"""))
def caption_lag(spark, sf):
    c = v.cues(spark, sf).withColumn("committed_ms", F.col("end_ms") + 4000 + F.col("cue_no") * 700 % 2100)
    live = c.groupBy("session_id").agg(F.max("end_ms").alias("audio_ms")).withColumn(
        "audio_ms", F.col("session_id") % 3 * 2000 + F.col("audio_ms"))
    return Y.caption_lag(c, live).withColumn("in_budget", F.round("in_budget", 6))


SYNC = """v_sync AS (SELECT session_id, started_ms + 90000 AS live_edge_ms, started_ms + 70000 AS server_now_ms,
  CASE WHEN session_id % 4 <> 0 THEN started_ms END AS join_epoch_ms, 60000 AS stream_clock_ms, session_id % 5 * 500 AS nudge_ms
  FROM v_sessions)"""


@query("align_clock", with_views("v_cues v_sessions", """
SELECT s.session_id, t_ms AS video_ms, t_ms - (live_edge_ms - coalesce(server_now_ms - join_epoch_ms, stream_clock_ms)) + nudge_ms AS t_ms
FROM v_ticks t JOIN v_sync s ON t.session_id = s.session_id""", extra=TICKS + ", " + SYNC))
def align_clock(spark, sf):
    k = F.col("session_id")
    s = v.sessions(spark, sf).select(
        "session_id", (F.col("started_ms") + 90000).alias("live_edge_ms"), (F.col("started_ms") + 70000).alias("server_now_ms"),
        F.when(k % 4 != 0, F.col("started_ms")).alias("join_epoch_ms"), F.lit(60000).alias("stream_clock_ms"),
        (k % 5 * 500).alias("nudge_ms"))
    return Y.align_clock(ticks(spark, sf).withColumnRenamed("t_ms", "video_ms"), s)
