"""Queries over caption text and cues."""

from pyspark.sql import functions as F

from cuelake.functions import clock, text as T
from cuelake.functions.values import SILENCE_PHRASES
from cuelake.operators import cues as Q, scan
from cuelake.plans import live, views as v
from cuelake.plans.registry import query
from cuelake.plans.view_sql import tok, with_views

W = r"[\p{L}\p{N}_]"
SQL_WRAP = """list_reduce({0}, lambda acc, x: CASE WHEN acc = '' THEN x
    WHEN length(regexp_extract(acc, '[^\\n]*$')) + 1 + length(x) <= 32 THEN acc || ' ' || x
    ELSE acc || chr(10) || x END, '')"""
LINES = f"""v_lines AS (
  SELECT session_id, cue_no, speaker, start_ms, end_ms, array_to_string(t, ' ') AS raw,
         string_split({SQL_WRAP.format('t')}, chr(10))[-2:] AS lines
  FROM (SELECT *, {tok('text')} AS t FROM v_cues) WHERE len(t) > 0)"""
TIME = ("printf('%02d:%02d:%02d.%03d', {0} // 3600000, ({0} // 60000) % 60, ({0} // 1000) % 60, {0} % 1000)")


def lined(spark, sf):
    return Q.drop_empty_captions(Q.wrap_caption(v.cues(spark, sf)))


@query("normalize_text", f"SELECT doc_id, array_to_string({tok('text')}, ' ') AS text FROM documents")
def normalize_text(spark, sf):
    return Q.normalize_text(v.table(spark, sf, "documents").select("doc_id", "text"))


@query("wrap_caption", with_views("v_cues", "SELECT session_id, cue_no, raw, array_to_string(lines, '|') AS lines "
                                  "FROM v_lines", extra=LINES))
def wrap_caption(spark, sf):
    return lined(spark, sf).select("session_id", "cue_no", "raw", F.array_join("lines", "|").alias("lines"))


@query("wrap_lines", f"SELECT doc_id, len(l) AS n_lines, l[1] AS first_line, array_to_string(l[-2:], '|') AS tail "
       f"FROM (SELECT doc_id, string_split({SQL_WRAP.format('t')}, chr(10)) AS l FROM "
       f"(SELECT doc_id, {tok('text')} AS t FROM documents) WHERE len(t) > 0)")
def wrap_lines(spark, sf):
    d = v.table(spark, sf, "documents").filter(F.col("text").rlike(r"\S")).select("doc_id", T.wrap_lines(F.col("text")).alias("l"))
    return d.select(
        "doc_id", F.size("l").cast("bigint").alias("n_lines"), F.get("l", F.lit(0)).alias("first_line"),
        F.array_join(F.slice("l", F.greatest(F.size("l") - 1, F.lit(1)), F.lit(2)), "|").alias("tail"))


@query("display_text", with_views("v_cues", "SELECT session_id, cue_no, array_to_string(lines, chr(10)) AS shown "
                                  "FROM v_lines", extra=LINES))
def display_text(spark, sf):
    return lined(spark, sf).select("session_id", "cue_no", T.display_text(F.col("lines")).alias("shown"))


STUTTER = f"""
  SELECT session_id, cue_no, unnest(range(len(t))) AS i, unnest(t) AS w FROM (
    SELECT session_id, cue_no, {tok("array_to_string(list_transform(t0, lambda w, i: CASE WHEN (i - 1) % 5 = 2 THEN w || '  ' || replace(w, 'e', 'E') || ' ' || w WHEN (i - 1) % 7 = 3 THEN w || ' ' || w WHEN (i - 1) % 11 = 4 THEN w || ' !!,,,' ELSE w END), ' ')")} AS t
    FROM (SELECT *, {tok('text')} AS t0 FROM v_cues))"""


def collapse_sql(tokens: str, keys: str) -> str:
    """Tokens (keys, i, w) with 3+ equal neighbours as one (islands; the last may end in marks), joined per key, then
    one replacement per punctuation mark."""
    marks = "string_agg(w, ' ' ORDER BY i)"
    for m in ",.!?;:":
        marks = f"regexp_replace({marks}, '[{m}]+', '{m}', 'g')"
    return f"""
SELECT {keys}, trim(regexp_replace({marks}, '\\s+([,.!?;:])', '\\1', 'g')) AS text FROM (
  SELECT {keys}, i, CASE WHEN n >= 3 THEN w || regexp_replace(last_w, '^{W}+', '') ELSE w END AS w
  FROM (SELECT *, first_value(i) OVER r AS first_i, last_value(w) OVER r AS last_w, count(*) OVER r AS n FROM (
    SELECT *, sum(CASE WHEN joined THEN 0 ELSE 1 END) OVER (PARTITION BY {keys} ORDER BY i) AS run FROM (
      SELECT *, coalesce(lower(regexp_extract(w, '^{W}+')) = lower(regexp_extract(pw, '{W}+$'))
             AND regexp_extract(w, '^{W}+') <> '' AND regexp_full_match(pw, '{W}+'), false) AS joined
      FROM (SELECT *, lag(w) OVER (PARTITION BY {keys} ORDER BY i) AS pw FROM {tokens})))
    WINDOW r AS (PARTITION BY {keys}, run ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
  WHERE n < 3 OR i = first_i) GROUP BY {keys}"""


@query("clean_fragment", with_views("v_cues", collapse_sql("stutter", "session_id, cue_no"), extra=f"stutter AS ({STUTTER})"))
def clean_fragment(spark, sf):
    """Text with injected stutters and runs of marks; the SQL twin collapses runs of equal words by islands."""
    c = v.cues(spark, sf).select("session_id", "cue_no", "text")
    bad = F.transform(v.tokens(F.col("text")), lambda w, i: F.when(
        i % 5 == 2, F.concat(w, F.lit("  "), F.replace(w, F.lit("e"), F.lit("E")), F.lit(" "), w)).when(i % 7 == 3, F.concat(w, F.lit(" "), w))
        .when(i % 11 == 4, F.concat(w, F.lit(" !!,,,"))).otherwise(w))
    return Q.clean_fragments(c.withColumn("text", F.array_join(bad, " "))).filter("text <> ''")


@query("last_word", f"SELECT doc_id, coalesce(regexp_extract_all(text, '{W}+')[-1], '') AS word FROM documents")
def last_word(spark, sf):
    return v.table(spark, sf, "documents").select("doc_id", T.last_word(F.col("text")).alias("word"))


@query("wer_tokens", rf"""
SELECT doc_id, len(t) AS n, array_to_string(t, ' ') AS words FROM (SELECT doc_id,
  list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}\p{{M}}_\s'']', '', 'g'), '\s+'),
  lambda w: w <> '') AS t FROM documents)""")
def wer_tokens(spark, sf):
    t = T.wer_tokens(F.col("text"))
    return v.table(spark, sf, "documents").select("doc_id", F.size(t).cast("bigint").alias("n"),
                                                  F.array_join(t, " ").alias("words"))


@query("clocks", with_views("v_cues", f"""
SELECT session_id, cue_no, {TIME.format('m')} AS vtt,
  printf('%02d:%02d:%02d.%03d', (m // 3600000) % 24, (m // 60000) % 60, (m // 1000) % 60, m % 1000) AS log_clock,
  printf('%02d:%02d:%02d', m // 3600000, (m // 60000) % 60, (m // 1000) % 60) AS up,
  CASE WHEN m >= 3600000 THEN printf('%d:%02d:%02d', m // 3600000, (m // 60000) % 60, (m // 1000) % 60)
       ELSE printf('%02d:%02d', (m // 60000) % 60, (m // 1000) % 60) END AS short
FROM (SELECT session_id, cue_no, end_ms * 977 AS m FROM v_cues)"""))
def clocks(spark, sf):
    m = F.col("end_ms") * 977
    return v.cues(spark, sf).select("session_id", "cue_no", clock.vtt_time(m).alias("vtt"),
                                    clock.log_time(m).alias("log_clock"), clock.uptime(m).alias("up"),
                                    clock.short_clock(m).alias("short"))


@query("reading_load", with_views("v_cues", """
SELECT session_id, cue_no, round(least(greatest(chars / 14.0 * 1000, 1200), 4000), 3) AS dwell_ms,
  round(chars * 1000 / span, 6) AS chars_per_sec, chars * 1000 / span > 14.0 AS too_fast
FROM (SELECT session_id, cue_no, CAST(length(text) AS DOUBLE) AS chars, end_ms - start_ms AS span FROM v_cues)"""))
def reading_load(spark, sf):
    c = v.cues(spark, sf).withColumn("chars", F.length("text"))
    return Q.reading_load(c).select("session_id", "cue_no", "dwell_ms", "chars_per_sec", "too_fast")


@query("speaker_changes", with_views("v_cues", """
SELECT session_id, cue_no, CASE WHEN named IS NOT NULL AND (prev IS NULL OR prev <> named) THEN named ELSE '' END AS shown
FROM (SELECT *, last_value(named IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY cue_no
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
      FROM (SELECT *, CASE WHEN cue_no % 4 <> 3 THEN speaker END AS named FROM v_cues))"""))
def speaker_changes(spark, sf):
    c = v.cues(spark, sf).withColumn("speaker", F.when(F.col("cue_no") % 4 != 3, F.col("speaker")))
    return Q.speaker_changes(c).select("session_id", "cue_no", "shown")


@query("drop_hallucinations", rf"""
WITH s AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'Thank you!' WHEN 1 THEN event_type || ' ' || event_type || ', '
    || event_type WHEN 2 THEN ' Bye bye. ' WHEN 3 THEN event_type || ' now' WHEN 4 THEN 'Please subscribe soon'
    ELSE event_type END AS text, CASE WHEN event_id % 13 <> 0 THEN (event_id % 10) / 10.0 END AS p FROM events),
n AS (SELECT *, trim(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}_\s]', '', 'g')) AS b FROM s)
SELECT event_id, text FROM n WHERE NOT coalesce(p > 0.5, false)
  AND b NOT IN ({", ".join(repr(p) for p in SILENCE_PHRASES)})
  AND NOT (len({tok('b')}) >= 3 AND len(list_distinct({tok('b')})) = 1)""")
def drop_hallucinations(spark, sf):
    e, k = v.events(spark, sf), F.col("event_id") % 6
    t = F.col("event_type")
    text = (F.when(k == 0, "Thank you!").when(k == 1, F.concat(t, F.lit(" "), t, F.lit(", "), t))
             .when(k == 2, " Bye bye. ").when(k == 3, F.concat(t, F.lit(" now"))).when(k == 4, "Please subscribe soon")
             .otherwise(t))
    prob = F.when(F.col("event_id") % 13 != 0, (F.col("event_id") % 10) / 10)
    s = e.select("event_id", text.alias("text"), prob.alias("no_speech_prob"))
    return Q.drop_hallucinations(s).select("event_id", "text")


@query("drop_empty_captions", f"""
SELECT conv_id, turn, len({tok('t')}) AS words FROM (SELECT conv_id, turn,
  CASE WHEN turn % 3 = 1 THEN chr(10) || '  ' ELSE text END AS t FROM conversations) WHERE len({tok('t')}) > 0""")
def drop_empty_captions(spark, sf):
    c = v.table(spark, sf, "conversations").withColumn(
        "text", F.when(F.col("turn") % 3 == 1, "\n  ").otherwise(F.col("text")))
    kept = Q.drop_empty_captions(Q.wrap_caption(c))
    return kept.select("conv_id", "turn", F.size(v.tokens(F.col("text"))).cast("bigint").alias("words"))


BOUNDARY = rf"""shown AS (SELECT session_id, utterance_id, frag_no,
  CASE WHEN prev <> '' AND lower(head) = lower(prev) AND rest <> '' THEN rest ELSE text END AS text
FROM (SELECT *, regexp_extract(text, '^({W}+)', 1) AS head, regexp_replace(text, '^{W}+\s*', '') AS rest,
        lag(regexp_extract_all(text, '{W}+')[-1], 1, '') OVER (PARTITION BY session_id, utterance_id ORDER BY frag_no) AS prev
  FROM (SELECT session_id, utterance_id, frag_no,
        CASE WHEN frag_no % 3 = 1 THEN lag(lw) OVER (PARTITION BY session_id, utterance_id ORDER BY frag_no) || ' ' || text
             ELSE text END AS text
        FROM (SELECT *, coalesce(regexp_extract_all(text, '{W}+')[-1], '') AS lw FROM v_fragments)))),
pieces AS (SELECT session_id, utterance_id, frag_no, unnest(range(len(t))) AS i, unnest(t) AS w
  FROM (SELECT *, {tok('text')} AS t FROM shown))"""


@query("dedupe_boundary", with_views("v_fragments", collapse_sql("pieces", "session_id, utterance_id, frag_no"), extra=BOUNDARY))
def dedupe_boundary(spark, sf):
    """Every third fragment starts with the last word of the one before it. The view has no one-word fragments with
    a mark that repeat; those runs are tested against a row loop."""
    f = v.fragments(spark, sf)
    prev = f.select("session_id", "utterance_id", (F.col("frag_no") + 1).alias("frag_no"),
                    T.last_word(F.col("text")).alias("lw"))
    f = f.join(prev, ["session_id", "utterance_id", "frag_no"], "left")
    f = f.withColumn("text", F.when(F.col("frag_no") % 3 == 1, F.concat_ws(" ", "lw", "text")).otherwise(F.col("text")))
    return Q.dedupe_boundary(f).select("session_id", "utterance_id", "frag_no", "text")


@query("suppress_repeats", with_views("v_cues", """
SELECT session_id, cue_no, text FROM (SELECT *, lag(text) OVER (PARTITION BY session_id ORDER BY cue_no) AS p FROM (
  SELECT session_id, cue_no, CASE WHEN cue_no % 5 = 0 THEN '' WHEN cue_no % 3 = 0 THEN lag(t) OVER (PARTITION BY session_id ORDER BY cue_no)
         ELSE t END AS text FROM (SELECT *, array_to_string({0}, ' ') AS t FROM v_cues))
  WHERE text <> '') WHERE p IS NULL OR p <> text""".format(tok("text"))))
def suppress_repeats(spark, sf):
    """Captions, every third one the same as the one before, every fifth one blank."""
    c = v.cues(spark, sf)
    before = c.select("session_id", (F.col("cue_no") + 1).alias("cue_no"), F.col("text").alias("was"))
    text = F.when(F.col("cue_no") % 5 == 0, " ").when(F.col("cue_no") % 3 == 0, F.col("was")).otherwise(F.col("text"))
    c = c.join(before, ["session_id", "cue_no"], "left").withColumn("text", text)
    return Q.suppress_repeats(c).select("session_id", "cue_no", "text")


@query("number_cues", """
SELECT user_id AS session_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS cue_no
FROM events""")
def number_cues(spark, sf):
    e = v.events(spark, sf).select(F.col("user_id").alias("session_id"), "ts", "event_id")
    order = ["ts", "event_id"]
    return Q.number_cues(scan.range_blocks(e, ["session_id"], order), ["session_id"], order).drop("ts")


@query("recent_cues", with_views("v_cues", """
SELECT session_id, cue_no, text FROM v_cues
QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY cue_no DESC) <= 3"""))
def recent_cues(spark, sf):
    return Q.recent_cues(v.cues(spark, sf), 3).select("session_id", "cue_no", "text")


@query("cues_since", with_views("v_cues", "SELECT session_id, cue_no, start_ms FROM v_cues WHERE cue_no >= 4"))
def cues_since(spark, sf):
    return Q.cues_since(v.cues(spark, sf), 4).select("session_id", "cue_no", "start_ms")


VTT = (f"cue_no || chr(10) || {TIME.format('start_ms')} || ' --> ' || {TIME.format('end_ms')} "
       "|| ' line:90%,end align:center' || chr(10) || {0} || chr(10)")


@query("webvtt_document", with_views("v_cues", f"""
SELECT session_id, 0 AS part_no, 'WEBVTT' || chr(10) || chr(10)
  || string_agg({VTT.format('text')}, chr(10) ORDER BY cue_no) AS document FROM v_cues GROUP BY session_id"""))
def webvtt_document(spark, sf):
    return Q.webvtt_document(v.cues(spark, sf))


@query("tail_text", with_views("v_cues", """
SELECT session_id, string_agg(t, ' ' ORDER BY cue_no) AS tail FROM (
  SELECT *, coalesce(sum(length(t) + 1) OVER (PARTITION BY session_id ORDER BY cue_no DESC
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM (SELECT session_id, cue_no, trim(replace(text, chr(10), ' ')) AS t FROM v_cues) WHERE t <> '')
WHERE before < 80 GROUP BY session_id"""))
def tail_text(spark, sf):
    return Q.tail_text(v.cues(spark, sf))


@query("transcript", with_views("v_cues", "SELECT session_id, 0 AS part_no, string_agg(text, chr(10) ORDER BY cue_no) "
                                "AS transcript FROM v_cues GROUP BY session_id"))
def transcript(spark, sf):
    return Q.transcript(v.cues(spark, sf))


@query("session_position", with_views("v_cues", "SELECT session_id, max_by(end_ms, cue_no) AS current_ms, "
                                      "count(*) AS cue_count FROM v_cues GROUP BY session_id"))
def session_position(spark, sf):
    return Q.session_position(v.cues(spark, sf))


@query("cue_feed", with_views("v_cues", """
SELECT CAST(session_id AS VARCHAR) AS key, cue_no, array_to_string(lines, chr(10)) AS text, len(lines) AS n_lines,
  printf('%d.%03d', start_ms // 1000, start_ms % 1000) AS start, printf('%d.%03d', end_ms // 1000, end_ms % 1000) AS end
FROM v_lines""", extra=LINES))
def cue_feed(spark, sf):
    c = lined(spark, sf).withColumn("text", T.display_text(F.col("lines")))
    f = Q.cue_feed(c).withColumn("r", F.from_json("value", "text STRING, lines ARRAY<STRING>, start STRING, end STRING"))
    return f.select("key", "cue_no", "r.text", F.size("r.lines").cast("bigint").alias("n_lines"), "r.start", "r.end")


@query("merge_captions", with_views("v_cues v_sounds", """
SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY start_ms, end_ms, source, text) AS cue_no FROM (
  SELECT session_id, start_ms, end_ms, text, 'speech' AS source FROM v_cues UNION ALL
  SELECT session_id, window_no * 1000, window_no * 1000 + 2000, '[' || upper(label) || ']', 'sound' FROM v_sounds
  WHERE prob >= 0.45)"""))
def merge_captions(spark, sf):
    s = v.sounds(spark, sf).filter("prob >= 0.45").select(
        "session_id", (F.col("window_no") * 1000).alias("start_ms"), (F.col("window_no") * 1000 + 2000).alias("end_ms"),
        F.concat(F.lit("["), F.upper("label"), F.lit("]")).alias("text"))
    return Q.merge_captions(v.cues(spark, sf), s)


CHAIN = f"""pieces AS (SELECT session_id, cue_no, unnest(range(len(t))) AS i, unnest(t) AS w
  FROM (SELECT *, {tok('text')} AS t FROM v_cues)),
cleaned AS ({collapse_sql("pieces", "session_id, cue_no")}),
shown AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY cue_no) AS cue_no, start_ms, end_ms,
    array_to_string(string_split({SQL_WRAP.format(tok('c.text'))}, chr(10))[-2:], chr(10)) AS text
  FROM cleaned c JOIN v_cues USING (session_id, cue_no) WHERE c.text <> '')"""


@query("caption_documents", with_views("v_cues", f"""
SELECT session_id, 0 AS part_no, 'WEBVTT' || chr(10) || chr(10)
  || string_agg({VTT.format('text')}, chr(10) ORDER BY cue_no) AS document,
  count(*) AS cue_count, max_by(text, cue_no) AS last_cue, max(end_ms) AS uptime_ms FROM shown GROUP BY session_id""", extra=CHAIN))
def caption_documents(spark, sf):
    """Flagship: texts cleaned, laid out, numbered, written as WebVTT next to the session's roll-up."""
    return live.documents(live.caption_cues(v.cues(spark, sf).withColumnRenamed("cue_no", "seq")))
