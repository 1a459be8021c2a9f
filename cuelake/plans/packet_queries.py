"""Queries over caption byte pairs, packets, transcripts and display blocks."""

from pyspark.sql import functions as F

from cuelake.functions import codec as C, text as T
from cuelake.operators import packets as P, quality as W, sync as Y
from cuelake.plans import views as v
from cuelake.plans.registry import query
from cuelake.plans.signal_queries import ticks
from cuelake.plans.text_queries import LINES, lined
from cuelake.plans.view_sql import tok, with_views

CODE = "CASE WHEN unicode({0}) BETWEEN 32 AND 127 THEN unicode({0}) ELSE 63 END"
PARITY = "CASE WHEN bit_count({0}) % 2 = 0 THEN {0} + 128 ELSE {0} END"


def chars_sql(text: str) -> str:
    """Parity bytes of a string as a list."""
    c = CODE.format("c")
    return (f"list_transform(list_transform(string_split({text}, ''), lambda c: {c}), "
            f"lambda x: {PARITY.format('x')})")


BYTES = f"""v_bytes AS (
  SELECT session_id, cue_no, line_no, {chars_sql('line')} AS b FROM (
    SELECT session_id, cue_no, unnest(range(len(lines))) AS line_no, unnest(lines) AS line FROM v_lines))"""
P608 = LINES + ", " + BYTES + """, v_p608 AS (
  SELECT session_id, cue_no, row_number() OVER (PARTITION BY session_id ORDER BY cue_no, line_no, k) - 1 AS pair_no, b1, b2
  FROM (SELECT session_id, cue_no, line_no, i + 1 AS k, b[2 * i + 1] AS b1, coalesce(b[2 * i + 2], 128) AS b2
        FROM (SELECT *, unnest(range((len(b) + 1) // 2)) AS i FROM v_bytes)
        UNION ALL SELECT session_id, cue_no, line_no, 0, 148, 173 FROM v_bytes
        UNION ALL SELECT session_id, min(cue_no), -1, 0, 148, 37 FROM v_lines GROUP BY session_id))"""
NOTE = """CASE WHEN b1 = 148 AND b2 = 37 THEN 'RU2 — Roll-Up 2 rows' WHEN b1 = 148 AND b2 = 166 THEN 'RU3 — Roll-Up 3 rows'
    WHEN b1 = 148 AND b2 = 39 THEN 'RU4 — Roll-Up 4 rows' WHEN b1 = 148 AND b2 = 173 THEN 'CR  — Carriage Return'
    WHEN b1 = 148 AND b2 = 44 THEN 'EDM — Erase Displayed Memory' WHEN b1 = 148 AND b2 = 175 THEN 'EOC — End of Caption'
    WHEN b1 = 128 AND b2 = 128 THEN 'NULL'
    WHEN b1 % 128 >= 32 AND b2 % 128 >= 32 THEN 'text: ' || chr(CAST(b1 % 128 AS INT)) || chr(CAST(b2 % 128 AS INT))
    WHEN b1 % 128 >= 32 AND b2 % 128 = 0 THEN 'text: ' || chr(CAST(b1 % 128 AS INT)) || ' + NULL'
    ELSE printf('raw: %02X %02X', b1, b2) END"""
P708 = LINES + f""", v_payload AS (
  SELECT session_id, cue_no, raw, rn, list_concat(
    CASE WHEN rn = 1 THEN [143, 152, 4, 74, 105, 113, 31, 9, 128] ELSE [128] END,
    flatten(list_transform(lines, lambda l: list_concat([13], list_transform(string_split(l, ''), lambda c: {CODE.format('c')}))))) AS p
  FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY cue_no) AS rn FROM v_lines)),
v_blocks AS (SELECT *, flatten(list_transform(range((len(p) + 30) // 31),
    lambda i: list_concat([32 + len(p[31 * i + 1:31 * i + 31])], p[31 * i + 1:31 * i + 31]))) AS q FROM v_payload),
v_even AS (SELECT *, list_concat(q, CASE WHEN len(q) % 2 = 1 THEN [0] ELSE [0, 0] END) AS e FROM v_blocks),
v_p708 AS (SELECT session_id, cue_no, raw, list_concat([(rn - 1) % 4 * 64 + (len(e) // 2 - 1) % 64], e) AS packet,
    len(e) // 2 - 1 > 63 AS oversize FROM v_even)"""
HEX = "array_to_string(list_transform({0}, lambda b: printf('%02X', b)), ' ')"

# Greedy row filling, word by word, all sessions side by side.
ROLL = f"""
v_seq AS (SELECT session_id, frag_no, word_no, left(w, 32) AS w,
    row_number() OVER (PARTITION BY session_id ORDER BY frag_no, word_no) AS i
  FROM (SELECT session_id, frag_no, unnest(range(len(t))) AS word_no, unnest(t) AS w
        FROM (SELECT *, {tok('text')} AS t FROM v_session_fragments))),
v_walk AS (SELECT session_id, i, CAST(length(w) AS BIGINT) AS col, false AS new_row FROM v_seq WHERE i = 1
  UNION ALL SELECT s.session_id, s.i, CASE WHEN r.col + 1 + length(w) > 32 THEN length(w) ELSE r.col + 1 + length(w) END,
    r.col + 1 + length(w) > 32 FROM v_walk r JOIN v_seq s ON s.session_id = r.session_id AND s.i = r.i + 1),
v_place AS (SELECT s.*, new_row, CAST(sum(CAST(new_row AS INT)) OVER (PARTITION BY s.session_id ORDER BY s.i) AS BIGINT) AS row_no
  FROM v_seq s JOIN v_walk r ON s.session_id = r.session_id AND s.i = r.i)"""
RPAIRS = ROLL + f""", v_runs AS (SELECT session_id, frag_no, row_no, bool_or(new_row) AS new_row, min(i) AS i,
    string_agg(CASE WHEN new_row OR i = 1 THEN '' ELSE ' ' END || w, '' ORDER BY i) AS text FROM v_place GROUP BY 1, 2, 3),
v_rb AS (SELECT *, {chars_sql('text')} AS b FROM v_runs),
v_rp AS (SELECT session_id, frag_no, row_number() OVER (PARTITION BY session_id ORDER BY frag_no, row_no, k) - 1 AS pair_no, b1, b2
  FROM (SELECT session_id, frag_no, row_no, j + 10 AS k, b[2 * j + 1] AS b1, coalesce(b[2 * j + 2], 128) AS b2
        FROM (SELECT *, unnest(range((len(b) + 1) // 2)) AS j FROM v_rb)
    UNION ALL SELECT session_id, frag_no, row_no, unnest([0, 1]), 148, 173 FROM v_rb WHERE new_row
    UNION ALL SELECT session_id, frag_no, row_no, unnest([2, 3, 4, 5]), 148, unnest([37, 37, 224, 224]) FROM v_rb
      WHERE i = 1 OR (new_row AND row_no % 3 = 0)))"""


def fragments(spark, sf):
    return v.session_fragments(spark, sf)


def pairs608(spark, sf):
    return P.encode_608_simple(lined(spark, sf))


def packets708(spark, sf):
    return P.encode_708(lined(spark, sf).withColumn("text", F.col("raw")))


def rollup_pairs(spark, sf):
    return P.encode_608_rollup(fragments(spark, sf))


@query("encode_608_simple", with_views("v_cues", "SELECT session_id, cue_no, pair_no, b1, b2 FROM v_p608", extra=P608))
def encode_608_simple(spark, sf):
    return pairs608(spark, sf)


@query("encode_608_rollup", with_views("v_session_fragments", "SELECT session_id, frag_no, pair_no, b1, b2 FROM v_rp",
                                       recursive=True, extra=RPAIRS))
def encode_608_rollup(spark, sf):
    return rollup_pairs(spark, sf)


@query("encode_708", with_views("v_cues", f"SELECT session_id, cue_no, {HEX.format('packet')} AS raw_hex, oversize FROM v_p708",
                                extra=P708))
def encode_708(spark, sf):
    return packets708(spark, sf).select("session_id", "cue_no", "raw_hex", "oversize")


@query("cc_triples", with_views("v_cues", """
SELECT session_id, cue_no, i AS pos, CASE WHEN i = 0 THEN 6 ELSE 7 END AS cc_type, packet[2 * i + 1] AS d1,
  coalesce(packet[2 * i + 2], 0) AS d2 FROM (SELECT *, unnest(range((len(packet) + 1) // 2)) AS i FROM v_p708)""", extra=P708))
def cc_triples(spark, sf):
    t = P.cc_triples(packets708(spark, sf)).select("session_id", "cue_no", F.posexplode("cc_data").alias("pos", "c"))
    return t.select("session_id", "cue_no", "pos", "c.cc_type", "c.d1", "c.d2")


@query("audit_708", with_views("v_cues", """
SELECT session_id, cue_no, seq, size_code, (size_code + 1) * 2 AS declared_bytes, n AS body_bytes,
  (size_code + 1) * 2 = n AS length_ok, coalesce((lag(seq) OVER (PARTITION BY session_id ORDER BY cue_no) + 1) % 4 = seq, true) AS seq_ok
FROM (SELECT session_id, cue_no, packet[1] // 64 AS seq, packet[1] % 64 AS size_code, len(packet) - 1 AS n FROM v_p708
      WHERE cue_no % 5 <> 3)""", extra=P708))
def audit_708(spark, sf):
    return P.audit_708(packets708(spark, sf).filter("cue_no % 5 <> 3"))


@query("first_row_init", with_views("v_cues", """
SELECT session_id, cue_no, n = 1 AS is_init, (n - 1) % 4 AS seq FROM (
  SELECT *, row_number() OVER (PARTITION BY session_id, g ORDER BY cue_no) AS n FROM (
    SELECT *, sum(CASE WHEN cue_no % 6 = 4 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY cue_no) AS g FROM v_cues))"""))
def first_row_init(spark, sf):
    return P.first_row_init(v.cues(spark, sf), reset=F.col("cue_no") % 6 == 4).select("session_id", "cue_no", "is_init", "seq")


@query("annotate_pairs", with_views("v_cues", f"SELECT session_id, pair_no, b1, b2, {NOTE} AS note FROM v_p608", extra=P608))
def annotate_pairs(spark, sf):
    return P.annotate_pairs(pairs608(spark, sf)).select("session_id", "pair_no", "b1", "b2", "note")


@query("packet_stats", with_views("v_session_fragments", """
SELECT session_id, count(*) AS pairs, count(*) FILTER (b1 % 128 BETWEEN 16 AND 31) AS control, count(*) FILTER (b1 % 128 >= 32) AS text,
  count(*) FILTER (b1 % 128 = 0 AND b2 % 128 = 0) AS null_pairs, count(*) FILTER (b1 % 128 BETWEEN 16 AND 31 AND b2 % 128 = 45) AS crs,
  CAST(sum(CASE WHEN bit_count(b1) % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN bit_count(b2) % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS parity_errors
FROM (SELECT session_id, b1, CASE WHEN pair_no % 50 = 7 THEN b2 % 128 ELSE b2 END AS b2 FROM v_rp) GROUP BY 1""",
                                  recursive=True, extra=RPAIRS))
def packet_stats(spark, sf):
    p = rollup_pairs(spark, sf).withColumn(
        "b2", F.when(F.col("pair_no") % 50 == 7, F.col("b2") % 128).otherwise(F.col("b2")))
    return P.packet_stats(p)


PACED = P608 + """, v_paced AS (
  SELECT *, pair_no + max(arrival - pair_no) OVER (PARTITION BY session_id ORDER BY pair_no) AS frame_no
  FROM (SELECT *, cue_no * 40 - 40 AS arrival FROM v_p608))"""


def paced(spark, sf):
    return P.pace_pairs(pairs608(spark, sf).withColumn("arrival_frame", F.col("cue_no") * 40 - 40))


@query("pace_pairs", with_views("v_cues", "SELECT session_id, pair_no, frame_no FROM v_paced", extra=PACED))
def pace_pairs(spark, sf):
    return paced(spark, sf).select("session_id", "pair_no", "frame_no")


@query("frame_lock", with_views("v_cues", """
SELECT g.session_id, g.frame_no, coalesce(b1, 128) AS b1, coalesce(b2, 128) AS b2 FROM (
  SELECT session_id, unnest(range(min(frame_no), max(frame_no) + 1)) AS frame_no FROM v_paced GROUP BY session_id) g
LEFT JOIN v_paced p ON p.session_id = g.session_id AND p.frame_no = g.frame_no""", extra=PACED))
def frame_lock(spark, sf):
    return P.frame_lock(paced(spark, sf))


@query("backlog_depth", with_views("v_cues", """
SELECT session_id, push_no, before, before + n AS after FROM (
  SELECT p.session_id, p.cue_no AS push_no, count(*) AS n,
    (SELECT count(*) FROM v_paced q WHERE q.session_id = p.session_id AND q.cue_no < p.cue_no AND q.frame_no >= min(p.arrival)) AS before
  FROM v_paced p GROUP BY 1, 2)""", extra=PACED))
def backlog_depth(spark, sf):
    p = pairs608(spark, sf).groupBy("session_id", F.col("cue_no").alias("push_no")).agg(F.count("*").alias("n_pairs"))
    return P.backlog_depth(p.withColumn("frame", F.col("push_no") * 40 - 40)).select("session_id", "push_no", "before", "after")


@query("backlog_resets")
def backlog_resets(spark, sf):
    """Depends on every earlier reset: checked against a row loop in the tests."""
    f = fragments(spark, sf).select("session_id", F.col("frag_no").alias("push_no"), "text",
                                    (F.col("frag_no") * 2).alias("frame"))
    return P.backlog_resets(f, limit=120)


@query("dedupe_control", with_views("v_session_fragments", """
SELECT session_id, pair_no, c1, c2 FROM (
  SELECT *, row_number() OVER (PARTITION BY session_id, g ORDER BY pair_no) AS k FROM (
    SELECT *, sum(CASE WHEN ctl AND c1 = p1 AND c2 = p2 THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY pair_no) AS g FROM (
      SELECT *, c1 BETWEEN 16 AND 31 AS ctl, lag(c1) OVER w AS p1, lag(c2) OVER w AS p2 FROM (
        SELECT session_id, pair_no, b1 % 128 AS c1, b2 % 128 AS c2 FROM v_rp WHERE b1 % 128 <> 0)
      WINDOW w AS (PARTITION BY session_id ORDER BY pair_no)))) WHERE k % 2 = 1""", recursive=True, extra=RPAIRS))
def dedupe_control(spark, sf):
    return P.dedupe_control(rollup_pairs(spark, sf)).select("session_id", "pair_no", "c1", "c2")


SHOWN = """SELECT session_id, row_no, string_agg(regexp_replace(w, '[^\\x20-\\x7f]', '?', 'g'), ' ' ORDER BY i) AS text
FROM v_place GROUP BY 1, 2"""


@query("decode_rollup", with_views("v_session_fragments", SHOWN, recursive=True, extra=ROLL))
def decode_rollup(spark, sf):
    return P.decode_rollup(rollup_pairs(spark, sf))


@query("visible_rows", with_views("v_session_fragments", SHOWN + " QUALIFY row_number() OVER (PARTITION BY session_id "
                                  "ORDER BY row_no DESC) <= 2", recursive=True, extra=ROLL))
def visible_rows(spark, sf):
    return P.visible_rows(rollup_pairs(spark, sf))


@query("roundtrip_check", with_views("v_session_fragments", f"""
SELECT session_id, count(*) AS rows, 0 AS wrong_rows, max(length(text)) AS widest FROM ({SHOWN}) GROUP BY 1""",
                                     recursive=True, extra=ROLL))
def roundtrip_check(spark, sf):
    return P.roundtrip_check(fragments(spark, sf))


#: Start of an access unit in hex: two bytes, the mark GA94, the type byte 3.
UNIT_HEAD = "00014741393403"


@query("extract_cc_pairs", with_views("v_cues", """
SELECT session_id, cue_no AS au_no, row_number() OVER (PARTITION BY session_id, cue_no ORDER BY pair_no) - 1 AS k, b1, b2
FROM v_p608 WHERE pair_no % 3 <> 1""", extra=P608))
def extract_cc_pairs(spark, sf):
    """Access units built from the pair table: up to 31 triples behind each mark, every third one not field 1."""
    p = pairs608(spark, sf)
    item = F.struct("pair_no", F.concat(
        F.when(F.col("pair_no") % 3 == 1, "FD").otherwise("FC"), F.lpad(F.hex("b1"), 2, "0"), F.lpad(F.hex("b2"), 2, "0")).alias("h"))
    g = p.groupBy("session_id", "cue_no", F.expr("pair_no div 31").alias("g")).agg(F.array_sort(F.collect_list(item)).alias("t"))
    unit = F.concat(F.lit(UNIT_HEAD), F.lpad(F.hex(F.size("t") + 0x40), 2, "0"), F.lit("FF"),
                    F.array_join(F.transform("t", lambda x: x["h"]), ""), F.lit("FFEE"))
    g = g.groupBy("session_id", "cue_no").agg(F.array_sort(F.collect_list(F.struct("g", unit.alias("u")))).alias("us"))
    units = g.select("session_id", F.col("cue_no").alias("au_no"),
                     F.unhex(F.array_join(F.transform("us", lambda x: x["u"]), "")).alias("payload"))
    return P.extract_cc_pairs(units)


# --- display blocks ---

PAGES = f"""
v_seq AS (SELECT session_id, frag_no, word_no, w, start_ms, latest_ms, run_no,
    row_number() OVER (PARTITION BY session_id, run_no ORDER BY frag_no, word_no) AS i
  FROM (SELECT *, unnest(range(len(t))) AS word_no, unnest(t) AS w FROM (
    SELECT *, {tok('text')} AS t, sum(CASE WHEN start_ms - pe >= 500 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY frag_no) AS run_no
    FROM (SELECT *, max(end_ms) OVER (PARTITION BY session_id ORDER BY frag_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe,
            max(end_ms) OVER (PARTITION BY session_id ORDER BY frag_no) AS latest_ms FROM v_session_fragments)))),
v_walk AS (
  SELECT session_id, run_no, i, CAST(length(w) AS BIGINT) AS col, 1 AS lines, CAST(length(w) AS BIGINT) AS chars, true AS opens, false AS spilled,
    length(w) >= 32 AND regexp_matches(w, '[.!?…]["'')\\]]?$') AS closes FROM v_seq WHERE i = 1
  UNION ALL
  SELECT session_id, run_no, i, CASE WHEN fresh OR col + 1 + n > 32 THEN n ELSE col + 1 + n END,
    CASE WHEN fresh THEN 1 WHEN col + 1 + n > 32 THEN lines + 1 ELSE lines END, CASE WHEN fresh THEN n ELSE chars + 1 + n END,
    fresh, fresh AND NOT closed,
    (CASE WHEN fresh THEN n ELSE chars + 1 + n END) >= 32 AND regexp_matches(w, '[.!?…]["'')\\]]?$') AND NOT (fresh AND NOT closed)
  FROM (SELECT s.session_id, s.run_no, s.i, s.w, length(s.w) AS n, r.col, r.lines, r.chars, r.closes AS closed,
          r.closes OR (r.lines = 2 AND r.col + 1 + length(s.w) > 32) AS fresh
        FROM v_walk r JOIN v_seq s ON s.session_id = r.session_id AND s.run_no = r.run_no AND s.i = r.i + 1)),
v_blk AS (SELECT s.*, r.spilled, r.closes, sum(CAST(opens AS INT)) OVER (PARTITION BY s.session_id ORDER BY s.run_no, s.i) AS block_no,
    lead(CASE WHEN r.spilled THEN latest_ms END) OVER (PARTITION BY s.session_id, s.run_no ORDER BY s.i) AS spill_ms
  FROM v_seq s JOIN v_walk r ON s.session_id = r.session_id AND s.run_no = r.run_no AND s.i = r.i),
v_pages AS (SELECT session_id, CAST(block_no AS BIGINT) AS block_no, min(start_ms) AS start_ms,
    max(coalesce(spill_ms, latest_ms)) AS end_ms, string_agg(w, ' ' ORDER BY run_no, i) AS text, bool_or(closes) AS closed FROM v_blk GROUP BY 1, 2)"""


@query("paginate_blocks", with_views("v_session_fragments", "SELECT session_id, block_no, start_ms, end_ms, length(text) AS chars "
                                     "FROM v_pages", recursive=True, extra=PAGES))
def paginate_blocks(spark, sf):
    return Y.paginate_blocks(fragments(spark, sf)).drop("lines")


PAGE_TICKS = PAGES + """, v_page_ticks AS (SELECT session_id, unnest(range(0, m + 9000, 2300)) AS t_ms FROM (
  SELECT session_id, max(end_ms) AS m FROM v_session_fragments GROUP BY 1))"""


@query("display_at", with_views("v_session_fragments", """
SELECT session_id, t_ms, CASE WHEN t_ms - e <= 6000 THEN b END AS block_no, CASE WHEN t_ms - e <= 6000 THEN x END AS shown FROM (
  SELECT t.session_id, t.t_ms, max(p.block_no) AS b, max_by(p.end_ms, p.block_no) AS e, max_by(p.text, p.block_no) AS x
  FROM v_page_ticks t LEFT JOIN v_pages p ON p.session_id = t.session_id AND p.start_ms <= t.t_ms GROUP BY 1, 2)""",
                                recursive=True, extra=PAGE_TICKS))
def display_at(spark, sf):
    """The display blocks of every session at playhead ticks; lines are joined by blanks for the comparison."""
    f = fragments(spark, sf)
    shown = Y.display_at(ticks(spark, sf, f), Y.paginate_blocks(f))
    return shown.select("session_id", "t_ms", "block_no", F.array_join("lines", " ").alias("shown"))


# --- accuracy ---

WORD_LETTERS = r"\p{L}\p{N}\p{M}_\s''"

DIST = f"""v_tok AS (SELECT doc_id, seg_no, lang, source, {tok('ref')} AS r, {tok('hyp')} AS h FROM v_pairs),
v_glyph AS (SELECT *, list_distinct(list_concat(r, h)) AS d FROM v_tok),
v_dist AS (SELECT doc_id, seg_no, lang, source, len(r) AS n, len(h) AS m, levenshtein(
    array_to_string(list_transform(r, lambda w: chr(CAST(33 + list_position(d, w) AS INT))), ''),
    array_to_string(list_transform(h, lambda w: chr(CAST(33 + list_position(d, w) AS INT))), '')) AS dist FROM v_glyph)"""


# Whole documents: SQL has no word-level edit distance over texts of this length, so these have no twins; the segments below have.

@query("wer_distance")
def wer_distance(spark, sf):
    return W.wer_distance(v.transcript_pairs(spark, sf)).select("doc_id", "distance")


@query("wer")
def wer(spark, sf):
    return W.wer(v.transcript_pairs(spark, sf)).select(
        "doc_id", F.round("wer", 6).alias("wer"), "ref_words", "hyp_words", "substitutions", "deletions", "insertions", "error")


@query("corpus_wer")
def corpus_wer(spark, sf):
    return rates(W.corpus_wer(W.wer(v.transcript_pairs(spark, sf)), ["lang", "source"]), "lang", "source")


@query("accuracy_summary")
def accuracy_summary(spark, sf):
    return archived_accuracy(spark, sf, v.transcript_pairs(spark, sf))


def rates(c, *keys):
    return c.select(*keys, F.round("wer", 6).alias("wer"), F.round("accuracy", 6).alias("accuracy"), "ref_words", "segment_count")


def archived_accuracy(spark, sf, pairs):
    a = v.table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.lit(None).cast("double").alias("accuracy"), F.lit(0).alias("segment_count"))
    s = W.accuracy_summary(a, W.corpus_wer(W.wer(pairs.withColumnRenamed("doc_id", "id")), ["id"]))
    return s.select("id", F.round("accuracy", 6).alias("accuracy"), "segment_count", "accuracy_summary.ref_words")


@query("segment_wer_distance", with_views("v_pairs", "SELECT doc_id, seg_no, dist AS distance FROM v_dist", extra=DIST))
def segment_wer_distance(spark, sf):
    return W.wer_distance(v.segment_pairs(spark, sf)).select("doc_id", "seg_no", "distance")


@query("segment_wer", with_views("v_pairs", """
SELECT doc_id, seg_no, CASE WHEN n > 0 THEN round(dist / n, 6) END AS wer, n AS ref_words, m AS hyp_words,
  CASE WHEN n > 0 THEN n - m END AS deletions_minus_insertions FROM v_dist""", extra=DIST))
def segment_wer(spark, sf):
    return W.wer(v.segment_pairs(spark, sf)).select(
        "doc_id", "seg_no", F.round("wer", 6).alias("wer"), "ref_words", "hyp_words",
        (F.col("deletions") - F.col("insertions")).alias("deletions_minus_insertions"))


@query("segment_corpus_wer", with_views("v_pairs", """
SELECT lang, source, round(sum(dist) / sum(n), 6) AS wer, round(1 - sum(dist) / sum(n), 6) AS accuracy,
  CAST(sum(n) AS BIGINT) AS ref_words, count(*) AS segment_count FROM v_dist WHERE n > 0 GROUP BY 1, 2""", extra=DIST))
def segment_corpus_wer(spark, sf):
    return rates(W.corpus_wer(W.wer(v.segment_pairs(spark, sf)), ["lang", "source"]), "lang", "source")


@query("segment_accuracy_summary", with_views("v_pairs", """
SELECT d.doc_id AS id, round(1 - e / n, 6) AS accuracy, coalesce(k, 0) AS segment_count, n AS ref_words FROM documents d LEFT JOIN (
  SELECT doc_id, CAST(sum(dist) AS BIGINT) AS e, CAST(sum(n) AS BIGINT) AS n, count(*) AS k FROM v_dist WHERE n > 0 GROUP BY 1) v
  ON d.doc_id = v.doc_id""", extra=DIST))
def segment_accuracy_summary(spark, sf):
    return archived_accuracy(spark, sf, v.segment_pairs(spark, sf))


@query("pair_transcripts", rf"""
WITH pairs AS (SELECT doc_id, text AS ref, array_to_string(list_filter(list_transform(r, lambda w, i: CASE WHEN (i - 1) % 11 = 5 THEN NULL
      WHEN (i - 1) % 13 = 7 THEN 'zz' WHEN (i - 1) % 17 = 9 THEN w || ' qq' ELSE w END), lambda x: x IS NOT NULL), ' ') AS hyp
  FROM (SELECT doc_id, text, {tok("regexp_replace(lower(text), '[^" + WORD_LETTERS + "]', '', 'g')")} AS r FROM documents))
SELECT a.doc_id, a.ref, b.hyp, b.doc_id IS NOT NULL AS paired FROM pairs a LEFT JOIN (SELECT doc_id, hyp FROM pairs WHERE doc_id % 4 <> 1) b USING (doc_id)""")
def pair_transcripts(spark, sf):
    """Whole documents; those with an id of 1 modulo 4 have no hypothesis."""
    p = v.transcript_pairs(spark, sf)
    ref, hyp = p.select("doc_id", "ref"), p.select("doc_id", "hyp").filter("doc_id % 4 <> 1")
    alone = W.unpaired_transcripts(ref, hyp, "doc_id").withColumn("hyp", F.lit(None).cast("string"))
    return W.pair_transcripts(ref, hyp, "doc_id").withColumn("paired", F.lit(True)).unionByName(
        alone.withColumn("paired", F.lit(False)))


@query("words_intact", with_views("v_words v_session_fragments", f"""
SELECT e.session_id, count(*) AS expected, count(h.word) AS intact FROM v_words e LEFT JOIN (
  SELECT DISTINCT session_id, lower(unnest(string_split(text, ' '))) AS word FROM ({SHOWN})) h
ON e.session_id = h.session_id AND lower(e.word) = h.word GROUP BY 1""", recursive=True, extra=ROLL))
def words_intact(spark, sf):
    """Words that come out of the roll-up stream as they went in; long ones are cut, some letters replaced."""
    shown = P.decode_rollup(rollup_pairs(spark, sf))
    decoded = shown.select("session_id", F.explode(T.space_words(F.col("text"))).alias("word"))
    return W.words_intact(v.words(spark, sf), decoded)
