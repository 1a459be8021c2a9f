"""Caption text and cue operators: clean-up across fragments, layout, numbering, documents, tails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.functions import clock, text as T, values as V
from cuelake.operators import scan

S = ["session_id"]
PART_CUES = 4096


def normalize_text(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn(text, T.collapse_space(F.col(text)))


def wrap_caption(df: DataFrame, width: int = V.LINE_WIDTH, keep: int = V.MAX_LINES) -> DataFrame:
    raw = T.collapse_space(F.col("text"))
    return df.withColumn("raw", raw).withColumn("lines", T.wrap_caption(F.col("raw"), width, keep))


def drop_empty_captions(df: DataFrame) -> DataFrame:
    """After layout: captions without any line emit nothing. A collapsed text has no lines exactly when it is empty,
    which is cheaper to test than the layout."""
    return df.filter(F.col("raw") != "") if "raw" in df.columns else df.filter(F.size("lines") > 0)


def clean_fragments(df: DataFrame) -> DataFrame:
    return df.withColumn("text", T.clean_fragment(F.col("text")))


def dedupe_boundary(fragments: DataFrame, rows: int = scan.BLOCK_ROWS) -> DataFrame:
    """Clean fragments; drop a first word that repeats the last word shown before it in the utterance.

    A fragment of one word and a mark (``going.``) loses its word when dropped, so the next equal one is kept:
    such runs alternate. Position in the run and the verdict on its first member decide, without a row loop.
    """
    keys, order = ["session_id", "utterance_id"], ["frag_no"]
    t = T.collapse_space(F.col("text"))
    f = fragments.withColumn("text", t).filter(F.col("text") != "")
    single = F.col("text").rlike(r"(?U)^\w+\b\W+$")
    f = f.select("*", single.alias("_one"), F.lower(T.last_word(F.col("text"))).alias("_last"))
    f = scan.seq_blocks(f, "frag_no", rows)
    f = scan.prefix(f, keys, order, {
        "_prev": ("last", F.struct("_one", "_last")), "_n": ("sum", F.lit(1))}, before=True, keep=True)
    same = F.col("_prev._last") == F.col("_last")
    chained = F.coalesce(F.col("_prev._one") & same, F.lit(False))
    first_cut = F.coalesce(~F.col("_prev._one") & same, F.lit(False))
    n = F.coalesce("_n", F.lit(0))
    head = F.when(F.col("_one") & ~chained, F.struct(n.alias("n"), first_cut.alias("cut")))
    f = scan.prefix(f, keys, order, {"_run": ("last", head)}, keep=True)
    odd = (F.coalesce("_n", F.lit(0)) - F.col("_run.n")) % 2 == 1
    cut = F.col("_one") & (odd != F.col("_run.cut"))
    f = scan.prefix(f, keys, order, {"_shown": ("last", F.when(cut, "").otherwise(F.col("_last")))},
                    before=True, keep=True)
    fixed = T.clean_fragment(F.col("text"), F.coalesce("_shown", F.lit("")))
    return f.withColumn("text", fixed).drop("_one", "_last", "_prev", "_n", "_run", "_shown", scan.BLK)


def suppress_repeats(captions: DataFrame, order: str = "cue_no", rows: int = scan.BLOCK_ROWS) -> DataFrame:
    """Drop blank captions and those equal to the previous non-blank one."""
    t = captions.withColumn("text", T.collapse_space(F.col("text"))).filter(F.col("text") != "")
    t = scan.prefix(scan.seq_blocks(t, order, rows), S, [order], {"_before": ("last", F.col("text"))}, before=True)
    return t.filter(F.col("_before").isNull() | (F.col("_before") != F.col("text"))).drop("_before", scan.BLK)


def drop_hallucinations(segments: DataFrame, limit: float = 0.5) -> DataFrame:
    """Drop segments with a high no-speech probability, a known invented phrase, or one word said 3+ times.

    An unknown probability or text is no reason to drop a segment.
    """
    spark = segments.sparkSession
    phrases = F.broadcast(spark.createDataFrame([(p,) for p in V.SILENCE_PHRASES], "_bare string"))
    s = segments.filter(~F.coalesce(F.col("no_speech_prob") > limit, F.lit(False))).withColumn("_bare", T.bare_text(F.col("text")))
    words = T.space_words(F.col("_bare"))
    spam = (F.size(words) >= 3) & (F.size(F.array_distinct(words)) == 1)
    return s.filter(~F.coalesce(spam, F.lit(False))).join(phrases, "_bare", "left_anti").drop("_bare")


def number_cues(cues: DataFrame, keys: list[str], order: list[str], name: str = "cue_no", keep: bool = False) -> DataFrame:
    """1-based cue index per key over a blocked table (``seq_blocks`` or ``range_blocks``)."""
    return scan.number_rows(cues, keys, order, name, keep).drop(scan.BLK)


def recent_cues(cues: DataFrame, n: int = 10) -> DataFrame:
    return scan.last_rows(cues, S, [F.col("cue_no").desc()], "cue_no", n)


def cues_since(cues: DataFrame, index: int) -> DataFrame:
    return cues.filter(F.col("cue_no") >= index)


def render_cue(position: str = V.CUE_POSITION) -> Column:
    """Numbered WebVTT cue with its closing newline."""
    return F.concat(F.col("cue_no").cast("string"), F.lit("\n"), clock.vtt_time(F.col("start_ms")), F.lit(" --> "),
                    clock.vtt_time(F.col("end_ms")), F.lit(f" {position}\n"), F.col("text"), F.lit("\n"))


def webvtt_document(cues: DataFrame, part_cues: int = PART_CUES) -> DataFrame:
    """WebVTT text per session in parts of at most ``part_cues`` cues.

    The parts in order, joined by a newline, are the document; only the first carries the header.
    """
    c = cues.select("session_id", (F.col("cue_no") - 1).alias("_i"), render_cue().alias("_cue"))
    parts = scan.ordered_parts(c, S, "_i", "_cue", "\n", "document", part_cues)
    head = F.when(F.col("part_no") == 0, "WEBVTT\n\n").otherwise("")
    return parts.withColumn("document", F.concat(head, F.col("document")))


def transcript(cues: DataFrame, sep: str = "\n", part_cues: int = PART_CUES) -> DataFrame:
    c = cues.select("session_id", (F.col("cue_no") - 1).alias("_i"), "text")
    return scan.ordered_parts(c, S, "_i", "text", sep, "transcript", part_cues)


def _suffix(items: Column, enough) -> Column:
    """Join the shortest run of last texts that satisfies ``enough(length of the joined text)``."""
    start = F.struct(F.lit("").alias("t"), F.lit(False).alias("full"), F.lit(True).alias("none"))

    def add(acc: Column, x: Column) -> Column:
        joined = F.when(acc["none"], x).otherwise(F.concat(x, F.lit(" "), acc["t"]))
        return F.when(acc["full"], acc).otherwise(F.struct(
            joined.alias("t"), enough(F.length(joined)).alias("full"), F.lit(False).alias("none")))

    return F.aggregate(F.reverse(items), start, add, lambda acc: acc["t"])


def tail_text(cues: DataFrame, max_chars: int = V.TAIL_CHARS) -> DataFrame:
    """Newest cue texts of a session until they hold ``max_chars`` characters, oldest first.

    Every non-blank text adds at least two characters, so ``max_chars / 2`` cues always suffice.
    """
    t = F.trim(F.regexp_replace("text", "\n", " "))
    c = cues.select("session_id", "cue_no", t.alias("t")).filter(F.col("t") != "")
    need = scan.last_rows(c, S, [F.col("cue_no").desc()], "cue_no", max_chars // 2 + 1)
    items = F.array_sort(F.collect_list(F.struct("cue_no", "t")))
    return need.groupBy("session_id").agg(items.alias("i")).select(
        "session_id", _suffix(F.transform("i", lambda x: x["t"]), lambda n: n + 1 >= max_chars).alias("tail"))


def running_tails(cues: DataFrame, max_chars: int = V.TAIL_CHARS, rows: int = scan.BLOCK_ROWS) -> DataFrame:
    """At each cue: the joined texts up to it, newest first until longer than ``max_chars``, wrapped to 2 lines.

    Cues are placed by the characters of their session up to their end. What a tail shows lies within ``max_chars`` + 1 of there, so a window over
    that range holds just these texts; a block of characters gets the texts within reach before it as well.
    """
    reach, size = max_chars + 1, max(rows, max_chars + 2)
    c = scan.prefix(scan.seq_blocks(cues, "cue_no", rows), S, ["cue_no"], {"_upto": ("sum", F.coalesce(F.length("text"), F.lit(0)).cast("bigint") + 1)}, keep=True)
    c = c.drop(scan.BLK)
    own = F.expr(f"_upto div {size}")
    near_end = F.expr(f"_upto % {size}") >= size - reach
    here, there = (F.struct(b.alias(scan.BLK), F.lit(h).alias("_halo")) for b, h in ((own, False), (own + 1, True)))
    wide = c.select("*", F.inline(F.when(near_end, F.array(here, there)).otherwise(F.array(here))))
    frame = Window.partitionBy(*S, scan.BLK).orderBy("_upto").rangeBetween(-reach, Window.currentRow)
    shown = wide.withColumn("_items", F.collect_list("text").over(frame)).filter(~F.col("_halo"))
    return shown.withColumn("lines", T.wrap_lines(F.array_join("_items", " "), keep=V.MAX_LINES)).drop("_items", "_upto", "_halo", scan.BLK)


def session_position(cues: DataFrame) -> DataFrame:
    return cues.groupBy("session_id").agg(F.max_by("end_ms", "cue_no").alias("current_ms"),
                                          F.count("*").alias("cue_count"))


def speaker_changes(cues: DataFrame, rows: int = scan.BLOCK_ROWS) -> DataFrame:
    """``shown``: the speaker where it differs from the last one named before, else empty."""
    named = F.when(F.col("speaker") != "", F.col("speaker"))
    c = scan.prefix(scan.seq_blocks(cues, "cue_no", rows), S, ["cue_no"], {"_prev": ("last", named)}, before=True)
    new = named.isNotNull() & (F.col("_prev").isNull() | (F.col("_prev") != named))
    return c.withColumn("shown", F.when(new, F.col("speaker")).otherwise("")).drop("_prev", scan.BLK)


def reading_load(blocks: DataFrame, cps: float = 14.0, min_ms: int = 1200, max_ms: int = 4000) -> DataFrame:
    dwell = F.least(F.greatest(F.col("chars") / cps * 1000, F.lit(float(min_ms))), F.lit(float(max_ms)))
    span = F.col("end_ms") - F.col("start_ms")
    rate = F.when(span > 0, F.col("chars") * 1000 / span)
    return (blocks.withColumn("dwell_ms", F.round(dwell, 3)).withColumn("chars_per_sec", F.round(rate, 6))
                  .withColumn("too_fast", F.coalesce(rate > cps, F.lit(False))))


def cue_feed(cues: DataFrame) -> DataFrame:
    """Push record per cue, keyed by session."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(F.regexp_replace(x, r"(?U)\s", " ")) != "")
    body = F.struct("text", lines.alias("lines"), clock.seconds3(F.col("start_ms")).alias("start"),
                    clock.seconds3(F.col("end_ms")).alias("end"))
    return cues.select(F.col("session_id").cast("string").alias("key"), "cue_no", F.to_json(body).alias("value"))


def merge_captions(speech: DataFrame, sounds: DataFrame) -> DataFrame:
    """Speech captions and bracketed sound captions as one table with a ``source``, numbered by time in each session."""
    cols = ["session_id", "start_ms", "end_ms", "text"]
    both = speech.select(*cols, F.lit("speech").alias("source")).unionByName(
        sounds.select(*cols, F.lit("sound").alias("source")))
    order = ["start_ms", "end_ms", "source", "text"]
    return number_cues(scan.range_blocks(both, S, order), S, order)
