"""Caption and video alignment: as-of lookups, lag, clock offset, display blocks."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.functions import text as T, values as V
from cuelake.operators import cues as Q, scan
from cuelake.operators.folds import fold_blocks

S = ["session_id"]


def _as_of(ticks: DataFrame, facts: DataFrame, at: str, order: str, value) -> DataFrame:
    """Attach to each tick (session_id, t_ms) the newest fact with ``at <= t_ms`` as column ``_fact``.

    One union and a running last value: no range join, and hot sessions are split by time.
    """
    extra = [c for c in ticks.columns if c not in ("session_id", "t_ms")]
    left = ticks.select("session_id", "t_ms", F.struct(F.lit(1).alias("x"), *extra).alias("_tick"),
                        F.lit(1).alias("_kind"), F.lit(0).cast("bigint").alias("_o"))
    right = facts.select("session_id", F.col(at).alias("t_ms"), F.lit(0).alias("_kind"),
                         F.col(order).cast("bigint").alias("_o"), value.alias("_value"))
    keys = ["t_ms", "_kind", "_o"]
    both = scan.range_blocks(left.unionByName(right, allowMissingColumns=True), S, keys)
    out = scan.prefix(both, S, keys, {"_fact": ("last", F.col("_value"))})
    return out.filter(F.col("_kind") == 1).select("session_id", "t_ms", *[F.col(f"_tick.{c}").alias(c) for c in extra],
                                                  "_fact")


def display_at(ticks: DataFrame, blocks: DataFrame, idle_ms: int = V.IDLE_CLEAR_MS) -> DataFrame:
    """Block on screen at each playhead tick: the newest begun one, cleared when stale."""
    block = F.struct("block_no", "start_ms", "end_ms", "lines")
    t = _as_of(ticks, blocks, "start_ms", "block_no", block)
    shown = F.col("_fact").isNotNull() & (F.col("t_ms") - F.col("_fact.end_ms") <= idle_ms)
    return t.select("session_id", "t_ms", F.when(shown, F.col("_fact.block_no")).alias("block_no"),
                    F.when(shown, F.col("_fact.lines")).alias("lines"))


def replay_tail(ticks: DataFrame, cues: DataFrame, max_chars: int = V.TAIL_CHARS,
                rows: int = scan.BLOCK_ROWS) -> DataFrame:
    """Trailing caption text at each tick, in two lines. Tails are built once per cue, not per tick."""
    tails = Q.running_tails(cues, max_chars, rows)
    t = _as_of(ticks, tails, "start_ms", "cue_no", F.struct("lines"))
    return t.select("session_id", "t_ms", F.coalesce("_fact.lines", F.array().cast("array<string>")).alias("lines"))


def caption_lag(cues: DataFrame, live: DataFrame, target_ms: int = V.TARGET_DELAY_MS,
                min_cache_ms: int | None = None, budget_ms: int = 5000) -> DataFrame:
    """Per session: how far captions trail live audio, and whether they cover the playback delay.

    ``cues`` carry ``committed_ms``; ``live`` has (session_id, audio_ms).
    """
    need = target_ms if min_cache_ms is None else min_cache_ms
    wait = F.col("_wait")
    cues = cues.withColumn("_wait", F.col("committed_ms") - F.col("end_ms"))
    rank = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY _wait)").cast("bigint")
    c = cues.groupBy("session_id").agg(
        F.max_by("end_ms", "cue_no").alias("clock_ms"), F.avg((wait <= budget_ms).cast("double")).alias("in_budget"),
        rank(0.5).alias("median_ms"), rank(0.95).alias("p95_ms"), F.max(wait).alias("worst_ms"))
    share = F.floor(100 * F.col("clock_ms") / F.greatest(F.lit(1000), F.lit(target_ms)))
    return live.join(c, "session_id", "left").select(
        "session_id", F.coalesce("clock_ms", F.lit(0)).alias("clock_ms"),
        (F.col("audio_ms") - F.coalesce("clock_ms", F.lit(0))).alias("lag_ms"), "in_budget", "median_ms", "p95_ms", "worst_ms",
        F.coalesce(F.col("clock_ms") >= need, F.lit(False)).alias("ready"),
        F.coalesce(F.least(F.lit(99), share), F.lit(0)).cast("int").alias("percent"))


def align_clock(positions: DataFrame, sync: DataFrame) -> DataFrame:
    """Video position to stream time: ``video - (live edge - live audio) + nudge``.

    ``sync`` has one row per session: live_edge_ms, server_now_ms, join_epoch_ms, stream_clock_ms, nudge_ms.
    """
    audio = F.coalesce(F.col("server_now_ms") - F.col("join_epoch_ms"), F.col("stream_clock_ms"))
    k = sync.select("session_id", (F.col("live_edge_ms") - audio).alias("k_ms"),
                    F.coalesce("nudge_ms", F.lit(0)).alias("nudge_ms"))
    return positions.join(k, "session_id").select(
        "session_id", "video_ms", (F.col("video_ms") - F.col("k_ms") + F.col("nudge_ms")).alias("t_ms"))


class Pages:
    """Fragments to display blocks of two lines. State: the words, onset and newest end of the open block."""

    columns = ("frag_no", "words", "start_ms", "latest_ms")
    output = ("frag_no bigint", "k int", "text string", "start_ms bigint", "end_ms bigint")
    SENTENCE = re.compile(V.SENTENCE_END)

    def start(self):
        return {"open": None, "frag": None}

    def entries(self):
        return F.array(F.lit("open"), F.lit("frag"))

    def step(self, s, frag_no, words, start_ms, latest_ms):
        block, out = s["open"], []

        def seal():
            out.append((int(frag_no), len(out), block["text"], block["start"], int(latest_ms)))

        for w in words:
            if block:
                col = block["col"] + 1 + len(w)
                lines = block["lines"] + (col > V.LINE_WIDTH)
                if lines > V.MAX_LINES:
                    seal()
                    block = {"text": w, "start": int(start_ms), "lines": 1, "col": len(w)}
                    continue
                block = {"text": f"{block['text']} {w}", "start": block["start"], "lines": lines,
                         "col": len(w) if col > V.LINE_WIDTH else col}
            else:
                block = {"text": w, "start": int(start_ms), "lines": 1, "col": len(w)}
            if self.SENTENCE.search(w) and len(block["text"]) >= V.LINE_WIDTH:
                seal()
                block = None
        return {"open": block, "frag": [int(frag_no), len(out), int(latest_ms)]}, out

    def finish(self, s):
        if not s["open"]:
            return []
        frag, k, latest = s["frag"]
        return [(frag, k, s["open"]["text"], s["open"]["start"], latest)]


def speech_runs(fragments: DataFrame, gap_ms: int = V.FLUSH_GAP_MS, rows: int = scan.BLOCK_ROWS) -> DataFrame:
    """Number runs of fragments without a pause of ``gap_ms``; every run starts with an empty block."""
    f = fragments.withColumn("words", T.space_words(F.col("text"))).filter(F.size("words") > 0)
    f = scan.seq_blocks(f, "frag_no", rows)
    f = scan.prefix(f, S, ["frag_no"], {"_end": ("max", F.col("end_ms"))}, before=True, keep=True)
    pause = F.coalesce(F.col("start_ms") - F.col("_end") >= gap_ms, F.lit(False)).cast("bigint")
    f = scan.prefix(f, S, ["frag_no"], {"run_no": ("sum", pause), "latest_ms": ("max", F.col("end_ms"))}, keep=True)
    return f.drop("_end", scan.BLK)


def _finished(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("chars", F.length("text")).withColumn(
        "lines", T.wrap_lines(F.col("text"), keep=V.MAX_LINES)).drop("text")


def paginate_blocks(fragments: DataFrame, gap_ms: int = V.FLUSH_GAP_MS, rows: int = scan.BLOCK_ROWS) -> DataFrame:
    """Display blocks of at most two 32-column lines per session, numbered from 1."""
    runs = speech_runs(fragments, gap_ms, rows)
    sealed = fold_blocks(scan.seq_blocks(runs, "frag_no", rows), ["session_id", "run_no"], ["frag_no"], Pages(), keep=True)
    numbered = scan.number_rows(scan.seq_blocks(sealed, "frag_no", rows), S, ["frag_no", "k"], "block_no", keep=True)
    return _finished(numbered).select("session_id", "block_no", "start_ms", "end_ms", "lines", "chars")
