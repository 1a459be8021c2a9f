"""Line-21 byte pairs (608) and DTVCC packets (708): build, pace, decode, audit."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.functions import codec as C, text as T, values as V
from cuelake.operators import scan
from cuelake.operators.folds import fold_blocks
from cuelake.sources.scratch import stage

S = ["session_id"]
PAIRS = "array<struct<b1:int,b2:int>>"


def first_row_init(rows: DataFrame, order: str = "cue_no", reset: Column | None = None,
                   block_rows: int = scan.BLOCK_ROWS) -> DataFrame:
    """``is_init`` (row carries set-up codes) and ``seq`` (0..3) per session, restarting at rows with ``reset``."""
    r = scan.number_rows(scan.seq_blocks(rows, order, block_rows), S, [order], "_n")
    again = F.col("_n") - 1 if reset is None else F.when(reset, F.col("_n") - 1)
    if reset is None:
        at = F.col("_n") - 1
    else:
        r = scan.prefix(r, S, [order], {"_base": ("max", again)}, keep=True)
        at = F.col("_n") - 1 - F.coalesce("_base", F.lit(0))
    return r.withColumn("is_init", at == 0).withColumn("seq", (at % 4).cast("int")).drop("_n", "_base", scan.BLK)


def _numbered(runs: DataFrame, order: list[str], keep: list[str], rows: int) -> DataFrame:
    """Explode ``pairs`` arrays into rows numbered from 0 over the session."""
    r = scan.seq_blocks(runs.withColumn("_k", F.size("pairs").cast("bigint")), order[0], rows)
    r = scan.prefix(r, S, order, {"_base": ("sum", F.col("_k"))}, before=True, keep=True)
    r = r.select(*keep, F.coalesce("_base", F.lit(0)).alias("_base"), F.posexplode("pairs").alias("_i", "_p"))
    return r.select(*keep, (F.col("_base") + F.col("_i")).alias("pair_no"), "_p.b1", "_p.b2")


def encode_608_simple(cues: DataFrame, roll_up: int = 2, rows: int = scan.BLOCK_ROWS) -> DataFrame:
    """Cues with ``lines`` to pairs: mode code on the first cue of a session, then CR and text per line."""
    c = first_row_init(cues, block_rows=rows)
    mode = F.when(F.col("is_init"), F.array(C.control(V.ROLL_UP[roll_up]))).otherwise(F.array().cast(PAIRS))
    body = F.flatten(F.transform("lines", lambda x: F.concat(
        F.array(C.control(V.CARRIAGE_RETURN)), C.text_pairs(x))))
    return _numbered(c.select("session_id", "cue_no", F.concat(mode, body).alias("pairs")),
                     ["cue_no"], ["session_id", "cue_no"], rows)


class Columns:
    """Where each word of a session lands: a space before it, or a new row. State: the column, None before any, and the rows so far."""

    columns = ("frag_no", "words")
    output = ("frag_no bigint", "word_no int", "word string", "spaced boolean", "new_row boolean", "first boolean", "row_no bigint")
    totals = ("rows",)

    def start(self):
        return {"col": None, "rows": 0}

    def states(self):
        return [{"col": c, "rows": 0} for c in (None, *range(V.LINE_WIDTH + 1))]

    def entries(self):
        return F.array(F.lit("col"), F.lit("rows"))

    def step(self, s, frag_no, words):
        col, row, out = s["col"], s["rows"], []
        for i, w in enumerate(words):
            w, first = w[:V.LINE_WIDTH], col is None
            col = col or 0
            spaced = col > 0
            roll = col + spaced + len(w) > V.LINE_WIDTH
            col = len(w) if roll else col + spaced + len(w)
            row += roll
            out.append((int(frag_no), i, w, spaced and not roll, roll, first, row))
        return {"col": col, "rows": row}, out

    def finish(self, s):
        return []


def rollup_layout(fragments: DataFrame, rows: int = scan.BLOCK_ROWS) -> DataFrame:
    """One row per word with the roll-up row it is shown in (``row_no`` from 0)."""
    f = fragments.select("session_id", F.col("frag_no").cast("bigint").alias("frag_no"),
                         T.space_words(F.col("text")).alias("words")).filter(F.size("words") > 0)
    return fold_blocks(scan.seq_blocks(f, "frag_no", rows), S, ["frag_no"], Columns(), keep=True)


def layout_rows(layout: DataFrame) -> DataFrame:
    """Text of each roll-up row as a decoder should show it."""
    items = F.array_sort(F.collect_list(F.struct("frag_no", "word_no", "word")))
    return layout.groupBy("session_id", "row_no").agg(
        C.basic_text(F.array_join(F.transform(items, lambda x: x["word"]), " ")).alias("text"))


def encode_608_rollup(fragments: DataFrame, roll_up: int = 2, rows: int = scan.BLOCK_ROWS) -> DataFrame:
    """Fragments to doubled-control roll-up pairs; words flow across fragments and fill 32-column rows."""
    return encode_layout(rollup_layout(fragments, rows), roll_up, rows)


def encode_layout(placed: DataFrame, roll_up: int = 2, rows: int = scan.BLOCK_ROWS) -> DataFrame:
    """Words of a ``rollup_layout`` to pairs."""
    text = F.concat(F.when(F.col("spaced"), " ").otherwise(""), F.col("word"))
    items = F.array_sort(F.collect_list(F.struct("word_no", text.alias("t"))))
    runs = placed.groupBy("session_id", "frag_no", "row_no").agg(
        F.array_join(F.transform(items, lambda x: x["t"]), "").alias("text"),
        F.max("new_row").alias("new_row"), F.max("first").alias("first"))
    none = F.array().cast(PAIRS)
    setup = F.array(*[C.control(c) for c in (V.ROLL_UP[roll_up],) * 2 + (V.PREAMBLE_ROW15,) * 2])
    feed = F.array(*[C.control(V.CARRIAGE_RETURN)] * 2)
    again = F.col("new_row") & (F.col("row_no") % V.REINIT_ROWS == 0)
    pairs = F.concat(F.when(F.col("new_row"), feed).otherwise(none),
                     F.when(F.col("first") | again, setup).otherwise(none), C.text_pairs(F.col("text")))
    return _numbered(runs.select("session_id", "frag_no", "row_no", pairs.alias("pairs")),
                     ["frag_no", "row_no"], ["session_id", "frag_no"], rows)


def encode_708(cues: DataFrame, service: int = 1, cr: str = "single", rows: int = scan.BLOCK_ROWS) -> DataFrame:
    """Cues with ``lines`` to DTVCC packets; ``cr='reference'`` writes 13 zero bytes for each carriage return."""
    if not 1 <= service <= 6:
        raise ValueError("service must be 1..6")
    c = first_row_init(cues, block_rows=rows)
    ints = lambda xs: F.array(*[F.lit(x).cast("int") for x in xs])
    start = F.when(F.col("is_init"), ints([V.RESET, *V.DEFINE_WINDOW_0, V.SET_WINDOW_0])).otherwise(
        ints([V.SET_WINDOW_0]))
    mark = ints([0] * 13 if cr == "reference" else [13])
    body = F.flatten(F.transform("lines", lambda x: F.concat(mark, C.codes(x))))
    c = c.withColumn("_b", C.service_blocks(F.concat(start, body), service))
    odd = F.size("_b") % 2 == 1
    c = c.withColumn("_b", F.concat(F.col("_b"), F.when(odd, ints([0])).otherwise(ints([0, 0]))))
    code = F.expr("size(_b) div 2 - 1").cast("int")
    c = c.withColumn("oversize", code > 63).withColumn(
        "packet", F.concat(F.array((F.col("seq") * 64 + code.bitwiseAND(F.lit(63))).cast("int")), F.col("_b")))
    return c.select("session_id", "cue_no", "text", "packet", C.spaced_hex(F.col("packet")).alias("raw_hex"),
                    "oversize")


def cc_triples(packets: DataFrame) -> DataFrame:
    """``cc_data``: (type, d1, d2) per byte pair, start type first, odd tail filled with zero."""
    def triples(p: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(p) - 1, F.lit(2)), lambda i: F.struct(
            F.when(i == 0, V.DTVCC_START).otherwise(V.DTVCC_DATA).alias("cc_type"), F.get(p, i).alias("d1"),
            F.coalesce(F.get(p, i + 1), F.lit(0)).alias("d2"),
            F.when(i == 0, "DTVCC_START").otherwise("DTVCC_DATA").alias("type_name")))

    return packets.withColumn("cc_data", T.let(F.col("packet"), triples))


def audit_708(packets: DataFrame, order: str = "cue_no", rows: int = scan.BLOCK_ROWS) -> DataFrame:
    """Decode packet headers from ``raw_hex``; check declared against real length and the sequence per session."""
    b = C.bytes_of_hex(F.col("raw_hex"))
    p = packets.select("session_id", order, b.alias("_b"))
    head = F.get("_b", F.lit(0))
    p = p.select("session_id", order, F.expr("_b[0] div 64").cast("int").alias("seq"), (head % 64).alias("size_code"),
                 (F.size("_b") - 1).alias("body_bytes"))
    p = scan.prefix(scan.seq_blocks(p, order, rows), S, [order], {"_prev": ("last", F.col("seq"))}, before=True, keep=True)
    declared = (F.col("size_code") + 1) * 2
    return p.select("session_id", order, "seq", "size_code", declared.alias("declared_bytes"), "body_bytes",
                    (declared == F.col("body_bytes")).alias("length_ok"),
                    F.coalesce((F.col("_prev") + 1) % 4 == F.col("seq"), F.lit(True)).alias("seq_ok"))


def annotate_pairs(pairs: DataFrame) -> DataFrame:
    """Note per byte pair: control name, characters, or raw hex. The control table has seven fixed rows."""
    table = pairs.sparkSession.createDataFrame(list(V.PAIR_NOTES), "b1 int, b2 int, _name string")
    c1, c2 = F.col("b1").bitwiseAND(F.lit(127)), F.col("b2").bitwiseAND(F.lit(127))
    two = F.format_string("text: %s%s", F.char(c1), F.char(c2))
    one = F.format_string("text: %s + NULL", F.char(c1))
    raw = F.format_string("raw: %02X %02X", "b1", "b2")
    note = (F.when(F.col("_name").isNotNull(), F.col("_name")).when((c1 >= 32) & (c2 >= 32), two)
             .when((c1 >= 32) & (c2 == 0), one).otherwise(raw))
    return pairs.join(F.broadcast(table), ["b1", "b2"], "left").withColumn("note", note).drop("_name")


def packet_stats(pairs: DataFrame) -> DataFrame:
    c1, c2 = F.col("b1").bitwiseAND(F.lit(127)), F.col("b2").bitwiseAND(F.lit(127))
    ctrl = (c1 >= 16) & (c1 <= 31)
    bad = (~C.parity_ok(F.col("b1"))).cast("int") + (~C.parity_ok(F.col("b2"))).cast("int")
    return pairs.groupBy("session_id").agg(
        F.count("*").alias("pairs"), F.count_if(ctrl).alias("control"), F.count_if(c1 >= 32).alias("text"),
        F.count_if((c1 == 0) & (c2 == 0)).alias("null_pairs"), F.count_if(ctrl & (c2 == 0x2D)).alias("crs"),
        F.sum(bad).alias("parity_errors"))


def pace_pairs(pairs: DataFrame, rows: int = scan.BLOCK_ROWS) -> DataFrame:
    """First-in first-out, one pair per frame: the frame each pair leaves in (``pair_no`` dense from 0)."""
    p = scan.prefix(scan.seq_blocks(pairs, "pair_no", rows), S, ["pair_no"],
                    {"_ahead": ("max", F.col("arrival_frame") - F.col("pair_no"))}, keep=True)
    return p.withColumn("frame_no", F.col("pair_no") + F.col("_ahead")).drop("_ahead", scan.BLK)


def frame_grid(paced: DataFrame, chunk: int = 4096) -> DataFrame:
    """Every frame between the first and last scheduled one, made chunk by chunk so no task makes a whole session."""
    span = paced.groupBy("session_id").agg(F.min("frame_no").alias("lo"), F.max("frame_no").alias("hi"))
    parts = span.select("session_id", "lo", "hi", F.explode(F.sequence(
        F.expr(f"lo div {chunk}"), F.expr(f"hi div {chunk}"))).alias("c")).repartition("session_id", "c")
    return parts.select("session_id", F.explode(F.sequence(
        F.greatest("lo", F.col("c") * chunk), F.least("hi", F.col("c") * chunk + chunk - 1))).alias("frame_no"))


def _filled(paced: DataFrame, rows: int, chunk: int = 4096) -> DataFrame:
    """Pairs with the null pairs of the idle frames before each. A gap is told by the frame before, so no grid of frames is made, sorted and joined;
    it is written out chunk by chunk, and no value is longer than a chunk."""
    p = scan.seq_blocks(paced.select("session_id", "frame_no", "b1", "b2"), "frame_no", rows)
    p = scan.prefix(p, S, ["frame_no"], {"_prev": ("last", F.col("frame_no"))}, before=True, keep=True)
    first = F.least(F.coalesce(F.col("_prev") + 1, F.col("frame_no")), F.col("frame_no"))
    p = p.select("session_id", "frame_no", "b1", "b2", first.alias("_lo"))
    p = p.select("*", F.explode(F.sequence(F.expr(f"_lo div {chunk}"), F.expr(f"frame_no div {chunk}"))).alias("_c"))
    at = F.sequence(F.greatest("_lo", F.col("_c") * chunk), F.least("frame_no", F.col("_c") * chunk + chunk - 1))
    sent, null = F.col("_at") == F.col("frame_no"), F.lit(V.NULL)
    return p.select("*", F.explode(at).alias("_at")).select(
        "session_id", F.col("_at").alias("frame_no"), F.when(sent, F.col("b1")).otherwise(null).alias("b1"), F.when(sent, F.col("b2")).otherwise(null).alias("b2"))


def frame_lock(paced: DataFrame, frames: DataFrame | None = None, rows: int = scan.BLOCK_ROWS) -> DataFrame:
    """Exactly one pair per video frame, from the first scheduled one to the last or of given ``frames``; idle frames carry the null pair."""
    if frames is None:
        return _filled(paced, rows)
    grid = frames.select("session_id", "frame_no")
    null = F.lit(V.NULL)
    return grid.join(paced.select("session_id", "frame_no", "b1", "b2"), ["session_id", "frame_no"], "left").select(
        "session_id", "frame_no", F.coalesce("b1", null).alias("b1"), F.coalesce("b2", null).alias("b2"))


def backlog_depth(pushes: DataFrame, rows: int = scan.BLOCK_ROWS) -> DataFrame:
    """Pairs waiting when each push arrives and after it, with no limit.

    ``pushes``: session_id, push_no (dense), frame (arrival), n_pairs.
    """
    p = scan.seq_blocks(pushes, "push_no", rows)
    p = scan.prefix(p, S, ["push_no"], {"_sent": ("sum", F.col("n_pairs"))})
    lead = F.when(F.col("n_pairs") > 0, F.col("frame") - (F.col("_sent") - F.col("n_pairs")))
    p = scan.prefix(p, S, ["push_no"], {"_ahead": ("max", lead)}, before=True, keep=True)
    free = F.col("_ahead") + F.col("_sent") - F.col("n_pairs")
    waiting = F.coalesce(F.greatest(free - F.col("frame"), F.lit(0)), F.lit(0))
    return p.withColumn("before", waiting).withColumn("after", waiting + F.col("n_pairs")).drop(
        "_sent", "_ahead", scan.BLK)


class RollUp:
    """Full roll-up encoder for one session: state (column, rows, set up or not); rows are byte pairs."""

    columns = ("frag_no", "words")
    output = ("frag_no bigint", "k int", "b1 int", "b2 int")

    def __init__(self, roll_up: int = 2):
        self.setup = [(V.CONTROL, c) for c in (V.ROLL_UP[roll_up],) * 2 + (V.PREAMBLE_ROW15,) * 2]

    def start(self):
        return {"col": None, "rows": 0}

    def entries(self):
        return F.array(F.lit("col"), F.lit("rows"))

    #: Seven-bit codes with odd parity; anything outside 0x20-0x7F is a question mark.
    BYTES = [c if c.bit_count() % 2 else c + 128 for c in (x if x >= 0x20 else 0x3F for x in range(128))]

    @classmethod
    def _chars(cls, text: str) -> list[tuple[int, int]]:
        table, other = cls.BYTES, cls.BYTES[0x3F]
        full = [table[c] if c < 128 else other for c in map(ord, text)] + [V.NULL] * (len(text) % 2)
        return list(zip(full[::2], full[1::2]))

    def pairs(self, s, words) -> tuple[dict, list[tuple[int, int]]]:
        """State after a fragment, and its pairs."""
        out, line, rows = [], "", s["rows"]
        after, placed = Columns().step({"col": s["col"], "rows": 0}, 0, words)
        for _, _, w, spaced, roll, first, _ in placed:
            if roll:
                out += self._chars(line) + [(V.CONTROL, V.CARRIAGE_RETURN)] * 2
                line, rows = "", rows + 1
            if first or (roll and rows % V.REINIT_ROWS == 0):
                out += self.setup
            line += " " * spaced + w
        return {"col": after["col"], "rows": rows}, out + self._chars(line)

    def step(self, s, frag_no, words):
        after, out = self.pairs(s, words)
        return after, [(int(frag_no), i, *p) for i, p in enumerate(out)]

    def finish(self, s):
        return []


class PackedRollUp(RollUp):
    """The same pairs, one row per fragment: a pair is ``256 * b1 + b2``."""

    output = ("frag_no bigint", "codes array<int>")

    def step(self, s, frag_no, words):
        after, out = self.pairs(s, words)
        return after, [(int(frag_no), [256 * b1 + b2 for b1, b2 in out])]


def unpacked(fragments: DataFrame) -> DataFrame:
    """Rows of ``PackedRollUp`` to one row per pair, numbered ``k`` from 0 in its fragment."""
    code = F.col("_code")
    return fragments.select("session_id", "frag_no", F.posexplode("codes").alias("k", "_code")).select(
        "session_id", "frag_no", "k", F.shiftright(code, 8).alias("b1"), code.bitwiseAND(F.lit(255)).alias("b2"))


class Backlog(RollUp):
    """Queue with a limit: a push that would pass it clears the queue, leaves two erase codes, resets the encoder."""

    columns = ("push_no", "frame", "words")
    output = ("push_no bigint", "n_pairs int", "before bigint", "after bigint", "reset boolean")

    def __init__(self, limit: int = V.QUEUE_LIMIT, roll_up: int = 2):
        super().__init__(roll_up)
        self.limit = limit

    def start(self):
        return {"q": {"col": None, "rows": 0, "depth": 0, "frame": 0}}

    def entries(self):
        return F.array(F.lit("q"))

    def step(self, s, push_no, frame, words):
        q = s["q"]
        before = max(0, q["depth"] - (int(frame) - q["frame"]))
        enc, made = RollUp.step(self, {"col": q["col"], "rows": q["rows"]}, push_no, words)
        flood = before + len(made) > self.limit
        after = 2 if flood else before + len(made)
        if flood:
            enc = {"col": None, "rows": 0}
        return ({"q": {**enc, "depth": after, "frame": int(frame)}},
                [(int(push_no), len(made), before, after, flood)])


def backlog_resets(pushes: DataFrame, limit: int = V.QUEUE_LIMIT, rows: int = scan.BLOCK_ROWS) -> DataFrame:
    """Queue depth around every push and the pushes that reset it.

    ``pushes``: session_id, push_no, frame, text. Depth depends on every earlier reset, so this is a fold.
    """
    p = pushes.select("session_id", "push_no", "frame", T.space_words(F.col("text")).alias("words")).filter(
        F.size("words") > 0)
    return fold_blocks(scan.seq_blocks(p, "push_no", rows), S, ["push_no"], Backlog(limit), keep=True)


def _decoded(pairs: DataFrame, rows: int) -> DataFrame:
    """What a decoder acts on (see ``dedupe_control``), with the row each pair falls in, the erases and the depth set so far; one staged write.

    A block is summed up by its leading run of one control code, its trailing run, and what the rest of it rolls, erases and sets. Whether the
    leading run goes on from the block before decides which of its copies count; that is settled when blocks are put together.
    """
    c1, c2 = F.col("b1").bitwiseAND(F.lit(127)), F.col("b2").bitwiseAND(F.lit(127))
    p = pairs.select("session_id", "pair_no", c1.alias("c1"), c2.alias("c2")).filter(F.col("c1") != 0)
    p = stage(scan.seq_blocks(p, "pair_no", rows))
    alone = scan.one_block(p)  # then nothing is carried from block to block
    is_control = (F.col("c1") >= 16) & (F.col("c1") <= 31)
    key = F.when(is_control, F.col("c1") * 128 + F.col("c2")).otherwise(-1).cast("int")
    code = F.when(is_control & ~((F.col("c1") <= 23) & (F.col("c2") >= 64)), F.col("c2"))  # no preambles
    in_block = Window.partitionBy(*S, scan.BLK).orderBy("pair_no")
    p = p.withColumns({"is_control": is_control, "_key": key, "code": code, "_n": F.row_number().over(in_block), "_prev": F.lag(key).over(in_block)})
    fresh = ~F.col("is_control") | F.col("_prev").isNull() | (F.col("_prev") != F.col("_key"))
    p = p.withColumn("_run", F.max(F.when(fresh, F.col("_n"))).over(in_block))
    leads = F.col("_run") == 1
    even = (F.col("_n") - F.col("_run")) % 2 == 0
    rolls = lambda c: F.coalesce(c.isin(V.CARRIAGE_RETURN & 127, V.ERASE), F.lit(False)).cast("bigint")
    erases = lambda c: F.coalesce(c == V.ERASE, F.lit(False)).cast("bigint")
    depth = lambda c: F.when(c.isin(*[x & 127 for x in V.ROLL_UP.values()]), c - V.ROLL_UP[2] + 2).cast("int")
    rest = ~leads & even
    blocks = p.groupBy(*S, scan.BLK).agg(
        F.min_by(F.struct("_key", "code"), "_n").alias("lead"), F.count_if(leads).alias("lead_size"), F.max_by("_key", "_n").alias("trail"),
        (F.max("_n") - F.max("_run") + 1).cast("bigint").alias("trail_size"), (F.max("_run") == 1).alias("one_run"),
        F.sum(F.when(rest, rolls(F.col("code"))).otherwise(0)).alias("rolls"), F.sum(F.when(rest, erases(F.col("code"))).otherwise(0)).alias("erases"),
        F.max_by(depth(F.col("code")), F.when(rest & depth(F.col("code")).isNotNull(), F.col("_n"))).alias("depth"))

    def combine(c: Column, b: Column) -> Column:
        goes_on = (b["lead"]["_key"] >= 0) & (c["key"] == b["lead"]["_key"])
        before = F.when(goes_on, c["size"]).otherwise(0)
        kept = F.floor((b["lead_size"] + 1 - before % 2) / 2).cast("bigint")
        led = F.when(kept > 0, b["lead"]["code"])
        return F.struct(
            b["trail"].alias("key"), (F.when(b["one_run"], before).otherwise(0) + b["trail_size"]).alias("size"),
            (c["rolls"] + b["rolls"] + kept * rolls(b["lead"]["code"])).alias("rolls"),
            (c["erases"] + b["erases"] + kept * erases(b["lead"]["code"])).alias("erases"),
            F.coalesce(b["depth"], depth(led), c["depth"]).alias("depth"))

    nothing = F.struct(F.lit(-1).alias("key"), F.lit(0).alias("size"), F.lit(0).alias("rolls"), F.lit(0).alias("erases"), F.lit(None).cast("int").alias("depth"))
    state = "struct<key:int,size:bigint,rolls:bigint,erases:bigint,depth:int>"
    if alone:
        d = p.withColumn("_carry", nothing.cast(state))
    else:
        d = p.join(scan.carries(blocks, S, state, nothing, combine), [*S, scan.BLK])
    joined = leads & F.col("is_control") & (F.col("_carry.key") == F.col("_key"))
    place = F.col("_n") - F.col("_run") + F.when(joined, F.col("_carry.size")).otherwise(0)
    upto = in_block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return d.filter(place % 2 == 0).select(
        "session_id", "pair_no", "c1", "c2", "is_control", "code",
        (F.col("_carry.rolls") + F.sum(rolls(F.col("code"))).over(upto)).alias("row_no"),
        (F.col("_carry.erases") + F.sum(erases(F.col("code"))).over(upto)).alias("erases"),
        F.coalesce(F.last(depth(F.col("code")), ignorenulls=True).over(upto), F.col("_carry.depth")).alias("depth"))


def dedupe_control(pairs: DataFrame, rows: int = scan.BLOCK_ROWS) -> DataFrame:
    """What a decoder acts on: no null pairs, seven-bit codes, and only every odd copy in a run of one control code."""
    return _decoded(pairs, rows).select("session_id", "pair_no", "c1", "c2", "is_control")


def _row_texts(screen: DataFrame, *more: Column) -> DataFrame:
    shown = lambda c: F.when(F.col(c) >= 32, F.char(F.col(c))).otherwise("")  # codes below 0x20 are never printed
    t = F.concat(shown("c1"), shown("c2"))
    t = F.when(F.col("is_control"), "").otherwise(t)
    items = F.array_sort(F.collect_list(F.struct("pair_no", t.alias("t"))))
    return screen.groupBy("session_id", "row_no").agg(
        F.array_join(F.transform(items, lambda x: x["t"]), "").alias("text"), F.max("erases").alias("erases"),
        F.min(F.coalesce("depth", F.lit(2))).alias("depth"), *more)


def decode_rollup(pairs: DataFrame, rows: int = scan.BLOCK_ROWS) -> DataFrame:
    """Transcript rows of a pair stream; rows wiped by an erase code before they rolled up are left out."""
    own, above = (F.struct(r.alias("row_no"), F.lit(w).alias("wiped")) for r, w in ((F.col("row_no"), False), (F.col("row_no") - 1, True)))
    marked = F.when(F.col("code") == 0x2C, F.array(own, above)).otherwise(F.array(own))  # an erase code tells the row above that it is wiped
    screen = _decoded(pairs, rows).select("session_id", "pair_no", "c1", "c2", "is_control", "erases", "depth", F.inline(marked))
    return _row_texts(screen, F.max("wiped").alias("wiped")).filter(~F.col("wiped") & (F.col("text") != "")).select("session_id", "row_no", "text")


def visible_rows(pairs: DataFrame, rows: int = scan.BLOCK_ROWS) -> DataFrame:
    """Rows on screen after the last pair of each session: the last 2..4 since the last erase.

    A row stays as long as it lies within the smallest depth that was set during it and each later row; what a smaller screen
    has dropped does not come back. The screen has four rows at most, so the last four decide.
    """
    texts = _row_texts(_decoded(pairs, rows))
    last = scan.last_rows(texts, S, [F.col("row_no").desc()], "row_no", 4)
    ends = last.groupBy("session_id").agg(
        F.max("erases").alias("_e"), F.collect_list(F.struct(F.col("row_no").alias("r"), F.col("depth").alias("d"))).alias("_later"))
    kept = F.forall("_later", lambda q: q["r"] - F.col("row_no") < q["d"])
    return last.join(ends, "session_id").filter((F.col("erases") == F.col("_e")) & kept & (F.col("text") != "")).select(
        "session_id", "row_no", "text")


def roundtrip_check(fragments: DataFrame, rows: int = scan.BLOCK_ROWS) -> DataFrame:
    """Encode, decode and compare with the layout row by row; one verdict per session."""
    layout = stage(rollup_layout(fragments, rows))
    want = layout_rows(layout).withColumnRenamed("text", "want")
    got = decode_rollup(encode_layout(layout, rows=rows), rows).withColumnRenamed("text", "got")
    both = want.join(got, ["session_id", "row_no"], "full")
    return both.groupBy("session_id").agg(
        F.count("want").alias("rows"), F.count_if(~F.col("want").eqNullSafe(F.col("got"))).alias("wrong_rows"),
        F.max(F.length("got")).alias("widest"))


def extract_cc_pairs(units: DataFrame) -> DataFrame:
    """Field-1 pairs found in access-unit payloads (session_id, au_no, payload BINARY)."""
    mark = b"GA94"

    def found(data: bytes) -> list[tuple[int, int]]:
        out, at = [], data.find(mark)
        while at >= 0:
            count = data[at + 5] & 0x1F if at + 5 < len(data) else 0
            body = data[at + 7:at + 7 + 3 * count]
            triples = zip(body[0::3], body[1::3], body[2::3])
            out += [(x, y) for v, x, y in triples if v & 7 == 4]
            at = data.find(mark, at + len(mark))
        return out

    def scan_units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(s, a, i, *p) for s, a, d in zip(pdf.session_id, pdf.au_no, pdf.payload)
                    for i, p in enumerate(found(bytes(d)))]
            yield pd.DataFrame(rows, columns=["session_id", "au_no", "k", "b1", "b2"])

    kind = units.schema["session_id"].dataType.simpleString()
    return units.select("session_id", F.col("au_no").cast("bigint").alias("au_no"), "payload").mapInPandas(
        scan_units, f"session_id {kind}, au_no bigint, k int, b1 int, b2 int")
