"""Byte pairs and packets: literal cases and exhaustive parity."""

import random

import pytest
from pyspark.sql import functions as F

from cuelake.functions import codec as C
from cuelake.operators import packets as P


def lines_df(spark, rows):
    return spark.createDataFrame(rows, "session_id int, cue_no bigint, text string, lines array<string>")


def test_parity_all_values(spark):
    got = spark.range(128).select("id", C.odd_parity(F.col("id")).alias("p")).collect()
    assert all(bin(r.p).count("1") % 2 == 1 and r.p & 127 == r.id for r in got)
    assert {r.id: r.p for r in got}[0] == 0x80 and {r.id: r.p for r in got}[0x48] == 0xC8


def test_text_pairs(spark):
    df = spark.createDataFrame([("Hello",), ("Hi",), ("é",), ("",), ("😀x",)], "t string").select(C.text_pairs(F.col("t")))
    got = [[tuple(p) for p in r[0]] for r in df.collect()]
    assert len(got[0]) == 3 and got[1] == [(0xC8, 0xE9)] and got[2] == [(0xBF, 0x80)] and got[3] == []
    assert got[4] == [(0xBF, 0xF8)]


def test_encode_608_simple(spark):
    out = P.encode_608_simple(lines_df(spark, [(1, 1, "", ["Hi", "yo"]), (1, 2, "", ["é"]), (2, 7, "", ["ab"])]))
    got = {}
    for r in out.orderBy("session_id", "pair_no").collect():
        got.setdefault((r.session_id, r.cue_no), []).append((r.b1, r.b2))
    assert got[(1, 1)][:3] == [(0x94, 0x25), (0x94, 0xAD), (0xC8, 0xE9)] and len(got[(1, 1)]) == 5
    assert got[(1, 2)] == [(0x94, 0xAD), (0xBF, 0x80)] and got[(2, 7)][0] == (0x94, 0x25)


def test_encode_708(spark):
    rows = [(1, i, "", ["Hi there"]) for i in range(1, 7)] + [(2, 1, "", ["x" * 32, "y" * 32])]
    out = P.cc_triples(P.encode_708(lines_df(spark, rows))).orderBy("session_id", "cue_no").collect()
    first, second = out[0].packet, out[1].packet
    assert first[1] >> 5 == 1 and first[2] == 0x8F and 0x98 in first and 0x8F not in second
    window = first[3:10]
    assert window == [0x98, 4, 74, 105, 0x71, 31, 9] and window[4] & 15 == 1
    assert [r.packet[0] >> 6 for r in out[:6]] == [0, 1, 2, 3, 0, 1] and out[6].packet[0] >> 6 == 0
    for r in out:
        assert len(r.packet) - 1 == ((r.packet[0] & 63) + 1) * 2
        assert [c.cc_type for c in r.cc_data] == [6] + [7] * (len(r.cc_data) - 1)
    # service blocks of the long packet: 9 set-up bytes, 2 line marks, 64 characters in blocks of at most 31
    p, i, sizes = out[6].packet, 1, []
    while p[i]:
        sizes.append(p[i] & 31)
        i += 1 + (p[i] & 31)
    assert sizes == [31, 31, 13]
    zeros = P.encode_708(lines_df(spark, rows), cr="reference").orderBy("session_id", "cue_no").first().packet
    assert zeros[11:24] == [0] * 13
    with pytest.raises(ValueError):
        P.encode_708(lines_df(spark, rows), service=7)


def test_audit_flags_oversize(spark):
    rows = [(1, 1, "", ["z" * 32] * 5), (1, 2, "", ["ok"])]
    p = P.encode_708(lines_df(spark, rows))
    got = P.audit_708(p).orderBy("cue_no").collect()
    assert [r.length_ok for r in got] == [False, True] and [r.seq_ok for r in got] == [True, True]
    assert [r.oversize for r in p.orderBy("cue_no").collect()] == [True, False]


def test_annotations(spark):
    pairs = [(0x94, 0x25), (0x94, 0xAD), (0x80, 0x80), (0xC8, 0xE9), (0xC8, 0x80), (0x01, 0x02)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, b1 int, b2 int")
    got = [r.note for r in P.annotate_pairs(df).orderBy("i").collect()]
    assert got == ["RU2 — Roll-Up 2 rows", "CR  — Carriage Return", "NULL", "text: Hi", "text: H + NULL", "raw: 01 02"]


@pytest.mark.parametrize("block", [2, 1000])
def test_pacing_is_the_frame_recurrence(spark, block):
    r, rows = random.Random(3), []
    for s in (1, 2):
        at = 0
        for i in range(80):
            at += r.choice([0, 0, 0, 1, 5])
            rows.append((s, i, at, 1, 1))
    df = spark.createDataFrame(rows, "session_id int, pair_no bigint, arrival_frame bigint, b1 int, b2 int")
    paced = P.pace_pairs(df, block)
    got = {(x.session_id, x.pair_no): x.frame_no for x in paced.collect()}
    last = {}
    for s, i, at, _, _ in rows:
        last[s] = max(at, last.get(s, -1) + 1)
        assert got[(s, i)] == last[s]
    frames = P.frame_lock(paced).groupBy("session_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("b1") == 0x80).alias("idle")).collect()
    assert all(x["n"] - x.idle == 80 for x in frames)
    assert P.frame_grid(paced, 7).count() == P.frame_grid(paced).count()


@pytest.mark.parametrize("block", [2, 1000])
def test_control_copies_and_erase(spark, block):
    cr, edm, ru3, null, h, i, j = (0x94, 0xAD), (0x94, 0x2C), (0x94, 0xA6), (0x80, 0x80), (0xC8, 0x80), (0xE9, 0x80), (0x4A, 0x80)
    pairs = [ru3, ru3, h, cr, null, cr, cr, i, edm, edm, j, cr, h, cr, i, cr, j]
    df = spark.createDataFrame([(1, k, *p) for k, p in enumerate(pairs)], "session_id int, pair_no bigint, b1 int, b2 int")
    kept = [r.pair_no for r in P.dedupe_control(df, block).orderBy("pair_no").collect()]
    assert kept == [0, 2, 3, 6, 7, 8, 10, 11, 12, 13, 14, 15, 16]
    assert [r.text for r in P.decode_rollup(df, block).orderBy("row_no").collect()] == ["H", "J", "H", "i", "J"]
    assert [r.text for r in P.visible_rows(df, block).orderBy("row_no").collect()] == ["H", "i", "J"]


def test_extract_cc_pairs_ignores_cut_and_foreign_triples(spark):
    unit = b"\x00GA94\x03\x43\xff\xfc\x94\xad\xfd\x94\xad\xf8\x01\x02xxGA94\x03\x42\xff\xfc\xc8\xe9\xfc\x80"
    df = spark.createDataFrame([("s", 1, unit), ("s", 2, b"none"), ("s", 3, b"GA94")], "session_id string, au_no bigint, payload binary")
    assert [(r.au_no, r.b1, r.b2) for r in P.extract_cc_pairs(df).orderBy("au_no", "k").collect()] == [
        (1, 0x94, 0xAD), (1, 0xC8, 0xE9)]


def _pairs(spark, pairs):
    return spark.createDataFrame([(1, k, *p) for k, p in enumerate(pairs)], "session_id int, pair_no bigint, b1 int, b2 int")


@pytest.mark.parametrize("block", [2, 1000])
def test_rows_dropped_by_a_smaller_screen_stay_dropped(spark, block):
    ru2, ru3, cr, h, i, j = (0x94, 0x25), (0x94, 0x26), (0x94, 0x2D), (0x48, 0), (0x69, 0), (0x4A, 0)
    df = _pairs(spark, [ru3, h, cr, i, cr, j, ru2, ru3])
    assert [r.text for r in P.visible_rows(df, block).orderBy("row_no").collect()] == ["i", "J"]
    df = _pairs(spark, [ru3, h, cr, i, cr, j])
    assert [r.text for r in P.visible_rows(df, block).orderBy("row_no").collect()] == ["H", "i", "J"]


def test_low_codes_are_not_printed(spark):
    df = _pairs(spark, [(0x01, 0x48), (0x0F, 0x69), (0x4A, 0x05)])
    assert [r.text for r in P.decode_rollup(df).collect()] == ["HiJ"]


def decoder(pairs):
    """Pair by pair: kept pairs with row, erases and depth, by the decoder's own rules."""
    last, row, erases, depth, out = None, 0, 0, None, []
    for n, (b1, b2) in enumerate(pairs):
        c1, c2 = b1 & 127, b2 & 127
        if c1 == 0:
            continue
        if 16 <= c1 <= 31:
            if last == (c1, c2):
                last = None
                continue
            last = (c1, c2)
            if not (c1 <= 23 and c2 >= 64):
                row += c2 in (0x2D, 0x2C)
                erases += c2 == 0x2C
                depth = {0x25: 2, 0x26: 3, 0x27: 4}.get(c2, depth)
        else:
            last = None
        out.append((n, row, erases, depth))
    return out


@pytest.mark.parametrize("block", [1, 2, 3, 7, 10_000])
def test_decoding_state_over_any_blocks(spark, block):
    r = random.Random(block)
    sessions = {}
    for s in range(12):
        pairs = []
        while len(pairs) < 60:
            pair = r.choice([(0x94, 0xAD), (0x94, 0x2C), (0x94, 0x25), (0x94, 0xA6), (0x94, 0x27), (0x94, 0xE0), (0x80, 0x80), (0xC8, 0xE9), (0x15, 0x2D)])
            pairs += [pair] * r.choice([1, 1, 2, 2, 3, 5, 9])
        sessions[s] = pairs
    df = spark.createDataFrame([(s, n, *p) for s, ps in sessions.items() for n, p in enumerate(ps)], "session_id int, pair_no bigint, b1 int, b2 int")
    got = {}
    for x in P._decoded(df, block).orderBy("session_id", "pair_no").collect():
        got.setdefault(x.session_id, []).append((x.pair_no, x.row_no, x.erases, x.depth))
    assert got == {s: decoder(ps) for s, ps in sessions.items()}
