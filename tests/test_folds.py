"""Folds: literal cases, row loops written independently, and any block size gives the same rows."""

import random

import pytest
from pyspark.sql import functions as F

from cuelake.operators import agreement as G, folds, packets as P, scan, sounds as L, sync as Y

W = "array<struct<text:string,start_ms:bigint,end_ms:bigint>>"


def run_agreement(spark, steps, delay=0, block=1000):
    """``steps``: (step, [(text, start s, end s)], buffer end s, flush)."""
    rows = [(1, 1, k, [(t, int(a * 1000), int(b * 1000)) for t, a, b in ws], int(end * 1000), flush)
            for k, ws, end, flush in steps]
    df = spark.createDataFrame(rows, f"session_id int, utterance_id int, step int, words {W}, buffer_end_ms bigint, utterance_end boolean")
    out = G.local_agreement(df, int(delay * 1000), block).orderBy("n").collect()
    return [(r.step, r.text) for r in out], out


def hyp(*words, start=0.0):
    return [(" " + w, start + i * 0.5, start + i * 0.5 + 0.4) for i, w in enumerate(words)]


def test_agreement_cases(spark):
    none, _ = run_agreement(spark, [(1, hyp("Hello", "there"), 9, False)])
    assert none == [(2, " Hello"), (2, " there")]                # only the flush after the last step of an open input
    got, _ = run_agreement(spark, [(1, hyp("Hello", "there"), 9, False), (2, hyp("Hello", "there", "world"), 9, False)])
    assert got == [(2, " Hello"), (2, " there"), (3, " world")]
    got, _ = run_agreement(spark, [(1, hyp("the", "cat"), 9, False), (2, hyp("the", "hat"), 9, True)])
    assert got == [(2, " the"), (2, " hat")]
    got, _ = run_agreement(spark, [(1, hyp("end", "of", "sentence"), 9, True)])
    assert got == [(1, " end"), (1, " of"), (1, " sentence")]
    three = hyp("Hello", "there", "world")
    got, _ = run_agreement(spark, [(1, three, 1.0, False), (2, three, 1.0, False), (3, three, 2.0, True)])
    assert got == [(2, " Hello"), (2, " there"), (3, " world")]
    got, _ = run_agreement(spark, [(1, hyp("one", "two"), 9, False), (2, hyp("one", "two"), 9, False),
                                   (3, hyp("two", "three", start=0.95), 9, False), (4, hyp("two", "three", start=0.95), 9, True)])
    assert [t for _, t in got] == [" one", " two", " three"]     # repeated head is dropped


def agreement_loop(steps, delay):
    """Word lists step by step, written without the fold."""
    shown, before, at, out = [], [], 0, []
    for k, ws, end, flush in steps:
        new = [w for w in ws if w[1] * 1000 > at - 100]
        if new and shown and abs(new[0][1] * 1000 - at) < 1000:
            for i in range(1, min(5, len(shown), len(new)) + 1):
                if [x.strip().lower() for x in shown[-i:]] == [w[0].strip().lower() for w in new[:i]]:
                    new = new[i:]
                    break
        done = []
        while len(done) < min(len(new), len(before)):
            w = new[len(done)]
            if w[2] * 1000 > end * 1000 - delay or w[0].strip().lower() != before[len(done)][0].strip().lower():
                break
            done.append(w)
        before = new[len(done):]
        if flush:
            done, before = done + before, []
        if done:
            at = int(done[-1][2] * 1000)
            shown = (shown + [w[0] for w in done])[-50:]
            out += [(k, w[0]) for w in done]
    return out + [(steps[-1][0] + 1, w[0]) for w in before]


@pytest.mark.parametrize("block", [3, 1000])
def test_agreement_any_block(spark, block):
    """A moving buffer over noisy speech with flushes now and then."""
    r = random.Random(12)
    spoken = [r.choice(["the", "cat", "sat", "on", "mats"]) for _ in range(160)]
    steps = []
    for k in range(1, 60):
        last = k * 2.5
        near = [(i, w) for i, w in enumerate(spoken) if last - 12 <= i < last]
        heard = [(" " + (w if r.random() < 0.93 else "noise"), i * 0.5 + r.choice([0, 0.04]), i * 0.5 + 0.4) for i, w in near]
        steps.append((k, heard if r.random() < 0.95 else [], last * 0.5, k % 17 == 0))
    got, _ = run_agreement(spark, steps, 0.6, block)
    want = agreement_loop([(k, [(t, int(a * 1000) / 1000, int(b * 1000) / 1000) for t, a, b in ws], int(e * 1000) / 1000, f)
                           for k, ws, e, f in steps], 600)
    assert got == want and len(got) > 60


def test_agreement_lost_carry(spark):
    """A step without new words loses the carried ones unless they are heard again."""
    got, _ = run_agreement(spark, [(1, hyp("a", "b"), 9, False), (2, [], 9, False), (3, [], 9, True)])
    assert got == []


def test_late_words(spark):
    rows = [(1, 1, k, [(" a", 0, 400), (" b", 500, 900)], 9000, False) for k in (1, 2, 3)]
    df = spark.createDataFrame(rows, f"session_id int, utterance_id int, step int, words {W}, buffer_end_ms bigint, utterance_end boolean")
    assert [(r.step, r.text) for r in G.late_words(df, 0).orderBy("start_ms").collect()] == [(3, " a"), (3, " b")]


def score_rows(seed, sessions=2, windows=120):
    r = random.Random(seed)
    labels = ["Music", "Applause", "Siren", "Speech", "Laughter", "Rain"]
    return [(s, w, x, r.choice([0.05, 0.2, 0.3, 0.4, 0.5, 0.7, 0.7, 0.9])) for s in range(sessions) for w in range(windows)
            for x in labels if r.random() < (0.7 if x != "Rain" else 0.03)]


def fire_loop(rows):
    """The detector as a loop over windows, independent of the fold."""
    names = {"Music": "MUSIC", "Applause": "APPLAUSE", "Siren": "SIREN", "Laughter": "LAUGHTER", "Rain": "RAIN"}
    out = []
    for s in sorted({x[0] for x in rows}):
        memory = {}
        for w in sorted({x[1] for x in rows if x[0] == s}):
            here = {x[2]: x[3] for x in rows if x[0] == s and x[1] == w}
            talk, best = here.get("Speech", 0) >= 0.5, None
            for label, p in here.items():
                if label not in names:
                    continue
                m = memory.setdefault(names[label], {"on": False, "quiet": 0, "at": -99})
                if p >= 0.45:
                    m["quiet"] = 0
                    free = not m["on"] and w - m["at"] >= 8 and not (talk and names[label] not in ("MUSIC", "APPLAUSE"))
                    if free and (best is None or (p, names[label]) > best):
                        best = (p, names[label])
                elif p < 0.25:
                    m["quiet"] += 1
                    if m["quiet"] >= 2:
                        m["on"] = False
            if best:
                memory[best[1]].update(on=True, at=w)
                out.append((s, w * 1000, f"[{best[1]}]", best[0]))
    return sorted(out)


@pytest.mark.parametrize("block", [9, 86_400])
def test_sound_events_any_block(spark, block):
    rows = score_rows(1)
    df = spark.createDataFrame(rows, "session_id int, window_no bigint, label string, prob double")
    got = sorted((r.session_id, r.end_ms, r.text, r.prob) for r in L.sound_events(df, rows=block).collect())
    assert got == fire_loop(rows) and len(got) > 10


def words_of(seed, sessions=3, frags=60):
    r = random.Random(seed)
    vocab = ["a", "be", "see", "word", "longer", "letters", "seven77", "x" * 40, "é", "end.", "why?"]
    return [(s, i, " ".join(r.choice(vocab) for _ in range(r.randint(0, 5)))) for s in range(sessions) for i in range(frags)]


@pytest.mark.parametrize("block", [4, 10_000])
def test_rollup_any_block(spark, block):
    rows = words_of(2) + [(9, i, "seven77") for i in range(40)]           # equal words never fall into step
    df = spark.createDataFrame(rows, "session_id int, frag_no bigint, text string")
    got = {}
    for r in P.encode_608_rollup(df, rows=block).orderBy("session_id", "pair_no").collect():
        got.setdefault(r.session_id, []).append((r.frag_no, r.b1, r.b2))
    for s in {x[0] for x in rows}:
        enc, state, want = P.RollUp(), P.RollUp().start(), []
        for _, i, t in sorted(x for x in rows if x[0] == s):
            if t.split():
                state, made = enc.step(state, i, t.split())
                want += [(f, a, b) for f, _, a, b in made]
        assert got[s] == want
        assert all(bin(x).count("1") % 2 == 1 for _, a, b in want for x in (a, b))


@pytest.mark.parametrize("block", [3, 10_000])
def test_roundtrip_and_screen(spark, block):
    rows = words_of(4)
    df = spark.createDataFrame(rows, "session_id int, frag_no bigint, text string")
    for r in P.roundtrip_check(df, block).collect():
        assert r.wrong_rows == 0 and r.widest <= 32
    seen = P.visible_rows(P.encode_608_rollup(df, rows=block), block).groupBy("session_id").count().collect()
    assert all(r["count"] <= 2 for r in seen)


def test_council_round_trip(spark):
    text = ("The city council meeting will now come to order . Please rise for the pledge of allegiance . Item one on the "
            "agenda is the budget review for fiscal year twenty twenty six .").split()
    rows = [(1, i, " ".join(text[3 * i:3 * i + 3])) for i in range(len(text) // 3 + 1)]
    df = spark.createDataFrame(rows, "session_id int, frag_no bigint, text string")
    shown = [r.text for r in P.visible_rows(P.encode_608_rollup(df)).orderBy("row_no").collect()]
    assert len(shown) <= 2 and all(len(s) <= 32 for s in shown)
    assert all(w in " ".join(shown) for w in ("budget", "review", "fiscal"))


def queue_loop(rows, limit):
    """Frame by frame: one pair leaves per frame."""
    enc, out = P.RollUp(), []
    for s in sorted({r[0] for r in rows}):
        state, queue, now = enc.start(), 0, 0
        for _, i, t, frame in sorted(r for r in rows if r[0] == s):
            if not t.split():
                continue
            while now < frame:
                queue, now = max(0, queue - 1), now + 1
            before = queue
            state, made = enc.step(state, i, t.split())
            flood = queue + len(made) > limit
            queue = 2 if flood else queue + len(made)
            if flood:
                state = enc.start()
            out.append((s, i, before, queue, flood))
    return out


@pytest.mark.parametrize("block", [5, 10_000])
def test_backlog_resets(spark, block):
    rows = [(s, i, t, i * 4) for s, i, t in words_of(6)]
    df = spark.createDataFrame(rows, "session_id int, push_no bigint, text string, frame bigint")
    got = sorted((r.session_id, r.push_no, r.before, r.after, r.reset) for r in P.backlog_resets(df, 60, block).collect())
    assert got == queue_loop(rows, 60) and any(g[4] for g in got)


@pytest.mark.parametrize("block", [2, 10_000])
def test_backlog_depth_without_limit(spark, block):
    rows = [(s, i, t, i * 4) for s, i, t in words_of(6)]
    want = queue_loop(rows, 10 ** 9)
    df = spark.createDataFrame(rows, "session_id int, push_no bigint, text string, frame bigint")
    n = P.backlog_resets(df, 10 ** 9).select("session_id", "push_no", "n_pairs").join(df, ["session_id", "push_no"])
    got = sorted((r.session_id, r.push_no, r.before, r.after) for r in P.backlog_depth(n, block).collect())
    assert got == [w[:4] for w in want]


def page_loop(rows):
    """Blocks by wrapping the growing text anew for every word."""
    def lines(words):
        out, line = [], ""
        for w in words:
            both = f"{line} {w}" if line else w
            if len(both) <= 32:
                line = both
            else:
                out, line = out + [line] if line else out, w
        return out + [line] if line else out
    out = []
    for s in sorted({r[0] for r in rows}):
        cur, onset, newest, blocks = [], None, None, []
        for _, _, t, a, b in sorted(r for r in rows if r[0] == s):
            if not t.split():
                continue
            if newest is not None and a - newest >= 500 and cur:
                blocks.append((onset, newest, cur))
                cur = []
            newest = b if newest is None else max(newest, b)
            for w in t.split():
                if cur and len(lines(cur + [w])) > 2:
                    blocks.append((onset, newest, cur))
                    cur, onset = [w], a
                    continue
                onset = onset if cur else a
                cur = cur + [w]
                if w[-1] in ".?" and len(" ".join(cur)) >= 32:
                    blocks.append((onset, newest, cur))
                    cur = []
        if cur:
            blocks.append((onset, newest, cur))
        out += [(s, i, a, b, lines(c)[-2:], len(" ".join(c))) for i, (a, b, c) in enumerate(blocks, 1)]
    return out


@pytest.mark.parametrize("block", [3, 10_000])
def test_paginate(spark, block):
    r, rows, at = random.Random(8), [], {}
    for s, i, t in words_of(7):
        a = at.get(s, 0) + r.choice([0, 0, 100, 499, 500, 900])
        at[s] = a + r.choice([200, 800])
        rows.append((s, i, t, a, at[s]))
    df = spark.createDataFrame(rows, "session_id int, frag_no bigint, text string, start_ms bigint, end_ms bigint")
    got = sorted((x.session_id, x.block_no, x.start_ms, x.end_ms, x.lines, x.chars) for x in Y.paginate_blocks(df, rows=block).collect())
    assert got == page_loop(rows)


def test_blocks_settle_in_few_rounds(spark, monkeypatch):
    """Ordinary text: a key cut into 30 blocks needs only a few rounds."""
    rounds = []
    real = folds._packed
    monkeypatch.setattr(folds, "_packed", lambda *a: rounds.append(1) or real(*a))
    rows = [r for r in words_of(11, sessions=1, frags=300)]
    df = spark.createDataFrame(rows, "session_id int, frag_no bigint, text string").select(
        "session_id", "frag_no", F.split("text", " ").alias("words"))
    folds.block_starts(scan.seq_blocks(df, "frag_no", 10), ["session_id"], ["frag_no"], P.Columns())
    assert len(rounds) <= 4


def test_equal_words_take_two_passes(spark):
    """A session of equal words in 24 blocks: the same number of jobs as one in 3 blocks, and the columns of a sequential walk."""
    def jobs(n, group):
        df = spark.createDataFrame([(1, i, "seven77") for i in range(n)], "session_id int, frag_no bigint, text string")
        spark.sparkContext.setJobGroup(group, group)
        try:
            got = P.rollup_layout(df, 10).orderBy("frag_no").collect()
        finally:
            spark.sparkContext.setJobGroup("", "")
        state = P.Columns().start()
        for i, r in enumerate(got):
            state, ((_, _, _, spaced, roll, first, row),) = P.Columns().step(state, i, ["seven77"])
            assert (r.spaced, r.new_row, r.first, r.row_no) == (spaced, roll, first, row)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(240, "many blocks") == jobs(30, "few blocks")


def test_carries_put_summaries_together_in_order(spark):
    df = spark.createDataFrame([(k, b, b % 3, f"{k}{b}") for k in (1, 2) for b in range(7)], "k int, _blk bigint, n int, t string")
    start = F.struct(F.lit(0).alias("n"), F.lit("").alias("t"))
    got = scan.carries(df, ["k"], "struct<n:bigint,t:string>", start,
                       lambda c, b: F.struct((c["n"] + b["n"]).alias("n"), F.concat(c["t"], b["t"]).alias("t"))).collect()
    assert {(r.k, r._blk): tuple(r._carry) for r in got} == {
        (k, b): (sum(x % 3 for x in range(b)), "".join(f"{k}{x}" for x in range(b))) for k in (1, 2) for b in range(7)}


def test_fold_input_is_shuffled_after_the_join(spark):
    """The shuffle of a fold must not be dropped as redundant: only then no skewed join can split a block."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a = spark.range(9).select("id", F.lit(0).cast("bigint").alias("_blk"))
        b = folds._sorted(a.join(a.withColumn("x", F.lit(1)), ["id", "_blk"]), ["id", "_blk"], ["x"], [])
        plan = b._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "hashpartitioning(xxhash64(" in plan and "REPARTITION_BY_COL" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_skewed_join_does_not_split_a_block(spark):
    """With adaptive skew splitting forced on, a block must still be folded by one task."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k",
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, x in conf.items():
            spark.conf.set(k, x)
        n = 20_000
        df = spark.range(0, n, 1, 16).select(
            F.when(F.col("id") % 10 == 0, F.col("id") % 7 + 1).otherwise(0).alias("session_id"), F.col("id").alias("frag_no"),
            F.concat(F.lit("word"), F.col("id").cast("string")).alias("text"))
        for block in (4_000, 1 << 20):
            got = P.rollup_layout(df, block)
            assert got.count() == n
            firsts = got.filter("first").groupBy("session_id").count().collect()
            assert len(firsts) == 8 and all(r["count"] == 1 for r in firsts)
    finally:
        for k, x in old.items():
            spark.conf.set(k, x) if x is not None else spark.conf.unset(k)
