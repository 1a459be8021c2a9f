"""Feeds of rows that are built from a table take little room: no staged copy, no shuffled rows, and streams drop their shuffles batch by batch."""

import os
import time

import pytest
from pyspark.sql import functions as F

from cuelake.operators import agreement as G
from cuelake.plans import stream_queries as Q, views as v
from cuelake.sources.scratch import scratch_root
from cuelake.streaming import jobs as J, processors as X

KEYS = ["session_id", "utterance_id"]


COLUMNS = "conv_id bigint, turn bigint, role string, text string"


def turns(nth: int | None) -> list[tuple]:
    """Turns of 0 to 60 words; only those of one session are long, so later slices have rows in few tasks. Every ``nth`` has no number."""
    said = [(c, t, "user", " ".join(f"w{c}x{i % 7}" for i in range(60 if c == 5 else (c * 5 + t * 3) % 14))) for c in range(12) for t in range(4)]
    return [(c, None if nth and i % nth == 0 else t, *rest) for i, (c, t, *rest) in enumerate(said)] + [(3, 9, "user", None)]


@pytest.fixture
def talk(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(J, "SMALL_WEIGHT", 0)
    spark.createDataFrame(turns(None), COLUMNS).write.parquet(f"{tmp_path}/conversations.parquet")
    return str(tmp_path)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def shuffle_blocks(spark) -> set:
    """Shuffle files that this application keeps on disk."""
    store = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ")
    return {b for b in store.split() if b.startswith("shuffle_")}


def left_after(spark, run) -> set:
    before = shuffle_blocks(spark)
    run()
    for _ in range(50):  # files are dropped in the background
        left = shuffle_blocks(spark) - before
        if not left:
            break
        time.sleep(0.1)
    return left


def staged(spark) -> set:
    """Folders with staged copies of a feed's rows."""
    root = scratch_root(spark).removeprefix("file:")
    return {n for n in os.listdir(root) if n.startswith("feed-rows-")} if os.path.isdir(root) else set()


def test_a_drained_stream_leaves_no_shuffle_files(spark):
    df = spark.range(400).select((F.col("id") % 5).alias("session_id"), (F.col("id") + 1).alias("seq"), F.lit("live").alias("kind"), F.lit(None).cast("string").alias("reason"))
    feed = J.replay(df, ["session_id"], "seq")
    assert not left_after(spark, lambda: J.drain(X.lifecycle_stream(feed)))


def test_agreement_query_stages_no_copy_of_its_hypotheses(spark, talk):
    before = staged(spark)
    got = Q.local_agreement_stream(spark, talk)
    assert staged(spark) == before
    assert rows(got) == rows(G.local_agreement(v.hypotheses(spark, talk), 0).select(*got.columns))


def test_late_words_query_stages_no_copy_and_packs_its_words(spark, talk):
    before = staged(spark)
    got = Q.late_words_stream(spark, talk)
    assert staged(spark) == before
    assert got.inputFiles() and all(f.endswith(".zstd.parquet") for f in got.inputFiles())
    want = G.late_words(v.hypotheses(spark, talk), 0).groupBy(*KEYS, "step").agg(F.count("*").alias("late"))
    assert rows(got) == rows(want)


def test_live_captions_keep_neither_a_copy_nor_the_shuffles_of_what_they_stage(spark, talk):
    before, got = staged(spark), []
    h = v.hypotheses(spark, talk).filter("utterance_end")
    want = {(r.session_id, r.utterance_id): r.n for r in h.select(*KEYS, F.size("words").alias("n")).collect()}
    old = spark.conf.get(J.CLEANUP, None)
    assert not left_after(spark, lambda: got.append(Q.live_captions(spark, talk)))
    assert staged(spark) == before and spark.conf.get(J.CLEANUP, None) == old
    assert {(r.session_id, r.utterance_id): r.words for r in got[0].collect()} == want


@pytest.mark.parametrize("most", [1, 40, 1 << 20])
def test_every_batch_is_one_slice(spark, talk, monkeypatch, most):
    """Each slice is one batch, in order of time, however few tasks have rows of it; light steps share a slice."""
    monkeypatch.setattr(J, "SLICE_WEIGHT", most)
    h = v.hypotheses(spark, talk)
    seen = []

    def look(batch, number):
        seen.append(sorted({r.step for r in batch.select("step").collect()}))

    feed = J.replay_built(h, KEYS, "step", F.size("words"))
    q = feed.writeStream.foreachBatch(look).trigger(availableNow=True).start()
    q.awaitTermination()
    steps = sorted({r.step for r in h.select("step").collect()})
    assert [s for part in seen for s in part] == steps and all(seen)
    sizes = {r.step: r.n for r in h.groupBy("step").agg(F.sum(F.size("words")).alias("n")).collect()}
    assert all(len(part) == 1 or sum(sizes[s] for s in part) <= most for part in seen)
    assert len(seen) >= 3
    got = J.drain(X.local_agreement_stream(J.replay_built(h, KEYS, "step", F.size("words")), 0))
    want = G.local_agreement(h, 0)
    assert rows(got.select(*want.columns)) == rows(want)


def test_texts_cross_as_one_value_and_come_back_as_they_were(spark):
    """No stream shuffles an array of strings per hypothesis; marks, escapes and other scripts survive."""
    said = ['say "so"', "back\\slash", "tab\tnew\nline", "", "é漢😀", "#1~", "null", "a,b"]
    words = lambda n: [(w, i * 400, i * 400 + 400) for i, w in enumerate(said[:n])]
    steps = [(1, 1, n, words(n), n * 400, n == len(said)) for n in range(1, len(said) + 1)]
    schema = "session_id int, utterance_id int, step int, words array<struct<text string, start_ms bigint, end_ms bigint>>, buffer_end_ms bigint, utterance_end boolean"
    h = spark.createDataFrame(steps, schema)
    assert X.packed_words(h).schema["texts"].dataType.simpleString() == "string"
    feed = lambda: J.replay(h, KEYS, "step", 2)
    got, want = J.drain(X.local_agreement_stream(feed(), 0)), G.local_agreement(h, 0)
    assert rows(got.select(*want.columns)) == rows(want) and {r.text for r in got.collect()} == set(said)
    late, want = J.drain(X.late_words_stream(feed(), 0)), G.late_words(h, 0)
    assert rows(late.select(*want.columns)) == rows(want) and want.count()


def test_small_feeds_are_dealt_as_before(spark, tmp_path):
    spark.createDataFrame(turns(7), COLUMNS).write.parquet(f"{tmp_path}/conversations.parquet")
    before = staged(spark)
    got = rows(Q.local_agreement_stream(spark, str(tmp_path)))
    assert len(staged(spark) - before) == 1
    h = J.replay(v.hypotheses(spark, str(tmp_path)), KEYS, "step")
    assert got == rows(J.drain(X.local_agreement_stream(h, 0)).select(*KEYS, "n", "step", "text", "start_ms", "end_ms"))


def test_empty_feeds(spark, talk):
    h = v.hypotheses(spark, talk).filter("step < 0")
    assert J.drain(X.local_agreement_stream(J.replay_built(h, KEYS, "step", F.size("words")), 0)).count() == 0
