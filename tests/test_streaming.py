"""Streams give the rows of the batch form, however the input is cut into micro-batches."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cuelake.operators import agreement as G, sounds as L, sync as Y
from cuelake.plans import views as v
from cuelake.streaming import jobs as J, processors as X


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("slices", [1, 4])
def test_agreement(spark, sf, slices):
    h = v.hypotheses(spark, sf).filter("session_id < 4")
    s = J.drain(X.local_agreement_stream(J.replay(h, ["session_id", "utterance_id"], "step", slices), 2000))
    b = G.local_agreement(h, 2000)
    assert rows(s.select(*b.columns)) == rows(b)


@pytest.mark.parametrize("slices", [2, 5])
def test_sounds_from_maps(spark, sf, slices):
    """The map form for streams scores like the exploded batch form."""
    scores = v.sounds(spark, sf)
    maps = scores.groupBy("session_id", "window_no").agg(F.map_from_entries(F.collect_list(F.struct("label", "prob"))).alias("scores"))
    s = J.drain(X.sound_events_stream(X.window_scores(J.replay(maps, ["session_id"], "window_no", slices))))
    b = L.sound_events(scores)
    text = F.concat(F.lit("["), "caption", F.lit("]"))
    assert rows(s.select("session_id", F.col("time_ms"), text, "prob")) == rows(b.select("session_id", "end_ms", "text", "prob"))


def test_pages_with_timer(spark):
    """The event-time timer closes the last block of a session once the watermark has passed its pause."""
    f = [(1, i, "word " * 3, i * 1000, i * 1000 + 900) for i in range(6)] + [(2, 0, "late", 60_000, 60_500), (2, 1, "later", 120_000, 120_500)]
    df = spark.createDataFrame(f, "session_id int, frag_no bigint, text string, start_ms bigint, end_ms bigint")
    df = df.withColumn("ts", F.timestamp_millis("end_ms"))
    s = J.drain(X.paginate_stream(J.replay(df, ["session_id"], "end_ms", 3).withWatermark("ts", "1 second")))
    b = Y.paginate_blocks(df).drop("block_no")
    got, want = rows(s.select(*b.columns).filter("session_id = 1")), rows(b.filter("session_id = 1"))
    assert got == want and len(want) >= 1


def test_watchdog_reports_silence(spark):
    p = [(1, 0, 0, True), (1, 1, 2000, True), (2, 2, 2500, False), (3, 3, 2600, True), (3, 4, 90_000, True)]
    df = spark.createDataFrame(p, "session_id int, event_id bigint, ms bigint, locked boolean").withColumn("ts", F.timestamp_millis("ms"))
    s = J.replay(df, ["session_id"], "event_id", 5, 1).withWatermark("ts", "1 second")
    got = {(r.session_id, r.t_ms, r.what) for r in J.drain(X.signal_watchdog_stream(s, 6000, 6000)).collect()}
    assert (1, 8000, "lost") in got and (2, 8500, "never acquired") in got


def test_state_is_empty_after_all_utterances_ended(spark, sf, tmp_path):
    h = v.hypotheses(spark, sf).filter("session_id < 3")
    mark = str(tmp_path / "mark")
    s = J.drain(X.local_agreement_stream(J.replay(h, ["session_id", "utterance_id"], "step", 3), 0), mark)
    assert s.count() > 0
    left = spark.read.format("statestore").option("path", mark).option("stateVarName", "fold").load()
    assert left.count() == 0


def test_rows_that_come_late_or_again_are_left_out(spark):
    rows = [(1, 1, "live", None, 0), (1, 3, "end", "eos", 1), (1, 2, "live", None, 2), (1, 3, "end", "eos", 2), (2, 5, "live", None, 0), (2, 6, "end", "boom", 2)]
    df = spark.createDataFrame(rows, "session_id int, seq bigint, kind string, reason string, arrived int")
    got = J.drain(X.lifecycle_stream(J.replay(df, ["session_id"], "arrived", 3, 1)))
    assert sorted((r.session_id, r.seq, r.status) for r in got.collect()) == [(1, 1, "live"), (1, 3, "ended"), (2, 5, "live"), (2, 6, "error")]
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    try:  # with a time to live the rows are the same
        again = J.drain(X.lifecycle_stream(J.replay(df, ["session_id"], "arrived", 3, 1), ttl_ms=3_600_000))
        assert again.count() == 4
    finally:
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def test_watchdog_with_silence_over_any_slices(spark):
    polls = [(1, 0, True), (1, 3000, True), (1, 12_000, True), (2, 0, False), (2, 5000, False), (2, 6000, False), (3, 0, True), (3, 6000, True), (4, 100, False)]
    df = spark.createDataFrame([(s, i, t + 1, k) for i, (s, t, k) in enumerate(polls)], "session_id int, event_id bigint, ms bigint, locked boolean")
    df = df.withColumn("ts", F.timestamp_millis("ms"))
    closing = {"session_id": -1, "event_id": 99, "ms": 0, "locked": True, "ts": datetime(2050, 1, 1)}
    for slices in (1, 3):
        s = J.replay(df, ["session_id"], "ms", slices, 1, closing).withWatermark("ts", "1 hour")
        got = {(r.session_id, r.t_ms, r.what) for r in J.drain(X.signal_watchdog_stream(s, 6000, 6000)).collect() if r.session_id > 0}
        assert got == {(1, 9001, "lost"), (2, 6001, "never acquired"), (3, 12_001, "lost"), (4, 6101, "never acquired")}
