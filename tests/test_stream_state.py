"""State of streams: one value and one timer per key; a mark that a session was reported lasts."""

from datetime import datetime

from pyspark.sql import functions as F

from cuelake.operators import packets as P
from cuelake.plans import stream_queries as Q, views as v
from cuelake.streaming import jobs as J, processors as X


def test_a_session_reported_by_a_poll_is_not_reported_again(spark):
    """Its silence timer runs out before its next polls come: the mark must outlive the timer."""
    polls = [(1, 0, False), (1, 9000, False), (2, 500_000, True), (2, 1_000_000, True), (1, 1_500_000, False), (1, 1_509_000, False)]
    df = spark.createDataFrame([(s, i, t + 1, k) for i, (s, t, k) in enumerate(polls)], "session_id int, event_id bigint, ms bigint, locked boolean")
    s = J.replay(df.withColumn("ts", F.timestamp_millis("ms")), ["session_id"], "event_id", 6, 1).withWatermark("ts", "1 second")
    got = [(r.session_id, r.what) for r in J.drain(X.signal_watchdog_stream(s, 6000, 6000, X.DAY_MS)).collect() if r.session_id == 1]
    assert got == [(1, "never acquired")]


def test_polls_whose_ids_are_not_in_time_order(spark, tmp_path, monkeypatch):
    rows = [(i, datetime(2024, 1, 1 + (i * 7) % 20, 12), i % 3, "view") for i in range(60)]
    e = spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string")
    monkeypatch.setattr(v, "events", lambda spark, sf: e)
    got = sorted((r.session_id, r.t_ms) for r in Q.signal_watchdog_stream(spark, "").collect())
    first = {}
    for _, ts, s, _ in sorted(rows, key=lambda r: r[1]):
        first.setdefault(s, ts)
    base = {r.session_id: r.t for r in e.groupBy(F.col("user_id").alias("session_id")).agg(F.unix_millis(F.min("ts")).alias("t")).collect()}
    assert got == sorted((s, t + 21_600_000) for s, t in base.items()) and len(first) == 3


def test_small_folds_get_rows_and_rollup_gives_one_row_per_fragment():
    assert issubclass(X.RowFoldProcessor, X.FoldProcessor)
    one, packed, words = P.RollUp(), P.PackedRollUp(), ["word"] * 20 + ["caf\u00e9"]
    state, made = one.step(one.start(), 3, words)
    again, row = packed.step(packed.start(), 3, words)
    assert state == again and len(row) == 1 and row[0][0] == 3
    assert [divmod(c, 256) for c in row[0][1]] == [(a, b) for _, _, a, b in made]
