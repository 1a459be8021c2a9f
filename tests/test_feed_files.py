"""Large feeds are dealt over many files."""

from pyspark.sql import functions as F

from cuelake.streaming import jobs as J


def test_a_large_feed_has_more_files(spark, monkeypatch):
    df = spark.range(3000).select((F.col("id") % 2).alias("session_id"), F.col("id").alias("event_id"))
    monkeypatch.setattr(J, "FILE_BYTES", 1 << 11)
    feed = J.replay(df, ["session_id"], "event_id")
    got = J.drain(feed)
    assert got.count() == 3000 and got.distinct().count() == 3000
    files = got.groupBy("session_id").agg(F.count("*").alias("n")).collect()
    assert [r.n for r in files] == [1500, 1500]
    assert len(got.inputFiles()) > 6
