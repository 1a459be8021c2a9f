"""Keys of one block need no carries: no join; and frames are filled from gaps without a grid."""

import pytest
from pyspark.sql import functions as F

from cuelake.operators import packets as P, scan


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_prefix_of_single_blocks_has_no_join(spark):
    df = spark.range(60).select((F.col("id") % 3).alias("k"), F.col("id").alias("n"))
    specs = {"s": ("sum", F.col("n")), "m": ("max", -F.col("n")), "l": ("last", F.when(F.col("n") % 5 == 0, F.col("n")))}
    for before in (False, True):
        one, many = (scan.prefix(scan.seq_blocks(df, "n", rows), ["k"], ["n"], specs, before, keep=True) for rows in (1000, 4))
        assert "Join" not in plan(one) and "Join" in plan(many)
        cols = ["k", "n", *specs]
        assert sorted(map(tuple, one.select(*cols).collect())) == sorted(map(tuple, many.select(*cols).collect()))


def test_decoder_reads_its_rows_once(spark):
    df = spark.createDataFrame([(1, k, 0x94, 0xAD) if k % 4 == 0 else (1, k, 0xC8, 0xE9) for k in range(20)],
                               "session_id int, pair_no bigint, b1 int, b2 int")
    rows = P.decode_rollup(df)
    assert "Join" not in plan(rows)
    assert rows.count() == 5


@pytest.mark.parametrize("block", [3, 5000, 1 << 20])
def test_frames_from_gaps(spark, block):
    at = {1: [5, 6, 9, 10_000], 2: [0], 3: [7, 4100, 4101, 12_300]}
    paced = spark.createDataFrame([(s, f, 1, 2) for s, fs in at.items() for f in fs], "session_id int, frame_no bigint, b1 int, b2 int")
    locked = P.frame_lock(paced, rows=block)
    got = sorted(map(tuple, locked.collect()))
    assert got == [(s, f, *((1, 2) if f in fs else (0x80, 0x80))) for s, fs in at.items() for f in range(fs[0], fs[-1] + 1)]
    grid = P.frame_grid(paced)
    assert got == sorted(map(tuple, P.frame_lock(paced, grid).collect()))
    if block > 12_300:
        assert "Join" not in plan(locked)
