"""Running values, trailing frames and top rows against plain Python, with blocks far smaller than a key."""

import random

import pytest
from pyspark.sql import functions as F

from cuelake.operators import scan


def table(spark, seed, gaps=False):
    """Three keys; one holds two thirds of the rows."""
    r = random.Random(seed)
    rows = []
    for key, n in ((1, 200), (2, 60), (3, 1)):
        seq = sorted(r.sample(range(n * 3), n)) if gaps else range(n)
        rows += [(key, s, r.choice([None, 1, 2, 5, -3])) for s in seq]
    r.shuffle(rows)
    return rows, spark.createDataFrame(rows, "k int, seq bigint, x int")


@pytest.mark.parametrize("block", [7, 10_000])
@pytest.mark.parametrize("before", [False, True])
def test_prefix(spark, block, before):
    rows, df = table(spark, block, gaps=True)
    out = scan.prefix(scan.seq_blocks(df, "seq", block), ["k"], ["seq"], {
        "s": ("sum", F.col("x")), "m": ("max", F.col("x")), "l": ("last", F.col("x")), "n": ("sum", F.lit(1))}, before)
    got = {(r.k, r.seq): (r.s, r.m, r.l, r.n) for r in out.collect()}
    for key in (1, 2, 3):
        seen = []
        for _, seq, x in sorted(
                (t for t in rows if t[0] == key), key=lambda t: t[1]):
            if not before:
                seen.append(x)
            known = [v for v in seen if v is not None]
            want = (sum(known) if known else None, max(known, default=None), known[-1] if known else None,
                    len(seen) or None)
            assert got[(key, seq)] == want
            if before:
                seen.append(x)


def test_range_blocks_split_a_heavy_key(spark):
    df = spark.range(3000).select((F.col("id") % 10 > 1).cast("int").alias("k"), F.col("id").alias("t"))
    b = scan.range_blocks(df, ["k"], ["t"], 6)
    assert b.filter("k = 1").select(scan.BLK).distinct().count() > 3
    n = scan.number_rows(b, ["k"], ["t"], "n")
    assert n.groupBy("k").agg(F.max("n").alias("m"), F.countDistinct("n").alias("d")).filter("m <> d").count() == 0
    assert n.filter("k = 1").orderBy("t").select("n").limit(3).collect() == [(1,), (2,), (3,)]


@pytest.mark.parametrize("block", [5, 10_000])
def test_trailing(spark, block):
    rows, df = table(spark, 3)
    out = scan.trailing(df, ["k"], "seq", 3, {"c": F.count("x"), "t": F.sum("x")}, block)
    got = {(r.k, r.seq): (r.c, r.t) for r in out.collect()}
    assert len(got) == len(rows)
    by = {(k, s): x for k, s, x in rows}
    for (k, s), v in got.items():
        w = [by[(k, i)] for i in range(max(0, s - 2), s + 1) if by[(k, i)] is not None]
        assert v == (len(w), sum(w) if w else None)


def test_last_rows_plan_limits_before_the_shuffle(spark):
    _, df = table(spark, 4)
    out = scan.last_rows(df, ["k"], [F.col("seq").desc()], "seq", 5)
    assert sorted((r.k, r.seq) for r in out.collect()) == sorted(
        [(1, i) for i in range(195, 200)] + [(2, i) for i in range(55, 60)] + [(3, 0)])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_ordered_parts(spark):
    df = spark.createDataFrame([(1, i, f"t{i}") for i in range(10)], "k int, i int, t string")
    got = {r.part_no: r.x for r in scan.ordered_parts(df, ["k"], "i", "t", "-", "x", 4).collect()}
    assert got == {0: "t0-t1-t2-t3", 1: "t4-t5-t6-t7", 2: "t8-t9"}
