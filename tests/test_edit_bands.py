"""The work of error rates grows with the edits that are no missing words, and a segment holds only its own words."""

import random

import numpy as np
from pyspark.sql import functions as F

from cuelake.operators import quality as W
from cuelake.plans import views as v
from tests.test_quality import full_table


def damaged(words, strange=10**6):
    out = []
    for i, w in enumerate(words):
        if i % 11 != 5:
            out += [strange] if i % 13 == 7 else [w, strange + 1] if i % 17 == 9 else [w]
    return out


def test_band_is_narrower_than_the_distance(monkeypatch):
    r = random.Random(2)
    ref = [r.randrange(400) for _ in range(2000)]
    walked, band = [], W._band

    def seen(refs, hyps, below, above, limit):
        walked.append(below + above + 1)
        return band(refs, hyps, below, above, limit)

    monkeypatch.setattr(W, "_band", seen)
    distance, _ = W.edits([np.array(ref)], [np.array(damaged(ref))])
    assert len(walked) == 1 and walked[0] < 0.9 * distance[0]


def test_pairs_of_all_shapes_share_a_table():
    r = random.Random(4)
    pairs = []
    for vocabulary in (1, 2, 4, 40):
        for _ in range(60):
            a = [r.randrange(vocabulary) for _ in range(r.randrange(25))]
            pairs += [(a, [r.randrange(vocabulary) for _ in range(r.randrange(25))]), (a, damaged(a)), (a, a[len(a) // 3:] + a[:len(a) // 3]), (a, a[::-1])]
    distance, substitutions = W.edits(*([np.array(p[side], np.int64) for p in pairs] for side in (0, 1)))
    for (a, b), d, s in zip(pairs, distance, substitutions):
        assert (d, s) == full_table(a, b)[:2]


def test_long_pairs_have_no_glyphs(spark):
    long = " ".join(f"w{k % 40}" for k in range(300))
    df = spark.createDataFrame([(long, long + " x"), ("a b", "a c")], "ref string, hyp string")
    assert sorted(r.distance for r in W.wer_distance(df).collect()) == [1, 1]


def test_a_stretch_is_damaged_as_in_the_whole(spark):
    words = F.array(*(F.lit(f"w{k}") for k in range(200)))
    whole, part = v._heard(words), v._heard(F.slice(words, 61, 60), F.lit(60))
    row = spark.range(1).select(F.slice(whole, 61, 60).alias("a"), part.alias("b")).first()
    assert row.a == row.b and len(row.a) == 60
