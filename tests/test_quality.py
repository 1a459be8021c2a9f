"""Word error rates: literal cases and an edit table written out cell by cell."""

import random

import numpy as np
import pytest

from cuelake.operators import quality as W


def full_table(ref, hyp):
    """(distance, S, D, I) by the smallest tuple in every cell."""
    row = [(j, 0, 0, j) for j in range(len(hyp) + 1)]
    for i, a in enumerate(ref, 1):
        new = [(i, 0, i, 0)]
        for j, b in enumerate(hyp, 1):
            d, s, x, y = row[j - 1]
            best = (d, s, x, y) if a == b else (d + 1, s + 1, x, y)
            d, s, x, y = row[j]
            best = min(best, (d + 1, s, x + 1, y))
            d, s, x, y = new[j - 1]
            new.append(min(best, (d + 1, s, x, y + 1)))
        row = new
    return row[-1]


def test_cases(spark):
    rows = [("hello world", "hello world", 0.0), ("hello world", "foo bar", 1.0), ("hello world there", "hello there", 1 / 3),
            ("hello world", "hello big world", 0.5), ("hello world", "", 1.0), ("Hello, WORLD!", "hello world", 0.0)]
    got = W.wer(spark.createDataFrame(rows, "ref string, hyp string, want double")).collect()
    assert all(abs(r.wer - r.want) < 1e-12 for r in got)


def test_empty_reference(spark):
    df = spark.createDataFrame([("", "hello")], "ref string, hyp string")
    r = W.wer(df).first()
    assert r.wer is None and "empty" in r.error
    with pytest.raises(Exception, match="empty"):
        W.wer(df, strict=True).collect()


def test_random_pairs(spark):
    r = random.Random(1)
    rows = [(" ".join(r.choice("abcd") for _ in range(r.randint(1, 12))), " ".join(r.choice("abcd") for _ in range(r.randint(0, 12))))
            for _ in range(300)]
    df = spark.createDataFrame(rows, "ref string, hyp string")
    for x in W.wer_distance(W.wer(df)).collect():
        d, s, de, i = full_table(x.ref.split(), x.hyp.split())
        assert (x.substitutions, x.deletions, x.insertions, x.distance) == (s, de, i, d)


def test_corpus_is_micro_averaged(spark):
    rows = [("a b c d e f g h i j", "a b c d e f g h i j", 1), ("a b", "x y", 1), ("", "q", 1)]
    c = W.corpus_wer(W.wer(spark.createDataFrame(rows, "ref string, hyp string, g int")), ["g"]).first()
    assert abs(c.wer - 2 / 12) < 1e-12 and c.segment_count == 2 and abs(c.accuracy - 10 / 12) < 1e-12


def test_long_texts_and_more_words_than_glyphs(spark, monkeypatch):
    r = random.Random(3)
    ref = [f"w{r.randrange(3000)}" for _ in range(1500)]
    hyp = [w if r.random() > 0.2 else f"x{r.randrange(3000)}" for w in ref if r.random() > 0.1]
    df = spark.createDataFrame([(" ".join(ref), " ".join(hyp)), ("", "a b"), ("a", "")], "ref string, hyp string")
    d, s, de, i = full_table(ref, hyp)
    monkeypatch.setattr(W, "GLYPHS", W.GLYPHS[:50])
    got = {x.ref: x for x in W.wer_distance(W.wer(df)).collect()}
    x = got[" ".join(ref)]
    assert (x.substitutions, x.deletions, x.insertions, x.distance) == (s, de, i, d)
    assert (got[""].distance, got["a"].distance) == (2, 1)


def numbered(*texts):
    ids = {}
    return [np.array([ids.setdefault(w, len(ids)) for w in t], np.int64) for t in texts]


def test_many_substitutions_do_not_spill_into_the_distance():
    n = 3000
    distance, substitutions = W.edits(*([x] for x in numbered([f"a{k}" for k in range(n)], [f"b{k}" for k in range(n)])))
    assert (distance[0], substitutions[0]) == (n, n)


def test_bands_that_have_to_widen(monkeypatch):
    """Shuffled words: the lower bound says nothing, so bands widen until they hold the distance."""
    monkeypatch.setattr(W, "FIRST_MARGIN", 1)
    r = random.Random(8)
    pairs = []
    for _ in range(200):
        ref = [r.choice("abcdefgh") for _ in range(r.randint(0, 40))]
        hyp = r.sample(ref, len(ref)) if r.random() < 0.5 else [r.choice("abcdefghij") for _ in range(r.randint(0, 40))]
        pairs.append((ref, hyp))
    both = [numbered(ref, hyp) for ref, hyp in pairs]
    distance, substitutions = W.edits([x for x, _ in both], [y for _, y in both])
    want = [full_table(ref, hyp)[:2] for ref, hyp in pairs]
    assert list(zip(distance.tolist(), substitutions.tolist())) == want


def test_a_text_of_20000_words():
    """Blocks moved about, words dropped, replaced and added; against the whole edit table, row by row."""
    r = random.Random(5)
    ref = [f"w{min(r.randrange(5000), r.randrange(5000))}" for _ in range(20_000)]
    hyp = [x for w in ref for x in ([] if r.random() < 0.08 else ["zz"] if r.random() < 0.08 else [w, "qq"] if r.random() < 0.05 else [w])]
    a, b = numbered(ref, hyp)
    unit = 1 << 20
    steps = np.arange(len(b) + 1) * unit
    row = steps
    for i, w in enumerate(a):
        best = np.empty_like(row)
        best[0] = (i + 1) * unit
        best[1:] = np.minimum(row[:-1] + np.where(b == w, 0, unit + 1), row[1:] + unit)
        row = np.minimum.accumulate(best - steps) + steps
    distance, substitutions = W.edits([a], [b])
    assert divmod(int(row[-1]), unit) == (distance[0], substitutions[0])


def test_missing_transcripts(spark):
    rows = [(1, "a b c", None), (2, "a b", "a x"), (3, None, "q"), (4, None, None), (5, "a", "")]
    scored = W.wer(spark.createDataFrame(rows, "id int, ref string, hyp string"))
    got = {r.id: (r.wer, r.deletions, r.ref_words, r.hyp_words, r.error) for r in scored.collect()}
    assert got == {1: (1.0, 3, 3, 0, None), 2: (0.5, 0, 2, 2, None), 5: (1.0, 1, 1, 0, None),
                   3: (None, None, 0, 1, "Reference transcript is missing"), 4: (None, None, 0, 0, "Reference transcript is missing")}
    c = W.corpus_wer(scored, []).first()
    assert (c.segment_count, c.ref_words, c.deletions, c.substitutions) == (3, 6, 4, 1) and abs(c.wer - 5 / 6) < 1e-12
    assert {r.id: r.distance for r in W.wer_distance(scored).collect()} == {1: 3, 2: 1, 3: None, 4: None, 5: 1}


def test_equal_pairs_go_to_different_tasks(spark):
    from pyspark.sql import functions as F
    df = spark.range(400).select("id", F.lit("a b c").alias("ref"), F.lit("a c").alias("hyp"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert W.wer(df).select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
