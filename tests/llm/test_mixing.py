import random

import pytest

from cuelake.llm import mixing


def brute_targets(sizes, most=3, weights=(5, 2, 1)):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    target, left, open_ = {}, sum(sizes.values()), set(names)
    while open_:
        share = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        full = [s for s in open_ if share[s] > most * sizes[s]]
        if not full:
            return target | share
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
            open_.remove(s)
    return target


def test_targets_and_takes(docs):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randint(0, 60), rng.choice(["a", "b", "c", "é", "Z", None])) for i in range(400)] + [(7, "w " * 9, "a"), (None, None, "b")]
    got = mixing.mix_totals(docs(rows)).collect()
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = brute_targets(sizes)
    assert len(got) == len(rows)
    by_target = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and (r.first_position is None) == (r.taken == 0)
        by_target.setdefault((r.source_size, r.target), []).append(r.taken)
    assert sorted(t for _, t in by_target) == pytest.approx(sorted(want.values()))
    for (_, target), taken in by_target.items():
        assert abs(sum(taken) - target) <= 1


def test_positions_follow_the_schedule(docs):
    """At every time, the words placed so far of each source are the integral of its schedule."""
    rows = [(i, "w " * 10, s) for i, s in enumerate(["a", "b", "c"] * 300)]
    got = mixing.curriculum(docs(rows)).collect()
    assert [r.position for r in got] == sorted(r.position for r in got)
    for source, knots in zip("abc", mixing.SCHEDULES):
        mine = [r.position for r in got if r.source == source]
        (_, w0), (_, w1) = knots
        for u in (0.25, 0.5, 0.75):
            part = (w0 * u + (w1 - w0) * u * u / 2) / mixing.integral(knots)
            assert sum(p < u for p in mine) / len(mine) == pytest.approx(part, abs=0.02)


def test_mixed_documents(docs):
    df = docs([(i, "w " * 20, "ab"[i % 2]) for i in range(60)] + [(3, "w " * 20, "b"), (99, None, "a")])
    got = mixing.mixed_documents(df)
    assert got.columns == df.columns
    words = {}
    for r in got.collect():
        words[r.source] = words.get(r.source, 0) + 20
    total = 61 * 20
    assert abs(words["a"] - total * 5 / 7) <= 60 and abs(words["b"] - total * 2 / 7) <= 60


def test_empty_and_wordless(docs):
    assert mixing.mix_totals(docs([])).count() == 0
    assert [(r.taken, r.target) for r in mixing.mix_totals(docs([(1, ""), (2, None)])).collect()] == [(0, 0.0)] * 2
