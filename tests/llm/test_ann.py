import numpy as np
import pytest
from pyspark.sql import functions as F

from cuelake.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int, cell string, c1 long"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, "c", 1) for i, v in rows], SCHEMA)


def brute(rows, k=5):
    rows = sorted({(i, tuple(np.float32(v).astype(float))) for i, v in rows})
    out = {}
    for q, x in rows:
        if q % 50 == 0:
            x = np.array(x)
            near = sorted((-float(np.dot(x, v)) / (float(np.sqrt(np.dot(x, x))) * float(np.sqrt(np.dot(v, v)))), i)
                          for i, v in ((i, np.array(v)) for i, v in rows) if i != q and len(v) == len(x))
            out[q] = [(i, -s) for s, i in near[:k]]
    return out


def test_recall_ties_and_unusable_vectors(shipped):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=16)) for i in range(1500)]
    same = rng.normal(size=16)
    rows += [(i, same) for i in range(2000, 2103)] + [(3000, np.ones(3)), (3001, np.ones(3) * 2)]
    bad = [(50_000, None), (50_050, []), (50_100, [0.0] * 16), (50_150, [float("nan")] * 16), (50_200, [None] * 16), (50_250, [float("inf")] * 16)]
    got = {}
    for r in ann.nearest(frame(shipped, rows + bad + [(None, same), (2050, same)]), F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute(rows)
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.95 * sum(map(len, want.values()))
    assert [i for i, _ in got[2050]] == [2000, 2001, 2002, 2003, 2004] and [i for i, _ in got[2000]] == [2001, 2002, 2003, 2004, 2005]
    assert [i for i, _ in got[3000]] == [3001]
    exact = {q: dict(brute([r for r in rows if len(r[1]) == 16], k=10 ** 6)[q]) for q in (0, 50)}
    assert all(abs(exact[q][i] - s) < 1e-12 for q in (0, 50) for i, s in got[q])


def test_cells_split_into_slots(shipped, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=4) * 0.01 + 1) for i in range(0, 400)]
    whole = sorted(tuple(r) for r in ann.nearest(frame(shipped, rows), F.col("vec_id") % 50 == 0).collect())
    monkeypatch.setattr(ann, "SHARD", 16)
    assert sorted(tuple(r) for r in ann.nearest(frame(shipped, rows), F.col("vec_id") % 50 == 0).collect()) == whole


def test_probes_begin_at_home_and_cost_rises():
    h = ann.Hasher(8)
    unit = np.random.default_rng(1).normal(size=(50, 8))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    cells, probes = h.cells(unit), h.probes(unit)
    assert (probes[:, :, 0] == cells).all()
    assert all(len(set(p)) == ann.PROBES for row in probes for p in row)


def test_empty(shipped):
    assert ann.nearest(frame(shipped, []), F.col("vec_id") % 50 == 0).count() == 0


def answers(shipped, rows, asked):
    got = {}
    for r in ann.nearest(frame(shipped, rows), asked).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    return got


@pytest.mark.parametrize("n", [2, 3, 7, 10])
def test_few_vectors_are_all_found(shipped, n):
    rng = np.random.default_rng(n)
    rows = [(i * 50, rng.normal(size=64)) for i in range(n)]
    assert answers(shipped, rows, F.lit(True)) == {q: [i for i, _ in near] for q, near in brute(rows).items()}


def test_opposite_and_rare_lengths(shipped):
    rng = np.random.default_rng(9)
    v = rng.normal(size=32)
    rows = [(0, v)] + [(i, -v + rng.normal(size=32) * 0.1) for i in range(1, 40)] + [(50, [1.0, 2.0]), (51, [-2.0, -1.0])]
    got = answers(shipped, rows, F.col("vec_id") % 50 == 0)
    assert got == {q: [i for i, _ in near] for q, near in brute(rows).items()} and got[50] == [51]


def test_many_parallel_vectors(shipped):
    rng = np.random.default_rng(11)
    v = np.float32(rng.normal(size=16))
    twos = [(i, v * np.float32(2.0) ** (i % 41 - 20)) for i in range(1, 41)] + [(50, v)]
    assert answers(shipped, twos, F.col("vec_id") == 50) == {50: [1, 2, 3, 4, 5]}
    v = np.float32(np.arange(1, 17))
    threes = [(i, v * np.float32(2 * i + 1)) for i in range(1, 41)] + [(100, v)]
    assert all(len(a) == 5 and max(a) <= 12 for a in answers(shipped, threes, F.col("vec_id") == 100).values())
