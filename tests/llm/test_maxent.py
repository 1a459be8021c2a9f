import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from cuelake.llm import maxent


def test_exact_unigram_and_better_held_out_score(docs, monkeypatch):
    monkeypatch.setattr(maxent, "BLOCK_TOKENS", 3000)  # several blocks per task
    rng = random.Random(1)
    tongues = [[f"{c}{i}" for i in range(60)] for c in "abc"]
    rows = [(i, " ".join(rng.choice(tongues[i % 3]) for _ in range(rng.randint(0, 120)))) for i in range(500)]
    rows += [(600, None), (601, ""), (602, "A1 a1 É \x1c x" + " zz" * 20_000), (None, "b1"), (3, rows[3][1])]
    got = maxent.language_scores(docs(rows)).collect()
    counts = Counter()
    tokens = [(i, (t or "").encode().lower().split() + [b""]) for i, t in rows]
    for i, ws in tokens:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1:
            counts.update(ws)
    n, v = sum(counts.values()), len(counts)
    want = sorted((-1 if i is None else i, zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1, len(ws), sum(w in counts for w in ws), n,
                   sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) for i, ws in tokens)
    mine = sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got)
    assert [m[:5] for m in mine] == [w[:5] for w in want]
    assert [m[5] for m in mine] == pytest.approx([w[5] for w in want])
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) * 0.9  # log probabilities are negative
    assert all(r.score < 0 for r in got)


def test_no_training_text_and_empty_table(docs):
    only_held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    (r,) = maxent.language_scores(docs([(only_held, "a b")])).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0)
    assert maxent.language_scores(docs([])).count() == 0


def test_classes_sum_to_one():
    """Over all codes, and inside rare classes over known words and one unseen, probabilities sum to 1."""
    rng = np.random.default_rng(0)
    place = maxent.place_words(rng.poisson(1.0, (maxent.FREQUENT, maxent.CONTEXTS + 1)).astype(float))
    assert len({tuple(p) for p in place[:maxent.START]}) == maxent.START
    model = maxent.Model(place, rng.normal(size=(maxent.BUCKETS, maxent.CLASSES + maxent.RARE)).astype(np.float32),
                         rng.normal(size=(maxent.BUCKETS, maxent.MEMBERS)).astype(np.float32))
    back = np.tile([[5, 1540, maxent.START]], (maxent.START, 1))
    assert (10 ** model.log10(np.arange(maxent.START), back)).sum() == pytest.approx(1, abs=1e-4)
    totals = maxent.Totals(100, 10, (30,) * 8, (3,) * 8)
    assert (10 ** totals.in_rare_class(np.array([10.0, 15.0, 5.0, 0.0]), np.zeros(4, int))).sum() == pytest.approx(1)


def test_every_training_position_is_visited_once():
    """Counted by the bias of the class softmax, which every trained position touches."""
    import pyarrow as pa
    sizes = np.array([1, 2, 9, 1, 30, 1, 7])
    held = np.array([False, True, False, False, False, True, False])
    codes = np.arange(sizes.sum()).astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes()
    block = pa.RecordBatch.from_arrays([pa.array([codes]), pa.array([sizes.tolist()], pa.list_(pa.int64())), pa.array([held.tolist()])],
                                       ["codes", "sizes", "held"])
    place = maxent.place_words(np.ones((maxent.FREQUENT, maxent.CONTEXTS + 1)))
    model = maxent.start_model(place, np.ones(maxent.FREQUENT), maxent.Totals(100, 10, (3,) * 8, (3,) * 8))
    seen = 0
    for turn in range(maxent.ROUNDS):
        (by_class, _) = maxent._train(model, turn)[0](iter([block]))
        seen += dict(zip(by_class.column("row").to_pylist(), by_class.column("n").to_pylist()))[0]  # row 0 is the bias
    assert seen == sizes[~held].sum()


def test_thousands_of_words_are_told_apart(docs):
    """Words beyond the first 1,536 have codes, and so a place in the softmaxes, of their own."""
    words = [f"word{i}" for i in range(5000)]
    coded, _, counts = maxent.coded_blocks(docs([(i, " ".join(words[i % 2500:] + words[:i % 2500])) for i in range(4)]))
    found = set()
    for batch in coded.toArrow().to_batches():
        for i in range(batch.num_rows):
            found |= set(maxent._unpack(batch, i)[0].tolist())
    assert len(counts) == 5001 and found == set(range(5001))


def test_row_sums():
    rng = np.random.default_rng(4)
    for most in (1, 3, 200):
        sizes = rng.integers(1, most + 1, 50)
        at, x = rng.integers(0, 90, sizes.sum()), rng.normal(size=(90, 5))
        starts = np.cumsum(sizes) - sizes
        got, order, times = maxent._row_sums(x, at, starts)
        assert times.tolist() == sizes[order].tolist() and sorted(order.tolist()) == list(range(50))
        assert np.allclose(got, np.add.reduceat(x[at], starts, axis=0)[order])
