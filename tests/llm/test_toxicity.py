import itertools
import random
import zlib

import numpy as np

from cuelake.llm import toxicity

CLEAN = [f"wort{i}" for i in range(300)]
BAD = ["idiot", "scum"] + [f"lowei{x}" for x in ("en", "st", "ung", "heit", "bar")]


def text(rng, toxic):
    words = [rng.choice(CLEAN) for _ in range(rng.randint(5, 60))]
    for _ in range(3 * toxic):
        words.insert(rng.randrange(len(words)), rng.choice(BAD))
    return " ".join(words) + "."


def test_marginals_against_enumeration():
    rng = np.random.default_rng(0)
    for _ in range(10):
        sizes = rng.integers(1, 7, rng.integers(1, 6))
        n = int(sizes.sum())
        score, trans, start = rng.normal(size=n), rng.normal(size=(2, 2)), rng.normal(size=2)
        first = np.zeros(n, bool)
        first[np.cumsum(sizes) - sizes] = True
        p, begun, moved = toxicity.marginals(score, first, trans, start, pairs=True)
        want, want_begun, want_moved, at = [], np.zeros(2), np.zeros((2, 2)), 0
        for k in map(int, sizes):
            paths = list(itertools.product((0, 1), repeat=k))
            e = np.exp([start[y[0]] + sum(trans[y[i - 1], y[i]] for i in range(1, k)) + sum(score[at + i] * y[i] for i in range(k)) for y in paths])
            for y, w in zip(paths, e / e.sum()):
                want_begun[y[0]] += w
                for i in range(1, k):
                    want_moved[y[i - 1], y[i]] += w
            want += list((e / e.sum()) @ np.array(paths))
            at += k
        assert np.allclose(p, want) and np.allclose(begun, want_begun) and np.allclose(moved, want_moved)


def test_held_out_accuracy_spans_and_cases(shipped, docs):
    rng = random.Random(3)
    toxic = [int(rng.random() < 0.3) for _ in range(600)]
    rows = [(i, text(rng, t)) for i, t in enumerate(toxic)]
    labels = shipped.createDataFrame([(i, t, None) for i, t in enumerate(toxic)] + [(5, None, 1), (None, 1, 1)], "doc_id long, toxic int, text int")
    extra = [(1000, None), (1001, ""), (1002, "wort1 " * 60_000 + "loweiung scum"), (1003, "İ wort2 IDIOT scum"), (None, "wort3"), (1000, None)]
    got = toxicity.document_scores(docs(rows + extra), labels).collect()
    assert len(got) == len(rows) + len(extra) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 600]
    assert len(held) > 60 and all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in held)
    assert sum(r.predicted == toxic[r.doc_id] for r in held) >= 0.97 * len(held)
    by_id = {r.doc_id: r for r in got}
    assert by_id[1000].predicted == by_id[1001].predicted == 0 and by_id[1000].spans == []
    assert by_id[1002].predicted == 1
    (span,) = by_id[1003].spans
    assert "İ wort2 IDIOT scum"[span.start:span.end] == "IDIOT scum"


def test_without_labels_and_empty(shipped, docs):
    none = shipped.createDataFrame([], "doc_id long, toxic int")
    df = docs([(1, "x y"), (2, None)])
    got = toxicity.drop_toxic(df, none)
    assert got.columns == df.columns and got.count() == 2
    assert toxicity.document_scores(docs([]), none).count() == 0


def test_many_tagged_segments_leave_the_untagged_their_share(shipped, monkeypatch):
    monkeypatch.setattr(toxicity, "TAGGED", 30)
    monkeypatch.setattr(toxicity, "UNTAGGED", 20)
    rows = [(k * 7919 % 1000, int(k < 300), k < 200, [f"w{k}"], [k < 200]) for k in range(400)]
    segments = shipped.createDataFrame(rows, "key long, toxic int, tagged boolean, words array<string>, tags array<boolean>")
    drawn = toxicity.draw(segments, 1.0, 1.0).collect()
    assert sum(r.tags == [True] for r in drawn) == 30 and sum(r.tags == [False] for r in drawn) == 20
    assert abs(sum(r.weight for r in drawn if r.tags[0]) - 200) < 1e-9 and abs(sum(r.weight for r in drawn if not r.tags[0]) - 200) < 1e-9
    clean = [r for r in drawn if int(r.words[0][1:]) >= 300]
    assert clean and sum(r.weight for r in toxicity.draw(segments, 1.0, 3.0).collect() if int(r.words[0][1:]) >= 300) == 3 * sum(r.weight for r in clean)


def test_a_weight_is_that_many_copies():
    import pandas as pd
    words, tags = [["a", "scum", "b"], ["a", "b"], ["c"]], [[False, True, False], [False, False], [False]]
    one = next(toxicity._fit_crf(iter([pd.DataFrame({"words": words, "tags": tags, "weight": [2.0, 3.0, 1.0]})])))
    n = [0, 0, 1, 1, 1, 2]
    more = next(toxicity._fit_crf(iter([pd.DataFrame({"words": [words[i] for i in n], "tags": [tags[i] for i in n], "weight": 1.0})])))
    assert np.allclose(one["rest"][0], more["rest"][0])
    assert np.allclose(np.frombuffer(one["weights"][0], "<f4"), np.frombuffer(more["weights"][0], "<f4"), atol=1e-5)
