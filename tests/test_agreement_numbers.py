"""Committed words are numbered by the fold itself, over any number of blocks, and read from Arrow as slices."""

import numpy as np
import pyarrow as pa

from cuelake.operators import agreement as G
from cuelake.operators.folds import Words
from cuelake.plans import views as v

SF = "/root/testdata/sf0.001"


def test_numbers_run_on_over_blocks(spark):
    h = v.hypotheses(spark, SF)
    key = lambda r: (r.session_id, r.utterance_id, r.n, r.step, r.text, r.start_ms, r.end_ms)
    whole = sorted(map(key, G.local_agreement(h, 2000).collect()))
    assert whole and sorted(map(key, G.local_agreement(h, 2000, rows=3).collect())) == whole
    seen = {}
    for s, u, n, *_ in whole:
        assert n == seen.get((s, u), -1) + 1
        seen[s, u] = n


def test_one_block_is_neither_staged_nor_numbered_again(spark):
    plan = G.local_agreement(v.hypotheses(spark, SF), 2000)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Window" not in plan


def test_words_as_a_list():
    words = Words(pa.array(["a", "b", "c", "d"]), np.arange(4))
    assert words.tolist() == ["a", "b", "c", "d"]
    assert words[np.array([1, 2])].tolist() == ["b", "c"]
    assert words[np.array([0, 3])].tolist() == ["a", "d"]
    assert words[np.array([], dtype=int)].tolist() == []
