"""The pipeline on a small table: every stage against a plain account of what it keeps."""

import hashlib
from collections import Counter

import corpus_pipeline
from cuelake.llm.common import stage


def test_stages(shipped, sf):
    docs = shipped.read.parquet(f"{sf}/documents.parquet").limit(120)
    seen = [docs]
    for name, step in corpus_pipeline.STAGES:
        seen.append(stage(step(shipped, seen[-1], sf), "test-stage"))
    for df in seen[1:-1]:
        assert df.columns == docs.columns
    raw, clean, once, few, mixed, ids = [df.collect() for df in seen]
    assert {tuple(r) for r in clean} <= {tuple(r) for r in raw}
    last = {}
    for r in clean:
        key = "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text or "")
        last[key] = max(last.get(key, r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in once) == sorted(last.values())
    assert {r.doc_id for r in few} <= {r.doc_id for r in once}
    assert max(Counter(r.doc_id for r in mixed).values()) <= 3 and {tuple(r) for r in mixed} <= {tuple(r) for r in few}
    texts = Counter(hashlib.sha256((r.text or "").encode()).hexdigest() for r in mixed)
    assert Counter(r.decoded_sha256 for r in ids) == texts


def test_nulls_empty_texts_repeats_and_an_empty_table(shipped, sf):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    long = " ".join(f"word{i}" for i in range(30))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "Some words here", None, None, 3), (3, long, "en", "a", 9), (3, long, "en", "a", 9),
            (4, long.upper(), "en", None, 9), (5, long + " more", "en", "b", 9), (6, "other words entirely", "en", "b", 9)]
    for given in (rows, []):
        docs = shipped.createDataFrame(given, schema)
        ids = []
        for _, step in corpus_pipeline.STAGES:
            docs = stage(step(shipped, docs, sf), "test-stage")
            ids.append(Counter(r.doc_id for r in docs.collect()))
        # 1 and 2 are equal without a text, 3 and 4 are equal, 5 is near 4; what has no words is in no mix, and the mix need not take all
        assert ids[2] == Counter([2, None, 4, 6] if given else [])
        assert set(ids[4]) <= {None, 4, 6} and max(ids[4].values(), default=0) <= 3 and bool(ids[4]) == bool(given)
