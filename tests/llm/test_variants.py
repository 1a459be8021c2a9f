import random
import zlib
from collections import Counter

import pytest

from cuelake.llm import variants


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows):
    import re
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{low}".encode())
            if h % 31 == 0:
                at = h % len(low)
                low = low[:at] + low[at + 1:]
            n[low] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def run(df):
    rows = variants.spelling_variants(df).collect()
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(got) == len(rows)
    return got


def corpus(seed, docs=60):
    """Words in chains of rarer and rarer misspellings, accents, prefixes that very many share, and ties."""
    rng = random.Random(seed)
    edit = lambda w: rng.choice([lambda i: w[:i] + rng.choice("abeéÿ") + w[i:], lambda i: w[:i] + w[i + 1:], lambda i: w[:i] + rng.choice("abeé") + w[i + 1:]])(rng.randrange(len(w)))
    words = []
    for _ in range(12):
        w, n = "".join(rng.choice("abeéÀÿ") for _ in range(rng.randint(6, 12))), 300
        while n:
            words += [w] * n
            words += [edit(w) for _ in range(n // 20)] * 2
            w, n = edit(w), n // 12
    words += ["intern" + "".join(rng.choice("abcd") for _ in range(rng.randint(1, 6))) for _ in range(600)]
    words += ["MIXEDcase", "mixedCASE", "×÷ÀÁÂÃÄ", "short", "aaaaaaa", "aaaaaaaa", "aaaaaaaaa"] * 3
    rng.shuffle(words)
    return [(i if i % 9 else None, " ".join(words[i::docs])) for i in range(docs)] + [(900, None), (901, ""), (902, "x" * 50_000), (902, "x" * 50_000)]


@pytest.mark.parametrize("block", [1024, 5])
def test_like_brute_force(docs, monkeypatch, block):
    monkeypatch.setattr(variants, "BLOCK", block)  # read by the worker's copy of _cut, which is pickled with its module
    rows = corpus(1)
    want = brute(rows)
    got = run(docs(rows))
    assert got == want
    assert any(r != f and f for f, r, *_ in want.values()) and max(k[3] for k in want.values()) > 5


def test_blocks_are_cut(docs, monkeypatch, shipped):
    monkeypatch.setattr(variants, "BLOCK", 5)
    words = shipped.createDataFrame([("intern" + a + b + c, 2) for a in "abc" for b in "abc" for c in "abc"], "word string, n long")
    got = {(r.word, r.other) for r in variants.near_words(words).collect()}
    all_words = [r.word for r in words.collect()]
    assert got == {(a, b) for a in all_words for b in all_words if one_edit(a, b)}


def test_sorted_list_against_all_pairs():
    rng = random.Random(4)
    for _ in range(200):
        words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(0, 7))) for _ in range(40)})
        known = variants.SortedList(words)
        for i, w in enumerate(words):
            assert list(known.one_edit(w, i + 1)) == [j for j in range(i + 1, len(words)) if one_edit(w, words[j])]
            assert list(known.one_edit(w)) == [j for j, v in enumerate(words) if one_edit(w, v)]
        assert list(known.one_edit("abba")) == [j for j, v in enumerate(words) if one_edit("abba", v)]


def test_empty(docs):
    assert run(docs([])) == {} and run(docs([(1, None), (2, "")])) == {}


def test_chain_of_forms(docs):
    rows = [(i, "station") for i in range(400)] + [(1000 + i, "stations") for i in range(30)] + [(2000, "stationss stationss")]
    got, want = run(docs(rows)), brute(rows)
    assert got == want
    assert got["stationss"][:2] == ("stations", "station") or "stationss" not in want
