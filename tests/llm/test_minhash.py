import random

from cuelake.llm import graph, minhash


def brute(rows):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w)} if 0 < len(w) < 5 else set(zip(w, w[1:], w[2:], w[3:], w[4:])))
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted((d, len(s), least[find(i)] if s else d, d == (least[find(i)] if s else d)) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def test_against_all_pairs(docs):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    passage = [rng.choice(words) for _ in range(40)]
    rows = []
    for k in range(40):
        base = [rng.choice(words) for _ in range(rng.randint(3, 120))]
        if k % 3 == 0:
            base[len(base) // 2:len(base) // 2] = passage
        for _ in range(rng.randint(1, 5)):
            text = list(base)
            for _ in range(rng.randint(0, 4)):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append(" ".join(text))
    drift = [rng.choice(words) for _ in range(100)]
    for k in range(30):  # a chain in which only neighbours are alike
        drift = drift[4:] + [rng.choice(words) for _ in range(4)]
        rows.append(" ".join(drift))
    rows += ["", None, " \t\n", "one two", "ONE Two", "É x", "é x", "a\x0bb\x1cc d", "long " * 30_000, rows[0], rows[0]]
    rng.shuffle(rows)
    rows = [(3 * i + 1, t) for i, t in enumerate(rows)]
    got = sorted(tuple(r) for r in minhash.near_duplicates(docs(rows)).collect())
    assert got == brute(rows)


def test_nulls_repeats_and_columns(docs):
    df = docs([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (5, "other"), (None, None)])
    got = minhash.drop_near_duplicates(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id or 0, r.text) for r in got.collect() if r.doc_id) == [(4, "a b c d e f"), (5, "other")]
    assert minhash.near_duplicates(docs([])).count() == 0


def test_every_allowed_error_pattern_shares_a_key(shipped):
    """Pigeonhole: any DISTANCE changed symbols leave a chunk with at most ERRORS of them."""
    rng = random.Random(1)
    base = [rng.randrange(1 << 14) for _ in range(minhash.SYMBOLS)]
    rows = []
    for _ in range(40):
        changed = list(base)
        for at in rng.sample(range(minhash.SYMBOLS), minhash.DISTANCE):
            changed[at] ^= rng.randrange(1, 1 << 14)
        rows.append(changed)
    packed = [[sum(r[c * 4 + i] << 15 * i for i in range(4)) for c in range(minhash.CHUNKS)] for r in [base, *rows]]
    df = shipped.createDataFrame(packed, ", ".join(f"{c} long" for c in minhash.CHUNK_NAMES)).select(minhash.index_keys().alias("k"))
    first, *others = [set(r.k) for r in df.collect()]
    assert all(first & other for other in others)


def test_components_of_a_long_chain(shipped):
    links = shipped.createDataFrame([(i, i + 1) for i in range(200)] + [(900, 800), (901, 800)], "a long, b long")
    got = {r.node: r.root for r in graph.components(links).collect()}
    assert got == {i: 0 for i in range(201)} | {800: 800, 900: 800, 901: 800}
