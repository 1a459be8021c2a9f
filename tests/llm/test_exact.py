import hashlib

from cuelake.llm import exact


def marks(df, index):
    return {(r.doc_id, bytes(r.digest)): (r.keep_id, r.group_size, r.kept, r.known) for r in exact.mark_copies(df, index).collect()}


def sha(text):
    return hashlib.sha256(text.encode()).digest()


def test_largest_id_stays_and_index_remembers(shipped, docs):
    index = exact.new_index(shipped, buckets=4)
    long = "Wort " * 100_000
    got = marks(docs([(1, "Same É"), (9, "same É"), (2, "same é"), (3, None), (4, ""), (5, long), (5, long), (None, "alone")]), index)
    assert got[1, sha("same É")] == (9, 2, False, False)
    assert got[9, sha("same É")] == (9, 2, True, False)
    assert got[2, sha("same é")] == (2, 1, True, False)  # only A-Z is lower-cased
    assert got[3, sha("")] == (4, 2, False, False) and got[4, sha("")] == (4, 2, True, False)
    assert got[5, sha(long.lower())] == (5, 2, True, False)
    assert got[None, sha("alone")] == (None, 1, True, False)
    again = exact.DigestIndex(shipped, index.path, 4).open()
    got = marks(docs([(50, "SAME É"), (51, "new")]), again)
    assert got[50, sha("same É")] == (9, 1, False, True) and got[51, sha("new")] == (51, 1, True, False)
    assert again.rows().count() == 6


def test_index_is_read_without_a_shuffle(shipped, docs):
    index = exact.new_index(shipped, buckets=4)
    marks(docs([(1, "a")]), index)
    plan = index.rows().groupBy("digest").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_drop_copies(shipped, docs):
    df = docs([(1, "a"), (2, "A"), (3, "b"), (3, "b"), (4, None)])
    got = exact.drop_copies(df, exact.new_index(shipped, buckets=2))
    assert got.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in got.collect()) == [(2, "A"), (3, "b"), (4, None)]


def test_empty_table(shipped, docs):
    assert exact.drop_copies(docs([]), exact.new_index(shipped, buckets=2)).count() == 0
