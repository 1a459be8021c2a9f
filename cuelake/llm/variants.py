"""Spelling variants: words one edit apart, found by dynamic programming down a sorted word list.

Of two words that differ by one inserted, deleted or replaced code point, the shorter L long, either the first L/2 code points agree or all but
these, counted from the end. So a word joins a range of the sorted list per possible L and side: words of L and L + 1 code points with a
common beginning, and, spelt backwards, with a common ending. A pair is reported by the first kind if it stands in both.

In a range each word walks down the others in order. The edit matrix between the two keeps three columns around the diagonal; its rows for
the prefix that a word shares with the one before it (their longest common prefix) are used again, and as soon as a row has no entry under two, all
words with that prefix are skipped, by links to the next word with a shorter common prefix. A pair is near if the last entry is exactly one.

Ranges come out of one range-partitioned, sorted shuffle and are cut into blocks of at most BLOCK words, so a range that holds any share
of all words is spread over tasks. Blocks of one range meet pairwise, unless their common prefixes are already too far apart. No task holds
more than two blocks, and no pair of words is left out.

Defined cases: a null or empty text has no words; a null id is written as an empty one before the colon; repeated rows are documents of their own, so their
words count each time; ties in counts go to the smaller word in code-point order; very long runs are words like others; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import lower_az, stage

LETTERS = "A-Za-zÀ-ÿ"
LEAST_CHARS, LEAST_COUNT, DAMAGED, TIMES = 7, 2, 31, 10
BLOCK, SHORT = 1024, 16
SALTS = 16
FAR = 2  # an entry of the edit matrix that is no use


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of the words that are long and frequent enough, after the deletions that the ids decide."""
    run = F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"[{LETTERS}]{{{LEAST_CHARS},}}"), F.lit(0)))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), run.alias("run")).select("id", lower_az(F.col("run")).alias("run"))
    hashed = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = F.pmod("h", F.length("run")).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    words = hashed.select(F.when(F.col("h") % DAMAGED == 0, cut).otherwise(F.col("run")).alias("word"))
    return (words.where(F.length("word") >= LEAST_CHARS).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT))


def common_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


class SortedList:
    """Sorted words with the common prefix of each and the one before it, and for each the next with a shorter one."""

    def __init__(self, words: list[str]):
        self.words, n = words, len(words)
        self.lcp = [0] + [common_prefix(a, b) for a, b in zip(words, words[1:])]
        self.shorter, waiting = [n] * n, []
        for i, x in enumerate(self.lcp):
            while waiting and self.lcp[waiting[-1]] > x:
                self.shorter[waiting.pop()] = i
            waiting.append(i)

    def one_edit(self, query: str, start: int = 0) -> Iterator[int]:
        """Places from `start` on whose word is exactly one edit from the query; with start > 0 the query is the word before."""
        words, lcp, shorter, n = self.words, self.lcp, self.shorter, len(self.words)
        size, j = len(query), start
        q = query + "\0\0"  # columns behind the end never match: words have no such character
        rows = [(FAR, 0, 1)]  # of the matrix, for the prefix read: distances to the query's prefix one shorter, equally long, one longer
        if start:
            rows += [(1, 0, 1 if d < size else FAR) for d in range(1, size + 1)]
        while j < n:
            word = words[j]
            del rows[lcp[j] + 1:]
            low, mid, high = rows[-1]
            dead = 0
            for d in range(len(rows), len(word) + 1):
                c = word[d - 1]
                less = min(mid + 1, low + (d < 2 or c != q[d - 2])) if d - 1 <= size else FAR
                same = min(mid + (c != q[d - 1]), high + 1, less + 1) if d <= size else FAR
                more = min(high + (c != q[d]), same + 1) if d < size else FAR
                low, mid, high = less, same, more
                rows.append((low, mid, high))
                if low > 1 and mid > 1 and high > 1:
                    dead = d
                    break
            if dead:
                j += 1
                while j < n and lcp[j] >= dead:
                    j = shorter[j]
            else:
                over = size - len(word)
                if -1 <= over <= 1 and rows[-1][over + 1] == 1:
                    yield j
                j += 1


_BLOCKS = ("backwards boolean, size int, head string, block long, first string, last string, words array<string>, ns array<long>")
_LINKS = "word string, other string, n long"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (backwards, size, head, word, n) to blocks of a range; a single word is kept only where its range may go on in another task."""
    base, seq, at, words, ns, out = TaskContext.get().partitionId() << 32, 0, None, [], [], []

    def close(edge: bool) -> None:
        nonlocal seq
        if len(words) > 1 or words and edge:
            out.append((*at, base + seq, words[0], words[-1], list(words), list(ns)))
        seq += bool(words)
        words.clear()
        ns.clear()

    def flush() -> pa.RecordBatch:
        names = [f.split()[0] for f in _BLOCKS.split(", ")]
        types = [pa.bool_(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64())]
        arrays = [pa.array(values, kind) for values, kind in zip(zip(*out) if out else [()] * len(types), types)]
        out.clear()
        return pa.RecordBatch.from_arrays(arrays, names)

    started = split = False
    for batch in batches:
        for *key, word, n in zip(*(c.to_pylist() for c in batch.columns)):
            if key != at:
                close(not started or split)
                started, split = at is not None, False
                at = key
            elif len(words) >= BLOCK:
                close(True)
                split = True
            words.append(word)
            ns.append(n)
        yield flush()
    close(True)
    yield flush()


def _links(rows: Iterator[tuple]) -> pa.RecordBatch:
    made = [*zip(*rows)] or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(made[0], pa.string()), pa.array(made[1], pa.string()), pa.array(made[2], pa.int64())], ["word", "other", "n"])


def _both_ways(backwards: bool, size: int, a: str, an: int, b: str, bn: int) -> Iterator[tuple]:
    """The two links of a near pair, if it belongs to this range and side."""
    half = size // 2
    if min(len(a), len(b)) == size and not (backwards and a[-half:] == b[-half:]):
        if backwards:
            a, b = a[::-1], b[::-1]
        yield a, b, bn
        yield b, a, an


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def pairs(batch):
        for backwards, size, words, ns in zip(*(c.to_pylist() for c in batch.columns)):
            known = SortedList(words)
            for i, (word, n) in enumerate(zip(words, ns)):
                for j in known.one_edit(word, i + 1):
                    yield from _both_ways(backwards, size, word, n, words[j], ns[j])

    for whole in batches:
        for start in range(0, whole.num_rows, 256):
            yield _links(pairs(whole.slice(start, 256)))


def _between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def pairs(batch):
        for backwards, size, words, ns, others, other_ns in zip(*(c.to_pylist() for c in batch.columns)):
            known = SortedList(others)
            for word, n in zip(words, ns):
                for j in known.one_edit(word):
                    yield from _both_ways(backwards, size, word, n, others[j], other_ns[j])

    for whole in batches:
        for start in range(0, whole.num_rows, 16):
            yield _links(pairs(whole.slice(start, 16)))


def near_words(words: DataFrame) -> DataFrame:
    """(word, other, n): every ordered pair of words one edit apart, with the other's count. `words` has one row per word. Runs jobs."""
    length, size = F.length("word"), F.col("size")
    sizes = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("size")).where(size >= LEAST_CHARS)
    both = sizes.select("n", "size", F.explode(F.array(F.struct(F.lit(False).alias("backwards"), F.col("word")),
                                                       F.struct(F.lit(True).alias("backwards"), F.reverse("word").alias("word")))).alias("s"))
    shared = F.when(F.col("s.backwards"), size - F.expr("size div 2")).otherwise(F.expr("size div 2")).cast("int")
    ranges = both.select("s.backwards", "size", F.substr("s.word", F.lit(1), shared).alias("head"), "s.word", "n")
    order = ["backwards", "size", "head", "word"]
    blocks = stage(ranges.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_cut, _BLOCKS), "variant-blocks")
    # full ranges lie side by side in the files and cost most, so they are dealt anew
    tasks, long = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.size("words") > SHORT
    dealt = blocks.where(~long).unionByName(blocks.where(long).repartition(tasks, "block"))
    within = dealt.select("backwards", "size", "words", "ns").mapInArrow(_within, _LINKS)

    key = ["backwards", "size", "head"]
    prefix = F.substr("first", F.lit(1), F.size(F.filter(F.sequence(F.lit(1), F.length("first")), lambda i: F.substr("first", F.lit(1), i) == F.substr("last", F.lit(1), i))))
    cut = blocks.groupBy(*key).agg(F.count(F.lit(1)).alias("of")).where(F.col("of") > 1).drop("of")  # ranges over several blocks
    parts = blocks.join(cut, key, "left_semi").select(*key, "block", prefix.alias("prefix"))
    other = parts.select(*key, F.col("block").alias("other_block"), F.col("prefix").alias("other_prefix"))
    upto = F.least(F.length("prefix"), F.length("other_prefix"))
    # equally long prefixes of words one edit apart are two edits apart at most
    meet = (parts.join(other, key).where(F.col("block") < F.col("other_block"))
            .where(F.levenshtein(F.substr("prefix", F.lit(1), upto), F.substr("other_prefix", F.lit(1), upto)) <= 2).select(*key[:2], "block", "other_block"))
    first = blocks.select("block", "words", "ns")
    second = blocks.select(F.col("block").alias("other_block"), F.col("words").alias("others"), F.col("ns").alias("other_ns"))
    pairs = meet.join(first, "block").join(second, "other_block").select("backwards", "size", "words", "ns", "others", "other_ns")
    return within.unionByName(pairs.mapInArrow(_between, _LINKS))


def _follow(rows: DataFrame, links: DataFrame) -> DataFrame:
    """(word, root) with the root replaced by the root of that word, if `links` has it; a root that many words share is salted."""
    left = rows.withColumn("salt", F.pmod(F.xxhash64("word"), F.lit(SALTS)))
    right = links.select(F.col("word").alias("root"), F.col("root").alias("next"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).alias("salt"))
    return left.join(right, ["root", "salt"], "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for every (word, form): the last of its forms. A form is several times as frequent as its word, so chains are short."""
    links = forms.select("word", F.col("form").alias("root"))
    inner = stage(links.join(links.select(F.col("root").alias("word")).distinct(), "word", "left_semi"), "variant-chains")
    while True:
        after = stage(_follow(inner, inner), "variant-chains")
        if after.where("moved").isEmpty():
            break
        inner = after.drop("moved")
    return _follow(links, inner).drop("moved")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """Per word: its form (the near word of largest count, if TIMES as frequent at least), root, n, n_near and form_n. Runs jobs."""
    words = stage(word_counts(docs), "variant-words")
    near = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), "other")).alias("best"))
    best_n = -F.col("best.less")
    is_form = best_n >= TIMES * F.col("n")
    made = stage(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(is_form, F.col("best.other")).alias("form"),
        F.when(is_form, best_n).alias("form_n")), "variant-forms")
    found = roots(made.where("form IS NOT NULL").select("word", "form"))
    return made.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
