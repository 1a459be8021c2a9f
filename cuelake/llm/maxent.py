"""A hashed maximum-entropy language model over words, and the smoothed unigram it starts from.

P(word | context) = P(class | context) P(group | class, context) P(word | group, context). The FREQUENT most frequent words form classes of MEMBERS groups
of MEMBERS words each, all other words (unseen ones too) fall into RARE classes by their last two bytes. The class is a softmax over hashed features of
the context (previous word, the word before it, both, and a skip over the nearest); inside a frequent class the group is a second softmax over
hashed features and the word a third one, inside a rare class it is the smoothed unigram of that class. Weights start at the unigram model and are
trained in ROUNDS, which share out the positions of the training text so that each is visited once: every partition runs Adagrad on its
positions of the round from the common weights, and the row-wise mean of the changes is the update.

Exact counts of every word have to meet every text. Texts are packed into blocks of about BLOCK_TOKENS tokens with a vocabulary of their
own, so only (block, word) rows are shuffled: word counts are summed over blocks, joined back to the blocks' vocabularies, and
texts themselves never move. After that join a block holds small codes (the frequent words, the rare classes), which training and scoring read.

Words are told apart by 64-bit hashes. Frequent words, classes, weights and totals are of fixed size; they are all the driver sees.

Defined cases: a null or empty text has one token, its end; without training text every known count is 0 and all words are unseen; null ids
count as empty for the fold and are kept; repeated rows are separate documents; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import doc_fold, give_back, slices, stage

CLASSES, MEMBERS, RARE = 24, 32, 8
GROUPS = CLASSES * MEMBERS
FREQUENT = GROUPS * MEMBERS
START = FREQUENT + RARE  # the code before a text
BLOCK_TOKENS = 1_200_000
CONTEXTS = 64  # previous words that place a word in a class
BUCKETS = 1 << 13
ROUNDS, RATE, BATCH = 2, 0.15, 8192
SCORE_BATCH = 16_384
AHEAD = 8
HELD = 1


def word_keys(words: pa.Array) -> np.ndarray:
    """Of each word (as binary) 61 bits of hash and its rare class, which its last two bytes decide; an empty word stands for the end of a text."""
    keys = np.fromiter(map(xxhash.xxh3_64_intdigest, words.to_numpy(zero_copy_only=False)), np.uint64, len(words))
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset:words.offset + len(words) + 1]
    data = np.concatenate([np.zeros(1, np.uint8), np.frombuffer(words.buffers()[2] or b"", np.uint8)])  # data[i] is byte i - 1
    sizes = np.diff(ends)
    last, before = (np.where(sizes > k, data[np.maximum(ends[1:] - k, 0)], 0).astype(np.uint64) for k in (0, 1))
    mixed = (last + before * np.uint64(257)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)
    return (keys & ~np.uint64(RARE - 1) | mixed & np.uint64(RARE - 1)).astype(np.int64)


def _planes(ids: np.ndarray) -> bytes:
    """32-bit numbers as four byte planes; the high ones compress to nothing."""
    return ids.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


_BLOCK = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int32())),
                    ("keys", pa.list_(pa.int64())), ("trained", pa.list_(pa.int32())), ("tokens", pa.binary())])


def _table_row(schema: pa.Schema, *values) -> pa.RecordBatch:
    """One row; list columns take NumPy arrays as they are."""
    columns = []
    for field, v in zip(schema, values):
        if pa.types.is_list(field.type):
            values = v if isinstance(v, pa.Array) else pa.array(v, field.type.value_type, safe=False)
            columns.append(pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), values))
        else:
            columns.append(pa.array([v], field.type))
    return pa.RecordBatch.from_arrays(columns, names=schema.names)


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased words of all texts, one after the other, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, sizes = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    real = pc.not_equal(words, "")  # blanks at either end of a text leave empty words
    keep = real.to_numpy(zero_copy_only=False)
    return words.filter(real), np.bincount(np.repeat(np.arange(len(sizes)), sizes)[keep], minlength=len(sizes))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    base, seq = TaskContext.get().partitionId() << 32, 0
    parts, total = [], 0

    def block():
        doc_ids, held = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        sizes = np.concatenate([p[3] for p in parts]) + 1  # with the end of the text
        found = pa.concat_arrays([p[2] for p in parts]).dictionary_encode()
        vocabulary = pa.concat_arrays([found.dictionary.cast(pa.binary()), pa.array([b""], pa.binary())])
        tokens = np.full(sizes.sum(), len(vocabulary) - 1, np.int64)
        is_word = np.ones(len(tokens), bool)
        is_word[np.cumsum(sizes) - 1] = False
        tokens[is_word] = found.indices.to_numpy()
        counts = np.bincount(tokens, minlength=len(vocabulary))
        order = np.argsort(-counts, kind="stable")
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        keys = word_keys(vocabulary)[order]
        trained = np.bincount(tokens[np.repeat(~held, sizes)], minlength=len(order))[order]
        return _table_row(_BLOCK, base + seq, pa.array(doc_ids, pa.int64()), held, sizes, keys, trained, _planes(place[tokens]))

    for whole in batches:
        for batch in slices(whole, 1, BLOCK_TOKENS):
            words, sizes = _words(batch.column(1))
            parts.append((np.array(batch.column(0).to_pylist(), object), batch.column(2).to_numpy(zero_copy_only=False).astype(bool), words, sizes))
            total += len(words) + len(sizes)
            if total >= BLOCK_TOKENS:
                yield block()
                parts.clear()
                total, seq = 0, seq + 1
                give_back()
    if parts:
        yield block()
    parts.clear()
    give_back()


@dataclass(frozen=True)
class Totals:
    """Counts over the training text: tokens, different words, and both per rare class."""

    tokens: int
    words: int
    rare_tokens: tuple[int, ...]
    rare_words: tuple[int, ...]

    def unigram(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.5) / (self.tokens + 0.5 * (self.words + 1)))

    def in_rare_class(self, count: np.ndarray, rare: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.5) / (np.array(self.rare_tokens)[rare] + 0.5 * (np.array(self.rare_words)[rare] + 1)))


_CODED = pa.schema([("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int32())),
                    ("known", pa.list_(pa.int64())), ("base", pa.list_(pa.float64())), ("inside", pa.list_(pa.float64())), ("codes", pa.binary())])


def _code(totals: Totals):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i] for n in batch.schema.names}
                at, code_at = np.divmod(row["places"].values.to_numpy(), START)
                count, code = np.empty(len(at)), np.empty(len(at), np.int64)
                count[at], code[at] = row["counts"].values.to_numpy(), code_at
                base = totals.unigram(count)
                rare = np.where(code >= FREQUENT, code - FREQUENT, 0)
                inside = np.where(code >= FREQUENT, totals.in_rare_class(count, rare), 0.0)
                tokens = _from_planes(row["tokens"].as_py())
                sizes = row["sizes"].values.to_numpy().astype(np.int64)
                starts = np.cumsum(sizes) - sizes
                sums = [np.add.reduceat(v[tokens], starts) for v in ((count > 0).astype(np.int32), base, inside)]
                codes = code.astype("<u2")[tokens].view(np.uint8).reshape(-1, 2).T.tobytes()
                yield _table_row(_CODED, row["doc_ids"].values, row["held"].values, sizes, *sums, codes)
        give_back()
    return run


def coded_blocks(docs: DataFrame) -> tuple[DataFrame, Totals, np.ndarray]:
    """Blocks of coded texts with their unigram figures, the totals, and the counts of the frequent words by code."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), (doc_fold() == HELD).alias("held"))
    blocks = stage(rows.mapInArrow(_pack, "block long, doc_ids array<long>, held array<boolean>, sizes array<int>, keys array<long>, "
                                          "trained array<int>, tokens binary"), "lm-blocks")
    seen = blocks.select(F.explode(F.arrays_zip("keys", "trained")).alias("w")).where("w.trained > 0")
    counts = stage(seen.groupBy(F.col("w.keys").alias("key")).agg(F.sum("w.trained").alias("count")), "lm-counts")
    top = counts.orderBy(F.desc("count"), "key").limit(FREQUENT).toPandas()  # FREQUENT rows
    spark = docs.sparkSession
    codes = spark.createDataFrame([(int(k), i) for i, k in enumerate(top["key"])], "top_key long, top_code int")
    rare = F.lit(FREQUENT) + F.col("key").bitwiseAND(F.lit(RARE - 1).cast("bigint")).cast("int")

    def coded(df: DataFrame) -> DataFrame:
        return (df.join(F.broadcast(codes), F.col("key") == F.col("top_key"), "left")  # FREQUENT rows at most
                .withColumn("code", F.coalesce("top_code", rare)).drop("top_key", "top_code"))

    sums = {r["code"]: (r["n"], r["v"]) for r in coded(counts).withColumn("code", F.greatest("code", F.lit(FREQUENT - 1)))
            .groupBy("code").agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    per = [sums.get(FREQUENT + k, (0, 0)) for k in range(RARE)]
    totals = Totals(sum(n for n, _ in sums.values()), sum(v for _, v in sums.values()), tuple(n for n, _ in per), tuple(v for _, v in per))
    vocabulary = blocks.select("block", F.posexplode("keys").alias("pos", "key")).withColumn("pos", F.col("pos").cast("bigint"))
    looked = coded(vocabulary.join(counts.hint("merge"), "key", "left"))
    looked = looked.select("block", (F.col("pos") * START + F.col("code")).cast("bigint").alias("place"), F.coalesce("count", F.lit(0)).cast("bigint").alias("count"))
    looked = looked.groupBy("block").agg(F.collect_list("place").alias("places"), F.collect_list("count").alias("counts"))  # one block's vocabulary
    joined = blocks.select("block", "doc_ids", "held", "sizes", "tokens").hint("merge").join(looked, "block")
    made = joined.mapInArrow(_code(totals), "doc_ids array<long>, held array<boolean>, sizes array<int>, known array<long>, "
                                            "base array<double>, inside array<double>, codes binary")
    return stage(made, "lm-coded"), totals, top["count"].to_numpy(np.float64)


def _unpack(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    codes = np.ascontiguousarray(np.frombuffer(batch.column("codes")[i].as_py(), np.uint8).reshape(2, -1).T).view("<u2").ravel()
    return codes, batch.column("sizes")[i].values.to_numpy().astype(np.int64), batch.column("held")[i].values.to_numpy(zero_copy_only=False)


def _before(codes: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """The code k places back in the same text."""
    out = np.full(len(codes), START, np.uint16)
    out[k:] = codes[:-k] if k < len(codes) else out[k:]
    out[place < k] = START
    return out


def contexts(codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Codes one, two and three places back, 16 bits each: a block has many of them."""
    place = np.arange(len(codes), dtype=np.int32) - np.repeat((np.cumsum(sizes) - sizes).astype(np.int32), sizes)
    return np.column_stack([_before(codes, place, k) for k in (1, 2, 3)])


def _tables(kind: int, *sizes: int) -> list[np.ndarray]:
    """Random numbers per code, one table for each part of a feature."""
    rng = np.random.default_rng([kind, BUCKETS])
    return [rng.integers(0, HASHED, n, dtype=np.int32) for n in sizes]


BIASES = 1024  # rows below are biases: of classes, and behind them of groups
HASHED = BUCKETS - BIASES
_LAST, _SECOND, _BOTH, _SKIP = (_tables(kind, START + 1, START + 1) for kind in (1, 2, 3, 4))
_LAST_IN, _SECOND_IN = (_tables(kind, START + 1, CLASSES + RARE) for kind in (5, 6))
_LAST_OF = _tables(7, START + 1, GROUPS)


def _row(tables: list[np.ndarray], *parts: np.ndarray) -> np.ndarray:
    """The weight row of a feature: tabulation hashing, that is the sum of a random number for each part, modulo the rows."""
    h = tables[0][parts[0]]
    for table, part in zip(tables[1:], parts[1:]):
        h = h + table[part]
        h -= HASHED * (h >= HASHED)
    return h + BIASES


def class_features(back: np.ndarray) -> np.ndarray:
    """Rows of the hashed features; the bias is row 0."""
    a, b, c = back.T
    return np.column_stack([_row(_LAST, a), _row(_SECOND, b), _row(_BOTH, a, b), _row(_SKIP, b, c)])


def member_features(back: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """Rows of the hashed features; the bias is the row of the class's number."""
    a, b, _ = back.T
    return np.column_stack([_row(_LAST_IN, a, cls), _row(_SECOND_IN, b, cls)])


def group_features(back: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Rows of the hashed features; the bias is the row behind the classes' with the group's number."""
    return _row(_LAST_OF, back[:, 0], group)[:, None]


def _summed(weights: np.ndarray, bias: np.ndarray, features: np.ndarray) -> np.ndarray:
    x = np.take(weights, features[:, 0], axis=0)
    for k in range(1, features.shape[1]):
        x += np.take(weights, features[:, k], axis=0)
    x += weights[0] if bias is None else np.take(weights, bias, axis=0)
    return x


def _log_of(x: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log of the softmax of each row at its target; the rows are overwritten."""
    x -= x.max(axis=1, keepdims=True)
    out = x[np.arange(len(x)), target].astype(np.float64)
    np.exp(x, out=x)
    return out - np.log(x.sum(axis=1))


def _excess(x: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The softmax of each row less one at its target; the rows are overwritten."""
    x -= x.max(axis=1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(axis=1, keepdims=True)
    x[np.arange(len(x)), target] -= 1
    return x


@dataclass
class Model:
    """Where each code stands (class, group in it, member), and the weights: of the class, and of group and member, a row per feature."""

    place: np.ndarray
    by_class: np.ndarray
    by_member: np.ndarray

    def log10(self, codes: np.ndarray, back: np.ndarray) -> np.ndarray:
        """Without the part inside rare classes."""
        out = np.empty(len(codes))
        for i in range(0, len(codes), SCORE_BATCH):
            s = slice(i, i + SCORE_BATCH)
            c, group, member = self.place[codes[s]].T
            got = _log_of(_summed(self.by_class, None, class_features(back[s])), c)
            own = np.flatnonzero(c < CLASSES)
            if len(own):
                near, c, group = back[s][own], c[own], group[own]
                got[own] += _log_of(_summed(self.by_member, c, member_features(near, c)), group)
                group = c * MEMBERS + group
                got[own] += _log_of(_summed(self.by_member, CLASSES + group, group_features(near, group)), member[own])
            out[s] = got / math.log(10)
        return out


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each frequent word follows each of the most frequent ones, in training texts."""
    table = np.zeros((FREQUENT, CONTEXTS + 1), np.int64)
    for batch in batches:
        for i in range(batch.num_rows):
            codes, sizes, held = _unpack(batch, i)
            use = np.flatnonzero((codes < FREQUENT) & ~np.repeat(held, sizes))
            back = np.minimum(contexts(codes, sizes)[:, 0], CONTEXTS)
            for k in range(0, len(use), 1 << 18):
                at = use[k:k + (1 << 18)]
                table += np.bincount(codes[at].astype(np.int64) * (CONTEXTS + 1) + back[at], minlength=table.size).reshape(table.shape)
    word, back = np.nonzero(table)
    yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(back), pa.array(table[word, back])], ["word", "back", "n"])


def place_words(table: np.ndarray) -> np.ndarray:
    """Class, group in it and member of each code: words with alike predecessors together, by balanced splits along the main direction."""
    x = np.sqrt(table)
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    groups = [np.arange(FREQUENT)]
    for ways in (3, 2, 2, 2, 2, 2, 2, 2, 2):  # classes, and groups in them
        cut = []
        for g in groups:
            y = x[g] - x[g].mean(axis=0)
            _, _, v = np.linalg.svd(y, full_matrices=False)
            along = y @ v[0] * np.sign(v[0][np.argmax(np.abs(v[0]))])
            cut += np.array_split(g[np.argsort(along, kind="stable")], ways)
        groups = cut
    place = np.zeros((START + 1, 3), np.int64)
    for k, g in enumerate(groups):
        place[g] = np.column_stack([np.full(len(g), k // MEMBERS), np.full(len(g), k % MEMBERS), np.arange(len(g))])
    place[FREQUENT:START, 0] = CLASSES + np.arange(RARE)
    return place


def start_model(place: np.ndarray, counts: np.ndarray, totals: Totals) -> Model:
    """The unigram model in all softmaxes."""
    by_class, by_member = np.zeros((BUCKETS, CLASSES + RARE), np.float32), np.zeros((BUCKETS, MEMBERS), np.float32)
    known = np.zeros(FREQUENT)
    known[:len(counts)] = counts
    sums = np.bincount(place[:FREQUENT, 0], known + 0.5 * (np.arange(FREQUENT) < len(counts)), CLASSES)
    rare = np.array(totals.rare_tokens) + 0.5 * (np.array(totals.rare_words) + 1)
    by_class[0] = np.log(np.maximum(np.concatenate([sums, rare]), 1e-3))
    group = place[:FREQUENT, 0] * MEMBERS + place[:FREQUENT, 1]
    by_member[:CLASSES] = np.log(np.maximum(np.bincount(group, known, GROUPS), 1e-3)).reshape(CLASSES, MEMBERS)
    by_member[CLASSES + group, place[:FREQUENT, 2]] = np.log(np.maximum(known, 1e-3))
    return Model(place, by_class, by_member)


def _row_sums(x: np.ndarray, at: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of the rows `at` of x from each start to the next, those of most rows first, with their order and their numbers of rows.

    The first AHEAD rows are added for all sums at once, as `reduceat` makes a call per column of every sum; it is left the rest of the long ones.
    """
    sizes = np.diff(np.r_[starts, len(at)])
    order = np.argsort(-sizes, kind="stable")
    first, sizes = starts[order], sizes[order]
    out = np.take(x, at[first], axis=0)
    for k in range(1, AHEAD + 1):
        m = int(np.searchsorted(-sizes, -k))  # sums of more than k rows
        if not m:
            break
        if k < AHEAD:
            out[:m] += np.take(x, at[first[:m] + k], axis=0)
        else:
            rest = sizes[:m] - k
            begin = np.cumsum(rest) - rest
            left = np.arange(rest.sum()) + np.repeat(first[:m] + k - begin, rest)
            out[:m] += np.add.reduceat(np.take(x, at[left], axis=0), begin, axis=0)
    return out, order, sizes


def _descend(weights, sums, touched, features, bias, wrong):
    """One Adagrad step on the rows of a batch; features repeat, so their gradients are added first. Bias rows come sorted, or are row 0 alone."""
    if bias is None:
        rows, g, n = np.zeros(1, np.int64), wrong.sum(axis=0, keepdims=True), np.array([len(wrong)])
    else:
        first = np.flatnonzero(np.r_[True, bias[1:] != bias[:-1]])
        g, order, n = _row_sums(wrong, np.arange(len(bias)), first)
        rows = bias[first[order]]
    flat = features.astype(np.uint16).ravel()
    by_row = np.argsort(flat, kind="stable")
    at = flat[by_row]
    starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    more, order, times = _row_sums(wrong, by_row // features.shape[1], starts)
    rows = np.r_[rows, at[starts[order]]]
    g = np.concatenate([g, more])
    s = sums[rows] + g * g
    sums[rows] = s
    weights[rows] -= RATE * g / np.sqrt(s)
    touched[rows] += np.r_[n, times]


def positions(sizes: np.ndarray, held: np.ndarray, turn: int) -> np.ndarray:
    """Where a block is trained in a round; over all rounds every position of every training text."""
    out = ~np.repeat(held, sizes)
    return np.flatnonzero(out & (np.arange(len(out)) % ROUNDS == turn))


def _train(model: Model, turn: int):
    columns = [f"d{k}" for k in range(MEMBERS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [[w.copy(), np.full_like(w, 1.0), np.zeros(len(w))] for w in (model.by_class, model.by_member)]
        for batch in batches:
            for i in range(batch.num_rows):
                codes, sizes, held = _unpack(batch, i)
                back = contexts(codes, sizes)
                at = positions(sizes, held, turn)
                at = at[np.random.default_rng(turn).permutation(len(at))]
                for k in range(0, len(at), BATCH):
                    b = at[k:k + BATCH]
                    cls, group, member = model.place[codes[b]].T
                    f = class_features(back[b])
                    _descend(*tables[0], f, None, _excess(_summed(tables[0][0], None, f), cls))
                    own = np.flatnonzero(cls < CLASSES)
                    if len(own):
                        own = own[np.argsort((cls[own] * MEMBERS + group[own]).astype(np.uint16), kind="stable")]
                        c, g, near = cls[own], group[own], back[b[own]]
                        f = member_features(near, c)
                        _descend(*tables[1], f, c, _excess(_summed(tables[1][0], c, f), g))
                        g = c * MEMBERS + g
                        f = group_features(near, g)
                        _descend(*tables[1], f, CLASSES + g, _excess(_summed(tables[1][0], CLASSES + g, f), member[own]))
        for which, (now, _, touched), was in zip((0, 1), tables, (model.by_class, model.by_member)):
            rows = np.flatnonzero(touched)
            change = np.zeros((len(rows), MEMBERS))
            change[:, :now.shape[1]] = (now[rows] - was[rows]) * touched[rows, None]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), which)), pa.array(rows), pa.array(touched[rows]),
                                              *(pa.array(change[:, k].astype(np.float32)) for k in range(MEMBERS))], ["part", "row", "n", *columns])
    return run, columns


def train(coded: DataFrame, totals: Totals, counts: np.ndarray) -> Model:
    pairs = coded.mapInArrow(_pairs, "word long, back long, n long").groupBy("word", "back").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros((FREQUENT, CONTEXTS + 1))
    table[pairs["word"], pairs["back"]] = pairs["n"]
    model = start_model(place_words(table), counts, totals)
    for turn in range(ROUNDS):
        run, columns = _train(model, turn)
        rows = coded.mapInArrow(run, "part long, row long, n double, " + ", ".join(f"{c} float" for c in columns))
        mean = rows.groupBy("part", "row").agg(*(F.sum(c).alias(c) for c in columns), F.sum("n").alias("n")).toPandas()  # 2 BUCKETS rows at most
        for which, weights in ((0, model.by_class), (1, model.by_member)):
            got = mean[mean["part"] == which]
            step = got[columns].to_numpy() / got[["n"]].to_numpy()
            weights[got["row"].to_numpy(np.int64)] += step[:, :weights.shape[1]].astype(np.float32)
    return model


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                codes, sizes, held = _unpack(batch, i)
                starts = np.cumsum(sizes) - sizes
                got = np.add.reduceat(model.log10(codes, contexts(codes, sizes)), starts)
                known, base, inside = (batch.column(c)[i].values for c in ("known", "base", "inside"))
                yield pa.RecordBatch.from_arrays([batch.column("doc_ids")[i].values, pa.array(held), pa.array(sizes), known, base,
                                                  pa.array(got + inside.to_numpy())], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])
    return run


def language_scores(docs: DataFrame) -> DataFrame:
    """Per document: held_out, n_tokens, n_known, train_tokens, base_score, score (log10). Runs jobs."""
    coded, totals, counts = coded_blocks(docs)
    scored = coded.mapInArrow(_score(train(coded, totals, counts)),
                              "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(totals.tokens).cast("bigint").alias("train_tokens"), "base_score", "score")
