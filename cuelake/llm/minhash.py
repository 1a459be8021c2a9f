"""Near-duplicate documents: MinHash signatures, a multi-index Hamming join, and links confirmed on full shingle sets.

A document's set are its distinct 5-word shingles. A signature has SYMBOLS b-bit MinHash values; two sets of similarity J differ in a
(1 - J) share of them. Signatures are split into CHUNKS; by the pigeonhole principle two signatures that differ in at most DISTANCE
symbols agree in some chunk up to ERRORS = DISTANCE // CHUNKS symbols, so a document is indexed under every chunk with every
choice of ERRORS symbols left out, and all pairs within DISTANCE share a key. At similarity 0.75 a pair exceeds DISTANCE = 31 of 64
symbols with probability 2e-5; closer pairs far less often.

Documents with equal sets are one class first. Each class is compared with the one in its buckets that meets most others, and
the links found are joined to components: a group of near copies costs as many comparisons as it has members. Classes that then share
a bucket across components are compared with each other, in blocks, if they also share one of their rarest shingles and have enough left from
there on, as alike sets must; so a passage that many texts share does not make all of them candidates. No link between different components is lost.
Candidates within DISTANCE are confirmed exactly on their shingle sets, which are computed again from the texts of the documents
concerned; a fixed-size bit map of their ids keeps the others from being shuffled.

Defined cases: texts without words (null, empty, white space) have empty sets and are linked with nothing; fewer than five words are one
shingle; rows that repeat a doc_id are separate documents; a null doc_id takes part and is never the smallest of a group, and rows with a null id stay
or go together; other columns are kept.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import stage
from cuelake.llm.graph import components

SHINGLE, PERCENT = 5, 75
SYMBOLS, CHUNKS, DISTANCE = 64, 16, 31
PER_CHUNK, ERRORS = SYMBOLS // CHUNKS, DISTANCE // CHUNKS
SYMBOL_BITS, LANE = 14, 15  # a chunk is a long of PER_CHUNK lanes: 14 bits and a spare one
BLOCK, SALTS = 128, 16
MAP_BITS = 1 << 23
TALLY = 1 << 18
_CARRY = sum(((1 << SYMBOL_BITS) - 1) << LANE * i for i in range(PER_CHUNK))
_SPARE = sum(1 << LANE * i + SYMBOL_BITS for i in range(PER_CHUNK))
CHUNK_NAMES = [f"s{i}" for i in range(CHUNKS)]

_draw = np.random.default_rng(20240229)
_FACTORS = _draw.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_OFFSETS = _draw.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles. bytes.split() cuts at exactly the six white space characters."""
    words = text.encode().lower().split() if text else []
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(h) < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), len(h))], np.uint64) if len(h) else h
    n = len(h) - SHINGLE + 1
    s = h[:n]
    for k in range(1, SHINGLE):
        s = mix(s) + h[k:k + n]
    return np.unique(mix(s))


def signature(shingles: np.ndarray) -> np.ndarray:
    """CHUNKS longs of PER_CHUNK symbols each."""
    low = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 2048):
        part = (shingles[None, i:i + 2048] ^ _OFFSETS[:, None]) * _FACTORS[:, None]
        np.minimum(low, part.min(axis=1), out=low)
    symbols = (mix(low) & np.uint64((1 << SYMBOL_BITS) - 1)).reshape(CHUNKS, PER_CHUNK)
    return (symbols << (np.arange(PER_CHUNK, dtype=np.uint64) * np.uint64(LANE))).sum(axis=1, dtype=np.uint64).astype(np.int64)


def set_class(shingles: np.ndarray) -> int:
    """One number for equal sets (64 bits)."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).astype(np.int64))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start in range(0, whole.num_rows, 1024):
            batch = whole.slice(start, 1024)
            sets = [shingle_set(v.as_py()) for v in batch.column(1)]
            sigs = np.array([signature(s) for s in sets], np.int64).reshape(-1, CHUNKS)
            columns = [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_class(s) for s in sets], pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(sigs[:, k]) for k in range(CHUNKS))], ["doc_id", "n", "cls", *CHUNK_NAMES])


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n (set size), cls (class of equal sets), and the signature's chunks."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_sign, "doc_id long, n long, cls long, " + ", ".join(f"{c} long" for c in CHUNK_NAMES))


def index_keys() -> Column:
    """All keys of a signature: each chunk, without each choice of ERRORS of its symbols."""
    keys = []
    for c, name in enumerate(CHUNK_NAMES):
        for k, gone in enumerate(itertools.combinations(range(PER_CHUNK), ERRORS)):
            kept = sum(((1 << LANE) - 1) << LANE * i for i in range(PER_CHUNK) if i not in gone)
            keys.append(F.xxhash64(F.lit(c * 100 + k), F.col(name).bitwiseAND(F.lit(kept).cast("bigint"))))
    return F.array(*keys)


def distance(a: str, b: str) -> Column:
    """In how many symbols two signatures differ: a lane that is not zero after XOR carries into its spare bit."""
    parts = [F.bit_count((F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}")) + F.lit(_CARRY).cast("bigint")).bitwiseAND(F.lit(_SPARE).cast("bigint")))
             for c in CHUNK_NAMES]
    return sum(parts[1:], parts[0])


def alike_sizes(a: str, b: str) -> Column:
    return F.least(F.col(f"{a}.n"), F.col(f"{b}.n")) * 100 >= F.greatest(F.col(f"{a}.n"), F.col(f"{b}.n")) * PERCENT


def _needed_map(ids: DataFrame) -> np.ndarray:
    """A bit map of MAP_BITS bits in which the slots of the ids are set."""
    slots = ids.select(F.pmod(F.xxhash64("doc_id"), F.lit(MAP_BITS)).alias("slot"))
    bit = F.expr("shiftleft(1L, cast(slot % 32 as int))")
    rows = slots.groupBy(F.expr("slot div 32").alias("word")).agg(F.bit_or(bit).alias("bits")).toPandas()  # MAP_BITS / 32 rows at most
    out = np.zeros(MAP_BITS // 32, np.uint32)
    out[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).astype(np.uint32)
    return out


def _sets(needed: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            slot = whole.column(1).to_numpy()
            rows = np.flatnonzero(needed[slot // 32] >> (slot % 32).astype(np.uint32) & np.uint32(1))
            for start in range(0, len(rows), 512):
                sets = [shingle_set(whole.column(0)[int(i)].as_py()) for i in rows[start:start + 512]]
                ends = np.cumsum([0, *map(len, sets)])
                flat = np.concatenate(sets).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([set_class(s) for s in sets], pa.int64()),
                                                  pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], ["cls", "shingles"])
    return run


def full_sets(classes: DataFrame, docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cls, shingles) of the wanted classes, from the texts."""
    needed = _needed_map(classes.join(wanted, "cls", "left_semi").select(F.col("rep").alias("doc_id")))
    rows = docs.select(F.col("text").cast("string").alias("text"), F.pmod(F.xxhash64(F.col("doc_id").cast("bigint")), F.lit(MAP_BITS)).alias("slot"))
    sets = rows.mapInArrow(_sets(needed), "cls long, shingles array<long>").join(wanted.hint("merge"), "cls", "left_semi")
    return stage(sets.dropDuplicates(["cls"]), "near-sets")


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the candidate pairs (a, b) of classes, those whose full sets are similar enough."""
    left, right = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("cls").alias("b"), F.col("shingles").alias("y"))
    full = pairs.hint("merge").join(left, "a").join(right.hint("merge"), "b")
    both = full.select("a", "b", (F.size("x") + F.size("y")).alias("sizes"), F.size(F.array_intersect("x", "y")).alias("both"))
    return stage(both.where(F.col("both") * (100 + PERCENT) >= F.col("sizes") * PERCENT).select("a", "b").distinct(), "near-links")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()


def _with_signature(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    sig = F.struct("n", *CHUNK_NAMES)
    x, y = classes.select(F.col("cls").alias("a"), sig.alias("x")), classes.select(F.col("cls").alias("b"), sig.alias("y"))
    return pairs.hint("merge").join(x, "a").join(y.hint("merge"), "b")


def _hashes(column: pa.ListArray) -> Iterator[np.ndarray]:
    ends, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).view(np.uint64)
    for start, end in zip(ends, ends[1:]):
        yield values[start:end]


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(TALLY, np.int64)
    for batch in batches:
        for s in _hashes(batch.column(1)):
            np.add.at(counts, (s % np.uint64(TALLY)).astype(np.int64), 1)
    slot = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(counts[slot])], ["slot", "n"])


def _rarest(counts: np.ndarray):
    """The shingles of which alike sets share at least one: all but the most frequent ones that an overlap can do without."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, parts, places = [], [], []
            for cls, s in zip(batch.column(0).to_pylist(), _hashes(batch.column(1))):
                first = len(s) - -(-len(s) * PERCENT // 100) + 1
                order = np.lexsort((s, counts[(s % np.uint64(TALLY)).astype(np.int64)]))[:first]
                names.append(np.full(len(order), cls, np.int64))
                parts.append(s[order].view(np.int64))
                places.append(np.arange(len(order)))
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (names, parts, places)], ["cls", "key", "pos"])
    return run


def _across(rest: DataFrame, sets: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs of classes (cls, root) in different components, within DISTANCE, that share one of their rarest shingles.

    The order of rarity is by a hashed tally of fixed size; any order that is the same for all sets loses no pair. Shingles of many
    classes are compared in blocks of classes against blocks.
    """
    rows = sets.mapInArrow(_tally, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()  # TALLY rows at most
    counts = np.zeros(TALLY, np.int64)
    counts[rows["slot"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    keys = stage(sets.mapInArrow(_rarest(counts), "cls long, key long, pos long").join(rest.hint("merge"), "cls"), "near-rarest")
    mixed = keys.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count(F.lit(1)).alias("size")).where("r0 < r1")
    met = (keys.join(mixed.select("key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")).hint("merge"), "key")
           .withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")))
    sig = classes.select("cls", F.struct("n", *CHUNK_NAMES).alias("sig"))
    both = met.hint("merge").join(sig, "cls")
    x = both.select("key", F.col("block").alias("i"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"),
                    F.col("cls").alias("a"), F.col("root").alias("ra"), F.col("sig").alias("x"), F.col("pos").alias("px"))
    y = both.select("key", F.col("block").alias("j"), F.explode(F.sequence(F.lit(0), F.col("block"))).alias("i"),
                    F.col("cls").alias("b"), F.col("root").alias("rb"), F.col("sig").alias("y"), F.col("pos").alias("py"))
    # if this is the first shingle in that order that both have, the overlap is at most what is left of either set from here on
    enough = F.least(F.col("x.n") - F.col("px"), F.col("y.n") - F.col("py")) * (100 + PERCENT) >= (F.col("x.n") + F.col("y.n")) * PERCENT
    near = ((F.col("ra") != F.col("rb")) & ((F.col("i") < F.col("j")) | (F.col("a") < F.col("b"))) & alike_sizes("x", "y") & enough
            & (distance("x", "y") <= DISTANCE))
    pairs = x.hint("merge").join(y, ["key", "i", "j"]).where(near)
    return stage(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near-across")


def near_groups(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n (set size), cls (class of equal sets), component_id (smallest doc_id reachable). Runs jobs."""
    signed = stage(signatures(docs), "near-signed")
    classes = stage(signed.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"),
                                                             *(F.first(c).alias(c) for c in CHUNK_NAMES)), "near-classes")
    keys = classes.select("cls", F.explode(index_keys()).alias("key"))
    met = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = stage(keys.hint("merge").join(met, "key"), "near-members")
    # the least changed of many copies meets most others, so it heads their buckets
    weights = stage(members.groupBy("cls").agg(F.sum("size").alias("met")).select("cls", F.struct("met", "cls").alias("weight")), "near-weights")
    heaviest = members.hint("merge").join(weights, "cls").groupBy("key").agg(F.max("weight").alias("head"))
    heads = members.select("key", "cls").hint("merge").join(heaviest, "key").groupBy("cls").agg(F.max("head").alias("head"))
    heads = heads.select("cls", F.col("head.cls").alias("head")).where("cls <> head")
    first = _with_signature(heads.select(F.col("head").alias("a"), F.col("cls").alias("b")), classes)
    first = stage(first.where(alike_sizes("x", "y") & (distance("x", "y") <= DISTANCE)).select("a", "b"), "near-first")
    links = confirm(first, full_sets(classes, docs, _ends(first)))
    roots = components(links).select(F.col("node").alias("cls"), "root")
    placed = stage(members.select("cls", "key").join(roots.hint("merge"), "cls", "left").withColumn("root", F.coalesce("root", "cls")), "near-placed")
    mixed = placed.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 < r1").select("key")
    rest = stage(placed.join(mixed.hint("merge"), "key", "left_semi").select("cls", "root").distinct(), "near-rest")
    sets = full_sets(classes, docs, rest.select("cls"))
    roots = components(links.unionByName(confirm(_across(rest, sets, classes), sets)))
    # few classes have links; one component may have most of these, so its smallest id is dealt over salts
    roots = stage(roots.withColumnRenamed("node", "cls"), "near-roots")
    linked = classes.join(roots, "cls").withColumn("salt", F.pmod(F.xxhash64("cls"), F.lit(SALTS)).cast("int"))
    ids = linked.groupBy("root").agg(F.min("rep").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    alone = classes.join(roots.hint("merge"), "cls", "left_anti").select("cls", F.col("rep").alias("component_id"))
    named = linked.join(ids.hint("merge"), ["root", "salt"]).select("cls", "component_id").unionByName(alone)
    named = stage(named.withColumnRenamed("cls", "_cls"), "near-named")
    found = signed.select("doc_id", "n", "cls").join(named.hint("merge"), (F.col("cls") == F.col("_cls")) & (F.col("n") > 0), "left")
    return found.select("doc_id", "n", "cls", F.coalesce("component_id", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    groups = near_groups(docs)
    return groups.select("doc_id", F.col("n").alias("n_shingles"), "component_id",
                         F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each group, the smallest doc_id, with all its columns; of rows that repeat it, one with the same text."""
    kept = stage(near_duplicates(docs).where("kept").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")), "near-kept")
    one, more = kept.where("rows = 1").hint("merge"), kept.where("rows > 1").hint("merge")
    once = docs.join(one, docs["doc_id"].eqNullSafe(one["doc_id"]), "left_semi")
    again = docs.join(more, docs["doc_id"].eqNullSafe(more["doc_id"]), "left_semi").dropDuplicates(["doc_id", "text"])
    return once.unionByName(again)
