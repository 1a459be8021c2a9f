"""Mixing sources to target weights along a curriculum whose weights change with training time.

Each source has a weight schedule, a piecewise linear function of training time 0..1. Its integral is the source's share of all
words; a source is used at most `most` times, and the excess is shared again by weight (one pass over the sources, sorted by
the level at which they fill up). Documents of a source are put in a random but fixed order; copies of a document lie at cumulative
word offsets in that order, and the offset's share of the source's target, put through the inverse of the integrated schedule,
is the copy's training position. Range-sorting by position gives the training order.

The cumulative offsets are a blocked prefix sum: each source is cut into `blocks` ranges of the order key, sums are formed per
block before any shuffle, and only block sums are scanned per source. So a source with a third of all rows is spread over all
tasks. Only DataFrame functions are used.

Defined cases: a null text has size 0; null sources are one source, last in order; a document of size 0 takes nothing; a null
doc_id is ordered like an empty id; repeated rows are separate documents with the same id. The last copy of one document per source
may be taken in part, in whole words: that is how a target is met to the word. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.llm.common import WORD, stage

#: Weight schedules as (time, weight) knots, dealt to the sources in turn: their integrals are 5, 2 and 1.
SCHEDULES = (((0.0, 7.5), (1.0, 2.5)), ((0.0, 2.0), (1.0, 2.0)), ((0.0, 0.5), (1.0, 1.5)))
_KEY_BITS = 60


def integral(knots: Sequence[tuple[float, float]]) -> float:
    return sum((u1 - u0) * (w0 + w1) / 2 for (u0, w0), (u1, w1) in zip(knots, knots[1:]))


def _dealt(tier: Column, values: Sequence[Column]) -> Column:
    out = values[-1]
    for k, v in enumerate(values[:-1]):
        out = F.when(tier == k, v).otherwise(out)
    return out


def _segments(knots: Sequence[tuple[float, float]]) -> Column:
    """Pieces of a schedule scaled to integral 1: start, weight at the start, slope, integral before."""
    whole, before, out = integral(knots), 0.0, []
    for (u0, w0), (u1, w1) in zip(knots, knots[1:]):
        out.append(F.struct(F.lit(u0).alias("u"), F.lit(w0 / whole).alias("w"), F.lit((w1 - w0) / whole / (u1 - u0)).alias("slope"),
                            F.lit(before).alias("before")))
        before += (u1 - u0) * (w0 + w1) / 2 / whole
    return F.array(*out)


def invert(share: Column, segments: Column) -> Column:
    """The training time at which the integrated schedule reaches a share in 0..1."""
    piece = F.element_at(F.filter(segments, lambda s: s["before"] <= share), -1)
    rest = share - piece["before"]
    speed = piece["w"] + F.sqrt(F.greatest(F.lit(0.0), piece["w"] * piece["w"] + F.lit(2.0) * piece["slope"] * rest))
    return piece["u"] + F.when(speed > 0, F.lit(2.0) * rest / speed).otherwise(F.lit(0.0))


def source_targets(sizes: DataFrame, schedules=SCHEDULES, most: int = 3) -> DataFrame:
    """From (source, source_size), one row per source: target words, filled up to `most` times each source's size."""
    by_name, by_level = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("level", F.col("source").asc_nulls_last())
    earlier = by_level.rowsBetween(Window.unboundedPreceding, -1)
    tier = (F.row_number().over(by_name) - 1) % len(schedules)
    ranked = (sizes.withColumn("tier", tier)
              .withColumn("weight", _dealt(F.col("tier"), [F.lit(integral(k)) for k in schedules]))
              .withColumn("cap", (F.col("source_size") * most).cast("double"))
              .withColumn("level", F.col("cap") / F.col("weight")))
    everything = Window.partitionBy()
    filled = ranked.withColumn("at", (F.sum(F.col("source_size")).over(everything).cast("double") - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0)))
                               / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0))))
    target = F.least(F.col("cap"), F.max("at").over(everything) * F.col("weight"))
    return (filled.withColumn("target", target).withColumn("words", F.floor(F.col("target") + 0.5).cast("bigint"))
            .select("source", "source_size", "tier", "target", "words"))


def order_key(doc_id: Column) -> Column:
    """A fixed random order of documents: the first 60 bits of the MD5 of the id."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("bigint")


def placed_documents(docs: DataFrame, schedules=SCHEDULES, most: int = 3, blocks: int = 1024) -> DataFrame:
    """One row per document: size, its source's size and target, the words before it in its source. Stages a narrow table."""
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"),
                         F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("bigint").alias("size"))
    marks = stage(narrow.withColumn("key", order_key(F.col("doc_id")))
                  .withColumn("block", F.floor(F.col("key") / F.lit((1 << _KEY_BITS) // blocks)).cast("int")), "mix-sizes")
    sums = stage(marks.groupBy("source", "block").agg(F.sum("size").alias("block_size")), "mix-blocks")
    targets = source_targets(sums.groupBy("source").agg(F.sum("block_size").alias("source_size")), schedules, most)
    upto = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.withColumn("carry", F.coalesce(F.sum("block_size").over(upto), F.lit(0)))
    carried = stage(carried.withColumnRenamed("source", "_s").join(targets, F.col("_s").eqNullSafe(F.col("source")))
                    .select(F.col("_s"), F.col("block").alias("_b"), "carry", "source_size", "tier", "target", "words"), "mix-carry")
    inside = Window.partitionBy("source", "block").orderBy("key", "doc_id", "size")
    placed = (marks.withColumn("slot", F.row_number().over(inside))
              .withColumn("inner", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")))
    return (placed.join(carried, F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b")))
            .withColumn("before", F.col("carry") + F.col("inner")).drop("_s", "_b", "carry", "inner", "key"))


def curriculum(docs: DataFrame, schedules=SCHEDULES, most: int = 3, blocks: int = 1024, unused: bool = False) -> DataFrame:
    """Copies of documents in training order: doc_id, source, copy, taken words, position, range-sorted by position.

    With `unused`, documents that are not taken at all come too, with 0 words and a null position (first in order).
    """
    placed = placed_documents(docs, schedules, most, blocks)
    whole = F.when(F.col("source_size") > 0, F.expr("words div source_size")).otherwise(F.lit(0))
    copies = (placed.withColumn("whole", whole).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("whole").cast("int"))))
              .withColumn("offset", F.col("copy") * F.col("source_size") + F.col("before"))
              .withColumn("taken", F.greatest(F.lit(0), F.least(F.col("size"), F.col("words") - F.col("offset")))))
    share = F.least(F.lit(1.0), F.col("offset").cast("double") / F.col("words").cast("double"))
    at = invert(share, _dealt(F.col("tier"), [_segments(k) for k in schedules]))
    copies = copies.withColumn("position", F.when(F.col("taken") > 0, at))
    if not unused:
        copies = copies.where("taken > 0")
    return (stage(copies.drop("offset", "whole", "tier", "words", "before"), "mix-copies")
            .repartitionByRange(F.col("position").asc_nulls_first(), "doc_id", "copy")
            .sortWithinPartitions(F.col("position").asc_nulls_first(), "doc_id", "copy"))


def mix_totals(docs: DataFrame) -> DataFrame:
    """One row per document, from the copies in the curriculum: words taken in all, and the first training position."""
    return (curriculum(docs, unused=True).groupBy("source", "block", "slot")
            .agg(F.first("doc_id").alias("doc_id"), F.first("size").alias("size"), F.first("source_size").alias("source_size"),
                 F.first("target").alias("target"), F.sum("taken").alias("taken"), F.min("position").alias("first_position"))
            .select("doc_id", "size", "source_size", "target", "taken", "first_position"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents themselves in training order, a row per copy. Texts stay whole: a part copy counts if half of it is taken.

    Rows that repeat doc_id, source and size all get the copies of the first of them.
    """
    places = (curriculum(docs).where(F.col("taken") * 2 >= F.col("size")).groupBy("doc_id", "source", "size", "slot")
              .agg(F.collect_list("position").alias("at"))
              .groupBy("doc_id", "source", "size").agg(F.min_by("at", "slot").alias("at")))
    size = F.regexp_count(F.coalesce(docs["text"], F.lit("")), F.lit(WORD))
    mine = docs["doc_id"].eqNullSafe(places["doc_id"]) & docs["source"].eqNullSafe(places["source"]) & (size == places["size"])
    order = "_position"
    while order in docs.columns:
        order = "_" + order
    return (docs.join(places, mine).select(*[docs[c] for c in docs.columns], F.explode(places["at"]).alias(order))
            .repartitionByRange(order).sortWithinPartitions(order).drop(order))
