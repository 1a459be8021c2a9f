"""Ordered analytics per key that stay parallel when one key is huge.

A plain ``Window.partitionBy(session)`` puts a whole session into one task. Here every key is cut into ordered
*blocks* (column ``_blk``); rows are windowed inside a block, each block is reduced to one summary row, the
summaries are scanned per key, and the result of all earlier blocks is added back. The large table is shuffled
once, on (key, block).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.sources.scratch import scratch_path, stage

BLK = "_blk"
BLOCK_ROWS = 1 << 20


def seq_blocks(df: DataFrame, seq: str, rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks for a key whose ``seq`` column is a unique integer from 0 or 1: at most ``rows`` rows per block."""
    return df.withColumn(BLK, F.expr(f"CAST({seq} AS BIGINT) div {rows}"))


def range_blocks(df: DataFrame, keys: list[str], order: list[str], partitions: int | None = None) -> DataFrame:
    """Blocks for rows without an integer sequence: Spark's range partitioner splits heavy keys by sampled order.

    A block is a stretch of at most BLOCK_ROWS rows of a sorted partition, however few partitions there are. The rows are written once
    to the shared scratch folder: both the summary pass and the row pass must see the same blocks, also after an executor is lost.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, "blocks")
    (df.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order)
       .withColumn(BLK, F.expr(f"monotonically_increasing_id() div {BLOCK_ROWS}"))  # the partition and, in 33 bits, the row's place
       .write.parquet(path))
    return spark.read.parquet(path)


def one_block(staged: DataFrame) -> bool:
    """Whether no key of a staged table has a second block (its files tell: no rows are read where all blocks are 0)."""
    return staged.filter(F.col(BLK).isNull() | (F.col(BLK) != 0)).isEmpty()


def _frame(keys: list[str], order: list[str], before: bool) -> Window:
    end = -1 if before else Window.currentRow
    return Window.partitionBy(*keys, BLK).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)


def prefix(df: DataFrame, keys: list[str], order: list[str],
           specs: dict[str, tuple[str, Column]], before: bool = False, keep: bool = False) -> DataFrame:
    """Add running ``sum`` / ``max`` / ``last`` (non-null) columns over all rows of the key up to each row.

    ``df`` carries ``_blk``; ``specs`` maps an output name to (kind, expression). ``before`` leaves the row
    itself out. ``order`` must be a total order inside the key and agree with the block order.

    Rows and block summaries both read ``df``. For a table scan that is two narrow scans; where ``df`` is itself
    the result of joins, windows or Python, pass ``keep``: it is then written once to the shared scratch folder, so
    a chain of scans neither computes its beginning again at every link nor builds an ever larger plan. Where every key of a written table
    has one block, nothing is carried and nothing joined.
    """
    alone = False
    if keep:
        df = stage(df)
        alone = one_block(df)
    for name, (_, expr) in specs.items():
        df = df.withColumn(f"_v_{name}", expr)
    summaries, carries, inner = [], {}, {}
    earlier = Window.partitionBy(*keys).orderBy(BLK).rowsBetween(Window.unboundedPreceding, -1)
    for name, (kind, _) in specs.items():
        value = F.col(f"_v_{name}")
        if kind == "sum":
            summaries.append(F.sum(value).alias(f"_s_{name}"))
            carries[f"_c_{name}"] = F.sum(f"_s_{name}").over(earlier)
            inner[f"_r_{name}"] = F.sum(value).over(_frame(keys, order, before))
        elif kind == "max":
            summaries.append(F.max(value).alias(f"_s_{name}"))
            carries[f"_c_{name}"] = F.max(f"_s_{name}").over(earlier)
            inner[f"_r_{name}"] = F.max(value).over(_frame(keys, order, before))
        elif kind == "last":
            at = F.when(value.isNotNull(), F.struct(*[F.col(c) for c in order]))
            summaries.append(F.max_by(value, at).alias(f"_s_{name}"))
            carries[f"_c_{name}"] = F.last(f"_s_{name}", ignorenulls=True).over(earlier)
            inner[f"_r_{name}"] = F.last(value, ignorenulls=True).over(_frame(keys, order, before))
        else:
            raise ValueError(f"unknown scan {kind!r}")
    rows = df.select("*", *[c.alias(n) for n, c in inner.items()])
    carry = (df.groupBy(*keys, BLK).agg(*summaries)
               .select(*keys, BLK, *[c.alias(n) for n, c in carries.items()]))
    out = rows if alone else rows.join(carry, [*keys, BLK], "left")
    cols = []
    for name, (kind, _) in specs.items():
        run = F.col(f"_r_{name}")
        if alone:
            cols.append(run.alias(name))
            continue
        car = F.col(f"_c_{name}")
        if kind == "sum":
            both = F.coalesce(run, F.lit(0)) + F.coalesce(car, F.lit(0))
            cols.append(F.when(run.isNotNull() | car.isNotNull(), both).alias(name))
        elif kind == "max":
            cols.append(F.greatest(run, car).alias(name))
        else:
            cols.append(F.coalesce(run, car).alias(name))
    kept = [c for c in df.columns if not c.startswith(("_v_", "_r_"))]
    return out.select(*kept, *cols)


def carries(blocks: DataFrame, keys: list[str], state: str, start: Column, combine) -> DataFrame:
    """(keys, block, ``_carry``): what all earlier blocks of the key come to, for any summary that can be put together in order.

    ``blocks`` has one row per key and block with the summary's columns; ``state`` is the type of the carry, ``start`` its value before the first
    block, and ``combine(carry, block)`` the carry after a block, as expressions over structs. The blocks of one key are combined in one row: a
    million rows of the key become one step.
    """
    one = F.struct(F.col(BLK), *[F.col(c) for c in blocks.columns if c not in (*keys, BLK)])
    none = F.array().cast(f"array<struct<{BLK}:{blocks.schema[BLK].dataType.simpleString()},_carry:{state}>>")

    def step(acc: Column, block: Column) -> Column:
        out = F.concat(acc["out"], F.array(F.struct(block[BLK].alias(BLK), acc["state"].alias("_carry"))))
        return F.struct(combine(acc["state"], block).cast(state).alias("state"), out.alias("out"))

    listed = blocks.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("_blocks"))
    done = F.aggregate("_blocks", F.struct(start.cast(state).alias("state"), none.alias("out")), step, lambda acc: acc["out"])
    return listed.select(*keys, F.inline(done))


def number_rows(df: DataFrame, keys: list[str], order: list[str], name: str, keep: bool = False) -> DataFrame:
    """1-based row number per key in ``order`` over a blocked table."""
    return prefix(df, keys, order, {name: ("sum", F.lit(1).cast("bigint"))}, keep=keep)


def with_halo(df: DataFrame, seq: str, n: int, rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks for frames of the last ``n`` rows: the tail of a block is also copied to the next one.

    ``seq`` is dense per key. Copies carry ``_halo = true`` and are dropped after the window.
    """
    blk = F.expr(f"CAST({seq} AS BIGINT) div {rows}")
    own = F.struct(blk.alias(BLK), F.lit(False).alias("_halo"))
    copy = F.struct((blk + 1).alias(BLK), F.lit(True).alias("_halo"))
    tail = F.expr(f"pmod({seq}, {rows})") >= rows - n
    at = F.explode(F.when(tail, F.array(own, copy)).otherwise(F.array(own)))
    base = df.drop(BLK)
    return base.select("*", at.alias("_at")).select(*base.columns, f"_at.{BLK}", "_at._halo")


def trailing(df: DataFrame, keys: list[str], seq: str, n: int,
             aggs: dict[str, Column], rows: int = BLOCK_ROWS) -> DataFrame:
    """Aggregates over the last ``n`` rows of the key at each row (``seq`` dense per key)."""
    frame = Window.partitionBy(*keys, BLK).orderBy(seq).rowsBetween(-(n - 1), Window.currentRow)
    wide = with_halo(df, seq, n, rows)
    return (wide.select("*", *[a.over(frame).alias(k) for k, a in aggs.items()])
                .filter(~F.col("_halo")).drop("_halo", BLK))


def last_rows(df: DataFrame, keys: list[str], order: list[Column], tie: str, n: int, salts: int = 64) -> DataFrame:
    """The first ``n`` rows per key in ``order`` (pass descending columns for the last rows).

    Two steps: per (key, salt) and then per key over at most ``n * salts`` rows. Spark also applies the
    row-number limit before the shuffle, so a hot key sends few rows.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(tie), F.lit(salts)))
    for part in ([*keys, "_salt"], list(keys)):
        w = Window.partitionBy(*part).orderBy(*order)
        salted = salted.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)
    return salted.drop("_salt", "_rn")


def ordered_parts(df: DataFrame, keys: list[str], seq: str, text: str, sep: str, name: str,
                  rows: int) -> DataFrame:
    """Join texts in ``seq`` order, one row per (key, part) of at most ``rows`` texts.

    A whole text of an unlimited key cannot be one value; the parts in order are the whole text.
    """
    part = F.expr(f"CAST({seq} AS BIGINT) div {rows}").alias("part_no")
    items = F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.col(text).alias("t"))))
    return (df.groupBy(*keys, part)
              .agg(F.array_join(F.transform(items, lambda x: x["t"]), sep).alias(name)))

