"""Path-dependent operators as folds over sorted rows.

A fold is a small object with ``start()``, ``step(state, *values) -> (state, rows)`` and ``finish(state) -> rows``;
its state is a dict of JSON values. Spark partitions and sorts, Python streams Arrow batches through the fold, so a
group never has to fit in memory. The same objects drive the streaming twins.

A key that is too large for one task is cut into ordered blocks. All blocks run at once from a guessed (empty) start
state; blocks whose predecessors ended otherwise run again from the right state, until nothing changes. The result
equals the sequential fold for any data, because block *b* is right after *b* rounds at the latest; states that
forget their past settle in two or three. A state entry passes untouched through blocks that do not name it
(``fold.entries``), so rare entries cost no rounds. A fold that names all its states (``fold.states``) needs no rounds: every block is
walked from each of them once, and two passes do for any data.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuelake.operators.scan import BLK, carries
from cuelake.sources.scratch import stage


def freeze(value) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False)


def thaw(start: str | None, fold) -> dict:
    """Start state of a block from ``{entry: json}``; entries without a value keep the fold's own start."""
    state = fold.start()
    if isinstance(start, str):
        state.update({k: json.loads(v) for k, v in json.loads(start).items() if v is not None})
    return state


def _runner(fold, parts: list[str], out: list[str], states: bool):
    """Batch iterator function: fold each run of equal ``parts`` in a sorted partition."""
    names = list(fold.columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, last = None, None, True
        rows: list[tuple] = []

        def close() -> None:
            if states:
                rows.extend((*current, k, freeze(v)) for k, v in state.items())
            elif last:
                rows.extend((*current, *r) for r in fold.finish(state))

        for pdf in batches:
            groups = zip(*[pdf[c].tolist() for c in parts])
            values = zip(*[pdf[c].tolist() for c in names])
            heads = zip(pdf["_start"], pdf["_final"])
            for group, vals, (start, final) in zip(groups, values, heads):
                if group != current:
                    if current is not None:
                        close()
                    current, last = group, bool(final)
                    state = thaw(start, fold)
                state, made = fold.step(state, *vals)
                if not states:
                    rows.extend((*group, *r) for r in made)
            yield pd.DataFrame(rows, columns=out)
            rows.clear()
        if current is not None:
            close()
            yield pd.DataFrame(rows, columns=out)

    return run


class Words:
    """A list of strings that stay in Arrow: one is read by its number, several are picked by a mask."""

    def __init__(self, values: pa.Array, at: np.ndarray):
        self.values, self.at = values, at

    def __getitem__(self, i):
        return Words(self.values, self.at[i]) if isinstance(i, np.ndarray) else self.values[int(self.at[i])].as_py()

    def tolist(self) -> list:
        """The strings themselves; neighbours are read as one slice."""
        n = len(self.at)
        if n and self.at[-1] - self.at[0] == n - 1:
            return self.values.slice(int(self.at[0]), n).to_numpy(zero_copy_only=False).tolist()
        return [self.values[int(i)].as_py() for i in self.at]


def _cells(column: pa.Array) -> list:
    """Values of a column; lists of numbers as NumPy slices, lists of strings as ``Words``."""
    if not pa.types.is_list(column.type):
        return column.to_pylist()
    ends, values = column.offsets.to_numpy(), column.values
    if pa.types.is_string(values.type):
        place = np.arange(len(values))
        return [Words(values, place[a:b]) for a, b in zip(ends[:-1], ends[1:])]
    flat = values.to_numpy(zero_copy_only=False)
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]


def _column(cells: tuple, kind: pa.DataType) -> pa.Array:
    """The inverse of ``_cells``; the ``Words`` of one column belong to one batch."""
    if not pa.types.is_list(kind) or not cells:
        return pa.array(cells, kind)
    at = np.concatenate([c.at if isinstance(c, Words) else c for c in cells])
    sizes = [len(c.at) if isinstance(c, Words) else len(c) for c in cells]
    ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    return pa.ListArray.from_arrays(ends, cells[0].values.take(pa.array(at)) if isinstance(cells[0], Words) else pa.array(at, kind.value_type))


ARROW = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "array<string>": pa.list_(pa.string()), "array<bigint>": pa.list_(pa.int64())}


def _arrow_runner(fold, parts: list[str], more: list[str], states: bool):
    """``_runner`` over Arrow batches, for folds with lists (``fold.arrow``): only the items a fold looks at become Python objects."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, last, kinds = None, None, True, None
        rows: list[tuple] = []

        def close() -> None:
            if states:
                rows.extend((*current, k, freeze(v)) for k, v in state.items())
            elif last:
                rows.extend((*current, *r) for r in fold.finish(state))

        def made_batch() -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * len(kinds)
            return pa.RecordBatch.from_arrays([_column(c, k) for c, k in zip(columns, kinds.values())], names=list(kinds))

        for batch in batches:
            kinds = kinds or {p: batch.schema.field(p).type for p in parts} | {c.split()[0]: ARROW[c.split()[1]] for c in more}
            groups = zip(*[batch.column(c).to_pylist() for c in parts])
            values = zip(*[_cells(batch.column(c)) for c in fold.columns])
            heads = zip(batch.column("_start").to_pylist(), batch.column("_final").to_pylist())
            for group, vals, (start, final) in zip(groups, values, heads):
                if group != current:
                    if current is not None:
                        close()
                    current, last = group, bool(final)
                    state = thaw(start, fold)
                state, made = fold.step(state, *vals)
                if not states:
                    rows.extend((*group, *r) for r in made)
            yield made_batch()
            rows.clear()
        if current is not None:
            close()
            yield made_batch()

    return run


def _folded(src: DataFrame, fold, parts: list[str], more: list[str], states: bool, schema: str) -> DataFrame:
    """Run a fold over sorted rows; ``more`` are the columns beside ``parts`` that it makes."""
    if getattr(fold, "arrow", False):
        return src.mapInArrow(_arrow_runner(fold, parts, more, states), schema)
    return src.mapInPandas(_runner(fold, parts, [*parts, *[c.split()[0] for c in more]], states), schema)


def _schema(df: DataFrame, cols: list[str], more: str) -> str:
    return ", ".join([f"{c} {df.schema[c].dataType.simpleString()}" for c in cols] + [more])


def _sorted(df: DataFrame, parts: list[str], order: list[str], cols: list[str]) -> DataFrame:
    """All rows of a block in one task, in order.

    The shuffle is on a hash of the block key, not on its columns: after a join on the same columns Spark would drop
    a ``repartition(*parts)`` as redundant, and adaptive execution might then split a skewed block over tasks.
    """
    seen = list(dict.fromkeys([*parts, *order, *cols]))
    return df.select(*seen).repartition(F.xxhash64(*parts)).sortWithinPartitions(*parts, *order)


def _packed(starts: DataFrame, parts: list[str]) -> DataFrame:
    """One row per block: its entries as a JSON object, and whether it is the last block of its key."""
    entries = F.map_from_entries(F.collect_list(F.struct("_entry", "_now")))
    return starts.groupBy(*parts).agg(F.to_json(entries).alias("_start"), F.first("_final").alias("_final"))


def _walks(fold, parts: list[str], out: list[str]):
    """Batch iterator function: where each run of equal ``parts`` leads from every state of the fold, and the totals it adds on the way.

    Starts that meet in one state go on together, so usually few are left after some rows.
    """
    states, totals = fold.states(), list(fold.totals)
    finite = [k for k in states[0] if k not in totals]
    number = {tuple(s[k] for k in finite): i for i, s in enumerate(states)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, walkers = None, []
        rows: list[tuple] = []

        def close() -> None:
            ends, sums = [0] * len(states), [[0] * len(states) for _ in totals]
            for state, members in walkers:
                for start, offsets in members:
                    ends[start] = number[tuple(state[k] for k in finite)]
                    for column, name, offset in zip(sums, totals, offsets):
                        column[start] = state[name] + offset
            rows.append((*current, ends, *sums))

        for pdf in batches:
            for group, vals in zip(zip(*[pdf[c].tolist() for c in parts]), zip(*[pdf[c].tolist() for c in fold.columns])):
                if group != current:
                    if current is not None:
                        close()
                    current, walkers = group, [[dict(s), [(i, [0] * len(totals))]] for i, s in enumerate(states)]
                for walker in walkers:
                    walker[0] = fold.step(walker[0], *vals)[0]
                if len(walkers) > 1:
                    met: dict[tuple, list] = {}
                    for state, members in walkers:
                        kept = met.setdefault(tuple(state[k] for k in finite), [state, []])
                        kept[1] += [(i, [o + state[t] - kept[0][t] for o, t in zip(offsets, totals)]) for i, offsets in members]
                    walkers = list(met.values())
            yield pd.DataFrame(rows, columns=out)
            rows.clear()
        if current is not None:
            close()
            yield pd.DataFrame(rows, columns=out)

    return run


def finite_starts(df: DataFrame, keys: list[str], order: list[str], fold, blocks: DataFrame) -> DataFrame:
    """Start state of every block, for a fold whose state is one of few (``fold.states()``) beside running ``fold.totals``: two passes for any data.

    Each block becomes a table from start to end state, and the tables of a key are put together in order.
    """
    parts, totals = [*keys, BLK], list(fold.totals)
    src = _sorted(df.join(blocks.select(*parts), parts), parts, order, list(fold.columns))
    more = "".join(f", _t_{t} array<bigint>" for t in totals)
    tables = src.mapInPandas(_walks(fold, parts, [*parts, "_ends", *[f"_t_{t}" for t in totals]]), _schema(df, parts, "_ends array<int>" + more))
    states = fold.states()
    first = fold.start()
    finite = [k for k in first if k not in totals]
    at = next(i for i, s in enumerate(states) if all(s[k] == first[k] for k in finite))
    state = "struct<at:int" + "".join(f",{t}:bigint" for t in totals) + ">"
    start = F.struct(F.lit(at).alias("at"), *[F.lit(first[t]).cast("bigint").alias(t) for t in totals])
    carried = carries(tables, keys, state, start, lambda c, b: F.struct(
        F.get(b["_ends"], c["at"]).alias("at"), *[(c[t] + F.get(b[f"_t_{t}"], c["at"])).alias(t) for t in totals]))
    known = [F.create_map(*[F.lit(x) for k in finite for x in (k, freeze(s[k]))]) for s in states]
    entries = F.get(F.array(*known), F.col("_carry.at"))
    if totals:
        entries = F.map_concat(entries, F.create_map(*[x for t in totals for x in (F.lit(t), F.col(f"_carry.{t}").cast("string"))]))
    return carried.join(blocks, parts).select(*parts, F.to_json(entries).alias("_start"), "_final")


def block_starts(df: DataFrame, keys: list[str], order: list[str], fold) -> DataFrame | None:
    """Start state of every block of the keys that have several, ready for a fold; None when there is no such key."""
    parts, slot = [*keys, BLK], [*keys, BLK, "_entry"]
    if df.filter(F.col(BLK) != 0).isEmpty():
        return None
    per_key = Window.partitionBy(*keys)
    blocks = (df.select(*parts).distinct()
                .withColumn("_of", F.count("*").over(per_key))
                .withColumn("_final", F.col(BLK) == F.max(BLK).over(per_key))
                .filter(F.col("_of") > 1).drop("_of"))
    blocks = stage(blocks)
    if blocks.isEmpty():
        return None
    if hasattr(fold, "states"):
        return finite_starts(df, keys, order, fold, blocks)
    named = df.select(*parts, F.explode(fold.entries()).alias("_entry")).distinct()
    known = stage(named.join(blocks, parts).select(*slot, "_final", F.lit(None).cast("string").alias("_now")))
    todo, ends = known, None
    in_order = Window.partitionBy(*keys, "_entry").orderBy(BLK)
    while True:
        src = df.join(_packed(todo, parts), parts)
        more = ["_entry string", "_end string"]
        fresh = _folded(_sorted(src, parts, order, [*fold.columns, "_start", "_final"]), fold, parts, more, True, _schema(df, parts, ", ".join(more)))
        fresh = stage(todo.select(*slot).distinct().join(fresh, slot, "left"))
        ends = fresh if ends is None else stage(
            ends.join(fresh.select(*slot), slot, "left_anti").unionByName(fresh))
        moved = stage(known.join(ends, slot).withColumn("_next", F.lag("_end").over(in_order)))
        known = moved.select(*slot, "_final", F.col("_next").alias("_now"))
        wrong = moved.filter(~F.col("_now").eqNullSafe(F.col("_next"))).select(*parts).distinct()
        if wrong.isEmpty():
            return _packed(known, parts)
        todo = known.join(wrong, parts)


def _counted(rows: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Numbers that start from 0 in every block run on over the blocks of a key; the rows are written once."""
    rows, parts = stage(rows), [*keys, BLK]
    earlier = Window.partitionBy(*keys).orderBy(BLK).rowsBetween(Window.unboundedPreceding, -1)
    ahead = rows.groupBy(*parts).agg(F.count("*").alias("_n")).select(*parts, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_ahead"))
    return rows.join(ahead, parts).withColumn(count, F.col(count) + F.col("_ahead")).drop("_ahead")


def fold_blocks(df: DataFrame, keys: list[str], order: list[str], fold, keep: bool = False, count: str | None = None) -> DataFrame:
    """Fold each key of a blocked table (``_blk``), exactly, with the blocks of a key in parallel.

    ``keep`` writes ``df`` once, for inputs that are more than a table scan. ``count`` names a column in which the fold numbers its rows from 0.
    """
    if keep:
        df = stage(df)
    parts = [*keys, BLK]
    known = block_starts(df, keys, order, fold)
    if known is None:
        src = df.withColumn("_start", F.lit(None).cast("string")).withColumn("_final", F.lit(True))
    else:
        src = df.join(known, parts, "left").withColumn("_final", F.coalesce("_final", F.lit(True)))
    made = _folded(_sorted(src, parts, order, [*fold.columns, "_start", "_final"]), fold, parts, list(fold.output), False,
                   _schema(df, parts, ", ".join(fold.output)))
    return (_counted(made, keys, count) if count and known is not None else made).drop(BLK)
