"""Small expressions and helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import string
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuelake.sources.scratch import stage  # noqa: F401  one way to stage tables in the whole library

#: Words are runs of anything but the six ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"


def lower_az(text: Column) -> Column:
    """Lower-case A-Z and nothing else; the plain lower() is the same and faster where a text is all ASCII."""
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def doc_fold(column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5: which documents are held out; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 5


def give_back() -> None:
    """Return freed memory of a Python worker to the system: workers are reused by later stages with needs of their own."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


class Recent(dict):
    """Results of a function of a string, of two generations of `size` keys each; keys over `longest` characters are not kept."""

    def __init__(self, make: Callable, size: int, longest: int):
        super().__init__()
        self.make, self.size, self.longest, self.older = make, size, longest, {}

    def __missing__(self, key: str):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > self.longest:
                return value
        if len(self) >= self.size:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


def slices(batch: pa.RecordBatch, column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of about `most` bytes in a string or binary column, of one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    upto, start = np.cumsum(sizes), 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(upto, upto[start] - sizes[start] + most, "right"))
        yield batch.slice(start, max(1, stop - start))
        start = max(start + 1, stop)


def add_columns(df: DataFrame, source: str, fields: list[T.StructField], load: Callable, keep: list[str] | None = None) -> DataFrame:
    """All columns (or those of `keep`) and new ones, which the function that `load` gives in a worker makes of the values of a column."""
    names = df.columns
    at, kept = names.index(source), [names.index(k) for k in (keep if keep is not None else names)]
    schema = T.StructType([*(df.schema.fields[k] for k in kept), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        act = load()
        types = [pa.binary() if isinstance(f.dataType, T.BinaryType) else pa.string() for f in fields]
        for whole in batches:
            for batch in slices(whole, at):
                made = zip(*[act(v.as_py()) for v in batch.column(at)])
                arrays = [pa.array(values, kind) for values, kind in zip(made, types)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), *arrays], schema.names)

    return df.mapInArrow(run, schema)


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
