"""Token counts of documents in flat token files, which hold nothing but token ids with an end-of-document id after each document.

Files are cut into blocks of bytes, and each block is read and searched with NumPy for the separator on its own, so one huge file is spread over all
tasks. A small row per block then goes through a prefix scan per file (documents before the block, last separator before it); joined back to the
blocks, the scan gives the document that crosses into a block its start, and the blocks write their documents in parallel.

Defined cases: an empty document has 0 tokens; tokens after the last separator of a file are one document with `ended` false; bytes that do not
fill a token at the end of a file are ignored; an empty file has no documents; a null text is written as an empty one; repeated rows are documents of
their own; other columns, whatever their names, are ignored. Files of any size are read, but where Arrow cannot open the store (see
`cuelake.sources.ranges`), files over 2 GB fail.

`write_token_files` makes such files from texts: 16-bit ids, a file per task. Its separator is the id whose bytes are two line feeds, so that
Spark's text writer writes it; the tokenizer's token with that id gets the free id `spare`.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuelake.llm.common import slices, stage
from cuelake.sources.ranges import read_ranges

END = 0x0A0A
WIDTH = 2
BLOCK_BYTES = 4 << 20


@functools.lru_cache(maxsize=2)
def _tokenizer(ranks_path: str, pattern: str) -> tiktoken.Encoding:
    from cuelake.llm.bpe import read_ranks
    return tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks=read_ranks(ranks_path), special_tokens={})


def write_token_files(docs: DataFrame, path: str, ranks_path: str, pattern: str, spare: int) -> None:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from cuelake.llm import separators
        encode = separators._tokenizer(ranks_path, pattern).encode_ordinary
        for whole in batches:
            for batch in slices(whole, 0):
                out = []
                for text in batch.column(0):
                    ids = np.array(encode(text.as_py() or ""), np.uint16)
                    ids[ids == END] = spare
                    out.append(ids.astype("<u2").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    flat = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "value binary")
    flat.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\n\n").text(path)


def token_blocks(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, block, data) of all files under a path, each block read by itself; block_bytes is a multiple of the token width."""
    return read_ranges(spark, path, block_bytes)


def _scan(end: int, width: int, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, tokens = [], []
            for block, data in zip(batch.column(1).to_pylist(), batch.column(2)):
                raw = data.as_py()
                ids = np.frombuffer(raw, f"<u{width}", len(raw) // width)
                ends.append(np.flatnonzero(ids == end) + block * (block_bytes // width))
                tokens.append(len(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tokens, pa.int64()), pa.array(ends, pa.list_(pa.int64()))],
                                             ["file", "block", "tokens", "ends"])
    return run


def document_tokens(blocks: DataFrame, end: int = END, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """file, doc_no (from 0 in its file), first_token, n_tokens, ended. Runs a job: separator positions are staged, blocks are read once."""
    found = stage(blocks.select("file", F.col("block").cast("bigint").alias("block"), "data").mapInArrow(_scan(end, width, block_bytes), "file string, block long, tokens long, ends array<long>"),
                  "separators")
    order = Window.partitionBy("file").orderBy("block")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    each = found.select("file", "block", F.size("ends").cast("bigint").alias("n"), F.array_max("ends").alias("last_end"))  # one small row a block
    carry = each.select("file", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("doc_base"),
                        F.coalesce(F.max("last_end").over(earlier) + 1, F.lit(0)).alias("open"), F.lead(F.lit(False), 1, True).over(order).alias("last"))
    scanned = found.join(carry, ["file", "block"])
    starts = F.concat(F.array("open"), F.transform("ends", lambda e: e + 1))
    upto = F.col("block") * (block_bytes // width) + F.col("tokens")
    rest = F.when(F.col("last") & (F.element_at(starts, -1) < upto), F.array(upto)).otherwise(F.array().cast("array<long>"))
    stops = F.concat("ends", rest)
    documents = F.posexplode(F.arrays_zip(F.slice(starts, F.lit(1), F.size(stops)).alias("start"), stops.alias("stop"))).alias("at", "d")
    return (scanned.select("file", "doc_base", F.size("ends").alias("n"), documents)
            .select("file", (F.col("doc_base") + F.col("at")).alias("doc_no"), F.col("d.start").alias("first_token"),
                    (F.col("d.stop") - F.col("d.start")).alias("n_tokens"), (F.col("at") < F.col("n")).alias("ended")))
