"""Alignment of two tokenizers' tokens over the same bytes.

Both token lists of a text spell a blank and the text. The list of B becomes a dictionary from the byte offset where a token ends to the number of tokens up
to there, in which the offsets where tokens of A end are looked up. Those that both have cut the two lists into groups; the tokens that end at such an
offset are linked. Tokens are never empty, so each group has exactly one link, of its last tokens.

How often a pair of ids is linked in the whole corpus is counted by a number per pair. Only pairs of which one's bytes end with the other's can
be linked; these follow from the two vocabularies alone (some hundred thousand), so the table of all pairs is of fixed size, whatever the
corpus. A text's links are written as numbers of that table, counted per task, summed by Spark, and the sums go back to every task.

A is a byte-level BPE file of the
`tokenizers` library, B a `sentencepiece` model that puts a blank before the text. Special tokens are not used, their strings
inside texts are ordinary text.

Defined cases: a null or empty text, and one whose tokens of A or B do not spell it exactly, has no tokens: all its numbers are 0, its lists are empty and its
digest is ''; repeated rows count their links each; null ids are kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import slices, stage

ID_BITS = 20
#: The usual byte-level pre-tokenizer and the pattern it cuts words by.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TEXT_BYTES = 1 << 20


def byte_symbols() -> dict[str, int]:
    """The characters of byte-level vocabularies: printable Latin-1 stands for itself, the other bytes for what follows 255, in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


@dataclass
class Alignment:
    """Ids, and for each group the numbers of ids of A and of B up to its end."""

    a: np.ndarray
    b: np.ndarray
    a_ends: np.ndarray
    b_ends: np.ndarray

    def groups(self, a_names: tuple[np.ndarray, np.ndarray], b_names: tuple[np.ndarray, np.ndarray]) -> bytes:
        """`a1,a2|b1;a3|b2,b3`, from each id's digits with a comma behind them and with the sign that ends a group's list."""
        parts = np.empty(len(self.a) + len(self.b), object)
        for ids, ends, others, (inner, last) in ((self.a, self.a_ends, np.r_[0, self.b_ends[:-1]], a_names), (self.b, self.b_ends, self.a_ends, b_names)):
            at = np.arange(len(ids)) + np.repeat(others, np.diff(ends, prepend=0))  # behind the other list's ids of the groups before
            parts[at] = inner[ids]
            parts[at[ends - 1]] = last[ids[ends - 1]]
        return b"".join(parts.tolist())[:-1]

    def links(self) -> np.ndarray:
        """A number per link made of both ids."""
        return self.a[self.a_ends - 1].astype(np.int64) << ID_BITS | self.b[self.b_ends - 1]


NOTHING = Alignment(*[np.zeros(0, np.int64)] * 4)


def align(a: np.ndarray, b: np.ndarray, a_sizes: np.ndarray, b_sizes: np.ndarray) -> Alignment:
    """Groups of two id lists over the same bytes; sizes by id."""
    b_at = dict(zip(np.cumsum(b_sizes[b]).tolist(), range(1, len(b) + 1)))
    found = np.fromiter(map(b_at.get, np.cumsum(a_sizes[a]).tolist(), itertools.repeat(0)), np.int64, len(a))  # offsets rise, so these do too
    a_ends = np.flatnonzero(found)
    return Alignment(a, b, a_ends + 1, found[a_ends])


def _names(size: int, end: bytes) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.array([b"%d%s" % (i, sign) for i in range(size)], object) for sign in (b",", end))


def byte_level(path: str):
    """The bytes of every id of a byte-level BPE file, and the function from a text to its ids without special tokens.

    Where ids follow the merges (the 256 bytes, then one id a merge, in order) and words are cut by the usual pattern, `tiktoken` gives the same ids several
    times faster; any other file goes through the `tokenizers` library.
    """
    symbols = byte_symbols()
    with open(path, encoding="utf-8") as f:
        config = json.load(f)
    model, cut = config["model"], config["pre_tokenizer"]
    tokens = [b""] * (1 + max([*model["vocab"].values(), *(t["id"] for t in config["added_tokens"])]))
    for token, i in model["vocab"].items():
        tokens[i] = bytes(symbols[c] for c in token)
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    plain = not config["normalizer"] and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix",
                                                                       "byte_fallback", "ignore_merges"))
    if plain and cut == BYTE_LEVEL and [model["vocab"][m] for m in merged] == list(range(256, 256 + len(merged))) and len(model["vocab"]) == 256 + len(merged):
        import tiktoken
        ranks = {token: i for i, token in enumerate(tokens[:len(model["vocab"])])}
        return tokens, tiktoken.Encoding("a", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    from tokenizers import Tokenizer
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    library.no_truncation()
    library.no_padding()
    return tokens, lambda text: library.encode(text, add_special_tokens=False).ids


class Pair:
    """Both tokenizers, and the table of id pairs that can be linked."""

    def __init__(self, a_path: str, b_path: str):
        from sentencepiece import SentencePieceProcessor
        self.a_bytes, self.a_ids = byte_level(a_path)
        self.b = SentencePieceProcessor(model_file=b_path)
        pieces = [(i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.b_bytes = [b"" if self.b.is_control(i) or self.b.is_unknown(i) else bytes([int(p[1:-1], 16)]) if self.b.is_byte(i)
                        else p.replace("▁", " ").encode() for i, p in pieces]
        self.a_sizes, self.b_sizes = (np.array(list(map(len, tokens))) for tokens in (self.a_bytes, self.b_bytes))
        self.a_names, self.b_names = _names(len(self.a_bytes), b"|"), _names(len(self.b_bytes), b";")

    def spelt(self, ids, of: list[bytes]) -> bytes:
        return b"".join(map(of.__getitem__, ids))

    def alignments(self, texts: list[str | None]) -> Iterator[Alignment]:
        for text, b in zip(texts, self.b.encode([t or "" for t in texts], num_threads=1)):
            if text:
                a, want = self.a_ids(" " + text), (" " + text).encode("utf-8", "surrogatepass")
                if self.spelt(a, self.a_bytes) == want and self.spelt(b, self.b_bytes) == want:
                    yield align(np.array(a), np.array(b), self.a_sizes, self.b_sizes)
                    continue
            yield NOTHING

    @functools.cached_property
    def linkable(self) -> np.ndarray:
        """Sorted numbers of all pairs whose bytes can end together: one's bytes are an ending of the other's."""
        def by_bytes(tokens: list[bytes]) -> dict[bytes, list[int]]:
            out: dict[bytes, list[int]] = {}
            for i, t in enumerate(tokens):
                if t:
                    out.setdefault(t, []).append(i)
            return out

        in_a, in_b, found = by_bytes(self.a_bytes), by_bytes(self.b_bytes), set()
        for token, ids in in_a.items():
            found |= {i << ID_BITS | j for k in range(len(token)) for j in in_b.get(token[k:], ()) for i in ids}
        for token, ids in in_b.items():
            found |= {i << ID_BITS | j for k in range(len(token)) for i in in_a.get(token[k:], ()) for j in ids}
        return np.array(sorted(found), np.int64)


@functools.lru_cache(maxsize=2)
def pair(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


def _aligned(docs: DataFrame, a_path: str, b_path: str, schema: str, types: list[pa.DataType], row) -> DataFrame:
    """doc_id and what `row` makes of a text's alignment."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from cuelake.llm import crosstok  # the worker's own module: its tokenizers outlive the task
        both = crosstok.pair(a_path, b_path)
        for whole in batches:
            for batch in slices(whole, 1, TEXT_BYTES):
                made = zip(*[row(both, x) for x in both.alignments(batch.column(1).to_pylist())])
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, t) for v, t in zip(made, types))], names)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def token_groups(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, the ids of both tokenizers, and per group the numbers of ids of A and of B up to its end."""
    return _aligned(docs, a_path, b_path, "doc_id long, a_ids array<int>, b_ids array<int>, a_ends array<int>, b_ends array<int>",
                    [pa.list_(pa.int32())] * 4, lambda both, x: tuple(v.astype(np.int32) for v in (x.a, x.b, x.a_ends, x.b_ends)))


def _digest(both: Pair, x: Alignment) -> tuple:
    links = np.searchsorted(both.linkable, x.links()).astype("<u4")
    return len(x.a), len(x.b), len(x.a_ends), len(links), hashlib.sha256(x.groups(both.a_names, both.b_names)).hexdigest() if len(x.a) else "", links.tobytes()


def _counted(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for links in batch.column(0):
                np.add.at(total, np.frombuffer(links.as_buffer(), "<u4"), 1)
        which = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(which, pa.int64()), pa.array(total[which])], ["pair", "n"])
    return run


def _totals(counts: np.ndarray, best: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [np.frombuffer(links.as_buffer(), "<u4") for links in batch.column(batch.num_columns - 1)]
            sums = [[int(table[links].sum(dtype=np.int64)) for links in each] for table in (best, counts)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(s, pa.int64()) for s in sums)], [*batch.schema.names[:-1], "n_best", "count_sum"])
    return run


def group_digests(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Per document: n_a, n_b, n_groups, n_links, groups_sha256, n_best and count_sum (see the module). Runs jobs."""
    links = stage(_aligned(docs, a_path, b_path, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary",
                           [pa.int64()] * 4 + [pa.string(), pa.binary()], _digest), "token-links")
    pairs = pair(a_path, b_path).linkable
    seen = links.select("links").mapInArrow(_counted(len(pairs)), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()  # linkable pairs at most
    counts = np.zeros(len(pairs), np.int64)
    counts[seen["pair"].to_numpy(np.int64)] = seen["n"]
    of_b = pairs & (1 << ID_BITS) - 1
    highest = np.zeros(int(of_b.max()) + 1, np.int64)
    np.maximum.at(highest, of_b, counts)
    return links.mapInArrow(_totals(counts, (counts == highest[of_b]).astype(np.int8)),
                            "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")
