"""Byte-level BPE over documents with a hierarchical-bitmap rank queue.

A text is split by the tokenizer's pattern, and each pre-token is merged on its own. The parts of a pre-token are a linked list of
byte positions; the adjacent pairs that form a token lie in one bucket per merge rank, and a two-level bitmap of the ranks in use
gives the lowest one by find-first-set. Buckets hand out their leftmost position; entries that a neighbouring merge has made stale
are skipped. A merge touches two pairs, so a pre-token of n bytes costs O(n log n) at worst, however long it is.

Each Python worker remembers the ids of recent short pre-tokens in two generations of REMEMBERED each, the older of which is dropped when the younger is
full; that bounds its memory and changes no result.

Defined cases: a null text is encoded as an empty one, which has no ids; special tokens do not exist, their strings are ordinary text; ids
are little-endian unsigned 32-bit integers in one binary per row; all other columns, whatever their names, are passed on.
"""

from __future__ import annotations

import base64
import functools
from heapq import heappop, heappush

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuelake.llm.common import Recent, add_columns

REMEMBERED, REMEMBERED_CHARS = 250_000, 48
_BITS = tuple(1 << i for i in range(256))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class RankMerger:
    """Merges pre-tokens by rank. The queue is empty between calls, so one instance serves a whole worker."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.buckets: list[list[int]] = [[] for _ in range(max(ranks.values()) + 1)]
        self.words = [0] * ((max(ranks.values()) >> 8) + 1)
        self.of_two = [ranks.get(bytes((a, b))) for a in range(256) for b in range(256)]

    def tokens(self, piece: bytes) -> list[bytes]:
        if piece in self.ranks:
            return [piece]
        get, words, buckets, bits, of_two = self.ranks.get, self.words, self.buckets, _BITS, self.of_two
        n, top = len(piece), 0
        rank_at = [of_two[a << 8 | b] for a, b in zip(piece, piece[1:])]
        rank_at.append(None)
        for i, r in enumerate(rank_at):
            if r is not None:
                bucket = buckets[r]
                if not bucket:
                    w = r >> 8
                    words[w] |= bits[r & 255]
                    top |= 1 << w
                bucket.append(i)  # positions rise, so the list is a heap
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while top:
            w = (top & -top).bit_length() - 1
            word = words[w]
            low = word & -word
            r = (w << 8) + low.bit_length() - 1
            bucket = buckets[r]
            i = heappop(bucket)
            if not bucket:
                words[w] = word = word ^ low
                if not word:
                    top ^= 1 << w
            if rank_at[i] != r:
                continue
            j = after[i]
            k = after[i] = after[j]
            rank_at[j] = None
            if k < n:
                before[k] = i
                r = rank_at[i] = get(piece[i:after[k]])
                if r is not None:
                    bucket = buckets[r]
                    if not bucket:
                        w = r >> 8
                        words[w] |= bits[r & 255]
                        top |= 1 << w
                    heappush(bucket, i)
            else:
                rank_at[i] = None
            if i:
                p = before[i]
                r = rank_at[p] = get(piece[p:k])
                if r is not None:
                    bucket = buckets[r]
                    if not bucket:
                        w = r >> 8
                        words[w] |= bits[r & 255]
                        top |= 1 << w
                    heappush(bucket, p)
        out, i = [], 0
        while i < n:
            k = after[i]
            out.append(piece[i:k])
            i = k
        return out


class Codec:
    def __init__(self, ranks_path: str, pattern: str):
        ranks = read_ranks(ranks_path)
        self.split = regex.compile(pattern).findall
        self.merger = RankMerger(ranks)
        self.packed = {token: rank.to_bytes(4, "little") for token, rank in ranks.items()}
        self.pieces = Recent(self._piece, REMEMBERED, REMEMBERED_CHARS)
        self.tokens = np.full(max(ranks.values()) + 1, None, object)
        self.tokens[list(ranks.values())] = np.array([*ranks, None], object)[:-1]  # None keeps NumPy from making byte strings of fixed width

    def _piece(self, piece: str) -> bytes:
        return b"".join(map(self.packed.__getitem__, self.merger.tokens(piece.encode())))

    def encode(self, text: str | None) -> tuple[bytes]:
        return (b"".join(map(self.pieces.__getitem__, self.split(text))) if text else b""),

    def decode(self, ids: bytes | None) -> tuple[bytes]:
        return b"".join(self.tokens[np.frombuffer(ids or b"", "<u4")].tolist()),

    def both(self, text: str | None) -> tuple[bytes, bytes]:
        return *(ids := self.encode(text)), *self.decode(*ids)


@functools.lru_cache(maxsize=4)
def codec(ranks_path: str, pattern: str) -> Codec:
    return Codec(ranks_path, pattern)


def _method(name: str, ranks_path: str, pattern: str):
    def load():
        from cuelake.llm import bpe  # the worker's own module: what it remembers outlives the task
        return getattr(bpe.codec(ranks_path, pattern), name)
    return load


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """All columns, and the token ids of the text."""
    return add_columns(df, text, [T.StructField(ids, T.BinaryType())], _method("encode", ranks_path, pattern))


def decode(df: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """All columns, and the bytes that the ids stand for."""
    return add_columns(df, ids, [T.StructField(decoded, T.BinaryType())], _method("decode", ranks_path, pattern))


def encode_and_decode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """All columns (or those of `keep`), `ids` and what they decode to, `decoded`; the text goes to Python once."""
    made = [T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())]
    return add_columns(df, text, made, _method("both", ranks_path, pattern), keep)


def token_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Per document: number of tokens, and digests of its ids and of what they decode to."""
    both = encode_and_decode(docs.select("doc_id", "text"), ranks_path, pattern, keep=["doc_id"])
    return both.select("doc_id", F.expr("octet_length(ids) div 4").cast("bigint").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
