"""BPE with word ends: a priority queue of merge ranks over a doubly linked symbol list, and decoding by vocabulary strings.

The tokenizer is a JSON file of the `tokenizers` library: normalizer, pre-tokenizer, vocabulary and merges are read from it. Strings of its
special tokens are cut out of a text first and stand for themselves. What is left is normalised and cut into words with the library's own
normalizer and pre-tokenizer, so that Unicode tables agree. Each word is merged here: its symbols form a linked list, all adjacent pairs that can
merge wait in a heap by (rank, position), the lowest is merged if its pair still stands there, else skipped as stale, and the two pairs
that a merge creates are pushed. A word of n symbols costs O(n log n), however long it is.

Normalisation and cutting never reach over white space, so a text is read in runs between white space. A worker remembers the results of recent short runs
and words in two generations of REMEMBERED each; the older one is dropped when the younger is full. That bounds its memory and changes no result.

Decoding joins the vocabulary strings of the ids with blanks, which is what the library does for a tokenizer without a decoder.

Defined cases: a null or empty text has no ids and decodes to ''; characters without a symbol in the vocabulary are left out, as the library does
without an unknown token; repeated rows are encoded alike, each for itself; an empty table gives no rows; all other columns, whatever their
names, are passed on. A tokenizer with a decoder, dropout, byte fallback, an unknown token or a prefix for inner symbols is refused.
"""

from __future__ import annotations

import functools
import json
import re
from heapq import heapify, heappop, heappush

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuelake.llm.common import Recent, add_columns

REMEMBERED, REMEMBERED_CHARS = 200_000, 48
SHIFT = 20  # symbols per word in a heap entry are 2^32 at most, ids 2^20

#: White space of Unicode.
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"


#: The normalizer and the word pattern for which the words of a run of printable
#: ASCII are known without the library, and these words in lower case.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
                                                  {"type": "Lowercase"}]}
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
ASCII_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+"


class Merger:
    """Merges one word into ids."""

    def __init__(self, vocabulary: dict[str, int], merges: list, suffix: str):
        self.vocabulary, self.suffix = vocabulary, suffix
        self.pairs: dict[int, int] = {}  # two ids -> rank and the id that the merge makes
        self.made: list[int] = []  # rank -> the id that the merge makes
        for rank, pair in enumerate(merges):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.pairs[vocabulary[a] << SHIFT | vocabulary[b]] = rank << SHIFT | vocabulary[a + b]
            self.made.append(vocabulary[a + b])
        self.ranks = {pair: m >> SHIFT for pair, m in self.pairs.items()}

    def ids(self, word: str) -> list[int]:
        get, merge, made_by = self.vocabulary.get, self.ranks.get, self.made
        symbols = list(map(get, word))
        symbols[-1] = get(word[-1] + self.suffix)
        if None in symbols:
            symbols = [s for s in symbols if s is not None]
        n = len(symbols)
        place = 8 if n <= 256 else 32  # entries of short words are small integers
        mask = (1 << place) - 1
        rank_at = [merge(a << SHIFT | b) for a, b in zip(symbols, symbols[1:])]  # of a symbol and the next one, if they can merge
        queue = [r << place | i for i, r in enumerate(rank_at) if r is not None]
        if not queue:
            return symbols
        heapify(queue)
        rank_at.append(None)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            entry = heappop(queue)
            i = entry & mask
            r = entry >> place
            if rank_at[i] != r:
                continue  # stale: a neighbour took part in another merge
            j = after[i]
            made = symbols[i] = made_by[r]
            symbols[j] = rank_at[j] = None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                r = rank_at[i] = merge(made << SHIFT | symbols[k])
                if r is not None:
                    heappush(queue, r << place | i)
            else:
                rank_at[i] = None
            if i:
                p = before[i]
                r = rank_at[p] = merge(symbols[p] << SHIFT | made)
                if r is not None:
                    heappush(queue, r << place | p)
        return [s for s in symbols if s is not None]


class Codec:
    def __init__(self, path: str):
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        model = config["model"]
        if (model["type"] != "BPE" or config["decoder"] or not config["pre_tokenizer"]
                or any(model.get(k) for k in ("dropout", "byte_fallback", "unk_token", "continuing_subword_prefix", "ignore_merges"))):
            raise ValueError("only plain BPE with a pre-tokenizer and without decoder, dropout, byte fallback and unknown token")
        library = Tokenizer.from_file(path)
        self.normalize = library.normalizer.normalize_str if library.normalizer else str
        self.cut = library.pre_tokenizer.pre_tokenize_str
        self.merger = Merger(model["vocab"], model["merges"], model.get("end_of_word_suffix") or "")
        self.strings = {i: s.encode() for s, i in model["vocab"].items()}
        self.special = {}
        for token in config["added_tokens"]:
            if token["normalized"] or token["single_word"] or token["lstrip"] or token["rstrip"]:
                raise ValueError("only added tokens that match as they are")
            self.special[token["content"]] = token["id"]
            self.strings[token["id"]] = token["content"].encode()
        longest_first = sorted(self.special, key=len, reverse=True)
        self.specials = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if longest_first else None
        self.ascii_words = None
        if config["normalizer"] == NORMALIZER and config["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] == WORDS:
            self.ascii_words = re.compile(ASCII_WORDS).findall  # the same for ASCII runs, without the library
        self.packed = {i: i.to_bytes(4, "little") for i in self.strings}
        self.spaced = {i: b" " + s for i, s in self.strings.items()}
        self.runs = re.compile(f"[^{SPACE}]+").findall
        self.of_word = Recent(self._word, REMEMBERED, REMEMBERED_CHARS)
        self.of_run = Recent(self._run, REMEMBERED, REMEMBERED_CHARS)

    def _word(self, word: str) -> tuple[bytes, bytes]:
        return self._packed(self.merger.ids(word))

    def _run(self, run: str) -> tuple[bytes, bytes]:
        if self.ascii_words and run.isascii() and run.isprintable():  # bytes that stand for themselves
            words = self.ascii_words(run.lower())
        else:
            words = [word for word, _ in self.cut(self.normalize(run))]
        return self.of_word[words[0]] if len(words) == 1 else _joined([self.of_word[word] for word in words])

    def _packed(self, ids: list[int]) -> tuple[bytes, bytes]:
        return b"".join([self.packed[i] for i in ids]), b"".join([self.spaced[i] for i in ids])

    def both(self, text: str | None) -> tuple[bytes, bytes]:
        """The ids as little-endian 32-bit integers, and what they decode to, in UTF-8."""
        parts = self.specials.split(text) if text and self.specials and self.specials.search(text) else [text or ""]
        found = []
        for at, part in enumerate(parts):
            found += [self._packed([self.special[part]])] if at % 2 else map(self.of_run.__getitem__, self.runs(part))
        ids, decoded = _joined(found)
        return ids, decoded[1:]

    def encode(self, text: str | None) -> tuple[bytes]:
        return self.both(text)[:1]

    def decode(self, ids: bytes | None) -> tuple[str]:
        return b" ".join(map(self.strings.__getitem__, np.frombuffer(ids or b"", "<u4").tolist())).decode(),


def _joined(pairs: list[tuple[bytes, bytes]]) -> tuple[bytes, bytes]:
    ids, decoded = zip(*pairs) if pairs else ((), ())
    return b"".join(ids), b"".join(decoded)


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _method(name: str, path: str):
    def load():
        from cuelake.llm import wordbpe  # the worker's own module: what it remembers outlives the task
        return getattr(wordbpe.codec(path), name)
    return load


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """All columns, and the token ids of the text, little-endian unsigned 32-bit integers in one binary."""
    return add_columns(df, text, [T.StructField(ids, T.BinaryType())], _method("encode", path))


def decode(df: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """All columns, and the text that the ids decode to."""
    return add_columns(df, ids, [T.StructField(decoded, T.StringType())], _method("decode", path))


def token_digests(docs: DataFrame, path: str) -> DataFrame:
    """Per document: number of tokens, and digests of its ids and of the text they decode to."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    made = [T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())]
    both = add_columns(rows, "text", made, _method("both", path), keep=["doc_id"])
    return both.select("doc_id", F.expr("octet_length(ids) div 4").cast("bigint").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
