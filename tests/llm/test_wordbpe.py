import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cuelake.llm import wordbpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def texts():
    rng = random.Random(0)
    out = ["", None, "a" * 30_000, " " * 3000 + "X", "ab" * 9000, "Don't  <|endoftext|>\r\n　x", "\U0001f600é\x00" * 50, "ΑΣ ΑΣ. İ ǅ",
           "<|startoftext|><|endoftext|>", "<|endoftext", "e<|endoftext|>́é", "a\x1cb\x85c ́d", "1234567 9'LL 'S ''s"]
    out += ["".join(rng.choice("aeinrst EÉß'\n1中́​Σ") for _ in range(rng.randint(0, 300))) for _ in range(300)]
    return out


def test_ids_and_decoded_texts_like_the_library(docs, library):
    df = docs(list(enumerate(texts())))
    both = wordbpe.decode(wordbpe.encode(df, PATH), PATH)
    assert both.columns == df.columns + ["ids", "decoded"]
    digests = {r.doc_id: r for r in wordbpe.token_digests(df, PATH).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for r in both.collect():
        want = library.encode(r.text or "", add_special_tokens=False).ids
        decoded = library.decode(want, skip_special_tokens=False)
        assert np.frombuffer(r.ids, "<u4").tolist() == want and r.decoded == decoded
        d = digests[r.doc_id]
        assert (d.n_tokens, d.ids_sha256, d.decoded_sha256) == (len(want), sha(np.array(want, "<u4").tobytes()), sha(decoded.encode()))


def test_code_points(library):
    """All scripts, signs and white space; of the large blocks of ideographs and syllables, and of planes without characters, only the edges."""
    codec = wordbpe.Codec(PATH)
    parts = [(0, 0x3500), (0x9FF0, 0xAD00), (0xD700, 0xD800), (0xE000, 0xE010), (0xF900, 0x14800), (0x16000, 0x17010), (0x18700, 0x20010), (0x2FA00, 0x31400)]
    points = [chr(c) for a, b in parts for c in range(a, b)]
    for joint in (" ", "a"):  # alone, and where it may end a word
        for i in range(0, len(points), 2000):
            text = joint.join(points[i:i + 2000])
            assert codec.both(text)[0] == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_queue_equals_merging_by_lowest_rank():
    codec = wordbpe.Codec(PATH)
    merger, rng = codec.merger, random.Random(3)
    for _ in range(300):
        word = "".join(rng.choice("aenrst") for _ in range(rng.randint(1, 40)))
        s = [merger.vocabulary[c] for c in word[:-1]] + [merger.vocabulary[word[-1] + merger.suffix]]
        while True:
            found = [(merger.pairs[a << wordbpe.SHIFT | b] >> wordbpe.SHIFT, i) for i, (a, b) in enumerate(zip(s, s[1:])) if a << wordbpe.SHIFT | b in merger.pairs]
            if not found:
                break
            i = min(found)[1]
            s[i:i + 2] = [merger.pairs[s[i] << wordbpe.SHIFT | s[i + 1]] & (1 << wordbpe.SHIFT) - 1]
        assert merger.ids(word) == s


def test_forgetting_changes_nothing(monkeypatch):
    text = " ".join(f"Thwh{i % 97}ndon{i}," for i in range(300))
    want = wordbpe.Codec(PATH).both(text)
    monkeypatch.setattr(wordbpe, "REMEMBERED", 5)
    assert wordbpe.Codec(PATH).both(text) == want


def test_null_ids_repeats_and_an_empty_table(docs):
    got = wordbpe.token_digests(docs([(None, None), (1, "Ab"), (1, "Ab")]), PATH).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert [(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got if r.doc_id is None] == [(0, empty, empty)]
    assert len(got) == 3 and got[1] == got[2]
    assert wordbpe.token_digests(docs([]), PATH).count() == 0


def test_short_and_long_words_take_the_same_way(library):
    codec = wordbpe.codec(public_tokenizers.path("word_bpe_49k.json"))
    for n in (1, 2, 255, 256, 257, 600):
        word = ("theinrst" * 100)[:n]
        assert codec.merger.ids(word) == library.encode(word, add_special_tokens=False).ids
    assert max(codec.merger.ranks.values()) < 1 << 22  # a merge is its rank alone, so entries of short words stay small
