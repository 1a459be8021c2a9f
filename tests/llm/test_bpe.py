import hashlib
import random

import numpy as np
import public_tokenizers
import tiktoken

from cuelake.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def test_ids_like_tiktoken_and_round_trip(docs):
    known = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})
    rng = random.Random(0)
    texts = ["", None, "a" * 50_000, " " * 3000 + "x", "ab" * 9000, "don't  <|endoftext|>\r\n　x", "\U0001f600é\x00" * 50]
    texts += ["".join(rng.choice("aeinrst éß'\n1中") for _ in range(rng.randint(0, 300))) for _ in range(300)]
    df = docs(list(enumerate(texts)))
    both = bpe.decode(bpe.encode(df, PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN)
    assert both.columns == df.columns + ["ids", "decoded"]
    for r in both.collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == known.encode_ordinary(r.text or "")
        assert bytes(r.decoded).decode() == (r.text or "")
    r = bpe.token_digests(docs([(None, None)]), PATH, public_tokenizers.PATTERN).first()
    assert (r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) == (None, 0, *[hashlib.sha256(b"").hexdigest()] * 2)
    assert bpe.token_digests(docs([]), PATH, public_tokenizers.PATTERN).count() == 0


def test_forgetting_pieces_changes_nothing(monkeypatch):
    codec = bpe.Codec(PATH, public_tokenizers.PATTERN)
    text = " ".join(f"thwh{i}ndon" for i in range(300))
    want = codec.encode(text)
    monkeypatch.setattr(bpe, "REMEMBERED", 7)
    assert bpe.Codec(PATH, public_tokenizers.PATTERN).encode(text) == want


def test_decoding_takes_every_id_there_is():
    codec = bpe.Codec(PATH, public_tokenizers.PATTERN)
    ranks = bpe.read_ranks(PATH)
    ids = np.array(sorted(ranks.values()), "<u4").tobytes()
    assert codec.decode(ids) == (b"".join(sorted(ranks, key=ranks.get)),) and codec.decode(None) == (b"",)
    assert isinstance(codec.tokens, np.ndarray)  # all ids of a text are looked up at once
