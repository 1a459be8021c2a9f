import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from cuelake.llm import crosstok

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tokens():
    """Ids and byte ranges of both tokenizers for a text, each found by the library's own decoder."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    symbols = {c: i for i, c in crosstok.byte_symbols().items()}
    assert len(symbols) == 256 and a.pre_tokenizer.pre_tokenize_str(" \n\x7f\xad")[0][0][0] == symbols[32]

    def both(text):
        want = (" " + (text or "")).encode()
        if not text:
            return [], []
        lists = []
        for ids, word in ((a.encode(" " + text, add_special_tokens=False).ids, lambda i: bytes(ord(c) if c not in back else back[c] for c in a.id_to_token(i))),
                          (b.encode(text), lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode())):
            at, out, spelt = 0, [], b""
            for i in ids:
                at += len(word(i))
                spelt += word(i)
                out.append((i, at))
            if spelt != want:
                return [], []
            lists.append(out)
        return lists
    back = crosstok.byte_symbols()
    return both


def texts():
    rng = random.Random(2)
    out = ["", None, "hello  world <|endoftext|>", "a▁b", " x\n\ty  ", "</s><s> ok <0x41>", "\x00 \U0001f600 é Å", "﻿z", "   ", "word " * 9000, "ß" * 3000]
    return out + ["".join(rng.choice("aeinrst éß'\n1中") for _ in range(rng.randint(0, 200))) for _ in range(150)]


def brute(rows, tokens):
    found, n = {}, Counter()
    for key, text in rows:
        a, b = tokens(text)
        links = [(i, j) for i, x in a for j, y in b if x == y] if len(a) < 2000 else [(i, dict((y, j) for j, y in b)[x]) for i, x in a if x in {y for _, y in b}]
        cuts, groups, at = sorted({x for _, x in a} & {y for _, y in b}), [], 0
        for cut in cuts:
            groups.append(",".join(str(i) for i, x in a if at < x <= cut) + "|" + ",".join(str(j) for j, y in b if at < y <= cut))
            at = cut
        found[key] = a, b, groups, links
        n.update(links)
    highest = defaultdict(int)
    for (_, j), k in n.items():
        highest[j] = max(highest[j], k)
    return {key: (len(a), len(b), len(g), len(links), sum(n[p] == highest[p[1]] for p in links), sum(n[p] for p in links),
                  hashlib.sha256(";".join(g).encode()).hexdigest() if a else "") for key, (a, b, g, links) in found.items()}


def test_like_brute_force(docs, tokens):
    rows = [(k, t if t is None or len(t) < 5000 else t[:4000]) for k, t in enumerate(texts())] + [(900, "hello world"), (901, "hello world")]
    got = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in crosstok.group_digests(docs(rows), A, B).collect()}
    want = brute(rows, tokens)
    assert got == want
    assert got[0] == got[1] == got[3] == (0, 0, 0, 0, 0, 0, "")


def test_groups_spell_the_same_bytes(docs):
    both = crosstok.pair(A, B)
    for r in crosstok.token_groups(docs(list(enumerate(texts()))), A, B).collect():
        i = j = 0
        for x, y in zip(r.a_ends, r.b_ends):
            assert both.spelt(r.a_ids[i:x], both.a_bytes) == both.spelt(r.b_ids[j:y], both.b_bytes) and x > i and y > j
            i, j = x, y
        assert (i, j) == (len(r.a_ids), len(r.b_ids))


def test_every_link_has_a_number():
    both = crosstok.pair(A, B)
    assert len(both.linkable) < 1_000_000
    known = set(both.linkable.tolist())
    for x in both.alignments(texts()):
        assert known.issuperset(x.links().tolist())


def test_null_ids_repeats_and_an_empty_table(docs):
    got = crosstok.group_digests(docs([(None, "a b"), (1, "a b"), (1, "a b")]), A, B).collect()
    assert {(r.n_links, r.count_sum) for r in got} == {(2, 6)} and len(got) == 3
    assert crosstok.group_digests(docs([]), A, B).count() == 0


def test_ids_of_a_like_the_tokenizers_library(tokens):
    """The quick way to A's ids, over texts and over every token of the vocabulary."""
    library = Tokenizer.from_file(A)
    library.encode_special_tokens = True
    spelt, ids = crosstok.byte_level(A)
    for text in [t for t in texts() if t] + [t.decode() for t in spelt if t and _is_text(t)]:
        assert list(ids(text)) == library.encode(text, add_special_tokens=False).ids


def _is_text(b):
    try:
        return bool(b.decode())
    except UnicodeDecodeError:
        return False


def test_a_file_of_another_kind_goes_through_the_library(tmp_path, monkeypatch):
    monkeypatch.setattr(crosstok, "BYTE_LEVEL", None)
    spelt, ids = crosstok.byte_level(A)
    assert [spelt[i] for i in ids(" hello <|endoftext|>")] == [b" hello", b" <", b"|", b"end", b"of", b"text", b"|", b">"]
