import random

import numpy as np
import public_tokenizers
import tiktoken

from cuelake.llm import bpe, separators
from cuelake.sources.scratch import scratch_path


def brute(ids, end):
    out, start = [], 0
    for k, x in enumerate(ids):
        if x == end:
            out.append((len(out), start, k - start, True))
            start = k + 1
    return out + [(len(out), start, len(ids) - start, False)] * (start < len(ids))


def test_blocks_of_any_size(shipped):
    rng = random.Random(0)
    files = [[rng.choice([7, 7, 1, 2, 3, 4]) for _ in range(rng.randint(0, 60))] for _ in range(25)]
    files += [[], [7], [7, 7, 7], [1] * 50, [7] + [1] * 50, [1] * 49 + [7]]
    for size in (2, 6, 64, 1 << 20):
        rows = []
        for f, ids in enumerate(files):
            raw = np.array(ids, "<u2").tobytes() + b"\x07" * (f % 2)  # half a token at the end
            rows += [(f"f{f}", k, raw[i:i + size]) for k, i in enumerate(range(0, len(raw), size))]
        blocks = shipped.createDataFrame(rows, "file string, block int, data binary")
        got = {}
        for r in separators.document_tokens(blocks, end=7, block_bytes=size).orderBy("file", "doc_no").collect():
            got.setdefault(r.file, []).append((r.doc_no, r.first_token, r.n_tokens, r.ended))
        assert got == {f"f{f}": brute(ids, 7) for f, ids in enumerate(files) if ids}


def test_written_files(shipped, docs):
    texts = ["", None, "\n\n", "a\n\nb" * 40, "x " * 50_000, "one", "one", "Ċਊ é"]
    path = scratch_path(shipped, "flat")
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    separators.write_token_files(docs(list(enumerate(texts))).coalesce(1), path, ranks, public_tokenizers.PATTERN, 50256)
    known = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(ranks), special_tokens={})
    for size in (64, 1 << 20):
        got = separators.document_tokens(separators.token_blocks(shipped, path, size), block_bytes=size).orderBy("doc_no").collect()
        assert [r.n_tokens for r in got] == [len(known.encode_ordinary(t or "")) for t in texts]
    empty = scratch_path(shipped, "flat")
    separators.write_token_files(docs([]), empty, ranks, public_tokenizers.PATTERN, 50256)
    assert separators.document_tokens(separators.token_blocks(shipped, empty)).count() == 0


def test_one_file_over_many_tasks(shipped, tmp_path):
    from pyspark.sql import functions as F
    ids = np.random.default_rng(1).integers(0, 50, 40_000)
    folder = tmp_path / "with blank %41"
    folder.mkdir()
    (folder / "big.bin").write_bytes(ids.astype("<u2").tobytes())
    (folder / "empty.bin").write_bytes(b"")
    blocks = separators.token_blocks(shipped, str(folder), 1000)
    assert blocks.select(F.spark_partition_id()).distinct().count() > 1
    got = separators.document_tokens(blocks, end=7, block_bytes=1000).orderBy("doc_no").collect()
    assert [(r.doc_no, r.first_token, r.n_tokens, r.ended) for r in got] == brute(ids.tolist(), 7)
    assert got[0].file.endswith("big.bin")
