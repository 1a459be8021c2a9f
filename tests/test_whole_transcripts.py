"""The transcript queries give whole transcripts, not only their lines."""

import pytest

from cuelake.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["read_transcript", "read_transcript_jsonl"])
def test_a_source_is_one_transcript(spark, name):
    turns = spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect()
    want = {str(s): " ".join(w for r in turns if r.conv_id % 4 == s for w in r.text.split()) for s in range(4)}
    rows = catalog.QUERIES[name](spark, SF).collect()
    assert [r.part_no for r in rows] == [0] * 4
    assert {r.file: r.transcript for r in rows} == want
