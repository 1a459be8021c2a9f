"""Readers and writers on real files."""

import json
import struct

from pyspark.sql import functions as F

from cuelake.sources import readers as R, writers as O


def test_pcm_files(spark, tmp_path):
    for n in range(3):
        (tmp_path / f"s1_{n}.pcm").write_bytes(struct.pack("<1600f", *[n / 10] * 1600))
    f = R.read_pcm_frames(R.pcm_files(spark, str(tmp_path))).orderBy("frame_no").collect()
    assert [(r.session_id, r.frame_no, r.start_ms, r.end_ms, len(r.samples)) for r in f] == [
        ("s1", 0, 0, 100, 1600), ("s1", 1, 100, 200, 1600), ("s1", 2, 200, 300, 1600)]
    assert abs(f[2].samples[5] - 0.2) < 1e-6


def test_archive_documents_of_the_reference_layout(spark, tmp_path):
    doc = {"id": "ab1", "url": "u", "created_at": 1.5, "status": "ended", "accuracy": None, "segment_count": 0, "cue_count": 2,
           "accuracy_summary": {}, "records": [], "cues": [{"start": 0.0, "end": 1.25, "text": "a"}, {"start": 1.25, "end": 2, "text": "b"}]}
    (tmp_path / "ab1.json").write_text(json.dumps(doc))
    (tmp_path / "bad.json").write_text(json.dumps({**doc, "id": "../x"}))
    s, c = R.read_session_archive(spark, str(tmp_path))
    assert [r.id for r in s.collect()] == ["ab1"]
    assert [(r.cue_no, r.start_ms, r.end_ms, r.text) for r in c.orderBy("cue_no").collect()] == [(1, 0, 1250, "a"), (2, 1250, 2000, "b")]


def test_archive_parts_keep_cue_numbers(spark, tmp_path):
    cues = spark.createDataFrame([("s", i, i * 10, i * 10 + 5, f"t{i}") for i in range(1, 8)],
                                 "session_id string, cue_no bigint, start_ms bigint, end_ms bigint, text string")
    s = spark.createDataFrame([("s", "u")], "id string, url string")
    O.archive_documents(s, cues, 3).write.json(str(tmp_path / "a"))
    sessions, back = R.read_session_archive(spark, str(tmp_path / "a"))
    assert sessions.count() == 1
    assert [(r.cue_no, r.text) for r in back.orderBy("cue_no").collect()] == [(i, f"t{i}") for i in range(1, 8)]


def test_gpu_lines(spark, tmp_path):
    (tmp_path / "g.csv").write_text("0, RTX, 76, 20, 2713, 16303, 54, 54.33, [N/A], N/A, 2000, 14000\n1, x, 5\n"
                                    "[N/A], y, bad, 1, 2, 3, [Not Supported], 5, 6, 7, 8, 9, extra\n")
    got = R.read_gpu_samples(spark, str(tmp_path)).orderBy("name").collect()
    assert [(r["index"], r.name, r.util_gpu, r.power_w, r.power_limit_w, r.temp_c, r.clock_mem_mhz) for r in got] == [
        (0, "RTX", 76.0, 54.33, None, 54.0, 14000.0), (0, "y", None, 5.0, 6.0, None, 9.0)]


def test_transcripts(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "j").mkdir()
    (tmp_path / "t" / "a.txt").write_text("one  two\n\n three\n")
    (tmp_path / "j" / "a.jsonl").write_text('{"text": "x y", "ts": 1}\n\n{"ts": 2}\n{"text": "z"}\n')
    assert R.read_transcript(spark, str(tmp_path / "t")).first().transcript == "one two three"
    assert R.read_transcript(spark, str(tmp_path / "j"), jsonl=True).first().transcript == "x y  z"


def test_transcripts_of_several_files_cut_over_many_tasks(spark, tmp_path):
    words = [[f"w{k % 977}" for k in range(i, i + 5)] for i in range(4000)]
    for part in range(2):
        text = "".join(" ".join(line) + "\n\n" * (1 + i % 2) for i, line in enumerate(words[part * 2000:part * 2000 + 2000]))
        (tmp_path / "a").mkdir(exist_ok=True)
        (tmp_path / "a" / f"part-{part:05}.txt").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = R.read_transcript_lines(spark, str(tmp_path / "*"), folders=True)
        got = lines.orderBy("line_no").collect()
        whole = R.read_transcript(spark, str(tmp_path / "*"), folders=True).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.line_no, r.text) for r in got] == [(i, " ".join(w)) for i, w in enumerate(words)]
    assert [r.transcript for r in whole] == [" ".join(w for line in words for w in line)]


def test_files_to_paired_transcripts_to_rates(spark, tmp_path):
    from cuelake.operators import quality as W
    for side, texts in (("ref", {"a": "one two three\nfour", "b": "x y", "c": "left out"}), ("hyp", {"a": "one three\nfour five", "b": "x y"})):
        (tmp_path / side).mkdir()
        for name, text in texts.items():
            (tmp_path / side / f"{name}.txt").write_text(text)
    sides = [R.read_transcript(spark, str(tmp_path / s)).select(F.substring_index("file", "/", -1).alias("name"), F.col("transcript").alias(s))
             for s in ("ref", "hyp")]
    both = W.pair_transcripts(*sides, "name").unionByName(W.unpaired_transcripts(*sides, "name"), allowMissingColumns=True)
    got = {r.name: (r.wer, r.deletions, r.insertions) for r in W.wer(both).collect()}
    assert got == {"a.txt": (0.5, 1, 1), "b.txt": (0.0, 0, 0), "c.txt": (1.0, 2, 0)}


def test_webvtt_files(spark, tmp_path):
    cues = spark.createDataFrame([(s, i, f"c{i}", i * 1000, i * 1000 + 1) for s in (1, 2) for i in range(1, 4)],
                                 "session_id int, cue_no bigint, text string, start_ms bigint, end_ms bigint")
    O.write_webvtt(cues, str(tmp_path / "v"), 2)
    text = "".join(p.read_text() for p in sorted((tmp_path / "v" / "session_id=1").glob("part-*.txt")))
    assert text.startswith("WEBVTT\n\n1\n") and text.index("c1") < text.index("c2") < text.index("c3")


def test_hook_failures_do_not_fail_the_job(spark):
    from cuelake.operators import scoring as H

    def load():
        def score(x):
            if len(x) < 2:
                raise RuntimeError("short")
            return [{"text": "w", "start_ms": 0, "end_ms": len(x)}]
        return score

    df = spark.createDataFrame([(1, [0.1, 0.2]), (2, [0.1])], "session_id int, samples array<float>")
    got = {r.session_id: (r.ok, len(r.words)) for r in H.score_words(df, load).collect()}
    assert got == {1: (True, 1), 2: (False, 0)}


def test_dump_line(spark):
    pairs = spark.createDataFrame([(1, 1, 0, 0x94, 0x25), (1, 1, 1, 0xC8, 0xE9)],
                                  "session_id int, cue_no int, pair_no bigint, b1 int, b2 int")
    assert O.hex_dump_608(pairs).first().dump == "  0000: 94 25  [RU2 — Roll-Up 2 rows]\n  0001: C8 E9  [text: Hi]"


def test_only_speech_is_scored(spark):
    from cuelake.plans import live

    def load():
        return lambda x: [{"text": "w", "start_ms": 0, "end_ms": 1}]

    rows = [(1, i, i * 100, i * 100 + 100, [0.5 if i in (3, 4, 9) else 0.0] * 4) for i in range(12)]
    f = spark.createDataFrame(rows, "session_id int, frame_no bigint, start_ms bigint, end_ms bigint, samples array<double>")
    got = {r.frame_no: r.utterance_id for r in live.score_speech(f, load, 0.1, 1).collect()}
    assert got == {3: 1, 4: 1, 5: 1, 9: 2, 10: 2}


def test_short_last_pcm_file_keeps_its_place(spark, tmp_path):
    for n, size in enumerate((1600, 1600, 800)):
        (tmp_path / f"s2_{n}.pcm").write_bytes(struct.pack(f"<{size}f", *[0.5] * size))
    f = R.read_pcm_frames(R.pcm_files(spark, str(tmp_path))).orderBy("frame_no").collect()
    assert [(r.start_ms, r.end_ms) for r in f] == [(0, 100), (100, 200), (200, 250)]


def test_gpu_line_with_an_empty_last_field(spark, tmp_path):
    (tmp_path / "g.csv").write_text("0, a, 1, 2, 3, 4, 5, 6, 7, 8, 9,\n1, b, 1, 2, 3, 4, 5, 6, 7, 8, 9\n")
    (r,) = R.read_gpu_samples(spark, str(tmp_path)).collect()
    assert (r.name, r.util_gpu, r.clock_mem_mhz) == ("a", 1.0, None)


def test_archive_batches_may_come_again(spark, tmp_path):
    path, index = str(tmp_path / "a"), str(tmp_path / "i")
    cues = spark.createDataFrame([(i % 7, i, i * 10, i * 10 + 5, f"t{i}") for i in range(1, 40)],
                                 "session_id bigint, cue_no bigint, start_ms bigint, end_ms bigint, text string")

    def sessions(ids, at, status):
        return spark.createDataFrame([(str(i), "u", "", "stream", float(at), status, None, 0) for i in ids],
                                     "id string, url string, video_id string, source_type string, created_at double, status string, accuracy double, segment_count int")

    batches = [sessions(range(7), 1, "ended"), sessions([2, 3], 5, "error"), sessions([3, 99], 0, "late")]
    for n in (0, 1, 1, 2, 1, 2):  # a batch may come again, also after later ones
        O.archive_batch(batches[n], cues, path, index, n, buckets=4)
    got = {r.id: (r.created_at, r.status, r.cue_count) for r in O.read_archive_index(spark, index).collect()}
    want = {str(i): (1.0, "ended", sum(k % 7 == i for k in range(1, 40))) for i in range(7)}
    want |= {"2": (5.0, "error", want["2"][2]), "3": (5.0, "error", want["3"][2]), "99": (0.0, "late", 0)}
    assert got == want
    touched = {p.name for p in (tmp_path / "i" / "version=1").iterdir() if p.name.startswith("bucket")}
    assert len(touched) <= 2  # only the buckets of the batch's two sessions
    assert {r.id for r in R.read_session_archive(spark, path)[0].collect()} == set(want)


def test_batches_of_a_scorer(spark):
    from cuelake.operators import scoring as H

    def load():
        def score(samples):
            if any(len(x) == 1 for x in samples):
                raise RuntimeError("short sample")
            return [[{"text": str(len(samples)), "start_ms": 0, "end_ms": len(x)}] for x in samples]
        return score

    df = spark.createDataFrame([(i, [0.1] * (1 if i == 5 else 2)) for i in range(8)], "session_id int, samples array<float>").coalesce(1)
    got = {r.session_id: (r.ok, r.error, [w.text for w in r.words]) for r in H.score_words(df, load, batch_size=3).collect()}
    assert got[5] == (False, "RuntimeError: short sample", [])
    assert got[0] == (True, None, ["3"]) and got[3] == (True, None, ["1"]) and got[7] == (True, None, ["2"])

    def broken():
        raise OSError("no model")

    assert {r.error for r in H.score_words(df, broken).collect()} == {"OSError: no model"}
