"""Clean-up and layout: literal cases, and the standard library's wrapping for any text."""

import random
import textwrap

import pytest
from pyspark.sql import functions as F

from cuelake.functions import clock, text as T
from cuelake.operators import cues as Q, sessions as A


def one(spark, text, fn):
    return [r[0] for r in spark.createDataFrame([(t,) for t in text], "t string").select(fn(F.col("t"))).collect()]


def test_clean_fragment_cases(spark):
    cases = {
        "the the the cat": "the cat", "go go go go now": "go now", "I had had enough": "I had had enough",
        "hello , world .": "hello, world.", "wait!!! stop..": "wait! stop.", "a   b\t c": "a b c",
        "The the THE end": "The end", "été été été ici": "été ici", "to to to.": "to.", "": "", " \n ": "", "one!?!": "one!?!"}
    assert one(spark, cases, T.clean_fragment) == list(cases.values())


def test_boundary_word(spark):
    rows = [("going to the store", "going", "to the store"), ("going", "going", "going"), ("Going home", "going", "home"),
            ("going.", "going", "."), ("go on", "", "go on"), ("goings on", "going", "goings on")]
    df = spark.createDataFrame(rows, "t string, p string, w string")
    for r in df.select(T.clean_fragment(F.col("t"), F.col("p")).alias("g"), "w").collect():
        assert r.g == r.w


def test_last_word_and_tokens(spark):
    assert one(spark, ["to the store.", "", "..."], T.last_word) == ["store", "", ""]
    assert one(spark, ["Hello, world!", "It's  a-b"], T.wer_tokens) == [["hello", "world"], ["it's", "ab"]]


def _text(r):
    alphabet = "ab-,.é1'!"
    words = ["".join(r.choice(alphabet[:r.choice([2, 3, 9])]) for _ in range(r.choice([1, 3, 7, 12, 31, 33, 70])))
             for _ in range(r.randint(0, 14))]
    return " ".join(words)


def test_wrap_caption_equals_textwrap(spark):
    r = random.Random(5)
    texts = [_text(r) for _ in range(400)] + ["", "well-known to-do semi-automatic re-entry x-ray-vision tests",
                                              "dash--between words--and more -- here", "a" * 100, "ab " + "c" * 64]
    got = one(spark, texts, lambda c: T.wrap_caption(c, 32, 2))
    for t, g in zip(texts, got):
        want = textwrap.wrap(t, width=32, break_long_words=True)
        assert g == want[-2:], t


def test_wrap_lines_keeps_long_words(spark):
    t = ["a " + "b" * 40 + " c d", "x" * 31 + " y", "  "]
    assert one(spark, t, lambda c: T.wrap_lines(c)) == [["a", "b" * 40, "c d"], ["x" * 31, "y"], []]
    assert one(spark, t[:1], lambda c: T.wrap_lines(c, keep=2)) == [["b" * 40, "c d"]]


def test_clocks(spark):
    df = spark.createDataFrame([(3_723_004,), (90_000_000,), (59_999,), (-5,)], "m bigint").select(
        clock.vtt_time(F.col("m")), clock.log_time(F.col("m")), clock.uptime(F.col("m")), clock.short_clock(F.col("m")))
    got = [tuple(r) for r in df.collect()]
    assert got[0] == ("01:02:03.004", "01:02:03.004", "01:02:03", "1:02:03")
    assert got[1][:2] == ("25:00:00.000", "01:00:00.000")
    assert got[2] == ("00:00:59.999", "00:00:59.999", "00:00:59", "00:59")
    assert got[3][3] == "00:00"


@pytest.mark.parametrize("block", [2, 1000])
def test_dedupe_boundary_against_a_row_loop(spark, block):
    """Includes runs of one word and a mark, where dropped words make the next equal one stay."""
    r = random.Random(9)
    words = ["going.", "going.", "going", "Going!", "go", "go on", "on go.", ".", "...", "a b", "b", ""]
    rows = [(s, 0, i, r.choice(words)) for s in range(40) for i in range(r.randint(1, 25))]
    df = spark.createDataFrame(rows, "session_id int, utterance_id int, frag_no int, text string")
    got = {(x.session_id, x.frag_no): x.text for x in Q.dedupe_boundary(df, block).collect()}
    import re
    want, last = {}, {}
    for s, _, i, t in rows:
        if not t:
            continue
        shown = last.get(s, "")
        m = re.match(r"(\w+)\b\s*", t)
        rest = t[m.end():] if m else ""
        if shown and m and rest and m.group(1).lower() == shown.lower():
            t = rest
        t = re.sub(r"([,.!?;:])\1+", r"\1", t)
        want[(s, i)] = t
        found = re.findall(r"\w+", t)
        last[s] = found[-1] if found else ""
    assert got == want


def test_webvtt_document_parts(spark):
    cues = spark.createDataFrame([(1, i, f"c{i}", i * 1000, i * 1000 + 500) for i in range(1, 6)],
                                 "session_id int, cue_no int, text string, start_ms bigint, end_ms bigint")
    whole = Q.webvtt_document(cues).first().document
    assert whole.startswith("WEBVTT\n\n1\n00:00:01.000 --> 00:00:01.500 line:90%,end align:center\nc1\n\n2\n")
    parts = [r.document for r in Q.webvtt_document(cues, 2).orderBy("part_no").collect()]
    assert len(parts) == 3 and "\n".join(parts) == whole


def test_tail_text(spark):
    rows = [(1, i, t) for i, t in enumerate(["x" * 50, "  ", "y" * 30, "z\nz", "w" * 60], 1)]
    cues = spark.createDataFrame(rows, "session_id int, cue_no int, text string")
    assert Q.tail_text(cues).first().tail == "y" * 30 + " z z " + "w" * 60


def test_classify_source(spark):
    rows = [("https://www.youtube.com/watch?v=abc&t=1", "", "youtube", "abc", ""), ("https://youtu.be/xyz", "", "youtube", "xyz", ""),
            ("SDI://2", "", "sdi", "", ""), ("rtmps://h/a", "", "stream", "", "rtmps"), ("rtmp://h/a", " rtmp://o ", "relay", "", "rtmp"),
            ("not a url", "", "stream", "", "")]
    df = spark.createDataFrame(rows, "url string, dest string, kind string, vid string, sch string")
    for r in A.classify_source(df).collect():
        assert (r.source_type, r.video_id, r.scheme) == (r.kind, r.vid, r.sch)


def test_drop_hallucinations(spark):
    rows = [("Thank you.", 0.0), ("thank thank thank", 0.0), ("real words here", 0.0), ("real words", 0.6), ("bye bye", 0.1), ("no no", 0.5)]
    df = spark.createDataFrame(rows, "text string, no_speech_prob double")
    assert sorted(r.text for r in Q.drop_hallucinations(df).collect()) == ["no no", "real words here"]


def test_unknown_probability_or_text_is_kept(spark):
    df = spark.createDataFrame([("hello there", None), ("loud", 0.9), (None, 0.1)], "text string, no_speech_prob double")
    assert sorted(str(r.text) for r in Q.drop_hallucinations(df).collect()) == ["None", "hello there"]


def test_escaped_video_id(spark):
    df = spark.createDataFrame([("https://www.youtube.com/watch?v=a%20b&t=3",)], "u string")
    assert [r[0] for r in df.select(T.youtube_id(F.col("u"))).collect()] == ["a b"]


@pytest.mark.parametrize("rows", [1, 3, 100, 1 << 20])
def test_running_tails_over_any_blocks(spark, rows):
    """Texts newest first until they are longer than the limit, as a loop does it; empty texts and very long ones as well."""
    r = random.Random(4)
    cues = [(s, i, " ".join("x" * r.randint(1, 9) for _ in range(r.choice([0, 0, 1, 2, 5, 40])))) for s in range(4) for i in range(1, 60)]
    df = spark.createDataFrame(cues, "session_id int, cue_no bigint, text string")
    got = {(x.session_id, x.cue_no): x.lines for x in Q.running_tails(df, rows=rows).collect()}
    want = {}
    for s in range(4):
        texts = [t for k, _, t in cues if k == s]
        for i in range(len(texts)):
            parts = []
            for t in reversed(texts[:i + 1]):
                parts.append(t)
                if len(" ".join(parts)) > 80:
                    break
            want[s, i + 1] = " ".join(reversed(parts)).split()
    assert got.keys() == want.keys()
    for k, words in want.items():
        lines, line = [], ""
        for w in words:
            if line and len(line) + 1 + len(w) > 32:
                lines.append(line)
                line = w
            else:
                line = f"{line} {w}" if line else w
        assert got[k] == (lines + [line] * bool(line))[-2:]
