"""Late words leave Python as lists, and hypotheses are built once per utterance."""

from cuelake.operators import agreement as G
from cuelake.operators.folds import Words
from cuelake.plans import views as v
from cuelake.streaming import jobs as J, processors as X

SF = "/root/testdata/sf0.001"
KEYS = ["session_id", "utterance_id", "step"]


def test_late_words_are_one_row_per_step(spark):
    judged = G._judged(v.hypotheses(spark, SF), G.LateWords(0), 1 << 20)
    assert judged.count() == judged.select(*KEYS).distinct().count()
    rows = lambda df: sorted(tuple(r) for r in df.select(*KEYS, "text", "start_ms", "end_ms").collect())
    whole = rows(G.single_words(judged))
    assert whole and rows(G.late_words(v.hypotheses(spark, SF), 0, rows=4)) == whole
    h = J.replay(v.hypotheses(spark, SF), KEYS[:2], "step")
    assert rows(J.drain(X.late_words_stream(h, 0))) == whole


def test_texts_stay_in_arrow(spark):
    class Looks(G.LateWords):
        def step(self, s, step, texts, *rest):
            assert isinstance(texts, Words)
            return super().step(s, step, texts, *rest)

    assert G._judged(v.hypotheses(spark, SF), Looks(0), 1 << 20).count()


def test_last_hypotheses_alone(spark):
    every, last = v.hypotheses(spark, SF).filter("utterance_end"), v.hypotheses(spark, SF, last_only=True)
    assert sorted(map(tuple, every.collect())) == sorted(map(tuple, last.collect()))
    assert last.filter("NOT utterance_end").isEmpty()
