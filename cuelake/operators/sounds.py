"""Sound-class scores to bracketed captions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuelake.functions import values as V
from cuelake.operators import scan
from cuelake.operators.folds import fold_blocks

SW = ["session_id", "window_no"]


def label_table(spark) -> DataFrame:
    return spark.createDataFrame(list(V.SOUND_CAPTIONS.items()), "label string, caption string")


def explode_scores(windows: DataFrame, scores: str = "scores") -> DataFrame:
    """MAP<label, prob> per window to one row per label."""
    return windows.select(*SW, F.explode(scores).alias("label", "prob"))


def map_sound_labels(scores: DataFrame) -> DataFrame:
    """Add the caption of each class; unmapped classes are dropped. The label table has a fixed 68 rows."""
    return scores.join(F.broadcast(label_table(scores.sparkSession)), "label")


def caption_scores(scores: DataFrame) -> DataFrame:
    """Highest probability per (window, caption)."""
    return map_sound_labels(scores).filter(F.col("prob") > 0).groupBy(*SW, "caption").agg(F.max("prob").alias("prob"))


def speech_arbitration(scores: DataFrame, gate: float = 0.5) -> DataFrame:
    """Caption scores with ``gated``: speech dominates the window and the caption may not run under it."""
    best = scores.groupBy(*SW, "label").agg(F.max("prob").alias("prob"))
    speech = F.when(F.col("label").isin(*V.SPEECH_LABELS), F.col("prob"))
    best = best.withColumn("speech", F.coalesce(F.max(speech).over(Window.partitionBy(*SW)), F.lit(0.0)))
    capped = map_sound_labels(best).filter(F.col("prob") > 0).groupBy(*SW, "caption").agg(
        F.max("prob").alias("prob"), F.max("speech").alias("speech"))
    gated = (F.col("speech") >= gate) & ~F.col("caption").isin(*V.COEXIST_CAPTIONS)
    return capped.withColumn("gated", gated)


def top_sounds(scored: DataFrame, k: int = 1) -> DataFrame:
    """Best ``k`` captions per window by (prob, caption), highest first."""
    w = Window.partitionBy(*SW).orderBy(F.col("prob").desc(), F.col("caption").desc())
    return scored.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def label_coverage(model_labels: DataFrame) -> DataFrame:
    """Mapped or speech label names the model does not have."""
    spark = model_labels.sparkSession
    names = list(chain(V.SOUND_CAPTIONS, V.SPEECH_LABELS))
    return spark.createDataFrame([(n,) for n in names], "label string").join(model_labels, "label", "left_anti")


class Hysteresis:
    """State per caption: [hot, cold, active, last fired ms]. Rows: fired captions.

    A caption absent from a window keeps its state. The winner of a window is chosen among all that are ready,
    which is why captions cannot be folded one by one. Counters are stored only as far as they can still matter
    (``hot`` below its limit, ``cold`` while active), so that equal futures have equal states.
    """

    columns = ("window_no", "time_ms", "scored")
    output = ("window_no bigint", "time_ms bigint", "caption string", "prob double")

    def __init__(self, on=0.45, off=0.25, min_hot=1, clear=2, cooldown_ms=8000, top=1):
        self.on, self.off, self.min_hot, self.clear = on, off, min_hot, clear
        self.cooldown_ms, self.top = cooldown_ms, top

    def start(self):
        return {}

    def entries(self):
        return F.transform("scored", lambda s: s["caption"])

    def step(self, states, window_no, time_ms, scored):
        ready = []
        for s in scored:
            name, p = s["caption"], float(s["prob"])
            hot, cold, active, fired = states.get(name) or [0, 0, False, None]
            if p >= self.on:
                hot, cold = hot + 1, 0
                cooled = fired is None or time_ms - fired >= self.cooldown_ms
                if hot >= self.min_hot and not active and cooled and not s["gated"]:
                    ready.append((p, name))
            elif p < self.off:
                hot, cold = 0, min(cold + 1, self.clear)
                active = active and cold < self.clear
            if fired is not None and time_ms - fired >= self.cooldown_ms:
                fired = None
            states[name] = [min(hot, self.min_hot - 1), cold if active else 0, active, fired]
        winners = sorted(ready, reverse=True)[:self.top]
        for p, name in winners:
            states[name] = [self.min_hot - 1, 0, True, int(time_ms)]
        return states, [(int(window_no), int(time_ms), name, p) for p, name in winners]

    def finish(self, states):
        return []


def window_table(scores: DataFrame, hop_ms: int = 1000) -> DataFrame:
    """One row per window with its (at most 68) caption scores; window time is its number times the hop."""
    items = F.array_sort(F.collect_list(F.struct("caption", "prob", "gated")))
    return speech_arbitration(scores).groupBy(*SW).agg(items.alias("scored")).withColumn(
        "time_ms", F.col("window_no") * hop_ms)


def sound_events(scores: DataFrame, hop_ms: int = 1000, window_ms: int = 2000, rows: int = 86_400,
                 **settings) -> DataFrame:
    """Bracketed sound captions with hysteresis, cooldown in event time and one winner per window."""
    w = scan.seq_blocks(window_table(scores, hop_ms), "window_no", rows)
    fired = fold_blocks(w, ["session_id"], ["window_no"], Hysteresis(**settings), keep=True)
    return fired.select(
        "session_id", F.greatest(F.col("time_ms") - window_ms, F.lit(0)).alias("start_ms"),
        F.col("time_ms").alias("end_ms"), F.concat(F.lit("["), "caption", F.lit("]")).alias("text"), "prob")
