"""Hooks that run a user-supplied scorer over frames or windows inside the tasks.

``load`` returns the scorer and is called once per task. The scorer takes one array of samples or, with ``batch_size``, a list of
that many, which is what models want. A failing row never fails the job: it yields an empty result with ``ok = false`` and the
error's text, so that a fall-back can be joined in. A batch that fails is scored again row by row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

WORDS = "array<struct<text:string,start_ms:bigint,end_ms:bigint>>"


def _said(error: Exception) -> str:
    return f"{type(error).__name__}: {error}"


def _score(df: DataFrame, load: Callable[[], Callable], name: str, kind: str, empty, batch_size: int | None) -> DataFrame:
    cols = [c for c in df.columns if c != "samples"]
    fields = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in cols)

    def one(scorer, sample):
        try:
            return (scorer([sample])[0] if batch_size else scorer(sample)), None
        except Exception as e:
            return empty(), _said(e)

    def many(scorer, samples: list) -> list[tuple]:
        if batch_size:
            try:
                found = list(scorer(samples))
                if len(found) == len(samples):
                    return [(f, None) for f in found]
            except Exception:  # found again below, where it belongs to a row
                pass
        return [one(scorer, s) for s in samples]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            scorer, broken = load(), None
        except Exception as e:
            scorer, broken = None, _said(e)
        for pdf in batches:
            samples, size = pdf["samples"].tolist(), batch_size or max(1, len(pdf))
            results = [(empty(), broken)] * len(samples) if broken else [r for at in range(0, len(samples), size) for r in many(scorer, samples[at:at + size])]
            out = pdf[cols].copy()
            out[name], out["error"] = [r[0] for r in results], [r[1] for r in results]
            out["ok"] = [r[1] is None for r in results]
            yield out[[*cols, name, "ok", "error"]]

    return df.mapInPandas(run, f"{fields}, {name} {kind}, ok boolean, error string")


def score_words(frames: DataFrame, load: Callable[[], Callable], batch_size: int | None = None) -> DataFrame:
    """``scorer(samples)`` -> list of dicts text, start_ms, end_ms. Filter silence before calling this."""
    return _score(frames, load, "words", WORDS, list, batch_size)


def score_labels(windows: DataFrame, load: Callable[[], Callable], batch_size: int | None = None) -> DataFrame:
    """``scorer(samples)`` -> dict label to probability."""
    return _score(windows, load, "scores", "map<string,double>", dict, batch_size)
