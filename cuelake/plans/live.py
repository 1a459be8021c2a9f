"""The caption path as one chain of operators: audio frames to cues, documents and packets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.functions import text as T
from cuelake.operators import agreement as G, cues as Q, frames as R, packets as P, scan, scoring as H, sessions as A


def score_speech(frames: DataFrame, load: Callable[[], Callable], threshold: float = 1e-4, hangover: int = 5) -> DataFrame:
    """Energy gate, then the user's word scorer on the frames of utterances only.

    The gate works on energies; samples are joined to its verdict by (session_id, frame_no), so they are shuffled
    once and silent ones never reach the scorer.
    """
    energy = R.frame_energy(frames).drop("samples")
    heard = R.utterances(R.vad(energy, threshold, hangover)).select("session_id", "frame_no", "utterance_id")
    return H.score_words(frames.join(heard, ["session_id", "frame_no"]), load)


def stable_fragments(steps: DataFrame, review_delay_ms: int) -> DataFrame:
    """Overlapping hypotheses to append-only fragments, cleaned, without words repeated across fragments."""
    words = G.local_agreement(steps, review_delay_ms)
    return Q.dedupe_boundary(G.committed_fragments(words))


def caption_cues(texts: DataFrame) -> DataFrame:
    """Texts with a sequence (session_id, seq, text, start_ms, end_ms) to numbered two-line cues."""
    laid = Q.drop_empty_captions(Q.wrap_caption(Q.clean_fragments(Q.normalize_text(texts))))
    cues = laid.withColumn("text", T.display_text(F.col("lines")))
    return Q.number_cues(scan.seq_blocks(cues, "seq"), ["session_id"], ["seq"], keep=True)


def documents(cues: DataFrame) -> DataFrame:
    """WebVTT parts of each session next to its roll-up."""
    return Q.webvtt_document(cues).join(A.cue_stats(cues), "session_id")


def packets(cues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(608 pairs, 708 packets) of laid-out cues."""
    return P.encode_608_simple(cues), P.encode_708(cues)
