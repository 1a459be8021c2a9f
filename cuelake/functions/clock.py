"""Clock strings from integer milliseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _parts(ms: Column) -> tuple[Column, Column, Column, Column]:
    ms = ms.cast("bigint")
    secs = F.floor(ms / 1000)
    return F.floor(secs / 3600), F.floor(secs / 60) % 60, secs % 60, ms % 1000


def vtt_time(ms: Column) -> Column:
    """``HH:MM:SS.mmm``; hours grow past two digits."""
    return F.format_string("%02d:%02d:%02d.%03d", *_parts(ms))


def log_time(ms: Column) -> Column:
    """As ``vtt_time`` with hours wrapping at a day."""
    h, m, s, f = _parts(ms)
    return F.format_string("%02d:%02d:%02d.%03d", h % 24, m, s, f)


def uptime(ms: Column) -> Column:
    h, m, s, _ = _parts(ms)
    return F.format_string("%02d:%02d:%02d", h, m, s)


def short_clock(ms: Column) -> Column:
    """``mm:ss``, or ``h:mm:ss`` from one hour; times before zero show as zero."""
    h, m, s, _ = _parts(F.greatest(ms, F.lit(0)))
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(F.format_string("%02d:%02d", m, s))


def seconds3(ms: Column) -> Column:
    """Seconds with three decimals, as in push records."""
    ms = ms.cast("bigint")
    return F.format_string("%d.%03d", F.floor(ms / 1000), ms % 1000)
