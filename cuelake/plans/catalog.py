"""All registered queries; importing this module registers them."""

from __future__ import annotations

from cuelake.plans import io_queries, packet_queries, signal_queries, stream_queries, text_queries  # noqa: F401
from cuelake.plans.registry import ORACLE, QUERIES  # noqa: F401


def flagship(spark, sf):
    return text_queries.caption_documents(spark, sf)
