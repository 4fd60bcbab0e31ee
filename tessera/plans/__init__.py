"""Registered queries of the engine's own operators."""

from __future__ import annotations


def registered() -> dict:
    """{name: (function of session and table folder, SQL or None)}."""
    from . import blocks, media, packets, reports

    return {**packets.QUERIES, **blocks.QUERIES, **media.QUERIES, **reports.QUERIES}
