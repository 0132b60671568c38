"""Conversations: ordered turns as one text."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.segments import joined_parts, segment_findings


def conversation_text(df: DataFrame, **sizes) -> DataFrame:
    """Texts of conversations with the offsets of their turns."""
    return joined_parts(df, "conv_id", "turn", "text", **sizes)


def turn_findings(df: DataFrame, **options) -> DataFrame:
    """Findings of conversations with the turns they start and end in."""
    return segment_findings(df, "conv_id", "turn", "text", **options)
