"""Thinking-block handling for responses that carry open/close markers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradelake.functions.text import after_last, strip

# Thinking markers per model family.
DEFAULT_MARKERS = ("<think>", "</think>")
CHANNEL_MARKERS = ("<|channel>thought\n", "<channel|>")


def _java_literal(text: str) -> str:
    return re.escape(text)


def strip_thinking(text: Column, markers: tuple[str, str] = DEFAULT_MARKERS) -> Column:
    """Drop complete blocks, then keep what follows the last close marker, trimmed."""
    opened, closed = markers
    rest = F.regexp_replace(text, f"(?s){_java_literal(opened)}.*?{_java_literal(closed)}", "")
    return strip(F.when(F.contains(rest, F.lit(closed)), after_last(rest, closed)).otherwise(rest))


def thinking_is_closed(text: Column, markers: tuple[str, str] = DEFAULT_MARKERS) -> Column:
    return F.contains(text, F.lit(markers[1]))


def before_close(text: Column, markers: tuple[str, str] = DEFAULT_MARKERS) -> Column:
    """Everything before the first close marker; NULL when it never closes."""
    return F.when(thinking_is_closed(text, markers), F.substring_index(text, markers[1], 1))


def after_close(text: Column, markers: tuple[str, str] = DEFAULT_MARKERS) -> Column:
    """Everything after the first close marker; NULL when it never closes."""
    closed = markers[1]
    start = F.locate(closed, text) + len(closed)
    return F.when(thinking_is_closed(text, markers), F.substr(text, start))


def thinking_body(before: Column, markers: tuple[str, str] = DEFAULT_MARKERS) -> Column:
    """Text after the first open marker, or all of it when there is none."""
    opened = markers[0]
    return F.when(F.contains(before, F.lit(opened)), F.substr(before, F.locate(opened, before) + len(opened))).otherwise(before)
