"""Small string expressions shared by the extractors (Column in, Column out)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# One line terminator, as a line splitter that knows every Unicode break understands it.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def strip(text: Column) -> Column:
    """Trim every kind of Unicode white space (``trim`` only removes U+0020)."""
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+\z", "")


def last_match(text: Column, pattern: str, group: int = 1) -> Column:
    """Group ``group`` of the last match, NULL when nothing matches."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(-1))


def count_of(text: Column, needle: str) -> Column:
    """Number of non-overlapping occurrences of a literal."""
    return F.floor((F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) / len(needle)).cast("long")


def after_last(text: Column, needle: str) -> Column:
    return F.substring_index(text, needle, -1)


def whole_div(a: Column | str, b: Column | int) -> Column:
    """Integer division of whole numbers, exact over the full 64 bits (``floor(a / b)`` goes through doubles)."""
    return F.call_function("div", F.col(a) if isinstance(a, str) else a, b if isinstance(b, Column) else F.lit(b))


def let(value: Column, fn) -> Column:
    """Bind ``value`` once for ``fn``, so lambdas inside it do not evaluate it again per element."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def any_of(text: Column, patterns: list[str]) -> Column:
    hit = F.lit(False)
    for p in patterns:
        hit = hit | F.rlike(text, F.lit(p))
    return hit
