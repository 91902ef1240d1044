"""Words as TESTDATA.md defines them, as Spark expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A maximal run of Unicode letters and digits.
WORD = r"[\p{L}\p{N}]+"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def raw_words(text: str | Column) -> Column:
    """Words as written, in order; null and empty texts give an empty array."""
    return F.regexp_extract_all(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), F.lit(WORD), F.lit(0))


def words(text: str | Column) -> Column:
    """Words in lower case. Each is lowered after the split, since lowering can add marks."""
    return F.transform(raw_words(text), F.lower)


def word_hashes(text: str | Column) -> Column:
    """64-bit hashes of the lower-case words, in order."""
    return F.transform(raw_words(text), lambda w: F.xxhash64(F.lower(w)))


def word_count(text: str | Column) -> Column:
    return F.size(raw_words(text))
