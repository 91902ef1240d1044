"""Analysis of text: the plain analyzer as an expression, the English one in Arrow batches."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnwell.functions.stem import stem

WORD = r"[\p{L}\p{N}]+"
_WORD = re.compile(r"[^\W_]+")

#: The English stop words.
STOP_WORDS = frozenset(
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
)


def plain(text: Column | str) -> Column:
    """Words of the text in lower case, in order; an empty array for null."""
    t = F.col(text) if isinstance(text, str) else text
    return F.transform(F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(WORD), F.lit(0)), F.lower)


@dataclass(frozen=True)
class Analyzer:
    """Steps in fixed order: split, fold, lower, truncate, drop stop words, stem."""

    fold: bool = False
    stop: bool = False
    stem: bool = False
    max_token_length: int | None = None

    def __post_init__(self):
        if self.max_token_length is not None and not 1 <= self.max_token_length <= 256:
            raise ValueError("max_token_length must lie in 1..256")

    def terms(self, text: str | None) -> list[str]:
        text = text or ""
        if self.fold:
            text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.category(c).startswith("M"))
        out = [w.lower() for w in _WORD.findall(text)]
        if self.max_token_length:
            out = [w[: self.max_token_length] for w in out]
        if self.stop:
            out = [w for w in out if w not in STOP_WORDS]
        if self.stem:
            out = [stem(w) for w in out]
        return out

    def column(self, text: Column | str) -> Column:
        """The terms as a column: built-in functions for the plain steps, Arrow batches otherwise."""
        if not (self.fold or self.stop or self.stem):
            words = plain(text)
            n = self.max_token_length
            return F.transform(words, lambda w: F.substring(w, 1, n)) if n else words
        run = F.pandas_udf(lambda s: s.map(self.terms), "array<string>")
        return run(F.col(text) if isinstance(text, str) else text)

    def describe(self) -> dict:
        return {"fold": self.fold, "stop": self.stop, "stem": self.stem, "max_token_length": self.max_token_length}


PLAIN = Analyzer()
ENGLISH = Analyzer(fold=True, stop=True, stem=True, max_token_length=40)
PRESETS = {"plain": PLAIN, "english": ENGLISH}


def estimated_tokens(text: Column | str) -> Column:
    """max(1, words * 13 / 10) in whole numbers; words are separated by Unicode white space."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    words = F.regexp_count(t, F.lit(r"[^\s\x0B\x85\p{Z}]+"))
    return F.greatest(F.lit(1), F.floor(words * 13 / 10)).cast("bigint")


def estimate_tokens(text: str | None) -> int:
    return max(1, len((text or "").split()) * 13 // 10)


_MARKS = "_:/.-"


def is_identifier(token: str) -> bool:
    """Looks like a name in code: longer than two bytes and with one of ``_ : / .``, or letters of both
    cases, or letters of which none is lower case. Punctuation around the token does not count."""

    def inner(c: str) -> bool:
        return c.isalnum() or c in _MARKS

    inside = [i for i, c in enumerate(token) if inner(c)]
    if not inside:
        return False
    t = token[inside[0] : inside[-1] + 1]
    if len(t.encode()) <= 2:
        return False
    upper = any("A" <= c <= "Z" for c in t)
    lower = any("a" <= c <= "z" for c in t)
    return any(c in "_:/." for c in t) or (upper and lower) or (upper and not lower)


def query_features(text: str) -> dict[str, float]:
    """Token count, shares of identifiers and of tokens with a digit, and quoted phrases of one query text."""
    tokens = text.split()
    n = max(1, len(tokens))
    return {
        "token_count": len(tokens),
        "identifier_fraction": sum(map(is_identifier, tokens)) / n,
        "numeric_fraction": sum(any(c.isnumeric() for c in t) for t in tokens) / n,
        "quoted_phrase_count": text.count('"') // 2,
    }
