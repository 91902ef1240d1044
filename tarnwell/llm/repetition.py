"""Problem 9: how much of a document repeats what the same document has said before.

The measures and their limits stand in a table of thresholds; :func:`measure` compiles the table
into one projection of built-in functions. Nothing is exploded, shuffled or sent to Python, so the
cost is one pass over the texts at any size and no document can become a hot group.

Cases: a null, blank or wordless text has no words and every ratio is 0.0; texts shorter than the
shingle repeat nothing; very long texts are processed whole (sorting their shingles, n log n);
repeated rows each get their own result; an empty table gives an empty result; other columns of the
input, whatever their names, are kept out of the expressions and passed on only on request.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwell.llm.words import bind, raw_words

SHINGLE = 8


@dataclass(frozen=True)
class Rule:
    """A document is flagged where the measure is below ``least`` or at or above ``most``."""

    measure: str
    least: float | None = None
    most: float | None = None


#: The threshold table. Ratios are shares of words, characters or lines of the same document.
RULES = (
    Rule("n_words", least=5),
    Rule("mean_word_length", least=2.0, most=20.0),
    Rule("symbol_ratio", most=0.25),
    Rule("stop_word_ratio", least=0.02),
    Rule("bullet_line_ratio", most=0.9),
    Rule("ellipsis_line_ratio", most=0.3),
    Rule("duplicate_line_ratio", most=0.3),
    Rule("duplicate_paragraph_ratio", most=0.3),
    Rule("repeat_share", most=0.30),
)

#: Frequent function words of the corpus languages (en, de, fr, es).
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "for", "with", "der", "die", "das", "und", "ist", "mit", "von",
    "le", "la", "les", "de", "des", "et", "est", "que", "el", "los", "las", "en", "y", "por", "con", "un",
)


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))


def shingle_hashes(hashes: Column, length: int = SHINGLE) -> Column:
    """Hashes of all runs of ``length`` words (a power of two), by doubling.

    Each pass combines the hash at a place with the one ``step`` places on, so a run of eight takes
    three passes of two look-ups instead of eight look-ups per word.
    """

    def paired(step: int):
        return lambda a: F.transform(a, lambda x, i: F.xxhash64(x, F.get(a, i + step)))

    out, step = hashes, 1
    while step < length:
        out = bind(out, paired(step))
        step *= 2
    return bind(out, lambda a: F.slice(a, F.lit(1), F.greatest(F.size(a) - (length - 1), F.lit(0))))


def repeated_words(shingles: Column, length: int = SHINGLE) -> Column:
    """Number of words inside runs that also start at an earlier word.

    Documents whose shingles are all different are settled by a hash set; only the others sort
    (shingle, place) pairs, in which every place but a shingle's first is a repeat. The union of
    the runs is summed in order of their places.
    """

    def covered(s: Column) -> Column:
        ordered = F.sort_array(F.transform(s, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
        repeats = bind(
            ordered,
            lambda t: F.filter(
                F.transform(t, lambda e, i: F.when((i > 0) & (F.get(t, i - 1)["h"] == e["h"]), e["at"])),
                lambda p: p.isNotNull(),
            ),
        )
        return F.aggregate(
            F.array_sort(repeats),
            F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
            lambda acc, p: F.struct(
                (acc["n"] + p + length - F.greatest(p, acc["end"])).alias("n"), (p + length).alias("end")
            ),
        )["n"]

    return bind(shingles, lambda s: F.when(F.size(F.array_distinct(s)) == F.size(s), F.lit(0)).otherwise(covered(s)))


def _distinct_gap(parts: Column) -> Column:
    """Share of the non-blank parts that equal an earlier one."""
    kept = F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")
    return bind(kept, lambda a: _ratio(F.size(a) - F.size(F.array_distinct(a)), F.size(a)))


def parts(text: str) -> dict[str, Column]:
    """What the measures share: the text, its words as written and its lines, each taken from the text once."""
    t = F.coalesce(F.col(text), F.lit(""))
    return {"t": t, "w": raw_words(text), "l": F.split(t, "\r?\n")}


def measures() -> dict[str, Column]:
    """All measures as expressions over the columns of :func:`parts`."""
    t, w = F.col("t"), F.col("w")
    lines = F.filter("l", lambda x: F.trim(x) != "")
    letters = F.aggregate(w, F.lit(0), lambda n, x: n + F.length(x))
    return {
        "n_words": F.size(w).cast("double"),
        "mean_word_length": _ratio(letters, F.size(w)),
        "symbol_ratio": _ratio(F.length(F.regexp_replace(t, r"[\p{L}\p{N}\s]+", "")), F.length(t)),
        "stop_word_ratio": _ratio(F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS))), F.size(w)),
        "bullet_line_ratio": bind(lines, lambda a: _ratio(F.size(F.filter(a, lambda x: x.rlike(r"^\s*[-*•]"))), F.size(a))),
        "ellipsis_line_ratio": bind(lines, lambda a: _ratio(F.size(F.filter(a, lambda x: x.rlike(r"(\.\.\.|…)\s*$"))), F.size(a))),
        "duplicate_line_ratio": _distinct_gap(F.col("l")),
        "duplicate_paragraph_ratio": _distinct_gap(F.split(t, r"\r?\n[ \t]*\r?\n")),
        "repeat_share": bind(
            F.transform(w, lambda x: F.xxhash64(F.lower(x))),
            lambda h: _ratio(repeated_words(shingle_hashes(h)), F.size(h)),
        ),
    }


def measure(df: DataFrame, id_col: str, text_col: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per input row: its id, each measure and for each rule ``bad_<measure>``.

    Every measure and flag is a column of its own, so a caller that needs one of them lets the
    optimiser drop the others.
    """
    have = measures()
    split = df.select(F.col(id_col).alias("i"), *[c.alias(name) for name, c in parts(text_col).items()])
    out = split.select(F.col("i").alias(id_col), *[have[r.measure].alias(r.measure) for r in rules])
    flags = []
    for r in rules:
        bad = F.lit(False)
        if r.least is not None:
            bad = bad | (F.col(r.measure) < r.least)
        if r.most is not None:
            bad = bad | (F.col(r.measure) >= r.most)
        flags.append(bad.alias(f"bad_{r.measure}"))
    return out.select("*", *flags)
