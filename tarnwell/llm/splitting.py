"""Problem 5: cutting long texts into overlapping pieces at natural boundaries.

A cut is an offset; the piece after cut c starts ``overlap`` code points before c (the first at 0)
and may reach to c - overlap + limit. From every boundary the next cut is therefore its farthest
boundary of the best kind within limit - overlap, and the greedy cuts of all texts are the chains
that start at 0. They are found by pointer doubling: the table of successors is built for every
boundary at once, then squared again and again, while the set of reached boundaries grows by
joining it to the table of the current power. The number of joins is the logarithm of the longest
chain, and every text advances in the same joins.

Kinds, best first: paragraph start, line start, sentence start, word start, any place. A boundary of
a lower kind is kept only in gaps of more than the window between boundaries of better kinds, as
no cut can fall on it elsewhere; within gaps without any boundary, cuts fall at the window's end.

Cases: null, empty and short texts are not cut and give no piece; white space at the start, at the
end and between paragraphs belongs to the pieces like anything else, so the pieces joined without
their overlaps are the text; ties do not arise, since offsets of a text are distinct; of repeated
rows of a record the current one counts; rows without number are left out; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnwell.session import materialize, release

LIMIT = 1500
OVERLAP = 150

PARAGRAPH, LINE, SENTENCE, WORD, ANY, END = 1, 2, 3, 4, 5, 6
KINDS = {PARAGRAPH: "paragraph", LINE: "line", SENTENCE: "sentence", WORD: "word", ANY: "any", END: "end"}

_SENTENCE = re.compile(r"[.!?…。！？][\"'»”’)\]]*\s+(?=\S)")
_WORD = re.compile(r"(?<=\s)\S")


def line_starts(text: str) -> tuple[list[int], list[int]]:
    """Offsets of the starts of paragraphs and of other lines, at their first character that is not white space."""
    paragraphs, lines = [], []
    after_blank, at = True, 0
    for line in text.split("\n"):
        body = line.lstrip()
        if body:
            (paragraphs if after_blank else lines).append(at + len(line) - len(body))
        after_blank = not body
        at += len(line) + 1
    return paragraphs, lines


def sentence_starts(text: str, a: int, b: int) -> list[int]:
    """Sentence starts after ``a`` and before ``b``; ``a`` is 0 or the place of a character."""
    return [m.end() for m in _SENTENCE.finditer(text, a, b)]


def word_starts(text: str, a: int, b: int) -> list[int]:
    return [m.start() for m in _WORD.finditer(text, a + 1, b)]


def boundaries(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[list[int], list[int]]:
    """(offsets, kinds) of the boundaries at which a cut can fall, with 0 first and the text's end last.

    Sentences and words are looked for only inside the gaps that need them.
    """
    window, n = limit - overlap, len(text)
    paragraphs, lines = line_starts(text)
    kept = {0: ANY, n: END} | {p: PARAGRAPH for p in paragraphs if 0 < p < n}

    def lines_between(_: str, a: int, b: int) -> list[int]:
        return lines[bisect.bisect_right(lines, a) : bisect.bisect_left(lines, b)]

    for kind, find in ((LINE, lines_between), (SENTENCE, sentence_starts), (WORD, word_starts)):
        have = sorted(kept)
        for a, b in zip(have[:-1], have[1:], strict=True):
            if b - a > window:
                kept |= {p: kind for p in find(text, a, b)}
    offsets = sorted(kept)
    out = []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        out.append(a)
        step = a + (limit if a == 0 else window)
        while step < b and b - a > window:
            out.append(step)
            kept[step] = ANY
            step += window
    out.append(n)
    return out, [kept[p] for p in out]


def oversized(records: DataFrame, limit: int = LIMIT) -> DataFrame:
    return records.where(F.length("text") > limit)


def boundary_table(records: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(number, at, kind) for every boundary of every text above the limit. Paragraph starts at 0 have kind 1 too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            numbers, at, kinds = [], [], []
            for number, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                o, k = boundaries(text, limit, overlap)
                if text[0].strip():
                    k[0] = PARAGRAPH
                numbers += [number] * len(o)
                at += o
                kinds += k
            yield pa.RecordBatch.from_arrays(
                [pa.array(numbers, pa.int64()), pa.array(at, pa.int64()), pa.array(kinds, pa.int32())], names=["number", "at", "kind"]
            )

    return records.select("number", "text").mapInArrow(run, "number bigint, at bigint, kind int")


def successors(table: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(number, at, next, hops): the farthest legal successor of every boundary that has one.

    A text's boundaries are at most its length, which one row holds already, so the frame of a text
    is bounded. The first piece has no overlap before it, so from 0 the window is the full limit.
    """
    window = limit - overlap

    def farthest(kind: int, reach: int):
        frame = W.partitionBy("number").orderBy("at").rangeBetween(1, reach)
        return F.max(F.when(F.col("kind") == kind, F.col("at"))).over(frame)

    def best(reach: int):
        return F.coalesce(*[farthest(k, reach) for k in (END, PARAGRAPH, LINE, SENTENCE, WORD, ANY)])

    step = F.when(F.col("at") == 0, best(limit)).otherwise(best(window))
    return table.withColumn("next", step).where(F.col("next").isNotNull()).select("number", "at", "next")


def cuts(records: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[DataFrame, DataFrame]:
    """(boundaries, cuts): both as (number, at, kind); cuts are the boundaries that the greedy chains reach.

    Tables are written between the rounds, so no round repeats the work of the ones before.
    """
    table = materialize(boundary_table(records, limit, overlap), "p5-boundaries")
    power = materialize(successors(table, limit, overlap), "p5-power")
    reached = table.where("at = 0").select("number", "at")
    previous = None
    while True:
        step = reached.join(power, ["number", "at"]).select("number", F.col("next").alias("at"))
        grown = materialize(reached.unionByName(step).distinct(), "p5-reached")
        jump = power.select("number", F.col("at").alias("next"), F.col("next").alias("far"))
        squared = materialize(power.join(jump, ["number", "next"]).select("number", "at", F.col("far").alias("next")), "p5-power")
        release(power)
        release(previous)
        previous = reached = grown
        power = squared
        if power.isEmpty():
            release(power)
            break
    return table, table.join(reached, ["number", "at"], "left_semi")


def split(records: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, parent: str = "id") -> DataFrame:
    """One row per piece: number, chunk (parent, position), start, stop, text, cut_kind and ``paragraphs``,
    the offsets of the paragraph starts between this piece's cut and the next."""
    long = oversized(records, limit)
    table, reached = cuts(long, limit, overlap)
    order = W.partitionBy("number").orderBy("at")
    marked = table.join(reached.select("number", "at", F.lit(1).alias("cut")), ["number", "at"], "left").withColumn(
        "position", F.sum(F.coalesce("cut", F.lit(0))).over(order) - 1
    )
    pieces = marked.groupBy("number", "position").agg(
        F.min("at").alias("from"),
        F.min_by("kind", "at").alias("kind"),
        F.sort_array(F.collect_list(F.when(F.col("kind") == PARAGRAPH, F.col("at")))).alias("paragraphs"),
    )
    pieces = pieces.withColumn("stop", F.lead("from").over(W.partitionBy("number").orderBy("position"))).where("stop IS NOT NULL")
    start = F.greatest(F.col("from") - overlap, F.lit(0))
    name = F.create_map(*[x for k, v in KINDS.items() for x in (F.lit(k), F.lit(v))])
    return pieces.join(long.select("number", F.col(parent).alias("parent"), "text"), "number").select(
        "number",
        F.struct(F.col("parent").alias("parent"), F.col("position").cast("bigint").alias("position")).alias("chunk"),
        start.alias("start"),
        "stop",
        F.substring(F.col("text"), (start + 1).cast("int"), (F.col("stop") - start).cast("int")).alias("text"),
        F.when(F.col("position") == 0, F.lit("start")).otherwise(name[F.col("kind")]).alias("cut_kind"),
        "paragraphs",
    )


def paragraph_breaks(pieces: DataFrame) -> DataFrame:
    """(number, break_at): every paragraph start, read off the pieces."""
    return pieces.select("number", F.explode("paragraphs").alias("break_at"))
