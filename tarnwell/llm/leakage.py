"""Problem 8: corpus documents that contain passages of held-out evaluation texts.

Suffix arrays over the corpus: every task turns the documents it reads into shards of word numbers and
ranks the suffixes of the shard and of the evaluation texts together, by prefix doubling. Every test suffix
is searched in the sorted array by bisection for the range of suffixes that share its first ``least`` words.
For the runs with a hit the doubling goes on up to the longest evaluation text, and each hit's longest
verbatim match follows from the tables of ranks by halving steps. A document lies in one shard whole, so
matches need no shuffle and no merge.

A word that no evaluation text contains cannot be part of a match. Such words end a run, and only
places whose next ``least`` words all occur in the evaluation texts are put into the array; that
loses nothing and keeps the arrays a fraction of the corpus. Inside a range the suffixes stand in the order
of the word before them, so those that only continue a longer common passage are skipped as one piece. A
passage that many documents and items share is expanded in pieces of at most PAIRS hits.

Cases: null, blank and short texts contain no passage; what stands between words does not count;
very long texts are processed whole; repeated documents each match, repeated items each count; an
empty corpus or an empty item table gives an empty result; other columns are ignored; rows without
id are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwell.llm.words import word_hashes

#: Words that a passage must share with an item.
LEAST = 12
#: Words of a corpus shard; a task holds one shard at a time.
SHARD_WORDS = 4_000_000
#: Words of evaluation texts sent to the tasks at once; larger item tables are searched in blocks of this size.
ITEM_WORDS = 2_000_000

#: Hits of evaluation suffixes in a shard that are followed at once.
PAIRS = 2_000_000

MATCHES = "doc_id bigint, item_id bigint, match_words int, doc_word int, item_word int"


class Items:
    """Word numbers of a block of evaluation texts, end to end, with the places where a search starts."""

    def __init__(self, ids: np.ndarray, texts: list[np.ndarray], least: int):
        lens = np.array([len(t) for t in texts], dtype=np.int64)
        flat = np.concatenate([*texts, np.empty(0, np.int64)])
        self.vocabulary, numbers = np.unique(flat, return_inverse=True)
        self.numbers = (numbers + 1).astype(np.int32)  # 0 is every other word
        self.owner = np.repeat(np.arange(len(lens)), lens)
        self.ids = ids
        start = np.cumsum(lens) - lens
        self.within = np.arange(len(flat)) - np.repeat(start, lens)
        self.left = np.repeat(lens, lens) - self.within
        self.starts = np.flatnonzero(self.left >= least)
        bits = max(10, int(np.ceil(np.log2(max(len(self.vocabulary), 1) * 8))))
        self.mask = np.int64((1 << bits) - 1)
        # Direct look-up by the low bits of the hash; the few words that share a slot are searched.
        self.slot = np.full(1 << bits, -1, np.int32)
        low = (self.vocabulary & self.mask).astype(np.int64)
        self.slot[low] = np.arange(len(self.vocabulary))
        self.shared = self.vocabulary[np.isin(low, low[self.slot[low] != np.arange(len(low))])]

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers of corpus words, 0 for words that no item has."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int32)
        at = self.slot[hashes & self.mask]
        out = np.where((at >= 0) & (self.vocabulary[np.maximum(at, 0)] == hashes), at + 1, 0).astype(np.int32)
        if len(self.shared):
            rest = np.flatnonzero((at >= 0) & (out == 0))
            near = np.minimum(np.searchsorted(self.vocabulary, hashes[rest]), len(self.vocabulary) - 1)
            out[rest] = np.where(self.vocabulary[near] == hashes[rest], near + 1, 0)
        return out


def suffix_ranks(words: np.ndarray, longest: int) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... words, up to ``longest``; past the end stands 0."""
    ranks = [np.unique(words, return_inverse=True)[1].astype(np.int64)]
    step = 1
    while 2 * step <= longest:
        shifted = np.zeros_like(ranks[-1])
        shifted[:-step] = ranks[-1][step:]
        ranks.append(np.unique(ranks[-1] * (int(ranks[-1].max()) + 1) + shifted, return_inverse=True)[1].astype(np.int64))
        step *= 2
    return ranks


def prefix_ranks(ranks: list[np.ndarray], length: int) -> np.ndarray:
    """Ranks of all suffixes by their first ``length`` words."""
    out, done = None, 0
    for k in reversed(range(len(ranks))):
        if not length >> k & 1:
            continue
        part = np.zeros_like(ranks[k])
        part[: max(0, len(part) - done)] = ranks[k][done:]
        out = part if out is None else np.unique(out * (int(part.max()) + 1) + part, return_inverse=True)[1].astype(np.int64)
        done += 1 << k
    return out


def common_length(ranks: list[np.ndarray], a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many words the suffixes at ``a`` and ``b`` share, at most ``most``: equal ranks of 2^k words move both on."""
    n, last = np.zeros(len(a), np.int64), len(ranks[0]) - 1
    for k in reversed(range(len(ranks))):
        same = ranks[k][np.minimum(a + n, last)] == ranks[k][np.minimum(b + n, last)]
        n += same.astype(np.int64) << k
    return np.minimum(n, most)


def _pieces(count: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(index, offset) of the elements of ranges of the sizes ``count``, at most ``most`` at once."""
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    for at in range(0, total, most):
        k = np.arange(at, min(at + most, total))
        of = np.searchsorted(ends, k, "right")
        yield of, k - (ends[of] - count[of])


def _longest(rows: np.ndarray) -> np.ndarray:
    """Of rows (doc, item, length, place, within) the one of greatest length per document and item, the first of equals."""
    order = np.lexsort([rows[4], rows[3], -rows[2], rows[1], rows[0]])
    rows = rows[:, order]
    first = np.ones(rows.shape[1], bool)
    first[1:] = (np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0)
    return rows[:, first]


def shard_matches(ids: np.ndarray, texts: np.ndarray, lens: np.ndarray, items: Items, least: int) -> pa.RecordBatch:
    """The longest match of each (document, item) of a shard; ``texts`` are word hashes end to end."""
    # One separator after each document keeps runs apart.
    doc = np.repeat(np.arange(len(lens)), lens + 1)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(lens + 1) - (lens + 1), lens + 1)
    is_word = place < np.repeat(lens, lens + 1)
    words = np.zeros(len(doc), np.int32)
    words[is_word] = items.number(texts)
    ends = np.flatnonzero(words == 0)
    run = np.diff(np.concatenate([[-1], ends])) - 1  # known words before each end
    # Runs long enough to hold a match, each with the word that ends it.
    runs = np.flatnonzero(run >= least)
    found = np.empty((5, 0), np.int64)
    if len(runs) and len(items.starts):
        size = run[runs] + 1
        offset = np.repeat(ends[runs] - run[runs], size) + (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))
        doc, place = doc[offset], place[offset]
        left = np.repeat(run[runs], size) - (np.arange(len(offset)) - np.repeat(np.cumsum(size) - size, size))
        # Runs and evaluation texts in one sequence; a 0 ends each of the former, and what is left bounds the latter.
        corpus = len(offset)
        both = np.concatenate([words[offset], items.numbers, [0]])
        start = prefix_ranks(suffix_ranks(both, least), least)
        before = np.concatenate([[0], both[:-1]]).astype(np.int64)
        before[corpus:-1][items.within == 0] = -1  # an item's first word continues nothing
        width = int(both.max()) + 2
        key = start * width + before + 1
        array = np.flatnonzero(left >= least)
        array = array[np.argsort(key[array], kind="stable")]
        sorted_keys, suffix = key[array], corpus + items.starts
        low, high = start[suffix] * width, (start[suffix] + 1) * width
        low, high = (np.searchsorted(sorted_keys, x) for x in (low, high))
        # The suffixes in the same range after the same word continue a longer passage.
        skip, on = (np.searchsorted(sorted_keys, key[suffix], side) for side in ("left", "right"))
        first_part, count = skip - low, (skip - low) + (high - on)
        # Deeper ranks are needed in the runs with a hit only.
        hit = np.cumsum(np.bincount(low, minlength=len(array) + 1) - np.bincount(high, minlength=len(array) + 1))[:-1] > 0
        of_run = np.repeat(np.arange(len(runs)), size)
        within_hit = np.zeros(len(runs), bool)
        within_hit[of_run[array[hit]]] = True
        kept = np.append(within_hit[of_run], np.ones(len(both) - corpus, bool))
        to = np.cumsum(kept) - 1
        longest = int(min(items.left.max(), run[runs][within_hit].max(initial=0)))
        ranks = suffix_ranks(both[kept], longest) if longest else []
        for of, k in _pieces(count, PAIRS):
            at = array[np.where(k < first_part[of], low[of] + k, on[of] + k - first_part[of])]
            which = items.starts[of]
            length = common_length(ranks, to[at], to[corpus + which], np.minimum(left[at], items.left[which]))
            found = _longest(np.concatenate([found, np.stack([doc[at], items.owner[which], length, place[at], items.within[which]])], 1))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids[found[0]] if len(ids) else [], pa.int64()),
            pa.array(items.ids[found[1]], pa.int64()),
            pa.array(found[2], pa.int32()),
            pa.array(found[3], pa.int32()),
            pa.array(found[4], pa.int32()),
        ],
        schema=_MATCH_SCHEMA,
    )


_MATCH_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("item_id", pa.int64()), ("match_words", pa.int32()), ("doc_word", pa.int32()), ("item_word", pa.int32())]
)


def _hash_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), word_hashes(text_col).alias("h"))


def _item_blocks(items: DataFrame, id_col: str, text_col: str, least: int) -> Iterator[Items]:
    """Evaluation texts in blocks of at most ITEM_WORDS words (or one text), read one block at a time."""
    ids, texts, words = [], [], 0
    for row in _hash_rows(items, id_col, text_col).where(F.size("h") >= least).orderBy("id").toLocalIterator():
        if words and words + len(row.h) > ITEM_WORDS:
            yield Items(np.array(ids), texts, least)
            ids, texts, words = [], [], 0
        ids.append(row.id)
        texts.append(np.array(row.h, dtype=np.int64))
        words += len(row.h)
    if ids:
        yield Items(np.array(ids), texts, least)


def leaks(
    corpus: DataFrame, items: DataFrame, least: int = LEAST, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text"
) -> DataFrame:
    """(doc_id, item_id, match_words, doc_word, item_word): the longest passage of at least ``least`` words
    that each document shares with each item, and the word places where it starts in both."""
    out = None
    for block in _item_blocks(items, item_id, text, least):

        def run(batches: Iterator[pa.RecordBatch], block: Items = block) -> Iterator[pa.RecordBatch]:
            ids, texts, lens, held = [], [], [], 0

            def flush() -> pa.RecordBatch:
                return shard_matches(np.concatenate(ids), np.concatenate(texts), np.concatenate(lens), block, least)

            for b in batches:
                if not b.num_rows:
                    continue
                c = b.column("h")
                o = np.asarray(c.offsets)
                ids.append(np.asarray(b.column("id")))
                texts.append(np.asarray(c.values)[o[0] : o[-1]])
                lens.append(np.diff(o).astype(np.int64))
                held += int(o[-1] - o[0])
                if held >= SHARD_WORDS:
                    yield flush()
                    ids, texts, lens, held = [], [], [], 0
            if ids:
                yield flush()

        part = _hash_rows(corpus, doc_id, text).mapInArrow(run, MATCHES)
        out = part if out is None else out.unionByName(part)
    return corpus.sparkSession.createDataFrame([], MATCHES) if out is None else out


def without_leaks(corpus: DataFrame, found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The corpus without the documents of ``found``; rows without id stay."""
    return corpus.join(found.select(F.col("doc_id").alias(doc_id)).distinct(), doc_id, "left_anti")
