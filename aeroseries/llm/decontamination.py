"""Finding benchmark items in training documents by n-gram seeds and Smith-Waterman alignment.

Words are letters and digits in lower case, so that punctuation and case do not hide a copy, in any script; in scripts
without blanks every character is a word. The runs of ``SEED`` words that at most ``RARE_ITEMS`` different items hold are the
seeds; an item without such a run has its rarest ones. So a question stem that many items share joins nothing, while
the item's own words do. Rarity is counted over the benchmark: what other documents hold does not change what is found in
one, and a thousand edited copies are found like a single one. Documents that hold a seed are aligned with its item around the place where it was found, unless the words they share there are too few for any
alignment to score enough. The score is the best local alignment's share of a perfect one; it finds copies with words changed,
left out or put in.

The grams that are not rare are counted by Spark and come to the driver: an eighth of the benchmark's at most. Items are taken in blocks of at most ``BLOCK_GRAMS`` grams, whose tables are broadcast; each block is one pass over the
documents. Nothing is shuffled.

Defined cases: null texts and ids are read as empty texts and null ids; an item shorter than a seed is a gram as a whole; an
item without words is found nowhere; repeated rows are reported each for itself; empty tables give no rows; other columns are
kept by ``clean`` and not read by ``find``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aeroseries.llm.words import FOLDED, Words, chunks, find_words, folded, utf8

#: Words in a gram.
SEED = 4
#: Most items whose texts hold a gram that is still rare.
RARE_ITEMS = 8
#: Least share of a perfect alignment for a document to count as holding the item.
LEAST_SCORE = 0.5
#: Grams of the items taken together: 16 bytes each in what is broadcast.
BLOCK_GRAMS = 2_000_000
MATCH, MISMATCH, GAP = 2, -1, -1

_FOUND = (
    "doc_id bigint, item_id bigint, score double, matched_words bigint, item_words bigint, "
    "start_word bigint, end_word bigint"
)


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int, int]:
    """Smith-Waterman over word hashes: score, matched words, and where the aligned part of the passage starts and ends."""
    n = len(passage)
    best = np.zeros((len(item) + 1, n + 1), dtype=np.int64)
    steps = np.arange(n + 1)
    for i, word in enumerate(item, 1):
        same = np.where(passage == word, MATCH, MISMATCH)
        row = np.zeros(n + 1, dtype=np.int64)
        row[1:] = np.maximum(0, np.maximum(best[i - 1, :-1] + same, best[i - 1, 1:] + GAP))
        # Gaps in the item: the best cell to the left, less a gap for each step from it.
        best[i] = np.maximum.accumulate(row - GAP * steps) + GAP * steps
    i, j = np.unravel_index(int(np.argmax(best)), best.shape)
    score, end, matched = int(best[i, j]), int(j), 0
    while best[i, j] > 0:
        same = item[i - 1] == passage[j - 1]
        if best[i, j] == best[i - 1, j - 1] + (MATCH if same else MISMATCH):
            matched += int(same)
            i, j = i - 1, j - 1
        elif best[i, j] == best[i - 1, j] + GAP:
            i -= 1
        else:
            j -= 1
    return score, matched, int(j), end


def _gram_sizes(words: Words) -> np.ndarray:
    """The gram length of each text: ``SEED``, or all its words if it has fewer."""
    return np.minimum(np.diff(words.first), SEED)


def _item_grams(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, item and word number of the grams of all items, in order."""
    sizes = _gram_sizes(words)
    text = words.text_of()
    grams = np.zeros(len(words.hashes), dtype=np.uint64)
    whole = np.zeros(len(words.hashes), dtype=bool)
    for size in range(1, SEED + 1):
        hashes, inside = words.windows(size)
        own = inside & (sizes[text] == size)
        grams[own], whole[own] = hashes[own], True
    at = np.flatnonzero(whole)
    return grams[at], text[at], at - words.first[text[at]]


def _common_grams(items: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The grams that more than ``RARE_ITEMS`` different item texts hold, in order, and how many do."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column(0))
            for start, end in chunks(texts):
                grams, item, _ = _item_grams(find_words(folded(texts[start:end]), FOLDED))
                once = np.unique(np.stack([item.astype(np.uint64), grams]), axis=1)[1]
                yield pa.RecordBatch.from_arrays([pa.array(once.view(np.int64))], names=["gram"])

    counted = items.select("text").distinct().mapInArrow(held, "gram long").groupBy("gram").count()
    rows = counted.where(F.col("count") > RARE_ITEMS).collect()
    grams = np.array([row[0] for row in rows], dtype=np.int64).view(np.uint64)
    order = np.argsort(grams)
    return grams[order], np.array([row[1] for row in rows], dtype=np.int64)[order]


def _rare(grams: np.ndarray, item: np.ndarray, common: tuple[np.ndarray, np.ndarray], n_items: int) -> np.ndarray:
    """Which grams of the items are seeds."""
    known, counts = common
    held = np.ones(len(grams), dtype=np.int64)
    if len(known):
        spots = np.minimum(np.searchsorted(known, grams), len(known) - 1)
        held = np.where(known[spots] == grams, counts[spots], 1)
    least = np.full(n_items, np.iinfo(np.int64).max)
    np.minimum.at(least, item, held)
    return held <= np.maximum(RARE_ITEMS, least[item])


def _hits(words: Words, known: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Word positions whose gram is among ``known`` (sorted), and its place there."""
    # Most grams are not known: the low bits rule out all but a few before the search.
    bits = max(16, int(np.ceil(np.log2(len(known) + 1))) + 5)
    low = np.uint64((1 << bits) - 1)
    maybe = np.zeros(1 << bits, dtype=bool)
    maybe[known & low] = True
    at, places = [], []
    for size in sizes:
        hashes, inside = words.windows(size)
        some = np.flatnonzero(maybe[hashes & low] & inside)
        spots = np.minimum(np.searchsorted(known, hashes[some]), len(known) - 1)
        real = known[spots] == hashes[some]
        at.append(some[real])
        places.append(spots[real])
    return np.concatenate(at), np.concatenate(places)


def _room(item: np.ndarray, passage: np.ndarray) -> int:
    """How many words an alignment of the two can match at most: those they share, each as often as both have it."""
    kinds, wanted = np.unique(item, return_counts=True)
    at = np.minimum(np.searchsorted(kinds, passage), len(kinds) - 1)
    present = np.bincount(at[kinds[at] == passage], minlength=len(kinds))
    return int(np.minimum(wanted, present).sum())


def _find_block(
    docs: DataFrame, items: list[tuple[int | None, str]], common: tuple[np.ndarray, np.ndarray], least_score: float
) -> DataFrame:
    words = find_words(folded([(text or "").encode() for _, text in items]), FOLDED)
    grams, item, spot = _item_grams(words)
    seed = _rare(grams, item, common, len(items))
    grams, item, spot = grams[seed], item[seed], spot[seed]
    sizes = sorted(set(_gram_sizes(words).tolist()) - {0})
    order = np.argsort(grams, kind="stable")
    seeds = tuple(part[order] for part in (grams, item, spot))
    bodies = [words.hashes[words.first[i] : words.first[i + 1]] for i in range(len(items))]
    ids = [key for key, _ in items]
    if not len(grams):
        return docs.sparkSession.createDataFrame([], _FOUND)
    shared = docs.sparkSession.sparkContext.broadcast((seeds, bodies, ids))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (known, _, _), contents, names = shared.value
        for batch in batches:
            texts = utf8(batch.column(1))
            rows = []
            for start, end in chunks(texts):
                found = find_words(folded(texts[start:end]), FOLDED)
                at, place = _hits(found, known, sizes)
                for text, key, score, matched, first, last in _aligned(found, at, place, shared.value, least_score):
                    rows.append((batch.column(0)[start + text].as_py(), names[key], score, matched, len(contents[key]), first, last))
            columns = list(zip(*rows)) or [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.float64(), *[pa.int64()] * 4]
            arrays = [pa.array(column, kind) for column, kind in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names=[part.split()[0] for part in _FOUND.split(", ")])

    return docs.mapInArrow(search, _FOUND)


def _aligned(words: Words, at: np.ndarray, place: np.ndarray, items: tuple, least_score: float) -> Iterator[tuple]:
    """The best alignment of each text with each item whose seed it holds, if it scores enough."""
    (known, items_of, spots_of), contents, _ = items
    # A gram that several items share stands once for each of them in the sorted seeds.
    several = np.searchsorted(known, known[place], side="right") - place
    nth = np.arange(several.sum()) - np.repeat(np.cumsum(several) - several, several)
    at, seed = np.repeat(at, several), np.repeat(place, several) + nth
    text, item = np.searchsorted(words.first, at, side="right") - 1, items_of[seed]
    # Seeds of one copy lie on nearly the same diagonal and share the passage around it.
    size = np.array([len(body) for body in contents])[item]
    stripe = (at - words.first[text] - spots_of[seed] + size) // (size + 1)
    pairs = np.unique(np.stack([text, item, stripe], axis=1), axis=0)
    best: dict[tuple[int, int], tuple] = {}
    for text, item, stripe in pairs.tolist():
        body = contents[item]
        size = len(body)
        own = words.hashes[words.first[text] : words.first[text + 1]]
        begin = max(0, stripe * (size + 1) - 2 * size)
        passage = own[begin : stripe * (size + 1) + 2 * size + 2]
        # Common seeds mostly stand alone: without enough words in common no alignment can score enough.
        if _room(body, passage) < least_score * size:
            continue
        score, matched, first, end = align(body, passage)
        share = score / (MATCH * size)
        if share >= least_score and share > best.get((text, item), (0.0,))[0]:
            best[text, item] = (share, matched, begin + first, begin + end)
    for (text, item), (share, matched, first, end) in best.items():
        yield text, item, share, matched, first, end


def find(
    docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", least_score: float = LEAST_SCORE,
) -> DataFrame:
    """Rows (doc_id, item_id, score, ...) for each document and item that it holds, with the words aligned."""
    own = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    asked = benchmark.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(item_text).cast("string").alias("text"))
    # A word takes a byte and a blank at least, which bounds the grams of a block before it is read.
    n_bytes = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = 1 + n_bytes // (2 * BLOCK_GRAMS)
    found, common = None, _common_grams(asked)
    for block in range(n_blocks):
        some = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == block).distinct()
        items = sorted(((row["item_id"], row["text"]) for row in some.collect()), key=lambda row: (row[0] is None, row))
        if any((body or "").strip() for _, body in items):
            part = _find_block(own, items, common, least_score)
            found = part if found is None else found.union(part)
    return own.sparkSession.createDataFrame([], _FOUND) if found is None else found


def clean(
    docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least_score: float = LEAST_SCORE
) -> DataFrame:
    """The documents that hold no item of the benchmark; a row goes if any row with its id holds one."""
    held = find(docs, benchmark, doc_id=doc_id, text=text, least_score=least_score)
    ids = held.select(F.col("doc_id").alias("__held")).distinct()
    return docs.join(ids, docs[doc_id].cast("bigint").eqNullSafe(F.col("__held")), "left_anti")
