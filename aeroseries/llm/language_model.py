"""Bigram scores of texts from a log-frequency Bloom filter.

Texts are written once as blocks of numbered words. Spark sums the exact count of every word over the training documents
(the base model) and the counts of word pairs, which fall into sections by their hash. Each section becomes a Bloom filter that
holds, for a pair that occurs c times, one entry for each level up to 1 + log2(c). A reader probes level after level until
one is missing; the last one found stands for the counts between two powers of two, and the mean of those is the estimate. A
section is as large as its entries need, so the filter grows with the corpus.

The filter is broadcast while it fits ``broadcast_bytes``, which is looked up before anything is collected. Beyond that
nothing is collected: the pairs of each block travel to the sections and their levels travel back. Both ways probe the
same bits and give the same scores.

P(w | v) = (f(v, w) + strength * P0(w)) / (c(v) + strength), where P0 is the base model (add-one over the vocabulary and one unseen
word), c is exact and f is the filter's estimate, at most c(v) and c(w), so that pairs with an unknown word are never taken for found.
A false entry (some one in a hundred of the pairs not seen) raises a probability that should have been the smoothed one.

Null and empty texts have the end as their only token. A null doc_id counts as the empty text when documents are held out. Repeated rows
are scored, and counted in training, one by one; an empty table gives no rows; without training documents all words are unknown. Long
texts are split over blocks and their sums added. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aeroseries.functions.lineage import stage_table
from aeroseries.llm.words import mix

#: The end of a text, which is also what stands before its first word; no word can be equal to it.
END = b"\n"
#: Bytes of text in a block, and in one piece of a long text.
BLOCK_BYTES = 8 << 20
PIECE_BYTES = 1 << 20
#: Pairs and words of a section, added up over blocks; bytes that tell pairs apart within one, and words.
SECTION_PAIRS, SECTION_WORDS = 1 << 20, 1 << 19
KEY_BYTES = 4
WORD_BYTES = 5
#: Bits of the filter for each level of each pair, and bits set by one of them in its 64-bit word.
BITS_AN_ENTRY = 14
PROBES = 5
_LEVEL = 0x9E3779B97F4A7C15
_FIRST, _SECOND = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)

_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_BLOCK_SCHEMA = (
    "block long, rows array<long>, doc_ids array<long>, held_out array<boolean>, lengths array<int>, before array<int>, "
    "tokens binary, words binary, trained binary, hashes binary, n_words long, pairs long"
)


@dataclass(frozen=True)
class Model:
    """Documents whose hash leaves ``remainder`` modulo ``folds`` are held out; weight of the base model in pairs."""

    folds: int = 7
    remainder: int = 2
    strength: float = 200.0
    broadcast_bytes: int = 256 << 20


# Blocks


def _pack(numbers: np.ndarray) -> bytes:
    """Numbers by their bytes: those that are mostly zero cost next to nothing."""
    planes = np.ascontiguousarray(numbers.astype("<i8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.compress(planes.tobytes(), 3)


def _unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<i8").ravel()


def _narrow(values: np.ndarray, width: int) -> bytes:
    """The lowest bytes of 64-bit values."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _wide(blob: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(blob) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(blob, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


def _pieces(text: bytes) -> Iterator[tuple[bytes, bool]]:
    """A text in lower case, cut at blanks, and whether a piece is the last one."""
    text, start = text.translate(_LOWER), 0
    while len(text) - start > PIECE_BYTES:
        blank = _BLANK.search(text, start + PIECE_BYTES)
        if not blank:
            break
        yield text[start : blank.start()], False
        start = blank.start()
    yield text[start:], True


class _Block:
    """Numbered words of some pieces of text."""

    def __init__(self) -> None:
        self.numbers = defaultdict(count().__next__)
        self.numbers[END]
        self.size, self.tokens = 0, []
        self.rows, self.doc_ids, self.held_out, self.before = [], [], [], []

    def add(self, row: int, doc_id: int | None, held_out: bool, last: bytes, words: list[bytes]) -> None:
        self.rows.append(row)
        self.doc_ids.append(doc_id)
        self.held_out.append(held_out)
        self.before.append(self.numbers[last])
        self.tokens.append(np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words)))

    def row(self, block: int) -> pa.RecordBatch:
        lengths, words = [len(own) for own in self.tokens], list(self.numbers)
        tokens = np.concatenate(self.tokens)
        trains = np.repeat(~np.array(self.held_out, dtype=bool), lengths)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
        pairs = np.unique(_pairs(tokens.astype(np.int64), lengths, self.before))
        values = [
            block, self.rows, self.doc_ids, self.held_out, lengths, self.before, _pack(tokens),
            # The end comes first; it is written as the empty word.
            zstandard.compress(b"\n".join([b"", *words[1:]]), 3), _pack(np.bincount(tokens[trains], minlength=len(words))),
            _narrow(hashes, WORD_BYTES), len(words), len(pairs),
        ]
        types = [
            pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.list_(pa.int32()),
            pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(),
        ]
        names = [field.split()[0] for field in _BLOCK_SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=names)


def _pairs(tokens: np.ndarray, lengths: list[int], before: list[int]) -> np.ndarray:
    """Each token with the one before it, as one number of their two numbers."""
    previous = np.empty_like(tokens)
    previous[1:] = tokens[:-1]
    lengths = np.asarray(lengths, dtype=np.int64)
    starts = np.cumsum(lengths) - lengths
    some = lengths > 0
    previous[starts[some]] = np.asarray(before, dtype=np.int64)[some]
    return previous << np.int64(32) | tokens


def encode(documents: DataFrame, model: Model) -> DataFrame:
    """Blocks of numbered words, stored."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, rows = (count(TaskContext.get().partitionId() << 33) for _ in range(2))
        block = _Block()
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for doc_id, text in zip(batch.column(0).to_pylist(), texts):
                name = b"" if doc_id is None else b"%d" % doc_id
                held_out, row, last = zlib.crc32(name) % model.folds == model.remainder, next(rows), END
                for piece, ends in _pieces(text.as_py() or b""):
                    words = piece.split()
                    if ends:
                        words.append(END)
                    block.add(row, doc_id, held_out, last, words)
                    last = words[-1] if words else last
                    block.size += len(piece)
                    if block.size >= BLOCK_BYTES:
                        yield block.row(next(numbers))
                        block = _Block()
        if block.rows:
            yield block.row(next(numbers))

    return stage_table(documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(blocks, _BLOCK_SCHEMA))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one by one: a block is large."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _sections(n: int, each: int) -> int:
    """How many sections hold about ``each`` of ``n``: a power of two."""
    return 1 << max(0, (n // each).bit_length())


# Words


def _word_sections(row: dict, sections: int) -> tuple[np.ndarray, np.ndarray]:
    """The words of a block in the order of their sections, and those sections."""
    section = (_wide(row["hashes"], WORD_BYTES) % np.uint64(sections)).astype(np.int64)
    order = np.argsort(section, kind="stable")
    return order, section[order]


def _spans(section: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The sections that occur, in order, and where each begins and ends."""
    found, first = np.unique(section, return_index=True)
    return found, list(zip(first.tolist(), np.append(first[1:], len(section)).tolist()))


def word_counts(blocks: DataFrame, sections: int) -> DataFrame:
    """(section, block, counts, known, total): exact counts of a block's words in training documents, stored.

    Each block sends a word once, whatever its frequency, to the section of its hash, where equal words (not hashes) are
    added up; the sums go back in the order of the block's words. ``known`` and ``total`` add up to the distinct words and
    the tokens of training documents.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            words, trained = zstandard.decompress(row["words"]).split(b"\n"), _unpack(row["trained"])
            order, section = _word_sections(row, sections)
            words = np.array(words, dtype=object)[order]
            found, spans = _spans(section)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(found), pa.array([row["block"]] * len(found), pa.int64()),
                    pa.array([zstandard.compress(b"\n".join(words[a:b]), 1) for a, b in spans], pa.binary()),
                    pa.array([_pack(trained[order[a:b]]) for a, b in spans], pa.binary()),
                ],
                names=["section", "block", "words", "trained"],
            )

    def add(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("block")
        parts = [_unpack(blob) for blob in rows["trained"].to_pylist()]
        words = pa.concat_arrays(
            [pa.array(zstandard.decompress(blob).split(b"\n"), pa.binary()) for blob in rows["words"].to_pylist()]
        )
        number = words.dictionary_encode().indices.to_numpy()
        totals = np.zeros(int(number.max()) + 1, dtype=np.int64)
        np.add.at(totals, number, np.concatenate(parts))
        ends = np.cumsum([len(part) for part in parts]).tolist()
        once = [True] + [False] * (len(parts) - 1)
        return pa.table(
            [
                rows["section"], rows["block"], pa.array([_pack(totals[number[a:b]]) for a, b in zip([0, *ends], ends)], pa.binary()),
                pa.array([int((totals > 0).sum()) * first for first in once]), pa.array([int(totals.sum()) * first for first in once]),
            ],
            names=["section", "block", "counts", "known", "total"],
        )

    dealt = blocks.select("block", "words", "trained", "hashes").mapInArrow(deal, "section long, block long, words binary, trained binary")
    summed = dealt.groupBy("section").applyInArrow(add, "section long, block long, counts binary, known long, total long")
    return stage_table(summed)


def _block_counts(row: dict, sections: int) -> np.ndarray:
    """The count of each word of a block, from the sections' parts."""
    order, _ = _word_sections(row, sections)
    counts = np.zeros(len(order), dtype=np.int64)
    counts[order] = np.concatenate([_unpack(blob) for blob in row["counts"]])
    return counts


# The filter


def _hash(pairs: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    first, second = hashes[pairs >> np.int64(32)], hashes[pairs & np.int64(0xFFFFFFFF)]
    return mix(mix(first * _FIRST) + second * _SECOND)


def _split(hashed: np.ndarray, sections: int) -> tuple[np.ndarray, np.ndarray]:
    """The section of each hash, and what tells hashes apart within one."""
    section = (hashed >> np.uint64(44)) & np.uint64(sections - 1) if sections <= 1 << 20 else hashed % np.uint64(sections)
    return section.astype(np.int64), hashed & np.uint64((1 << 8 * KEY_BYTES) - 1)


def _keys(blob: bytes) -> np.ndarray:
    """Keys of a block in a section, which travel in order as steps from one to the next."""
    return np.cumsum(_unpack(blob)).astype(np.uint64)


def _spots(keys: np.ndarray, level: int, sizes: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """The word of the filter and the bits in it for one level of some keys."""
    x = mix(keys + np.uint64(_LEVEL * level & (1 << 64) - 1))
    at = (x >> np.uint64(32)) * np.asarray(sizes, dtype=np.uint64) >> np.uint64(32)
    bits = np.zeros(len(x), dtype=np.uint64)
    for i in range(PROBES):
        bits |= np.uint64(1) << (x >> np.uint64(6 * i) & np.uint64(63))
    return at.astype(np.int64), bits


def quantise(counts: np.ndarray) -> np.ndarray:
    """1 + log2 of a positive count, floored."""
    return np.frexp(counts.astype(np.float64))[1]


def expected(levels: np.ndarray) -> np.ndarray:
    """The mean of the counts that share a level; none at level 0."""
    return np.where(levels > 0, (np.exp2(levels - 1.0) + np.exp2(levels * 1.0) - 1) / 2, 0.0)


def fill(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The filter of one section: 64-bit words."""
    levels = quantise(counts)
    words = np.zeros(max(1, -(-int(levels.sum()) * BITS_AN_ENTRY // 64)), dtype=np.uint64)
    level = 1
    while len(keys):
        at, bits = _spots(keys, level, len(words))
        np.bitwise_or.at(words, at, bits)
        level += 1
        keys, levels = keys[levels >= level], levels[levels >= level]
    return words


def probe(keys: np.ndarray, words: np.ndarray, starts: np.ndarray | int, sizes: np.ndarray | int) -> np.ndarray:
    """The highest level found of each key without one missing below; its section lies at ``starts`` of the words."""
    levels = np.zeros(len(keys), dtype=np.uint8)
    left = np.arange(len(keys))
    starts, sizes = np.broadcast_to(starts, len(keys)), np.broadcast_to(sizes, len(keys))
    level = 1
    while len(left):
        at, bits = _spots(keys[left], level, sizes[left])
        left = left[words[at + starts[left]] & bits == bits]
        levels[left] = level
        level += 1
    return levels


def _block_pairs(row: dict, trained_only: bool) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of a block and how often they occur in training documents."""
    pairs = _pairs(_unpack(row["tokens"]), row["lengths"], row["before"])
    trains = np.repeat(~np.array(row["held_out"], dtype=bool), row["lengths"])
    if trained_only:
        return np.unique(pairs[trains], return_counts=True)
    found, inverse = np.unique(pairs, return_inverse=True)
    return found, np.bincount(inverse[trains], minlength=len(found))


def _by_section(row: dict, sections: int, trained_only: bool) -> tuple[np.ndarray, ...]:
    """Sections, keys and counts of a block's pairs in the order of their sections and keys, and that order."""
    pairs, counts = _block_pairs(row, trained_only)
    section, keys = _split(_hash(pairs, _wide(row["hashes"], WORD_BYTES)), sections)
    order = np.lexsort((keys, section))
    return section[order], keys[order], counts[order], order


def pairs_by_section(blocks: DataFrame, sections: int, trained_only: bool) -> DataFrame:
    """(section, block, keys, counts): the pairs of a block that fall into a section."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            section, keys, counts, _ = _by_section(row, sections, trained_only)
            found, spans = _spans(section)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(found), pa.array([row["block"]] * len(found), pa.int64()),
                    pa.array([_pack(np.diff(keys[a:b].astype(np.int64), prepend=0)) for a, b in spans], pa.binary()),
                    pa.array([_pack(counts[a:b]) for a, b in spans], pa.binary()),
                ],
                names=["section", "block", "keys", "counts"],
            )

    wanted = blocks.select("block", "held_out", "lengths", "before", "tokens", "hashes")
    return wanted.mapInArrow(deal, "section long, block long, keys binary, counts binary")


def build_filter(blocks: DataFrame, sections: int) -> DataFrame:
    """(section, bits) of the pairs in training documents, stored."""

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        keys = np.concatenate([_keys(blob) for blob in rows["keys"].to_pylist()])
        counts = np.concatenate([_unpack(blob) for blob in rows["counts"].to_pylist()])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        words = fill(keys[first], np.add.reduceat(counts, first))
        return pa.table({"section": [key[0].as_py()], "bits": [words.tobytes()]}, pa.schema([("section", pa.int64()), ("bits", pa.binary())]))

    dealt = pairs_by_section(blocks, sections, trained_only=True)
    return stage_table(dealt.groupBy("section").applyInArrow(build, "section long, bits binary"))


class Filter:
    """All sections side by side."""

    def __init__(self, sections: int, parts: Iterator[tuple[int, bytes]]) -> None:
        parts = sorted(parts)
        self.sections, self.sizes = sections, np.ones(sections, dtype=np.int64)
        for section, bits in parts:
            self.sizes[section] = len(bits) // 8
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.words = np.zeros(int(self.sizes.sum()), dtype=np.uint64)
        for section, bits in parts:
            start = self.starts[section]
            self.words[start : start + self.sizes[section]] = np.frombuffer(bits, np.uint64)

    def levels(self, section: np.ndarray, keys: np.ndarray) -> np.ndarray:
        return probe(keys, self.words, self.starts[section], self.sizes[section])


def _levels_by_block(blocks: DataFrame, bits: DataFrame, sections: int) -> DataFrame:
    """(block, levels): the level of each of a block's pairs, in parts by section; the pairs travel to the sections."""

    def look_up(rows: pa.Table) -> pa.Table:
        # A section without a pair of a training document has no bits.
        known = rows["bits"].drop_null().to_pylist()
        words = np.frombuffer(known[0], np.uint64) if known else np.zeros(1, np.uint64)
        asked = rows.filter(pc.is_valid(rows["keys"]))
        parts = [probe(_keys(blob), words, 0, len(words)).tobytes() for blob in asked["keys"].to_pylist()]
        return pa.table([asked["section"], asked["block"], pa.array(parts, pa.binary())], names=["section", "block", "levels"])

    asked = pairs_by_section(blocks, sections, trained_only=False).select("section", "block", "keys")
    met = asked.unionByName(bits, allowMissingColumns=True).groupBy("section")
    found = met.applyInArrow(look_up, "section long, block long, levels binary")
    parts = F.sort_array(F.collect_list(F.struct("section", "levels")))["levels"]
    return found.groupBy("block").agg(parts.alias("levels"))


# Scores


def _scores(row: dict, counts: np.ndarray, levels: np.ndarray, order: np.ndarray, total: float, strength: float) -> tuple:
    """Sums over each piece of a block: tokens, known tokens, base score, score."""
    counts = counts.astype(np.float64)
    base = (counts + 1) / total
    pairs = _pairs(_unpack(row["tokens"]), row["lengths"], row["before"])
    found, inverse = np.unique(pairs, return_inverse=True)
    tokens = pairs & np.int64(0xFFFFFFFF)
    first, second = found >> np.int64(32), found & np.int64(0xFFFFFFFF)
    estimate = np.empty(len(order))
    estimate[order] = expected(levels)
    estimate = np.minimum(estimate, np.minimum(counts[first], counts[second]))
    logs = np.log10((estimate + strength * base[second]) / (counts[first] + strength))
    lengths = np.asarray(row["lengths"], dtype=np.int64)
    piece = np.repeat(np.arange(len(lengths)), lengths)
    add = lambda values: np.bincount(piece, weights=values, minlength=len(lengths))
    return lengths, add(counts[tokens] > 0).astype(np.int64), add(np.log10(base)[tokens]), add(logs[inverse])


def score(documents: DataFrame, model: Model = Model()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    blocks = encode(documents, model)
    zero = F.lit(0).cast("long")
    sizes = blocks.agg(*(F.coalesce(F.sum(name), zero).alias(name) for name in ("n_words", "pairs"))).first()
    word_sections, sections = _sections(sizes.n_words, SECTION_WORDS), _sections(sizes.pairs, SECTION_PAIRS)
    counts = word_counts(blocks, word_sections)
    sums = counts.agg(*(F.coalesce(F.sum(name), zero).alias(name) for name in ("known", "total"))).first()
    bits = build_filter(blocks, sections)
    size = bits.agg(F.coalesce(F.sum(F.octet_length("bits")), zero).alias("n")).first().n
    outcomes, strength = float(sums.total + sums.known + 1), model.strength
    parts = F.sort_array(F.collect_list(F.struct("section", "counts")))["counts"].alias("counts")
    joined = blocks.drop("words", "trained", "n_words", "pairs").join(counts.groupBy("block").agg(parts), "block")
    if size <= model.broadcast_bytes:
        whole = documents.sparkSession.sparkContext.broadcast(Filter(sections, bits.toLocalIterator()))
    else:
        whole = None
        joined = joined.join(_levels_by_block(blocks, bits, sections), "block")

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            section, keys, _, order = _by_section(row, sections, trained_only=False)
            if whole is None:
                levels = np.frombuffer(b"".join(row["levels"]), np.uint8)
            else:
                levels = whole.value.levels(section, keys)
            del section, keys
            n_tokens, n_known, base, own = _scores(row, _block_counts(row, word_sections), levels, order, outcomes, strength)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row["rows"], pa.int64()), pa.array(row["doc_ids"], pa.int64()), pa.array(row["held_out"], pa.bool_()),
                    pa.array(n_tokens), pa.array(n_known), pa.array(base), pa.array(own),
                ],
                names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
            )

    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    added = joined.mapInArrow(add_up, schema).groupBy("row", "doc_id", "held_out")
    added = added.agg(*(F.sum(name).alias(name) for name in ("n_tokens", "n_known", "base_score", "score")))
    return added.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(sums.total).cast("long").alias("train_tokens"), "base_score", "score"
    )
