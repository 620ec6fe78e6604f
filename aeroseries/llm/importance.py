"""Importance resampling towards a target: hashed n-gram features, log ratios of bucket shares, a Gumbel draw.

Words come from a byte table that lower-cases A-Z and blanks what separates, then ``bytes.split``. The hash of an n-gram
is the CRC-32 of its words joined by blanks; a longer one goes on from the hash of the shorter as its seed, so no n-gram is
put together. Bucket counts of both tables are summed by Spark and make one array of gains, as long as there are
buckets. A second scan gives each document the floored mean of its features' gains, to which Gumbel noise from its id is
added; the documents with the highest scores are the sample.

Nulls and empty texts have no words: no features, weight 0, never drawn. A null doc_id is drawn as the empty id and comes
first among ties. Equal scores are in order of doc_id, rows of one doc_id in order of their features and weight; repeated
rows each take a rank. An empty table of documents gives no rows; an empty target gives gains from its empty buckets. Long texts
are split and counted a piece at a time. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aeroseries.functions.lineage import stage_table
from aeroseries.llm.ranks import running_totals

#: Words of a text are split off in pieces of about this many bytes.
PIECE_BYTES = 1 << 20


@dataclass(frozen=True)
class Sampling:
    """Longest n-gram, buckets of the features, fewest words of a document that may be drawn, share drawn, seed of the draw."""

    longest: int = 1
    buckets: int = 10_000
    least_words: int = 20
    percent: int = 10
    seed: str = "2024"


def _byte_table() -> bytes:
    table = bytearray(b" " * 256)
    for byte in (*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)):
        table[byte] = byte
    for byte in range(ord("A"), ord("Z") + 1):
        table[byte] = byte + 32
    return bytes(table)


#: What each byte is read as; words consist of digits, letters and all bytes beyond ASCII.
BYTES = _byte_table()


def word_pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in lists that together hold all of them."""
    text = text.translate(BYTES)
    start = 0
    while start < len(text):
        end = text.find(b" ", start + PIECE_BYTES)
        end = len(text) if end < 0 else end
        yield text[start:end].split()
        start = end


def features(text: bytes, longest: int) -> tuple[int, Counter]:
    """How many words a text has, and how often each n-gram hash occurs."""
    n_words, counts, tail = 0, Counter(), []
    for words in word_pieces(text):
        n_words += len(words)
        joined = tail + words
        seeds = list(map(zlib.crc32, joined))
        counts.update(seeds[len(tail) :])
        for n in range(2, longest + 1):
            seeds = [zlib.crc32(b" " + word, seed) for seed, word in zip(seeds, joined[n - 1 :])]
            # Those that end within the words of earlier pieces were counted there.
            counts.update(seeds[max(0, len(tail) - n + 1) :])
        tail = joined[max(0, len(joined) - longest + 1) :] if longest > 1 else []
    return n_words, counts


def _texts(column: pa.Array) -> Iterator[bytes]:
    for text in column.cast(pa.binary()):
        yield text.as_py() or b""


def bucket_counts(df: DataFrame, sampling: Sampling) -> DataFrame:
    """(bucket, n): how many features of all texts fall into each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(sampling.buckets, dtype=np.int64)
        for batch in batches:
            for text in _texts(batch.column(0)):
                counts = features(text, sampling.longest)[1]
                at = np.fromiter(counts, np.int64, len(counts)) % sampling.buckets
                np.add.at(totals, at, np.fromiter(counts.values(), np.int64, len(counts)))
        seen = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(totals[seen])], names=["bucket", "n"])

    counted = df.select("text").mapInArrow(count, "bucket int, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(documents: DataFrame, target: DataFrame, sampling: Sampling) -> np.ndarray:
    """For each bucket a thousand times the log of its share in the target over its share in the documents, floored.

    One number per bucket comes to the driver, whatever the tables' size.
    """
    both = np.zeros((2, sampling.buckets), dtype=np.int64)
    for row, table in zip(both, (documents, target)):
        for bucket, n in bucket_counts(table, sampling).collect():
            row[bucket] = n
    (s, t), (all_s, all_t) = both.tolist(), both.sum(axis=1).tolist()
    of_s, of_t = float(all_s + sampling.buckets), float(all_t + sampling.buckets)
    return np.array(
        [math.floor(1000 * math.log(float(b + 1) * of_s / (float(a + 1) * of_t))) for a, b in zip(s, t)], dtype=np.int64
    )


def gumbel(seed: str, doc_id: int | None) -> int:
    """A thousand times a standard Gumbel variate from the hash of the id, floored."""
    name = f"{seed}:{'' if doc_id is None else doc_id}"
    h = int(hashlib.sha256(name.encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def score(documents: DataFrame, target: DataFrame, sampling: Sampling = Sampling()) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every document."""
    gains = documents.sparkSession.sparkContext.broadcast(bucket_gains(documents, target, sampling))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            for doc_id, text in zip(ids, _texts(batch.column(1))):
                n_words, counts = features(text, sampling.longest)
                at = np.fromiter(counts, np.int64, len(counts)) % sampling.buckets
                n = np.fromiter(counts.values(), np.int64, len(counts))
                total = int(n.sum())
                weight = int((gains.value[at] * n).sum()) // total if total else 0
                rows.append((n_words, total, weight, weight + gumbel(sampling.seed, doc_id)))
            columns = [pa.array(column, pa.int64()) for column in zip(*rows)] or [pa.array([], pa.int64())] * 4
            names = ["doc_id", "n_words", "n_features", "weight", "score"]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *columns], names=names)

    scored = documents.select(F.col("doc_id").cast("long"), "text")
    return scored.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long, score long")


def resample(documents: DataFrame, target: DataFrame, sampling: Sampling = Sampling()) -> DataFrame:
    """Every document's doc_id, n_features, weight, score, and its rank where it is drawn.

    Equal rows are counted before they are ordered, and get their ranks when they are written out again, so that no number
    of copies meets in one task.
    """
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    counted = stage_table(score(documents, target, sampling).groupBy(*columns).agg(F.count("*").alias("copies")))
    able = F.col("n_words") >= sampling.least_words
    found = counted.agg(F.coalesce(F.sum(F.when(able, F.col("copies"))), F.lit(0)).alias("n")).first().n
    drawn = sampling.percent * found // 100
    order = [(~able).cast("int"), F.desc("score"), F.col("doc_id"), F.col("n_features"), F.col("weight"), F.col("n_words")]
    ranked = running_totals(counted, [], order, "copies", "before")
    each = F.explode(F.sequence(F.col("before") + 1, F.col("before") + F.col("copies"))).alias("rank")
    ranked = ranked.select("doc_id", "n_features", "weight", "score", each)
    return ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
