"""Language of whole texts by a bidirectional gated recurrent network over bytes.

The network reads UTF-8 bytes in stretches of ``STRETCH``, once forwards and once backwards, and gives every position a
probability for each language; a document's probabilities are the mean over all its positions. It is trained in numpy by
backpropagation through time on excerpts of at most ``DOCS_PER_LANGUAGE`` labelled documents of each language, picked by
hash, so what reaches the driver is bounded by the number of languages. Prediction reads every byte of every text, in tasks
that hold a few megabytes at a time; nothing is shuffled.

Defined cases: a text that is null or has no letter is ``und`` with score 0; without any labelled text all are; a null id is
read as an empty one for the fold; repeated rows are predicted each for itself; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aeroseries.llm.words import utf8

#: Labelled documents of each language that are learned from, and the characters taken of each.
DOCS_PER_LANGUAGE = 400
EXCERPT = 400
HIDDEN = 8
STRETCH = 128
TRAIN_STRETCH, TRAIN_BATCH, TRAIN_STEPS, RATE = 64, 64, 300, 0.02
#: Stretches read side by side.
_SIDE_BY_SIDE = 2_048
_BYTES_AT_ONCE = 4 << 20
UNKNOWN = "und"


def _squash(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A rational form of the hyperbolic tangent, several times as fast, and what its slope needs."""
    x = np.clip(x, -3, 3)
    square = x * x
    x *= square + np.float32(27)
    x /= square * np.float32(9) + np.float32(27)
    return x, square


def _slope(square: np.ndarray) -> np.ndarray:
    return np.square((square - np.float32(9)) / (square + np.float32(3))) / np.float32(9)


@dataclass
class Network:
    """Weights for both directions: byte table, recurrent weights, and the layer over both states.

    Arrays have the stretches read side by side in their last dimension, so that every operation runs over adjacent memory.
    """

    languages: list[str]
    table: np.ndarray
    inner: np.ndarray
    outer: np.ndarray
    bias: np.ndarray

    @staticmethod
    def fresh(languages: list[str], seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        n = len(languages)
        draw = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
        return Network(
            languages, draw(2, 3 * HIDDEN, 256), draw(2, 3 * HIDDEN, HIDDEN), draw(n, 2 * HIDDEN), np.zeros((n, 1), np.float32)
        )

    def weights(self) -> list[np.ndarray]:
        return [self.table, self.inner, self.outer, self.bias]

    def states(self, data: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (position, unit, stretch) after each byte; the backward ones, the upper half of units, in reading order."""
        steps, side = data.shape
        h = np.zeros((2, HIDDEN, side), np.float32)
        out = np.empty((steps, 2 * HIDDEN, side), np.float32)
        x = np.empty((2, 3 * HIDDEN, side), np.float32)
        half, gated = np.float32(0.5), 2 * HIDDEN
        for t in range(steps):
            np.take(self.table[0], data[t], axis=1, out=x[0], mode="clip")
            np.take(self.table[1], data[steps - 1 - t], axis=1, out=x[1], mode="clip")
            g = self.inner @ h
            gates, gate_square = _squash((x[:, :gated] + g[:, :gated]) * half)
            gates *= half
            gates += half
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            n, n_square = _squash(x[:, gated:] + r * g[:, gated:])
            if keep is not None:
                keep.append((h, z, r, n, g[:, gated:], gate_square, n_square))
            h = n + z * (h - n)
            out[t, :HIDDEN] = h[0]
            out[steps - 1 - t, HIDDEN:] = h[1]
        return out

    def labels(self, states: np.ndarray) -> np.ndarray:
        """Probabilities (position, language, stretch) of the languages at each position."""
        score = self.outer @ states + self.bias
        score -= score.max(axis=1, keepdims=True)
        np.exp(score, out=score)
        score /= score.sum(axis=1, keepdims=True)
        return score

    def gradients(self, data: np.ndarray, target: np.ndarray) -> list[np.ndarray]:
        """Gradients of the mean cross-entropy over all positions; ``target`` has one language per stretch."""
        steps, side = data.shape
        kept: list = []
        states = self.states(data, kept)
        error = self.labels(states)
        error[:, target, np.arange(side)] -= 1
        error /= steps * side
        d_outer = np.einsum("tcb,tub->cu", error, states)
        d_bias = error.sum(axis=(0, 2))[:, None]
        d_states = self.outer.T @ error
        d_table, d_inner = np.zeros_like(self.table), np.zeros_like(self.inner)
        carried = np.zeros((2, HIDDEN, side), np.float32)
        d_x = np.empty((steps, 2, 3 * HIDDEN, side), np.float32)
        for t in range(steps - 1, -1, -1):
            before, z, r, n, inner_n, gate_square, n_square = kept[t]
            carried[0] += d_states[t, :HIDDEN]
            carried[1] += d_states[steps - 1 - t, HIDDEN:]
            d_n = carried * (1 - z) * _slope(n_square)
            gate = _slope(gate_square) * np.float32(0.25)
            d_z = carried * (before - n) * gate[:, :HIDDEN]
            d_r = d_n * inner_n * gate[:, HIDDEN:]
            d_x[t] = np.concatenate([d_z, d_r, d_n], axis=1)
            d_g = np.concatenate([d_z, d_r, d_n * r], axis=1)
            d_inner += d_g @ np.swapaxes(before, 1, 2)
            carried = carried * z + np.swapaxes(self.inner, 1, 2) @ d_g
        for way, read in ((0, data), (1, data[::-1])):
            flat = d_x[:, way].transpose(0, 2, 1).reshape(-1, 3 * HIDDEN)
            order = np.argsort(read.ravel(), kind="stable")
            values, starts = np.unique(read.ravel()[order], return_index=True)
            d_table[way][:, values] = np.add.reduceat(flat[order], starts, axis=0).T
        return [d_table, d_inner, d_outer, d_bias]


def train(excerpts: list[tuple[bytes, str]], seed: int = 7) -> Network:
    """A network trained on (excerpt, language) by Adam; languages are drawn equally often."""
    languages = sorted({language for _, language in excerpts})
    by_language = [[body for body, own in excerpts if own == language] for language in languages]
    network = Network.fresh(languages, seed)
    rng = np.random.default_rng(seed)
    means = [np.zeros_like(w) for w in network.weights()]
    squares = [np.zeros_like(w) for w in network.weights()]
    for step in range(1, TRAIN_STEPS + 1):
        target = rng.integers(0, len(languages), TRAIN_BATCH)
        data = np.full((TRAIN_STRETCH, TRAIN_BATCH), 32, dtype=np.uint8)
        for i, label in enumerate(target):
            own = by_language[label]
            body = own[rng.integers(0, len(own))]
            start = rng.integers(0, max(1, len(body) - TRAIN_STRETCH + 1))
            part = np.frombuffer(body[start : start + TRAIN_STRETCH], dtype=np.uint8)
            data[: len(part), i] = part
        rate = RATE * (1 - step / (TRAIN_STEPS + 1))
        for w, g, m, s in zip(network.weights(), network.gradients(data, target), means, squares):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            w -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return network


def pooled(network: Network, texts: list[bytes]) -> np.ndarray:
    """Mean probabilities over all bytes of each text; texts must not be empty."""
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    n_stretches = -(-lengths // STRETCH)
    owner = np.repeat(np.arange(len(texts)), n_stretches)
    data = np.full(int(n_stretches.sum()) * STRETCH, 32, dtype=np.uint8)
    starts = np.concatenate([[0], np.cumsum(n_stretches)[:-1]]) * STRETCH
    for start, text in zip(starts.tolist(), texts):
        data[start : start + len(text)] = np.frombuffer(text, dtype=np.uint8)
    rows = data.reshape(-1, STRETCH)
    used = np.minimum(STRETCH, lengths[owner] - (np.arange(len(rows)) * STRETCH - starts[owner]))
    total = np.zeros((len(texts), len(network.languages)))
    for at in range(0, len(rows), _SIDE_BY_SIDE):
        part = slice(at, at + _SIDE_BY_SIDE)
        labels = network.labels(network.states(np.ascontiguousarray(rows[part].T)))
        labels *= (np.arange(STRETCH)[:, None] < used[part][None, :])[:, None, :]
        np.add.at(total, owner[part], labels.sum(axis=0).T)
    return total / lengths[:, None]


def held_out(doc_id: str) -> Column:
    """Documents that are never learned from: CRC-32 of the id as text leaves 2 when divided by 4."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def training_excerpts(docs: DataFrame, doc_id: str, text: str, lang: str) -> list[tuple[bytes, str]]:
    """Excerpts of at most ``DOCS_PER_LANGUAGE`` labelled documents of each language, picked by hash."""
    body = F.col(text)
    rank = F.xxhash64(F.col(doc_id), body)
    start = F.pmod(F.xxhash64(rank), F.greatest(F.length(body) - EXCERPT, F.lit(1))) + 1
    usable = docs.filter(~held_out(doc_id) & F.col(lang).isNotNull() & F.rlike(body, F.lit("\\p{L}")))
    short = usable.select(F.col(lang).alias("lang"), rank.alias("rank"), F.substr(body, start.cast("int"), F.lit(EXCERPT)).alias("part"))
    # First within parts of a language, so that no task sees more than a bounded share of a frequent one.
    parted = short.withColumn("salt", F.pmod("rank", F.lit(64)))
    chosen = parted
    for keys in (("lang", "salt"), ("lang",)):
        order = Window.partitionBy(*keys).orderBy("rank", "part")
        chosen = chosen.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= DOCS_PER_LANGUAGE)
    rows = sorted((row["lang"], row["rank"], row["part"]) for row in chosen.collect())
    return [(part.encode(), own) for own, _, part in rows]


def identify(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", network: Network | None = None
) -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score); trains on the given labels unless a network is handed in."""
    if network is None:
        excerpts = training_excerpts(docs, doc_id, text, lang)
        network = train(excerpts) if excerpts else None
    model = docs.sparkSession.sparkContext.broadcast(network)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column(2))
            languages = [UNKNOWN] * len(texts)
            scores = np.zeros(len(texts))
            lettered = [i for i, yes in enumerate(batch.column(3).to_pylist()) if yes and model.value is not None]
            for part in parts(lettered, texts):
                found = pooled(model.value, [texts[i] for i in part])
                best = found.argmax(axis=1)
                scores[part] = np.clip(found.max(axis=1), 0, 1)
                for i, k in zip(part, best.tolist()):
                    languages[i] = model.value.languages[k]
            arrays = [batch.column(0), batch.column(1), pa.array(languages), pa.array(scores)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "held_out", "lang_pred", "score"])

    def parts(chosen: list[int], texts: list[bytes]) -> Iterator[list[int]]:
        some, size = [], 0
        for i in chosen:
            some.append(i)
            size += len(texts[i])
            if size > _BYTES_AT_ONCE:
                yield some
                some, size = [], 0
        if some:
            yield some

    body = F.col(text).cast("string")
    asked = docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"), held_out(doc_id).alias("held_out"), body.alias("text"),
        F.coalesce(F.rlike(body, F.lit("\\p{L}")), F.lit(False)).alias("lettered"),
    )
    return asked.mapInArrow(predict, "doc_id bigint, held_out boolean, lang_pred string, score double")
