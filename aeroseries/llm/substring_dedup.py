"""Removing repeated passages through prefix-partitioned suffix trees over words.

1. *Candidates.* Of every window of ``min_words`` words the smallest of its short word grams is kept as an anchor, so two
   equal windows hold equal anchors. Anchors are shuffled as packed numbers, and those found in one text only are dropped.
   A window without a repeated anchor cannot repeat. Equal texts count as one.
2. *Suffixes.* The suffixes that start at candidate windows are written to the checkpoint folder, sorted, with one entry
   per task for suffixes that are equal there. A suffix is its path in the tree, one byte a word, and where the path ends,
   at ``min_words`` words, a 64-bit hash of them all: windows that differ may share the path, but not the hash.
3. *Prefixes.* Suffixes are counted by their first byte; a prefix with more suffixes than a group may hold is extended byte
   by byte, until every prefix fits. Prefixes next to each other share a group while there is room.
4. *Subtrees.* Each group sorts its suffixes. Runs that agree in ``min_words`` words are the leaves below an internal node
   of that depth: a repeat. All but those of the smallest document are covered.
5. Words under a covered window are removed from their documents.

A passage that a third of all documents share has at most one entry per task in step 4, and one row per text in step 1
for each of its anchors. What goes to the driver is the list of prefixes, at most 256 times the number of groups.

Defined cases: a null text has no words; a null id counts as larger than all others, so its repeats go and it removes
none; rows with the same id never remove each other's words, and equal rows give equal results; an empty table gives no
rows; other columns are kept by ``remove_repeats`` and not read by ``measure``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aeroseries.functions.lineage import cut_lineage, stage_table
from aeroseries.llm.words import chunks, find_words, utf8

MIN_WORDS = 13
#: Words of a gram that may be an anchor; the window holds ``min_words - GRAM + 1`` of them.
GRAM = 6
#: UTF-8 bytes of text whose anchors meet in one bucket.
BUCKET_BYTES = 24 << 20
#: Suffixes in a group, some 9 MB with their origins.
GROUP_SUFFIXES = 250_000
#: What is known of the documents' words goes to the texts as a broadcast up to this size, checked after it is written;
#: beyond it the texts are shuffled to it.
BROADCAST_BYTES = 48 << 20
#: Bytes of texts that pass to Python at once. Ten thousand texts, Spark's own limit, would be 34 MB several times over, on
#: both sides of the pipe.
BATCH_BYTES = 4 << 20
#: Anchors, and suffixes with their origins, that a task gathers before it hands them on.
_HELD = 400_000
_HELD_SUFFIXES = 120_000
_LAST = 2**63 - 1

#: A text's hash in the origin of a suffix: only texts of rows with the same id have to be told apart.
_SHORT = 2**31 - 1

_ANCHORS = "bucket int, grams binary, docs binary, spots binary"
_SUFFIXES = "first int, n int, keys binary, ords binary, docs binary, spots binary"
_COVERED = "h bigint, ord bigint, spots binary"
#: Covered windows: one by one where they come from a subtree, so that the rows follow the input whatever the groups.
_WINDOWS = "h bigint, ord bigint, spot int"


def _order(doc_id: str) -> Column:
    return F.coalesce(F.col(doc_id).cast("bigint"), F.lit(_LAST))


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over ``width`` values from each on; the last ones see fewer."""
    out, reach = values.copy(), 1
    while reach < width:
        step = min(reach, width - reach)
        out[: len(out) - step] = pick(out[: len(out) - step], out[step:])
        reach += step
    return out


def anchors(texts: list[bytes], min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and word number of the grams that are smallest in some window of ``min_words`` words."""
    words = find_words(texts)
    total = len(words.hashes)
    width = min_words - GRAM + 1
    if total < min_words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams, _ = words.windows(GRAM)
    _, whole = _window_ends(words.first, min_words, total)
    least = _sliding(grams, width, np.minimum)
    # A gram is an anchor if it equals the smallest of a whole window that holds it.
    reach = np.where(whole, least, np.uint64(0))
    seen = _sliding(reach[::-1], width, np.maximum)[::-1]
    at = np.flatnonzero((seen == grams) & (seen > 0))
    text = words.text_of()[at]
    return grams[at], text, at - words.first[text]


def _key_bytes(min_words: int) -> int:
    return min_words - 1 + 8


def _keys(hashes: np.ndarray, windows: np.ndarray, at: np.ndarray, min_words: int) -> np.ndarray:
    """The keys of the suffixes that start at the given words, a row of bytes each."""
    keys = np.empty((len(at), _key_bytes(min_words)), dtype=np.uint8)
    steps = (hashes >> np.uint64(56)).astype(np.uint8)
    keys[:, : min_words - 1] = np.lib.stride_tricks.sliding_window_view(steps, min_words - 1)[at]
    keys[:, min_words - 1 :] = windows[at].astype(">u8").view(np.uint8).reshape(-1, 8)
    return keys


def _window_ends(first: np.ndarray, n: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    ends = np.repeat(first[1:], np.diff(first))
    return ends, np.arange(total) + n <= ends


def _repeated_anchors(docs: DataFrame, min_words: int) -> DataFrame:
    """Rows (h, spots): for each text, by its hash, packed, the anchors that occur in another text too."""
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = 1 + n_bytes // BUCKET_BYTES

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            texts = utf8(batch.column(1))
            ids = batch.column(0).to_numpy()
            for start, end in chunks(texts):
                grams, text, spots = anchors(texts[start:end], min_words)
                held.append((grams, ids[start:end][text], spots.astype(np.int32)))
                size += len(grams)
                if size > _HELD:
                    yield dealt(held)
                    held, size = [], 0
        if size:
            yield dealt(held)

    def dealt(held: list[tuple]) -> pa.RecordBatch:
        grams, ids, spots = (np.concatenate(column) for column in zip(*held))
        bucket = (grams % np.uint64(n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        grams, ids, spots, bucket = grams[order], ids[order], spots[order], bucket[order]
        starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        spans = list(zip(starts, np.append(starts[1:], len(bucket))))
        arrays = [pa.array(bucket[starts], pa.int32())]
        arrays += [pa.array([column[s:e].tobytes() for s, e in spans], pa.binary()) for column in (grams, ids, spots)]
        return pa.RecordBatch.from_arrays(arrays, names=["bucket", "grams", "docs", "spots"])

    def repeated(rows: pa.Table) -> pa.Table:
        grams, ids, spots = (
            np.frombuffer(b"".join(rows.column(name).to_pylist()), dtype=kind)
            for name, kind in (("grams", np.uint64), ("docs", np.int64), ("spots", np.int32))
        )
        order = np.argsort(grams, kind="stable")
        grams, ids, spots = grams[order], ids[order], spots[order]
        starts = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
        several = np.minimum.reduceat(ids, starts) != np.maximum.reduceat(ids, starts)
        keep = np.repeat(several, np.diff(np.append(starts, len(grams))))
        return pa.table({"h": pa.array(ids[keep]), "spot": pa.array(spots[keep])})

    packed = docs.select("h", "text").mapInArrow(emit, _ANCHORS)
    found = packed.groupBy("bucket").applyInArrow(lambda key, rows: repeated(rows), "h bigint, spot int")
    # One row per anchor and text, so that equal texts count once and the rows follow the input whatever the buckets.
    gathered = found.distinct().groupBy("h").agg(F.collect_list("spot").alias("spots"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spots = [_pack(np.array(parts, dtype=np.int32)) for parts in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spots, pa.binary())], names=["h", "spots"])

    return gathered.mapInArrow(merge, "h bigint, spots binary")


def _fitting(small: DataFrame) -> DataFrame:
    """A written table of (.., spots), marked for broadcast if it is small enough."""
    n, size = small.agg(F.count("*"), F.sum(F.octet_length("spots"))).first()
    return F.broadcast(small) if (size or 0) + 64 * n <= BROADCAST_BYTES else small


def _pack(values: np.ndarray) -> bytes:
    """Values of one column, compressed; sorted neighbours share much."""
    return len(values).to_bytes(4, "little") + pa.compress(np.ascontiguousarray(values), codec="zstd", asbytes=True)


def _unpack(packed: bytes, kind: str | type) -> np.ndarray:
    size = int.from_bytes(packed[:4], "little") * np.dtype(kind).itemsize
    return np.frombuffer(pa.decompress(packed[4:], size, codec="zstd", asbytes=True) if size else b"", dtype=kind)


def _joined(rows: pa.Table, name: str, kind: str | type) -> np.ndarray:
    parts = [_unpack(part, kind) for part in rows.column(name).to_pylist()]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=kind)


def _suffixes(texts: DataFrame, min_words: int) -> DataFrame:
    """Packed suffixes that start at candidate windows; a row with ``first`` -1 holds windows known to be covered."""
    width = min_words - GRAM + 1

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            bodies = utf8(batch.column(2))
            ords, hs = batch.column(0).to_numpy(), (batch.column(1).to_numpy() & _SHORT).astype(np.int32)
            marks = batch.column(3).to_pylist()
            for start, end in chunks(bodies):
                words = find_words(bodies[start:end])
                total = len(words.hashes)
                _, whole = _window_ends(words.first, min_words, total)
                # A window is a candidate if the smallest of its own grams is a repeated anchor.
                grams, _ = words.windows(GRAM)
                marked = np.full(total, np.uint64(2**64 - 1))
                for i in range(start, end):
                    spots = _unpack(marks[i], np.int32) + words.first[i - start]
                    marked[spots] = grams[spots]
                least = _sliding(grams, width, np.minimum)
                at = np.flatnonzero((_sliding(marked, width, np.minimum) == least) & whole)
                if not len(at):
                    continue
                keys = _keys(words.hashes, words.windows(min_words)[0], at, min_words)
                text = words.text_of()[at]
                held.append((keys, ords[start:end][text], hs[start:end][text], (at - words.first[text]).astype(np.int32)))
                size += len(at)
                if size > _HELD_SUFFIXES:
                    yield dealt(held)
                    held, size = [], 0
        if size:
            yield dealt(held)

    def dealt(held: list[tuple]) -> pa.RecordBatch:
        keys, ords, hs, spots = (np.concatenate(column) for column in zip(*held))
        keys = np.ascontiguousarray(keys).view(f"S{_key_bytes(min_words)}").ravel()
        order = np.lexsort((ords, keys))
        keys, ords, hs, spots = keys[order], ords[order], hs[order], spots[order]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        # Of suffixes that are equal here only those of the smallest document go on; the others are covered already.
        least = np.repeat(ords[starts], np.diff(np.append(starts, len(keys))))
        behind = ords > least
        rows = [(-1, int(behind.sum()), keys[:0], ords[behind], hs[behind], spots[behind])] if behind.any() else []
        ahead = np.flatnonzero(~behind)
        first = keys[ahead].view(np.uint8).reshape(len(ahead), -1)[:, 0].astype(np.int64)
        cuts = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
        for s, e in zip(cuts, np.append(cuts[1:], len(ahead))):
            own = ahead[s:e]
            rows.append((int(first[s]), len(own), keys[own], ords[own], hs[own], spots[own]))
        columns = list(zip(*rows))
        arrays = [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32())]
        arrays += [pa.array([_pack(part) for part in column], pa.binary()) for column in columns[2:]]
        return pa.RecordBatch.from_arrays(arrays, names=["first", "n", "keys", "ords", "docs", "spots"])

    return texts.mapInArrow(emit, _SUFFIXES)


def _prefixes(suffixes: DataFrame, min_words: int) -> list[bytes]:
    """The lower ends of the groups: variable-length prefixes, each with few enough suffixes."""
    key_bytes = _key_bytes(min_words)
    kept = suffixes.filter("first >= 0")
    counts = {bytes([row["first"]]): row["n"] for row in kept.groupBy("first").agg(F.sum("n").alias("n")).collect()}
    done: dict[bytes, int] = {}
    while counts:
        done |= {p: n for p, n in counts.items() if n <= GROUP_SUFFIXES or len(p) == key_bytes}
        large = sorted(p for p in counts if p not in done)
        if not large:
            break
        length = len(large[0]) + 1

        def longer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for keys in batch.column(0).to_pylist():
                    cells = _unpack(keys, f"S{key_bytes}").view(np.uint8).reshape(-1, key_bytes)[:, :length]
                    cells, n = np.unique(cells, axis=0, return_counts=True)
                    found = [(cell.tobytes(), int(k)) for cell, k in zip(cells, n) if cell[:-1].tobytes() in wanted]
                    columns = list(zip(*found)) or [(), ()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.int64())], names=["prefix", "n"]
                    )

        wanted = set(large)
        heads = [p[0] for p in large]
        some = kept.filter(F.col("first").isin(sorted(set(heads)))).select("keys")
        found = some.mapInArrow(longer, "prefix binary, n bigint").groupBy("prefix").agg(F.sum("n").alias("n"))
        counts = {bytes(row["prefix"]): row["n"] for row in found.collect()}
    groups, room = [], 0
    for prefix in sorted(done):
        if done[prefix] > room:
            groups.append(prefix)
            room = GROUP_SUFFIXES
        room -= done[prefix]
    return groups


def _covered(suffixes: DataFrame, min_words: int) -> DataFrame:
    """Rows (h, ord, spots): windows of a text that start in a smaller document too."""
    kind = f"S{_key_bytes(min_words)}"
    prefixes = np.array(_prefixes(suffixes, min_words), dtype=kind)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for _, _, keys, ords, ids, spots in zip(*(column.to_pylist() for column in batch.columns)):
                keys = _unpack(keys, kind)
                ords, ids, spots = _unpack(ords, np.int64), _unpack(ids, np.int32), _unpack(spots, np.int32)
                group = np.searchsorted(prefixes, keys, side="right") - 1
                cuts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
                for s, e in zip(cuts, np.append(cuts[1:], len(keys))):
                    rows.append((int(group[s]), e - s, *(_pack(part[s:e]) for part in (keys, ords, ids, spots))))
            columns = list(zip(*rows)) or [()] * 6
            kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=batch.schema.names)

    def subtree(rows: pa.Table) -> pa.Table:
        keys, ords, ids, spots = (
            _joined(rows, name, what)
            for name, what in (("keys", kind), ("ords", np.int64), ("docs", np.int32), ("spots", np.int32))
        )
        order = np.argsort(keys, kind="stable")
        keys, ords, ids, spots = keys[order], ords[order], ids[order], spots[order]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        least = np.repeat(np.minimum.reduceat(ords, starts), np.diff(np.append(starts, len(keys))))
        behind = ords > least
        return pa.table({"h": pa.array(ids[behind], pa.int64()), "ord": ords[behind], "spot": spots[behind]})

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ords, ids, spots in zip(*(batch.column(i).to_pylist() for i in range(3))):
                parts = _unpack(ords, np.int64), _unpack(ids, np.int32), _unpack(spots, np.int32)
                yield from _covered_rows(*parts).to_batches()

    routed = suffixes.filter("first >= 0").mapInArrow(route, _SUFFIXES)
    nodes = routed.groupBy("first").applyInArrow(lambda key, rows: subtree(rows), _WINDOWS)
    early = suffixes.filter("first < 0").select("ords", "docs", "spots").mapInArrow(known, _COVERED)
    both = nodes.unionByName(early, allowMissingColumns=True)
    gathered = both.groupBy("h", "ord").agg(F.collect_list("spot").alias("single"), F.collect_list("spots").alias("packed"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            single, packed = batch.column(2), batch.column(3).to_pylist()
            values, cuts = single.values.to_numpy(zero_copy_only=False), single.offsets.to_numpy()
            runs = []
            for start, end, parts in zip(cuts[:-1], cuts[1:], packed):
                spots = np.concatenate([values[start:end].astype(np.int32), np.frombuffer(b"".join(parts), dtype=np.int32)])
                runs.append(_pack(_runs(spots, min_words)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(runs, pa.binary())], names=["h", "ord", "spots"])

    return gathered.mapInArrow(merge, _COVERED)


def _runs(spots: np.ndarray, min_words: int) -> np.ndarray:
    """Where covered stretches of words start and end, one after the other."""
    spots = np.sort(spots)
    apart = np.flatnonzero(spots[1:] > spots[:-1] + min_words)
    starts, ends = np.append(spots[:1], spots[apart + 1]), np.append(spots[apart], spots[-1:]) + min_words
    return np.stack([starts, ends], axis=1).ravel().astype(np.int32)


def _covered_rows(ords: np.ndarray, ids: np.ndarray, spots: np.ndarray) -> pa.Table:
    order = np.lexsort((spots, ids, ords))
    ords, ids, spots = ords[order], ids[order], spots[order]
    cuts = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (ords[1:] != ords[:-1])])[: len(ids)])
    spans = zip(cuts, np.append(cuts[1:], len(ids)))
    return pa.table(
        {
            "h": pa.array(ids[cuts], pa.int64()),
            "ord": pa.array(ords[cuts], pa.int64()),
            "spots": pa.array([spots[s:e].tobytes() for s, e in spans], pa.binary()),
        }
    )


def decisions(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Rows (h, ord, copy, spots) for documents that lose words: copies of a smaller one, or the stretches that go.

    ``h`` is the lower part of the text's hash.
    """
    named = docs.select(_order(doc_id).alias("ord"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    named = named.select("ord", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(7), "text").alias("g"), "text")
    keys = cut_lineage(named.select("ord", "h", "g"))
    first = keys.groupBy("h", "g").agg(F.min("ord").alias("least"))
    copies = keys.join(first, ["h", "g"]).filter("ord > least").select(F.col("h").bitwiseAND(F.lit(_SHORT)).alias("h"), "ord")
    anchored = stage_table(_repeated_anchors(named, min_words).join(first.select("h", F.col("least").alias("ord")), "h"))
    texts = named.select("ord", "h", "text").join(_fitting(anchored), ["h", "ord"]).select("ord", "h", "text", "spots")
    suffixes = stage_table(_suffixes(texts, min_words))
    covered = _covered(suffixes, min_words)
    return covered.select("h", "ord", F.lit(False).alias("copy"), "spots").union(
        copies.distinct().select("h", "ord", F.lit(True), F.lit(None).cast("binary"))
    )


def kept_words(text: bytes, copy: bool | None, runs: bytes | None, min_words: int) -> tuple[list[bytes], int]:
    """The words of a text that stay, and how many it has."""
    words = text.split()
    if copy:
        return ([] if len(words) >= min_words else words), len(words)
    if runs is None:
        return words, len(words)
    bounds = _unpack(runs, np.int32)
    change = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(change, bounds[0::2], 1)
    np.add.at(change, bounds[1::2], -1)
    stays = np.cumsum(change)[: len(words)] == 0
    return [word for word, stay in zip(words, stays.tolist()) if stay], len(words)


def _with_decisions(docs: DataFrame, doc_id: str, text: str, min_words: int) -> DataFrame:
    # Read when a query is planned, so it stays set for the frame that is returned; it changes no rows.
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    found = _fitting(stage_table(decisions(docs, doc_id=doc_id, text=text, min_words=min_words))).select(
        F.col("h").alias("__h"), F.col("ord").alias("__ord"), F.col("copy").alias("__copy"), F.col("spots").alias("__spots")
    )
    return docs.join(
        found,
        (F.xxhash64(F.coalesce(docs[text], F.lit(""))).bitwiseAND(F.lit(_SHORT)) == F.col("__h")) & (_order(doc_id) == F.col("__ord")),
        "left",
    )


def measure(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Rows (doc_id, n_words, n_removed, kept_sha256), the last over the kept words joined by one blank."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for body, copy, spots in zip(utf8(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                kept, n = kept_words(body, copy, spots, min_words)
                rows.append((n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            n, removed, digest = zip(*rows) if rows else ((), (), ())
            arrays = [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    own = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    joined = _with_decisions(own, "doc_id", "text", min_words).select("doc_id", "text", "__copy", "__spots")
    return joined.mapInArrow(counted, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")


def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """The documents without repeated passages; a text that loses words has the others joined by one blank.

    Documents that lose all their words are left out.
    """

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index(text)
            bodies = batch.column(at).to_pylist()
            out, stays = [], []
            for body, copy, spots in zip(bodies, batch.column("__copy").to_pylist(), batch.column("__spots").to_pylist()):
                kept, n = kept_words((body or "").encode(), copy, spots, min_words)
                out.append(body if len(kept) == n else b" ".join(kept).decode())
                stays.append(bool(kept) or not n)
            columns = [pa.array(out, pa.string()) if i == at else batch.column(i) for i in range(len(batch.columns) - 2)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-2]).filter(pa.array(stays))

    joined = _with_decisions(docs, doc_id, text, min_words).select(*(f"`{c}`" for c in docs.columns), "__copy", "__spots")
    return joined.mapInArrow(cleaned, docs.schema)
