"""Near-duplicate groups by SimHash and meet-in-the-middle ball hashing.

Fingerprints at most three bits apart meet at a variant that lies one bit from one of them and two bits from the other.
Every fingerprint therefore stands for all its variants within two bits. Of the variants two bits away only those whose
two bits lie in the same half of the word are needed: of any three differing bits, two share a half.

A variant is sent to the group named by its routing bits. Variants that share a group travel as one row, the fingerprint
itself, and are spread out where they arrive, so the shuffle carries some dozens of rows for each distinct fingerprint
instead of a thousand. Where variants collide and one of them lies within one bit of its fingerprint, all fingerprints
there are verified against it and linked to it: a chain, never all pairs. Components of the links are found by rounds
of pointer jumping over checkpointed tables.

``keep_one`` leaves one document of each component.

Defined cases: a null text has no words; a text without words has fingerprint zero; equal fingerprints are linked; rows
that repeat an id get that id's rows' component each; a null id is kept, and counts as larger than all others; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aeroseries.functions.lineage import cut_lineage
from aeroseries.llm.components import connected_components
from aeroseries.llm.words import chunks, utf8

BITS = 64
#: Distinct fingerprints that should meet in one group.
GROUP_FINGERPRINTS = 4_000
#: Variants spread out at once in a group.
_VARIANTS_AT_ONCE = 4_000_000
_ONE = np.uint64(1)


def fingerprints_of(texts: list[bytes], width: int) -> np.ndarray:
    """SimHash of each text from its ``width``-word shingles, repeats included, hashed by XXH64 with seed 42."""
    from xxhash import xxh64_intdigest

    hashes: list[int] = []
    counts = np.zeros(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        words = text.lower().split()
        if len(words) > width:
            shingles = map(b" ".join, zip(*(words[k:] for k in range(width))))
            counts[i] = len(words) - width + 1
        elif words:
            shingles = (b" ".join(words),)
            counts[i] = 1
        else:
            continue
        hashes.extend(map(xxh64_intdigest, shingles, repeat(42)))
    total = np.array(hashes, dtype=np.uint64)
    ends = np.cumsum(counts)
    out = np.zeros(len(texts), dtype=np.uint64)
    for bit in range(BITS):
        ones = np.concatenate([[0], np.cumsum((total >> np.uint64(bit)) & _ONE, dtype=np.int64)])
        majority = 2 * (ones[ends] - ones[ends - counts]) > counts
        out |= majority.astype(np.uint64) << np.uint64(bit)
    return out


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """Rows (doc_id, fp) with the fingerprint as a signed 64-bit number."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column(1))
            for start, end in chunks(texts):
                found = fingerprints_of(texts[start:end], width).view(np.int64)
                ids = batch.column(0).slice(start, end - start)
                yield pa.RecordBatch.from_arrays([ids, pa.array(found)], names=["doc_id", "fp"])

    named = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return named.mapInArrow(hashed, "doc_id bigint, fp bigint")


def routing_bits(n_fingerprints: int) -> list[int]:
    """Which bits name a group: the same number from either half, as many as keep groups near their size."""
    n_groups = max(1, n_fingerprints // GROUP_FINGERPRINTS)
    half = min(12, (n_groups.bit_length() + 1) // 2)
    return [*range(half), *range(32, 32 + half)]


def flip_masks(bits: list[int]) -> list[int]:
    """All ways to flip none, one, or two bits of the same half among ``bits``."""
    pairs = [(a, b) for i, a in enumerate(bits) for b in bits[i + 1 :] if a // 32 == b // 32]
    return [0, *(1 << a for a in bits), *((1 << a) | (1 << b) for a, b in pairs)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def routed(distinct: DataFrame, route: list[int]) -> DataFrame:
    """Each fingerprint once for every group that holds one of its variants."""
    masks = F.array(*(F.lit(_signed(mask)) for mask in flip_masks(route)))
    mask = _signed(sum(1 << bit for bit in route))
    flips = distinct.select("fp", F.explode(masks).alias("flip"))
    return flips.select("fp", (F.col("fp").bitwiseXOR(F.col("flip")).bitwiseAND(F.lit(mask))).alias("group"))


def local_links(found: np.ndarray, group: int, route: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Links between the fingerprints whose variants meet in one group: each to the smallest it is connected to there."""
    fps = np.unique(found)
    n = len(fps)
    if n < 2:
        return fps[:0], fps[:0]
    mask = np.uint64(sum(1 << bit for bit in route))
    away = (fps & mask) ^ np.uint64(group)
    flipped = np.bitwise_count(away)
    free = [bit for bit in range(BITS) if bit not in route]
    parent = np.arange(n)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    one = np.array([1 << bit for bit in free], dtype=np.uint64)
    low, high = one[one < np.uint64(1 << 32)], one[one >= np.uint64(1 << 32)]
    two = np.concatenate([(side[:, None] | side[None, :])[np.triu_indices(len(side), 1)] for side in (low, high)])

    def meet(values: np.ndarray, owners: np.ndarray, near: np.ndarray) -> None:
        order = np.argsort(values, kind="stable")
        values, owners, near = values[order], owners[order], near[order]
        same = values[1:] == values[:-1]
        keep = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        values, owners, near = values[keep], owners[keep], near[keep]
        if not len(values):
            return
        starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
        sizes = np.diff(np.append(starts, len(values)))
        # The first fingerprint within one bit of the meeting point; without one, nothing there is linked.
        centres = np.minimum.reduceat(np.where(near, owners, n), starts)
        a, b = np.repeat(centres, sizes), owners
        real = (a < n) & (a != b)
        a, b = a[real], b[real]
        close = np.bitwise_count(fps[a] ^ fps[b]) <= 3
        for i, j in np.unique(np.stack([a[close], b[close]], axis=1), axis=0).tolist():
            i, j = root(i), root(j)
            if i != j:
                parent[max(i, j)] = min(i, j)

    # Variants of all that meet here differ from the group's bits nowhere; they are told apart by the free bits, and
    # handled in parts by the value of some of those bits mixed, so that a large group needs no more memory.
    ready = fps ^ away
    wide = int((flipped == 0).sum()) * (1 + len(one) + len(two)) + int((flipped == 1).sum()) * (1 + len(one)) + n
    parts = max(1, -(-wide // _VARIANTS_AT_ONCE))
    shift = np.uint64(0x9E3779B97F4A7C15)
    for part in range(parts):
        values, owners, near = [], [], []

        def take(base: np.ndarray, owner: np.ndarray, flips: np.ndarray | None, close: np.ndarray) -> None:
            rows = max(1, _VARIANTS_AT_ONCE // (1 if flips is None else max(1, len(flips))))
            for start in range(0, len(base), rows):
                some, own, cl = base[start : start + rows], owner[start : start + rows], close[start : start + rows]
                if flips is not None:
                    cl, own = np.repeat(cl, len(flips)), np.repeat(own, len(flips))
                    some = (some[:, None] ^ flips[None, :]).ravel()
                if parts > 1:
                    mine = ((some * shift) >> np.uint64(40)) % np.uint64(parts) == np.uint64(part)
                    some, own, cl = some[mine], own[mine], cl[mine]
                values.append(some)
                owners.append(own)
                near.append(cl)

        index = np.arange(n)
        take(ready, index, None, flipped <= 1)
        at0, at1 = flipped == 0, flipped == 1
        take(ready[at0], index[at0], one, np.ones(int(at0.sum()), dtype=bool))
        take(ready[at0], index[at0], two, np.zeros(int(at0.sum()), dtype=bool))
        # After a flip of a routing bit, only a second one in the same half is needed.
        in_low = away < np.uint64(1 << 32)
        for side, of_side in ((low, at1 & in_low), (high, at1 & ~in_low)):
            take(ready[of_side], index[of_side], side, np.zeros(int(of_side.sum()), dtype=bool))
        meet(np.concatenate(values), np.concatenate(owners), np.concatenate(near))
    roots = np.array([root(i) for i in range(n)])
    linked = roots != np.arange(n)
    return fps[linked], fps[roots[linked]]


def links(distinct: DataFrame) -> DataFrame:
    """Rows (a, b) that connect all fingerprints at most three bits apart; ``distinct`` has one row per fingerprint."""
    route = routing_bits(distinct.count())

    def in_group(key: tuple, rows: pa.Table) -> pa.Table:
        found = rows.column("fp").to_numpy().view(np.uint64)
        a, b = local_links(found, key[0].as_py() & (2**64 - 1), route)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    return routed(distinct, route).groupBy("group").applyInArrow(in_group, "a bigint, b bigint")


def components(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """Rows (doc_id, fp, component_id): the smallest id that a document's fingerprint reaches over links."""
    known = cut_lineage(fingerprints(docs, doc_id=doc_id, text=text, width=width))
    smallest = known.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = cut_lineage(links(smallest.select("fp")))
    member = connected_components(found)
    labelled = smallest.join(member, smallest["fp"] == member["node"], "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component")
    )
    heads = labelled.filter(F.col("component").isNotNull()).groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = labelled.select("fp", "component").join(heads, "component").select("fp", "component_id")
    return known.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """The documents with the smallest id of their component, whole rows; of rows that repeat this id all are kept."""
    heads = components(docs, doc_id=doc_id, text=text, width=width).select(F.col("component_id").alias("__head")).distinct()
    return docs.join(heads, docs[doc_id].cast("bigint").eqNullSafe(F.col("__head")), "left_semi")


def hex_fingerprint(fp):
    """A fingerprint as 16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
