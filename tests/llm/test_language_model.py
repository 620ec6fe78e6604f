"""The language model against plain dictionaries, and its filter against the counts that it holds."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from aeroseries.llm import language_model as lm
from aeroseries.llm.language_model import Model

END = "\n"
WORD = re.compile("[^\x20\x09-\x0d]+")


def tokens_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*WORD.findall(lowered), END]


def plain_scores(docs, model):
    held = [zlib.crc32(b"" if i is None else str(i).encode()) % model.folds == model.remainder for i, _ in docs]
    texts = [tokens_of(text) for _, text in docs]
    words, pairs = Counter(), Counter()
    for tokens, out in zip(texts, held):
        if not out:
            words.update(tokens)
            pairs.update(zip([END, *tokens], tokens))
    total = words.total() + len(words) + 1
    rows = []
    for (doc_id, _), tokens, out in zip(docs, texts, held):
        base = score = 0.0
        for first, second in zip([END, *tokens], tokens):
            p0 = (words[second] + 1) / total
            level = pairs[first, second].bit_length()
            estimate = (2 ** (level - 1) + 2**level - 1) / 2 if level else 0
            estimate = min(estimate, words[first], words[second])
            base += math.log10(p0)
            score += math.log10((estimate + model.strength * p0) / (words[first] + model.strength))
        known = sum(words[t] > 0 for t in tokens)
        rows.append((doc_id, out, len(tokens), known, words.total(), base, score))
    return rows


def key(row):
    return row[0] is not None, row[0] or 0, row[2], row[5]


DOCS = [
    (None, "Some words"), (None, None), (1, ""), (2, " \n\t "), (3, "one TWO two É é"), (3, "one TWO two É é"), (-7, "a\x00b \x1c c　d"),
    *[(10 + i, f"the cat number {i % 7} sat on the mat, the end of story {i} " * (1 + i % 4)) for i in range(120)],
    (5, "very long " * 300_000 + "text"), (6, "x" * 3_000_000 + "\nafter"),
]


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, -1])
def test_scores_equal_the_plain_version(make_docs, broadcast_bytes):
    model = Model(broadcast_bytes=broadcast_bytes, strength=20.0)
    scored = lm.score(make_docs(DOCS).repartition(3), model)
    assert scored.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    found = sorted((tuple(row) for row in scored.collect()), key=key)
    expected = sorted(plain_scores(DOCS, model), key=key)
    assert [row[:5] for row in found] == [row[:5] for row in expected]
    assert [row[5] for row in found] == pytest.approx([row[5] for row in expected])
    # A pair that was not seen may be taken for seen, which raises a score a little.
    equal = sum(math.isclose(a[6], b[6], rel_tol=1e-9) for a, b in zip(found, expected))
    assert equal > 0.9 * len(expected) and all(a[6] >= b[6] - 1e-6 * abs(b[6]) for a, b in zip(found, expected))


def test_held_out_texts_of_the_same_kind_score_above_the_base(make_docs):
    rows = [(i, f"the quick brown fox number {i % 13} jumps over the lazy dog and runs away") for i in range(300)]
    held = [row for row in lm.score(make_docs(rows)).collect() if row.held_out]
    assert held and all(row.score > row.base_score for row in held)


def test_without_training_documents_or_rows(make_docs):
    assert lm.score(make_docs([])).count() == 0
    (doc_id,) = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2][:1]
    (row,) = lm.score(make_docs([(doc_id, "a b")])).collect()
    assert row[:6] == (doc_id, True, 3, 0, 0, 0.0) and row.score == pytest.approx(0.0)


def test_filter_loses_nothing_and_adds_little():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 32, 200_000, dtype=np.uint64))
    counts = np.minimum(rng.zipf(1.5, len(keys)), 10**9)
    words = lm.fill(keys, counts)
    found = lm.probe(keys, words, 0, len(words))
    assert (found >= lm.quantise(counts)).all() and (found == lm.quantise(counts)).mean() > 0.97
    others = np.setdiff1d(rng.integers(0, 1 << 32, 200_000, dtype=np.uint64), keys)
    assert (lm.probe(others, words, 0, len(words)) > 0).mean() < 0.02


def test_sections_and_keys_travel_whole():
    hashed = lm.mix(np.arange(10_000, dtype=np.uint64))
    section, keys = lm._split(hashed, 64)
    assert np.bincount(section, minlength=64).min() > 100
    assert (lm._wide(lm._narrow(hashed, 5), 5) == hashed & np.uint64((1 << 40) - 1)).all()
    ordered = np.sort(keys).astype(np.int64)
    assert (lm._keys(lm._pack(np.diff(ordered, prepend=0))) == ordered).all()
    numbers = np.array([0, 1, 255, 256, 70_000, 2**31 - 1])
    assert (lm._unpack(lm._pack(numbers)) == numbers).all()
