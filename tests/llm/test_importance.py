"""Importance resampling against a plain version, on edges, and across pieces of a long text."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from aeroseries.llm import importance
from aeroseries.llm.importance import Sampling
from aeroseries.llm.ranks import running_totals
from pyspark.sql import functions as F

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_features(text, longest):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    runs = [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
    return len(words), Counter(zlib.crc32(run.encode()) for run in runs)


def plain_resample(docs, items, by):
    found = [(doc_id, *plain_features(text, by.longest)) for doc_id, text in docs]
    s, t = [0] * by.buckets, [0] * by.buckets
    for totals, counts in [(s, c) for _, _, c in found] + [(t, plain_features(x, by.longest)[1]) for x in items]:
        for crc, n in counts.items():
            totals[crc % by.buckets] += n
    of_s, of_t = float(sum(s) + by.buckets), float(sum(t) + by.buckets)
    gains = [math.floor(1000 * math.log(float(b + 1) * of_s / (float(a + 1) * of_t))) for a, b in zip(s, t)]
    rows = []
    for doc_id, n_words, counts in found:
        n = sum(counts.values())
        weight = math.floor(sum(gains[crc % by.buckets] * k for crc, k in counts.items()) / n) if n else 0
        name = f"{by.seed}:{'' if doc_id is None else doc_id}".encode()
        h = int(hashlib.sha256(name).hexdigest()[:8], 16)
        rows.append((doc_id, n_words, n, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= by.least_words), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[2:4], r[1]))
    drawn = Counter()
    ranks = {}
    for rank, row in enumerate(able[: by.percent * len(able) // 100], 1):
        ranks.setdefault(row, []).append(rank)
    out = []
    for row in rows:
        left = ranks.get(row, [])
        out.append((row[0], *row[2:], left[drawn[row]] if drawn[row] < len(left) else None))
        drawn[row] += 1
    return Counter(out)


@pytest.mark.parametrize("by", [Sampling(), Sampling(longest=3, buckets=97, least_words=2, percent=60, seed="x")])
def test_resampling_equals_the_plain_version(make_docs, by, monkeypatch):
    docs = [(None, "Ab c " * 20), (None, "Ab c " * 20), (None, None), (1, None), (2, ""), (3, "-- !\n"), (-5, "ÉTÉ x1 été " * 9)]
    docs += [(7, "the same row, twice over " * 5)] * 3
    docs += [(10 + i, f"Alpha beta{i % 5} Gamma-delta {i} " * (1 + i % 9)) for i in range(60)]
    items = ["Alpha gamma delta", None, "", "beta1 beta2 ÉTÉ"]
    found = importance.resample(make_docs(docs), make_docs([(None, x) for x in items]), by)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(tuple(row) for row in found.collect()) == plain_resample(docs, items, by)


def test_empty_tables(make_docs):
    assert importance.resample(make_docs([]), make_docs([(1, "a")])).count() == 0
    docs = [(i, "a b c d " * 6) for i in range(20)]
    found = importance.resample(make_docs(docs), make_docs([]))
    assert Counter(tuple(row) for row in found.collect()) == plain_resample(docs, [], Sampling())


def test_pieces_hold_every_feature_once(monkeypatch):
    text = ("Éa b-C ddd " * 400 + "x" * 900 + " end").encode()
    whole = importance.features(text, 4)
    monkeypatch.setattr(importance, "PIECE_BYTES", 50)
    assert importance.features(text, 4) == whole == plain_features(text.decode(), 4)
    assert importance.features(b"a b", 4) == plain_features("a b", 4)


def test_running_totals_of_a_hot_group(spark):
    rows = [("hot" if i % 3 else None, i * 7 % 1000, i % 4 + 1) for i in range(1000)]
    df = spark.createDataFrame(rows, "g string, v long, n long").repartition(7)
    found = running_totals(df, ["g"], [F.desc("v")], "n", "before").collect()
    assert len(found) == len(rows)
    for row in found:
        assert row.before == sum(n for g, v, n in rows if g == row.g and v > row.v)
