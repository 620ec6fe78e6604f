from __future__ import annotations

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from aeroseries.functions.medians import bracketed_medians, exact_median, middle


def _values(kind: str, size: int) -> list[float]:
    rng = random.Random(f"{kind}{size}")
    draw = {
        "mixed": lambda: rng.choice([-1, 1]) * 10 ** rng.uniform(-12, 12),
        "near": lambda: 400.0 + rng.gauss(0, 1e-9),
        "ties": lambda: float(rng.randint(-2, 2)),
        "tiny": lambda: rng.choice([0.0, -0.0, 5e-324, 1e-300, -1e-300, 1e300]),
        "sensor": lambda: round(rng.gauss(410, 8), 2),
        "edges": lambda: rng.choice([999.9999999999999, 1000.0, 1000.0000000000001, 99.99999999999999]),
    }[kind]
    return [draw() for _ in range(size)]


@pytest.mark.parametrize("broadcast", [True, False])
def test_exact_median_equals_sorting(spark, broadcast):
    groups = {
        (kind, size): _values(kind, size)
        for kind in ("mixed", "near", "ties", "tiny", "sensor", "edges")
        for size in (1, 2, 3, 10, 501, 1000)
    }
    rows = [(kind, size, value) for (kind, size), values in groups.items() for value in values]
    rows.append(("sensor", 3, None))
    df = spark.createDataFrame(rows, "kind string, size int, value double").repartition(8)
    found = {(r.kind, r.size): r.median for r in exact_median(df, ["kind", "size"], "value", "median", broadcast).collect()}
    assert set(found) == set(groups)
    for key, values in groups.items():
        ordered = sorted(values)
        n = len(ordered)
        expected = (ordered[(n - 1) // 2] + ordered[n // 2]) / 2
        assert math.isclose(found[key], expected, rel_tol=1e-15, abs_tol=0.0), key


def test_middle(spark):
    rows = [([],), ([3.0],), ([1.0, 2.0],), ([1.0, 2.0, 9.0],), ([1.0, 2.0, 4.0, 9.0],)]
    df = spark.createDataFrame(rows, "a array<double>").select(F.expr(middle("a")).alias("m"))
    assert [r.m for r in df.collect()] == [None, 3.0, 1.5, 2.0, 3.0]


@pytest.mark.parametrize("accuracy", [10_000, 3])
def test_bracketed_medians(spark, accuracy):
    """Also where a poor sketch puts the bracket beside the middle."""
    rng = random.Random(7)
    rows = []
    for key, n in (("many", 4_001), ("even", 2_000), ("two", 2), ("one", 1)):
        rows += [(key, rng.gauss(0, 100), float(rng.randint(0, 3)), None if rng.random() < 0.5 else -rng.random()) for _ in range(n)]
    rows += [("same", 5.0, 5.0, 5.0)] * 501 + [("none", None, None, None)] * 3
    rows += [("far", v, -v, v) for v in (float("-inf"), float("-inf"), 1.0, 2.0, float("inf"))]
    df = spark.createDataFrame(rows, "k string, a double, b double, c double").repartition(5)
    names = ("a", "b", "c")
    found = bracketed_medians(df, ["k"], {name: name for name in names}, "which", "mid", accuracy=accuracy)
    assert set(found.columns) == {"k", "which", "mid", "rows", "n"}
    found = {(r.k, r.which): (r.rows, r.n, r.mid) for r in found.collect()}
    for key in {row[0] for row in rows}:
        for i, name in enumerate(names, 1):
            own = [row[i] for row in rows if row[0] == key]
            values = [v for v in own if v is not None]
            assert found[key, name] == (len(own), len(values), statistics.median(values) if values else None)
