"""Hard negatives against plain integer products."""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import functions as F

from leadweave.llm import hardneg


def brute(rows, positives=5, negatives=5):
    """rows: (vec_id, embedding, label)."""
    rows = [(i, [math.floor(256 * x) for x in e], g) for i, e, g in rows if g is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    order = lambda s: (-s[0], s[1] is None, s[1] or 0)
    out = []
    for k, (i, e, g) in enumerate(rows):
        if i is None or i % 100:
            continue
        scored = [(max(-(2**63) + 1, min(2**63 - 1, sum(x * y for x, y in zip(e, f)))), j, h) for n, (j, f, h) in enumerate(rows) if n != k and len(f) == len(e)]
        for p in sorted((s for s in scored if s[2] == g), key=order)[:positives]:
            within = [s for s in scored if s[2] != g and 80 * p[0] <= 100 * s[0] <= 100 * p[0]]
            out += [(i, p[1], r + 1, s[1], p[0], s[0]) for r, s in enumerate(sorted(within, key=order)[:negatives])]
    return sorted(out, key=repr)


def test_packed_products_are_exact():
    rng = np.random.default_rng(1)
    for low, high, d in ((-256, 256, 64), (-3, 4, 1), (0, 1, 7), (-(2**40), 2**40, 5), (5, 5, 3), (-(2**20), 2**20, 64)):
        a, x = rng.integers(low, high, (9, d), endpoint=True), rng.integers(low, high, (23, d), endpoint=True)
        packed = hardneg.Packed(x, int(a.min()), int(a.max()))
        exact = np.clip(a.astype(object) @ x.astype(object).T, -hardneg._MOST, hardneg._MOST)
        assert (packed.products(a) == exact).all()
    assert hardneg.Packed(rng.integers(-256, 256, (8, 64)), -256, 256).fields == 2
    assert hardneg.integers(np.array([[1e300, -0.001, 0.5]])).tolist() == [[int(256 * 1e300), -1, 128]]


SCHEMA = "vec_id long, embedding array<float>, label int, score long, anchor long, part int"


def table(spark, rows):
    """With columns whose names the operator uses itself."""
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    f = lambda x: float(np.float32(x))
    base = [[f(rng.gauss(0, 0.3)) for _ in range(6)] for _ in range(8)]
    rows = []
    for i in range(700):
        b = base[i % 8]
        rows.append((i, [f(x + rng.choice([0, 0, 0.05]) * rng.gauss(0, 1)) for x in b], rng.randrange(4)))  # with ties and equal vectors
    rows += [(7000 + i, base[0], 0) for i in range(300)]  # one vector and label in a third of the rows
    rows += [(100, base[1], 1), (100, base[1], 1), (None, base[1], 2), (800, None, 1), (900, base[1], None), (1000, [f(0.1), None] * 3, 1), (1100, [float("nan")] * 6, 1), (1200, [float("inf")] + [0.0] * 5, 1)]
    rows += [(1300, [f(1e6)] * 6, 1), (1301, [f(1e30)] * 6, 1), (1302, [f(1e30)] * 6, 2), (1400, [], 0), (1401, [], 0), (1402, [], 1), (1500, [f(0.5)] * 3, 1), (1501, [f(0.5)] * 3, 1), (1503, [f(0.45)] * 3, 2)]
    want = brute(rows)
    assert len(want) > 100
    assert got(hardneg.hard_negatives(table(spark, rows))) == want
    for name, size in (("ANCHORS", 3), ("CANDIDATES", 40), ("SCORES", 100), ("SUMS", 16), ("BROADCAST_GROUPS", 0)):
        monkeypatch.setattr(hardneg, name, size)
    assert got(hardneg.hard_negatives(table(spark, rows))) == want


def test_odd_tables(spark, tmp_path):
    assert hardneg.hard_negatives(table(spark, [])).count() == 0
    assert hardneg.hard_negatives(table(spark, [(0, [1.0], 1), (1, [1.0], 2)])).count() == 0  # no positive
    assert got(hardneg.hard_negatives(table(spark, [(0, [1.0], 1), (1, [1.0], 1), (2, [0.81], 2), (3, [0.8], 3), (4, [1.01], 2)]))) == [(0, 1, 1, 2, 65536, 256 * 207)]
    assert hardneg.hard_negatives(table(spark, [(0, [-1.0], 1), (1, [1.0], 1), (2, [1.0], 2)])).count() == 0  # a range from -0.8 up to -1
    chosen = hardneg.hard_negatives(table(spark, [(5, [1.0], 1), (6, [1.0], 1), (7, [0.9], 2)]), is_anchor=F.col("vec_id") == 5)
    assert [r.negative_id for r in chosen.collect()] == [7]
    table(spark, [(7, [1.0], 9), (100, [1.0], 0), (101, [0.9], 5)]).select("vec_id", "embedding", "label").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert got(hardneg.op13_hardneg(spark, str(tmp_path))) == [(100, 7, 1, 101, 65536, 256 * 230)]
