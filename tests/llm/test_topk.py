import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from nomina.llm import topk

rng = np.random.default_rng(4)


def test_top_k_of_large_values(spark):
    """Products beyond 2^53 are exact, beyond 2^63 cut; what isn't finite SCALE times takes no part; lengths over 300 buckets."""
    big = 2.0**40
    rows = [(0, [big, 1.0]), (1, [big, 1.0]), (2, [big, 1.0 + 1 / 256]), (3, [3e15, 0.0]), (4, [-3e15, 0.0]), (5, [1e300, 0.0]), (6, [1e308, 0.0]), (7, [0.0, 0.0]), (8, [1e-3, -1e-3]), (50, [3e15, 3e15]), (100, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    held = {i: [math.floor(256 * int(c)) if abs(c) > 2**40 else math.floor(256 * c) for c in v] for i, v in rows if i != 6}
    want = []
    for q in (0, 50, 100):
        score = lambda i: min(max(sum(a * b for a, b in zip(held[q], held[i], strict=True)), -(2**63)), 2**63 - 1)  # noqa: B023, E731
        best = sorted((i for i in held if i != q), key=lambda i: (-score(i), i))[:5]
        want += [(q, n + 1, i, score(i)) for n, i in enumerate(best)]
    got = topk.top_k(df, F.col("vec_id") % 50 == 0).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == want


@pytest.mark.parametrize("cell, block", [(8, 4), (64, 1000)])
def test_top_k_over_cells_and_blocks(spark, monkeypatch, cell, block):
    monkeypatch.setattr(topk, "CELL", cell)
    monkeypatch.setattr(topk, "BLOCK", block)
    v = np.round(rng.standard_normal((300, 6)) * np.exp(rng.standard_normal(300))[:, None], 1)
    v[40:60] = v[:20]
    ids = rng.integers(0, 250, 300)
    got = topk.top_k(spark.createDataFrame([(int(i), r.tolist()) for i, r in zip(ids, v, strict=True)], "vec_id long, embedding array<double>").repartition(5), F.col("vec_id") % 10 == 0)
    x = np.floor(256 * v).astype(np.int64)
    want = []
    for q in sorted({int(i) for i in ids if i % 10 == 0}):
        found = sorted((-int(x[a] @ x[b]), int(ids[b])) for a in np.flatnonzero(ids == q) for b in np.flatnonzero(ids != q))[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()) == want
