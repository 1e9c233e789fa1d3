"""Hard negatives against all inner products, in whole numbers of Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sgspark.llm import negatives, queries

SCHEMA = "vec_id long, embedding array<double>, label int, score long, pos int, _key string"


def truth(rows, positives=5, per=5, least=80):
    ok = [(i, [math.floor(256 * x) for x in v], c) for i, v, c in rows if None not in (i, v, c) and all(x is not None and math.isfinite(x) and math.isfinite(256 * x) for x in v)]
    most = negatives.MOST
    out = []
    for a, (i, v, c) in enumerate(ok):
        if i % 100:
            continue
        scored = sorted((-max(-most, min(most, sum(x * y for x, y in zip(v, w, strict=True)))), j, d) for b, (j, w, d) in enumerate(ok) if b != a and len(w) == len(v))
        for s, p, _ in [x for x in scored if x[2] == c][:positives]:
            good = [x for x in scored if x[2] != c and least * -s <= 100 * -x[0] <= 100 * -s][:per]
            out += [(i, p, k, n, -s, -t) for k, (t, n, _) in enumerate(good, 1)]
    return sorted(out)


def found(spark, rows, **options):
    df = spark.createDataFrame([(i, v, c, 1, 2, "k") for i, v, c in rows], SCHEMA)
    out = negatives.mined(df, F.col("vec_id") % 100 == 0, **options)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in out.collect())


def clustered(n, dim, seed, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, dim))
    which = rng.integers(0, labels, n)
    v = centres[which] + 0.5 * rng.normal(size=(n, dim))
    v /= np.linalg.norm(v, axis=1)[:, None]
    label = np.where(rng.random(n) < 0.2, (which + 1) % labels, which)
    return [(i * 20, v[i].tolist(), int(label[i])) for i in range(n)]


@pytest.mark.parametrize("dim", [1, 3, 24])
def test_equals_all_products(spark, monkeypatch, dim):
    monkeypatch.setattr(negatives, "ROWS", 100)
    monkeypatch.setattr(negatives, "STRIP", 64)
    rows = clustered(700, dim, dim)
    assert found(spark, rows) == truth(rows)
    assert found(spark, rows, positives=2, negatives=3, least=95) == truth(rows, 2, 3, 95)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    base = clustered(60, 4, 9, 2)
    rows = [
        *base, *base[:5], (None, [1.0] * 4, 1), (100, None, 1), (200, [1.0, None, 0.0, 0.0], 0), (300, [nan, 0.0, 0.0, 0.0], 0), (400, [inf, 0.0, 0.0, 0.0], 0), (500, [1e307, 0.0, 0.0, 0.0], 0),
        (600, [0.1] * 4, None), (700, [], 1), (701, [], 1), (702, [], 0), (800, [0.5, 0.5], 0), (801, [0.4, 0.5], 0), (802, [0.4, 0.4], 1), (900, [0.0] * 4, 0), (901, [0.0] * 4, 0), (902, [0.0] * 4, 1),
        (1000, [0.3] * 4, 5), (1100, [-0.3] * 4, 6), (1101, [0.3] * 4, 6), *[(1200, [0.2] * 4, 0)] * 12,
    ]
    assert found(spark, rows) == truth(rows)
    assert found(spark, rows[:0]) == [] and found(spark, [r for r in rows if r[0] and r[0] % 100]) == []


def test_huge_components(spark):
    rng = np.random.default_rng(2)
    rows = [(50 * i, (rng.integers(-9, 9, 5) * 10.0 ** float(rng.integers(-2, 9))).tolist(), i % 3) for i in range(120)] + [(6000, [1e300] * 5, 1), (6001, [1e300] * 5, 1), (6002, [1e299] * 5, 0)]
    assert found(spark, rows) == truth(rows)


def test_bounds_hold(spark):
    """Every pair's score lies between its bounds, and few pairs of clustered rows are verified."""
    rng = np.random.default_rng(3)
    v = np.array([r[1] for r in clustered(800, 64, 3)])
    q = np.floor(256 * v)
    axes = np.linalg.eigh(q.T @ q)[1][:, ::-1][:, :32]
    a = negatives.Vectors.made(0, np.arange(400), np.zeros(400, np.int64), q[:400], axes)
    b = negatives.Vectors.made(1, np.arange(400), rng.integers(0, 2, 400), q[400:], axes)
    exact = q[:400] @ q[400:].T

    def wanted(i, j, low, high):
        of = exact if low.ndim == 2 else exact[i, j]
        assert (low <= of).all() and (of <= high).all()
        return high >= np.sort(exact, axis=1)[:, -5][:, None] if low.ndim == 2 else high >= np.sort(exact, axis=1)[i, -5]

    i, j = negatives.met(a, b, wanted)
    assert len(i) < 0.3 * exact.size and (exact[i, j] == negatives.products(a, i, b, j)).all()
    assert set(zip(*np.nonzero(exact >= np.sort(exact, axis=1)[:, -5][:, None]), strict=True)) <= set(zip(i, j, strict=True))


def test_op13_on_null_labels(spark, tmp_path):
    rows = [(i * 50, [math.sin(i * k) for k in range(1, 9)], None if i == 3 else i % 3) for i in range(80)]
    spark.createDataFrame([(i, v, c, 1, 2, "k") for i, v, c in rows], SCHEMA).write.parquet(str(tmp_path / "embeddings.parquet"))
    moved = [(i, v, c if c is None or i % 7 else (c + 1) % 10) for i, v, c in rows]
    assert sorted(tuple(r) for r in queries.op13_negatives(spark, str(tmp_path)).collect()) == truth(moved)
