"""Mixture fits against the same updates in numpy; bounds, tasks, and fits that are cut off."""

import json

import numpy as np
import pytest

from sgspark.operators import blocks, mixture

CANDIDATES = [mixture.Candidate("sparse", 0.1, 0.2, 0.5), mixture.Candidate("even", 0.5, 0.5, 0.3)]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(12)
    n, m = 90, 40
    e = rng.binomial(2, rng.uniform(0.1, 0.9, m)[:, None], (m, n))
    e[9] = 1
    x = e - e.mean(1, keepdims=True)
    y = x[3] * 1.2 - x[20] + rng.normal(size=n)
    other = rng.normal(size=n)
    panel = spark.createDataFrame([(j, e[j].tolist()) for j in range(m)], "vid long, e array<int>").coalesce(1)
    traits = spark.createDataFrame([(k, float(y[k]), float(other[k])) for k in range(n)], "k int, y double, z double").repartition(3)
    return panel, traits, e, np.column_stack([y, other])


def direct(e, y, order, sweeps):
    """Sweeps one variant at a time over the residuals themselves."""
    n = e.shape[1]
    x = e - e.mean(1, keepdims=True)
    size = (x**2).sum(1)
    x = np.where(size[:, None] > 0, x / np.sqrt(np.where(size > 0, size, 1))[:, None], 0) * np.sqrt(n - 1)
    y = (y - y.mean(0)) / y.std(0, ddof=1)
    m = int((size > 0).sum())
    beta = np.zeros((len(e), y.shape[1], len(CANDIDATES)))
    for t in range(y.shape[1]):
        for k, c in enumerate(CANDIDATES):
            r = y[:, t].copy()
            v, prior = np.array([(1 - c.f) / c.p, c.f / (1 - c.p)]) * c.h2 / m, np.array([c.p, 1 - c.p])
            for _ in range(sweeps):
                for j in order:
                    if size[j] == 0:
                        continue
                    g = n - 1
                    s = 1 / (g / (1 - c.h2) + 1 / v)
                    mu = s * (x[j] @ r + g * beta[j, t, k]) / (1 - c.h2)
                    w = prior * np.sqrt(s / v) * np.exp(mu**2 / 2 / s)
                    new = (w / w.sum()) @ mu
                    r -= x[j] * (new - beta[j, t, k])
                    beta[j, t, k] = new
    return beta


def got(df, m=40):
    out = np.zeros((m, 2, 2))
    for r in df.collect():
        out[r["vid"], ["y", "z"].index(r["trait"]), ["sparse", "even"].index(r["candidate"])] = r["beta"]
    return out


@pytest.mark.parametrize("side", [2048, 30])
def test_sweeps_equal_numpy(spark, data, monkeypatch, side):
    panel, traits, e, y = data
    monkeypatch.setattr(blocks, "VARIANTS", 16)
    path = mixture.prepared(panel, traits, ["y", "z"], side)
    df, bounds = mixture.fitted(spark, path, CANDIDATES, 4, 0.0)
    assert np.allclose(got(df), direct(e, y, range(40), 4)) and len(bounds) == 4
    rises = np.diff(np.array(bounds), axis=0)
    assert (rises > -1e-9).all() and (rises[0] > 1e-6).any()


def test_a_fit_that_is_cut_off(spark, data, monkeypatch):
    panel, traits, _, _ = data
    monkeypatch.setattr(blocks, "VARIANTS", 16)
    one, two = mixture.prepared(panel, traits, ["y", "z"], 45), mixture.prepared(panel, traits, ["y", "z"], 45)
    whole, bounds = mixture.fitted(spark, one, CANDIDATES, 5, 0.0)
    mixture.fitted(spark, two, CANDIDATES, 2, 0.0)
    rest, again = mixture.fitted(spark, two, CANDIDATES, 5, 0.0)
    assert (got(whole) == got(rest)).all() and bounds == again
    with pytest.raises(ValueError, match="other candidates"):
        mixture.fitted(spark, two, CANDIDATES[:1])


def test_it_ends_when_nothing_moves(spark, data):
    panel, traits, e, y = data
    path = mixture.prepared(panel, traits, ["y"])
    df, bounds = mixture.fitted(spark, path, CANDIDATES, 200, 1e-4)
    assert 3 < len(bounds) < 200 and len(mixture.fitted(spark, path, CANDIDATES, 200, 1e-4)[1]) == len(bounds)
    best = {r["vid"]: abs(r["beta"]) for r in df.where("candidate = 'sparse'").collect()}
    assert set(sorted(best, key=best.get)[-2:]) == {3, 20} and best[9] == 0


def test_odd_input(spark, data):
    panel, traits, _, _ = data
    for bad in (traits.where("k > 0"), traits.selectExpr("k", "CASE WHEN k > 3 THEN y END AS y"), traits.selectExpr("k", "1.0 AS y")):
        with pytest.raises(ValueError, match="traits are numbers"):
            mixture.prepared(panel, bad, ["y"])
    with pytest.raises(ValueError, match="between 0 and 1"):
        mixture.fitted(spark, mixture.prepared(panel, traits, ["y"]), [mixture.Candidate("x", 0.0, 0.5, 0.5)])


@pytest.mark.parametrize("side", [2048, 30])
def test_carriers_equal_numpy(spark, data, monkeypatch, side):
    _, traits, e, y = data
    monkeypatch.setattr(blocks, "VARIANTS", 16)
    monkeypatch.setattr(blocks, "densified", None)
    calls = spark.createDataFrame([(int(j), int(k), int(e[j, k])) for j, k in zip(*np.nonzero(e), strict=True)], "vid long, k int, g long")
    path = mixture.carried(calls.where("k < 30 OR k >= 60 OR vid > 20"), traits, ["y", "z"], 90, side)
    held = e.copy()
    held[:21, 30:60] = 0
    df, bounds = mixture.fitted(spark, path, CANDIDATES, 4, 0.0)
    assert np.allclose(got(df), direct(held, y, range(40), 4)) and (np.diff(np.array(bounds), axis=0) > -1e-9).all()


def test_carried_variants_are_exchanged_in_large_chunks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    n, m = 400, 3000
    e = (rng.random((m, n)) < 0.01).astype(int) * rng.integers(1, 3, (m, n))
    e[7], e[8] = 0, 1
    y = rng.normal(size=(n, 2)) + e[3][:, None]
    traits = spark.createDataFrame([(k, float(y[k, 0]), float(y[k, 1])) for k in range(n)], "k int, y double, z double")
    calls = spark.createDataFrame([(int(j), int(k), int(e[j, k])) for j, k in zip(*np.nonzero(e), strict=True)], "vid long, k int, g long")
    kept = np.flatnonzero(e.any(1))
    want = direct(e, y, range(m), 2)
    for pairs, square, few in ((mixture.PAIRS, 1024, 1), (20_000, 16, 60)):
        monkeypatch.setattr(mixture, "PAIRS", pairs)
        monkeypatch.setattr(blocks, "VARIANTS", square)
        path = mixture.carried(calls, traits, ["y", "z"], n, 200)
        chunks = json.loads(mixture.load(f"{path}/meta"))["chunks"]
        assert len(chunks) == 1 if few == 1 else 1 < len(chunks) <= few  # an exchange takes a second whatever its size
        df, bounds = mixture.fitted(spark, path, CANDIDATES, 2, 0.0)
        assert np.allclose(got(df, m)[kept], want[kept], atol=1e-12) and (np.diff(np.array(bounds), axis=0) > -1e-9).all()
