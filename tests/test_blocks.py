"""Block-matrix LD scores and orthonormal bases against numpy."""

import hashlib

import numpy as np
import pytest

from sgspark.operators import basis, blocks


def sign(i, p):
    return 1 if hashlib.md5(f"{i}:{p}".encode()).hexdigest()[0] < "8" else -1


def standardised(e, c=None):
    """Rows u, their shares of variance, by definition."""
    x = np.array([[np.nan if v is None else v for v in row] for row in e], dtype=float)
    x = np.where(np.isnan(x), 0, x - np.nanmean(x, axis=1, keepdims=True))
    q = np.linalg.qr(np.column_stack([np.ones(x.shape[1]), *(c if c is not None else [])]))[0]
    left = x - x @ q @ q.T
    size, raw = (left**2).sum(1), (x**2).sum(1)
    some = size > 1e-10 * raw
    return np.where(some[:, None], left / np.sqrt(np.where(some, size, 1))[:, None], 0), np.where(some, size / np.where(raw > 0, raw, 1), 0)


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    n, m = 50, 40
    common = rng.normal(size=n)
    e = [[None if rng.random() < 0.03 else int(v) for v in np.clip(np.round(1 + rng.normal(size=n) + common * (j % 3 == 0)), 0, 2)] for j in range(m)]
    e[7] = [1] * n
    a = [(1.0, float(j % 2 == 0), float(j < 25)) for j in range(m)]
    c = [rng.normal(size=n), rng.integers(0, 3, n).astype(float)]
    panel = spark.createDataFrame([(j, e[j], *a[j]) for j in range(m)], "vid long, e array<int>, base double, even double, low double")
    covariates = spark.createDataFrame([(i, float(c[0][i]), float(c[1][i]), float(c[1][i] * 2 - 1)) for i in range(n)], "k int, c1 double, c2 double, c3 double")
    return panel, covariates, e, np.array(a), c


@pytest.mark.parametrize("side, columns", [(2048, 1024), (16, 7)])
@pytest.mark.parametrize("weighted", [False, True])
def test_genomewide(spark, table, side, columns, weighted):
    panel, covariates, e, a, c = table
    q = basis.orthonormal(covariates, ["c1", "c2", "c3"])
    assert q.rank == 3
    got = blocks.genomewide(panel, ["base", "even", "low"], 6, q.rows.select("k", "q"), q.rank, weighted, side, columns)
    out = got.scores.orderBy("vid").toPandas()
    u, share = standardised(e, c)
    n, d = 50, 47
    v = share * (n - 1) / d
    w = a * v[:, None] if weighted else a
    z = np.array([[sign(j, p) for p in range(6)] for j in range(len(e))])
    assert np.allclose(out["v"], v)
    raw = np.zeros((len(e), 3))
    for k, name in enumerate(("base", "even", "low")):
        y = (u @ (u.T @ (np.sqrt(w[:, k : k + 1]) * z))) ** 2
        raw[:, k] = y.mean(1)
        assert np.allclose(out[f"l2_{name}"], y.mean(1) - w[:, k].sum() / d)
        assert np.allclose(out[f"var_{name}"], y.var(1, ddof=1) / 6)
    fixed = got.corrections.toPandas().set_index(["a", "b"])
    squares = (n * u**2).T @ w / w.sum(0)
    for i, one in enumerate(("base", "even", "low")):
        for j, other in enumerate(("base", "even", "low")):
            row, inside = fixed.loc[one, other], a[:, i] != 0
            s, m_a, m_b = raw[inside, j].sum(), inside.sum(), (a[:, j] != 0).sum()
            mu = (squares[:, i] * squares[:, j]).mean()
            rho = ((d + 1) ** 2 * s / (m_a * m_b) - n * mu) / (n * (n - 1))
            assert np.allclose([row["r2"], row["mu22"], row["rho2"], row["bias"], row["delta"]], [s / (m_a * m_b), mu, rho, s - m_a * m_b * rho, mu - 1 - 2 * rho])


@pytest.mark.parametrize("side", [2048, 9])
def test_exact(spark, table, side):
    panel, _, e, a, _ = table
    u, _ = standardised(e)
    r2 = (u @ u.T) ** 2
    got = blocks.exact(panel, side=side).orderBy("vid").toPandas()
    assert np.allclose(got["raw"], r2.sum(1)) and got["raw"][7] == 0
    assert np.allclose(blocks.exact(panel, "even", side=side).orderBy("vid").toPandas()["raw"], r2 @ a[:, 1])


def test_odd_panels(spark, table):
    panel = table[0]
    assert blocks.exact(panel.limit(0)).count() == 0
    assert blocks.genomewide(panel.limit(0), ["base"], 4).scores.count() == 0
    ragged = spark.createDataFrame([(1, [1, 2, 0]), (2, [1, 2])], "vid long, e array<int>")
    with pytest.raises(Exception, match="samples in a panel of"):
        blocks.exact(ragged).collect()
    with pytest.raises(Exception, match="negative"):
        blocks.genomewide(panel.selectExpr("vid", "e", "-base AS base"), ["base"], 2).scores.collect()
    with pytest.raises(ValueError, match="covariates aren't"):
        blocks.genomewide(panel, ["base"], 2, spark.createDataFrame([(i - 1, [1.0]) for i in range(50)], "k int, q array<double>"), 1)
    with pytest.raises(Exception, match="numbered from 0"):
        blocks.densified(spark.createDataFrame([(1, -1, 1)], "vid long, k int, g int"), 5).collect()
    large = spark.createDataFrame([(1, [40000.0, 2.5, 1.0]), (2, [70000.0, 2.0, 1.0])], "vid long, e array<double>")
    assert np.allclose([r["raw"] for r in blocks.exact(large).collect()], 1 + np.corrcoef([[40000.0, 2.5, 1.0], [70000.0, 2.0, 1.0]])[0, 1] ** 2)


def test_orthonormal(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 3)) * [1, 1e6, 1e-5]
    rows = [(i, *map(float, v), float(v[0] * 2 - v[1]), 5.0, 0.0) for i, v in enumerate(x)]
    table = spark.createDataFrame(rows, "k int, a double, b double, c double, d double, e double, f double").repartition(7)
    got = basis.orthonormal(table.union(spark.createDataFrame([(900, None, 1.0, 1.0, 1.0, 1.0, 1.0)], table.schema)), list("abcdef"))
    out = got.rows.orderBy("k").collect()
    q = np.array([r["q"] for r in out if r["q"] is not None])
    assert got.rank == 4 and out[-1]["q"] is None and np.abs(q.T @ q - np.eye(4)).max() < 1e-12
    span = np.column_stack([np.ones(400), x])
    left = span - q @ (q.T @ span)
    assert np.abs(left / np.abs(span).max(0)).max() < 1e-9
    nothing = basis.orthonormal(table.select("k", "f"), ["f"], constant=False)
    assert nothing.rank == 0 and set(r["q"] is not None and len(r["q"]) for r in nothing.rows.collect()) == {0}
    assert basis.orthonormal(table.limit(0), ["a"]).rank == 0


def test_a_tree_of_factors(spark, monkeypatch):
    monkeypatch.setattr(basis, "FAN", 2)
    rng = np.random.default_rng(7)
    table = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(300, 2)))], "k int, a double, b double").repartition(9)
    q = np.array([r["q"] for r in basis.orthonormal(table, ["a", "b"]).rows.collect()])
    assert np.abs(q.T @ q - np.eye(3)).max() < 1e-12
