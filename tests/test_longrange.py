"""Traces of pairs of units by probes against the same probes in numpy, and against exact traces within their errors."""

import numpy as np
import pytest

from sgspark.operators import basis, longrange
from test_blocks import standardised


@pytest.fixture(scope="module")
def genotypes():
    rng = np.random.default_rng(11)
    n, m = 60, 48
    ancestry = rng.normal(size=n)
    e = [[int(v) for v in np.clip(np.round(1 + 0.6 * ancestry * (j % 3 > 0) + 0.6 * rng.normal(size=n)), 0, 2)] for j in range(m)]
    e[5] = [2] * n
    return e, [j // 12 for j in range(m)], rng.normal(size=n)


def kernels(e, unit, c, units):
    u, v = standardised(e, None if c is None else [c])
    n = u.shape[1]
    fixed = np.linalg.qr(np.column_stack([np.ones(n), *([] if c is None else [c])]))[0]
    p = np.eye(n) - fixed @ fixed.T
    nu = n - fixed.shape[1]
    k = [nu / v.sum() * (u[np.array(unit) == g].T * v[np.array(unit) == g]) @ u[np.array(unit) == g] for g in range(units)]
    one = [x - np.trace(x) / nu * p for x in k]
    bare = [p @ (x - np.diag(np.diag(x))) @ p for x in k]
    return one, [x - np.trace(x) / nu * p for x in bare]


@pytest.mark.parametrize("side", [2048, 25])
@pytest.mark.parametrize("with_covariate", [False, True])
def test_the_same_probes(spark, genotypes, side, with_covariate):
    e, unit, c = genotypes
    panel = spark.createDataFrame([(j, e[j], float(unit[j])) for j in range(len(e))], "vid long, e array<int>, unit double").repartition(3)
    options = {}
    if with_covariate:
        b = basis.orthonormal(spark.createDataFrame([(i, float(x)) for i, x in enumerate(c)], "k int, c double"), ["c"])
        options = {"covariates": b.rows.select("k", "q"), "rank": b.rank}
    got = longrange.unit_traces(panel, "unit", 5, 10, 4, side=side, **options).orderBy("g", "h").toPandas()
    z = longrange.signs(0, 60, range(10))
    for name, made in zip(("self", "apart"), kernels(e, unit, c if with_covariate else None, 5), strict=True):
        y = np.stack([a @ z for a in made])
        groups = [np.einsum("gip,hip->gh", y[:, :, p], y[:, :, p]) / len(p) for p in (range(4), range(4, 8), range(8, 10))]
        assert np.allclose(got[name].to_numpy().reshape(5, 5), np.mean(groups, axis=0))
        assert np.allclose(got[f"{name}_se"].to_numpy().reshape(5, 5), np.std(groups, axis=0, ddof=1) / np.sqrt(3))
        assert np.allclose(got[name].to_numpy().reshape(5, 5)[4], 0)


def test_exact_traces_within_their_errors(spark, genotypes):
    e, unit, _ = genotypes
    panel = spark.createDataFrame([(j, e[j], unit[j]) for j in range(len(e))], "vid long, e array<int>, unit int")
    traces = longrange.unit_traces(panel, "unit", 4, 600, 20)
    got = traces.orderBy("g", "h").toPandas()
    for name, made in zip(("self", "apart"), kernels(e, unit, None, 4), strict=True):
        exact = np.array([[np.trace(a @ b) for b in made] for a in made])
        off = np.abs(got[name].to_numpy().reshape(4, 4) - exact) / got[f"{name}_se"].to_numpy().reshape(4, 4)
        assert off.max() < 4.5
        share = longrange.shares(traces).first()[f"rho_{name}"]
        assert abs(share - (1 - np.trace(exact) / exact.sum())) < 0.05
    row = longrange.shares(traces, spark.createDataFrame([(0, "a"), (1, "a"), (2, "b"), (3, "b")], "g int, grp string")).first()
    x = got["self"].to_numpy().reshape(4, 4)
    assert np.isclose(row["rho_self"], 1 - (x[:2, :2].sum() + x[2:, 2:].sum()) / x.sum())
    assert row["rho_diag"] == max(row["rho_self"] - row["rho_apart"], 0) and np.isclose(row["rho_off"], max(row["rho_self"] - row["rho_diag"], 0))


def test_no_variants(spark):
    none = spark.createDataFrame([], "vid long, e array<int>, unit int")
    assert longrange.unit_traces(none, "unit", 3, 4).count() == 0
