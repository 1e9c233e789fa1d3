import hashlib
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sgspark.functions import special
from sgspark.operators import axes, gwas, ldscore, ranks, relatives, segments, solve, traits, variance


@pytest.mark.parametrize("m,blocks", [(1, 1), (7, 3), (100, 23), (722, 200), (1001, 13)])
def test_units_are_floors_of_even_steps(spark, m, blocks):
    axis = spark.range(m).select(F.col("id").alias("pos"), F.col("id").alias("idx"))
    got = axes.equal_units(axis, blocks).orderBy("pos").toPandas()["unit"].to_numpy()
    edges = np.floor(np.linspace(0, m, blocks + 1)).astype(int)
    assert (got == np.searchsorted(edges, np.arange(m), side="right") - 1).all()


def test_jackknife_matches_numpy(spark):
    rng = np.random.default_rng(1)
    sizes, values, full = rng.integers(1, 9, 12), rng.normal(size=12), 0.3
    rows = spark.createDataFrame(pd.DataFrame({"k": 1, "m": sizes, "x": values, "f": full}))
    got = axes.jackknife(rows, "x", "f", "m", ["k"]).first()
    total = sizes.sum()
    w, pv = sizes / total, (total * full - (total - sizes) * values) / sizes
    assert math.isclose(got["se"], math.sqrt((w**2 / (1 - w) * (pv - (w * pv).sum()) ** 2).sum()), rel_tol=1e-9)


def test_quantile_and_tail(spark):
    from statistics import NormalDist

    ps = [1e-6, 0.01, 0.2, 0.5, 0.9, 0.9999]
    df = spark.createDataFrame([(p,) for p in ps], "p double").selectExpr("p", f"{special.normal_quantile('p')} AS z")
    for row in df.collect():
        assert abs(row["z"] - NormalDist().inv_cdf(row["p"])) < 1e-7
    tails = spark.createDataFrame([(0.0,), (1.0,), (1.96,), (-3.0,)], "z double").selectExpr("z", f"{special.two_sided_p('z')} AS p")
    for row in tails.collect():
        assert abs(row["p"] - math.erfc(abs(row["z"]) / math.sqrt(2))) < 2e-7


def test_alleles(spark):
    cases = [("A", "C", "A", "C", True, False), ("A", "C", "C", "A", True, True), ("A", "C", "T", "G", True, False), ("A", "C", "G", "T", True, True), ("A", "T", "A", "T", False, False), ("I", "C", "I", "C", False, False), ("A", "C", "A", "G", False, False), (None, "C", "A", "C", False, False)]
    df = spark.createDataFrame([c[:4] for c in cases], "a string, b string, c string, d string")
    got = [(r["keep"], r["flip"]) for r in gwas.harmonised(df, "a", "b", "c", "d").collect()]
    assert got == [c[4:] for c in cases]


def test_qc_drops_and_dedupes(spark):
    rows = [("t", "s1", 1, 10.0, 1.0, 0.5), ("t", "s1", 2, 20.0, 2.0, 0.5), ("t", "s2", 3, None, 1.0, 1.0), ("t", "s3", 4, 5.0, float("nan"), 1.0), ("t", "s4", 5, 5.0, 1.0, 0.0), ("t", "s5", 6, 20.0, 1.0, 1.0)]
    out = gwas.qc(spark.createDataFrame(rows, "trait string, snp string, line int, n double, beta double, se double")).orderBy("snp").collect()
    assert [(r["snp"], r["line"], round(r["z"], 6)) for r in out] == [("s1", 2, 4.0), ("s5", 6, 1.0)]


def test_window_scores_against_numpy(spark):
    rng = np.random.default_rng(2)
    g = rng.integers(0, 3, (40, 15))
    axis = spark.createDataFrame([(int(j), 1 + int(j >= 8), int(j)) for j in range(15)], "idx long, chr int, pos long")
    dosage = spark.createDataFrame([(int(j), int(i), int(g[i, j])) for i in range(40) for j in range(15) if g[i, j]], "idx long, sid long, g long")
    n = spark.createDataFrame([(40,)], "n long")
    pairs = ldscore.window_r2(axis, dosage, gwas.variant_sums(dosage), n, 3)
    got = ldscore.scores(pairs, axis.withColumn("base", F.lit(1)), ["base"]).orderBy("idx").toPandas()["l2_base"].to_numpy()
    r2 = np.corrcoef(g.T) ** 2
    adjusted = r2 - (1 - r2) / 38
    near = (np.abs(np.subtract.outer(np.arange(15), np.arange(15))) <= 3) & np.equal.outer(np.arange(15) >= 8, np.arange(15) >= 8)
    assert np.allclose(got, (adjusted * near).sum(1))


@pytest.mark.parametrize("tile,cells", [(2048, 1 << 22), (3, 20)])
def test_dense_scores_against_numpy(spark, monkeypatch, tile, cells):
    monkeypatch.setattr(ldscore, "TILE", tile)
    monkeypatch.setattr(ldscore, "CELLS", cells)
    rng = np.random.default_rng(3)
    x = rng.integers(-50, 50, (30, 8))
    panel = spark.createDataFrame([(i, 0, [int(v) for v in row]) for i, row in enumerate(x)], "vid long, label int, e array<long>")
    got = ldscore.gram_scores(panel).orderBy("vid").toPandas()["raw"].to_numpy()
    assert np.allclose(got, (np.corrcoef(x) ** 2).sum(1))
    assert ldscore.gram_scores(panel.limit(0)).count() == 0
    values = ldscore.sketch(panel, 5).toPandas().pivot(index="vid", columns="probe", values="y").to_numpy()
    signs = np.array([[1 if hashlib.md5(f"{i}:{p}".encode()).hexdigest()[0] < "8" else -1 for p in range(5)] for i in range(30)])
    centred = 8 * x - x.sum(1, keepdims=True)
    assert np.allclose(values, (centred @ (centred.T @ signs)) ** 2 / (centred**2).sum(1, keepdims=True))


def test_h2_recovers_planted_signal(spark):
    """Chi-squares drawn around 1 + n h2 l / M give back h2."""
    rng = np.random.default_rng(4)
    m, n, h2 = 4000, 5000.0, 0.4
    l2 = rng.uniform(1, 30, m)
    z2 = (1 + n * h2 * l2 / m) * rng.chisquare(1, m)
    rows = pd.DataFrame({"trait": "t", "unit": np.arange(m) * 20 // m, "n_star": n, "y": z2, "base": 1, "l2_base": l2})
    got = variance.h2_single(spark.createDataFrame(rows)).first()
    # the moment slope ignores the intercept's noise, so compare with the same ratio in numpy
    want = (z2.mean() - 1) * n / (n * n * l2.sum() / m / m)
    assert math.isclose(got["estimate"], want, rel_tol=1e-9)
    assert abs(got["estimate"] - h2) < 4 * got["se"]


def test_families_and_closure(spark):
    pairs = spark.createDataFrame([(5, 4), (4, 9), (1, 2), (7, 7), (None, 3), (9, 12), (20, 21), (21, 22), (22, 23), (23, 20)], "a long, b long")
    fam = {r["id"]: r["family"] for r in relatives.families(pairs).collect()}
    assert fam == {5: 4, 4: 4, 9: 4, 12: 4, 1: 1, 2: 1, 20: 20, 21: 20, 22: 20, 23: 20}
    assert relatives.closure(relatives.families(pairs)).count() == 6 + 1 + 6
    assert relatives.families(pairs.limit(0)).count() == 0


def test_as_of_and_interpolation(spark):
    points = spark.createDataFrame([("u", 1.0), ("u", 5.0), ("u", 9.0), ("w", 3.0)], "o string, x double")
    seg = spark.createDataFrame([("u", 2.0, "a"), ("u", 5.0, "b")], "o string, x double, code string")
    got = {(r["o"], r["x"]): r["found"] for r in segments.as_of(points, seg, "o", "x", "x", "code").collect()}
    assert got == {("u", 1.0): None, ("u", 5.0): "b", ("u", 9.0): "b", ("w", 3.0): None}
    knots = spark.createDataFrame([("u", 2.0, 10.0), ("u", 4.0, 20.0), ("u", 6.0, 40.0)], "o string, x double, y double")
    cm = {r["x"]: r["cm"] for r in segments.interpolated(points.where("o = 'u'"), knots, "o", "x", "y").collect()}
    assert cm == {1.0: 2.5, 5.0: 30.0, 9.0: 62.5}


def test_ranks_and_auc(spark):
    rng = np.random.default_rng(5)
    value, case = rng.integers(0, 10, 200), rng.integers(0, 2, 200)
    rows = spark.createDataFrame(pd.DataFrame({"k": 1, "v": value, "c": case}))
    want = pd.Series(value).rank().to_numpy()
    got = ranks.average_ranks(rows, "v", ["k"]).toPandas()
    assert sorted(got["rank"]) == sorted(want)
    one, zero = value[case == 1], value[case == 0]
    area = (np.greater.outer(one, zero) + 0.5 * np.equal.outer(one, zero)).mean()
    assert math.isclose(ranks.auc(rows, "v", "c", ["k"]).first()["auc"], area)


def test_polygenic_scores_against_numpy(spark):
    rng = np.random.default_rng(6)
    g = rng.integers(0, 3, (25, 10))
    w = rng.normal(size=10)
    dosage = spark.createDataFrame([(int(j), int(i), int(g[i, j])) for i in range(25) for j in range(10) if g[i, j]], "idx long, sid long, g long")
    scale = traits.scale(gwas.variant_sums(dosage), spark.createDataFrame([(25,)], "n long"))
    weights = scale.join(spark.createDataFrame(list(enumerate(map(float, w))), "idx long, w double"), "idx")
    got = traits.polygenic_scores(dosage, weights, spark.range(25).withColumnRenamed("id", "sid")).orderBy("sid").toPandas()["score"].to_numpy()
    assert np.allclose(got, ((g - g.mean(0)) / g.std(0, ddof=1)) @ w)


def test_u_statistics_against_numpy(spark):
    rng = np.random.default_rng(7)
    t = rng.normal(size=(9, 9))
    t = t + t.T
    rows = [(i, j, float(t[i, j])) for i in range(9) for j in range(9) if i != j]
    got = traits.u_statistics(spark.createDataFrame(rows, "a int, b int, t double")).first()
    np.fill_diagonal(t, 0)
    assert math.isclose(got["theta"], t.sum() / 72)
    assert math.isclose(got["null_variance"], 2 * (t**2).sum() / 72**2)


def test_delete_two_sets(spark):
    units = spark.range(5).withColumnRenamed("id", "unit")
    assert axes.delete_sets(units, 2).count() == 20


def test_conjugate_gradients_against_numpy(spark):
    rng = np.random.default_rng(8)
    g = rng.integers(0, 3, (20, 30))
    y = rng.normal(size=20)
    dosage = spark.createDataFrame([(int(j), int(i), int(g[i, j])) for i in range(20) for j in range(30) if g[i, j]], "idx long, sid long, g long")
    scale = traits.scale(gwas.variant_sums(dosage), spark.createDataFrame([(20,)], "n long"))
    got = solve.conjugate_gradients(dosage, scale, spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "sid long, y double"), 0.5, 25)
    x = (g - g.mean(0)) / g.std(0, ddof=1)
    want = np.linalg.solve(x @ x.T / 30 + 0.5 * np.eye(20), y)
    assert np.allclose(got.orderBy("sid").toPandas()["u"].to_numpy(), want, atol=1e-6)


def test_conjugate_gradients_short_of_the_tolerance(spark):
    dosage = spark.createDataFrame([(j, i, 1 + (i * j) % 2) for i in range(9) for j in range(12) if (i + j) % 3], "idx long, sid long, g long")
    scale = traits.scale(gwas.variant_sums(dosage), spark.createDataFrame([(9,)], "n long"))
    with pytest.raises(RuntimeError, match="after 1 rounds"):
        solve.conjugate_gradients(dosage, scale, spark.createDataFrame([(i, float(i * i)) for i in range(9)], "sid long, y double"), 0.5, 1)


def test_hc3_against_numpy(spark):
    rng = np.random.default_rng(9)
    x, y = rng.normal(size=30), rng.normal(size=30)
    got = traits.hc3(spark.createDataFrame(pd.DataFrame({"k": 1, "x": x, "y": y})), "x", "y", ["k"]).first()
    a = np.column_stack([np.ones(30), x])
    inv = np.linalg.inv(a.T @ a)
    b = inv @ a.T @ y
    e = (y - a @ b) / (1 - np.einsum("ij,jk,ik->i", a, inv, a))
    cov = inv @ (a.T * e**2) @ a @ inv
    assert math.isclose(got["slope"], b[1]) and math.isclose(got["se"], math.sqrt(cov[1, 1]))


def test_ancestry_runs(spark):
    lines = spark.createDataFrame([("s1", "3:01 10:11"), ("s2", "10:00")], "iid string, line string")
    seg = segments.ancestry_runs(lines)
    assert sorted(map(tuple, seg.collect())) == [("s1", 0, 3, 0, 1), ("s1", 3, 10, 1, 1), ("s2", 0, 10, 0, 0)]
    sites = spark.createDataFrame([(0,), (2,), (3,), (9,)], "site long")
    got = {(r["iid"], r["site"]): r["copies"] for r in segments.ancestry_dosage(seg, sites, 1).collect()}
    assert got == {("s1", 0): 1, ("s1", 2): 1, ("s1", 3): 2, ("s1", 9): 2} | {("s2", k): 0 for k in (0, 2, 3, 9)}
    with pytest.raises(Exception, match="not a run"):
        segments.ancestry_runs(spark.createDataFrame([("s", "3:0x")], "iid string, line string")).collect()


def test_exponential_fit(spark):
    curve = spark.createDataFrame([(float(i), 0.1 + 0.5 * math.exp(-0.3 * i)) for i in range(20)], "d double, k double")
    fit = segments.exponential_fit(curve, "d", "k", [0.1, 0.2, 0.3, 0.4]).first()
    assert fit["rate"] == 0.3 and math.isclose(fit["a"], 0.1) and math.isclose(fit["h"], 0.5)
