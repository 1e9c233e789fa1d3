"""Tails of weighted chi-squares in closed form and on grids; robust tests against numpy."""

import math

import numpy as np
import pytest

from sgspark.functions import quadratic
from sgspark.operators import robust


def even(x, k):
    term = total = 1.0
    for i in range(1, k // 2):
        term *= x / 2 / i
        total += term
    return math.exp(-x / 2) * total


Q = np.array([0.01, 0.5, 1, 3, 10, 40, 100, 300.0])


@pytest.mark.parametrize("k", [2, 4, 10, 60])
def test_chi_squares(k):
    want = np.array([even(x, k) for x in Q])
    for w, d in ((np.ones((8, k)), None), (np.ones((8, 1)), np.full((8, 1), float(k))), (np.pad(np.ones((8, k)), ((0, 0), (0, 3))), None)):
        p, error = quadratic.tails(Q, w, d)
        assert np.abs(p - want).max() < 1e-12 and error.max() < 1e-10


def test_weighted_pairs_and_single_ones():
    lam = np.array([3, 1.5, 0.2, 0.01])
    want = [sum(math.prod(a / (a - b) for b in lam if b != a) * math.exp(-q / 2 / a) for a in lam) for q in Q]
    assert np.abs(quadratic.tails(Q, np.tile(np.repeat(lam, 2), (8, 1)))[0] - want).max() < 1e-12
    p, _ = quadratic.tails(Q, np.ones((8, 1)))
    assert np.abs(p - [math.erfc(math.sqrt(x / 2)) for x in Q]).max() < 1e-12
    angle = (np.arange(200_000) + 0.5) * np.pi / 200_000
    for a, b in ((1, 0.3), (1, 1e-3), (5, 1e-6)):
        want = [np.exp(-q / 2 / (a * np.cos(angle) ** 2 + b * np.sin(angle) ** 2)).mean() for q in Q]
        assert np.abs(quadratic.tails(Q, np.tile([a, b], (8, 1)))[0] - want).max() < 1e-10


def test_signs():
    q = np.array([-5, -0.1, 0, 0.1, 5])
    p, error = quadratic.tails(q, np.tile([1, 1, -1, -1.0], (5, 1)))
    assert np.abs(p - np.where(q > 0, 0.5 * np.exp(-q / 2), 1 - 0.5 * np.exp(q / 2))).max() < 1e-12 and error.max() < 1e-10
    for c in (0.1, 1, 7):
        assert abs(quadratic.tails(np.zeros(1), np.array([[1, 1, -c, -c]]))[0][0] - 1 / (1 + c)) < 1e-11
        assert abs(quadratic.tails(np.zeros(1), np.array([[1, -c]]))[0][0] - (1 - 2 / np.pi * np.arctan(np.sqrt(c)))) < 1e-11
    w = np.array([[2, 1, -0.5, -3], [1, 2, 3, -4.0]])
    one, two = quadratic.tails(np.array([1.5, -2]), w)[0], quadratic.tails(np.array([-1.5, 2]), -w)[0]
    assert np.abs(one + two - 1).max() < 1e-11


def test_odd_values():
    p, error = quadratic.tails(np.array([1.0, np.nan, 0, -1, 3, 0, np.inf]), np.array([[0, 0], [1, 1], [-1, -2], [1, 2], [-1, -1.0], [0, 0], [1, 1]]))
    assert np.array_equal(p, [0, np.nan, 0, 1, 0, 1, np.nan], equal_nan=True)
    assert np.isnan(quadratic.tails(np.ones(1), np.ones((1, 1)), np.zeros((1, 1)))[0][0])


def test_many_rows_agree_with_a_half_of_the_step(monkeypatch):
    rng = np.random.default_rng(9)
    w = rng.exponential(size=(300, 25)) ** 3
    q = w.sum(axis=1) * rng.uniform(0.1, 4, 300)
    one, error = quadratic.tails(q, w)
    monkeypatch.setattr(quadratic, "STEP", 0.05)
    assert np.abs(one - quadratic.tails(q, w)[0]).max() < 1e-11 and error.max() < 1e-10


def test_tails_of_columns(spark):
    df = spark.createDataFrame([(1, 3.0, [1.0, 1.0]), (2, None, [1.0]), (3, 2.0, None), (4, 2.0, [1.0, 2.0, None]), (5, 1.0, [])], "i int, q double, w array<double>")
    got = {r["i"]: r["p"] for r in quadratic.with_tails(df, "q", "w").collect()}
    assert abs(got[1] - math.exp(-1.5)) < 1e-12 and got[2] is got[3] is got[4] is None and got[5] == 0


def people(n, seed, extra=False):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(n, 2))
    f = rng.normal(size=(n, 3)) + 0.3 * c[:, :1]
    y = np.column_stack([f @ [0.2, 0, 0.1] + c[:, 0] + rng.normal(size=n) * (1 + f[:, 0] ** 2), rng.normal(size=n)])
    return f, y, c


def direct(f, y, c):
    u = np.linalg.qr(np.column_stack([np.ones(len(f)), c]))[0]
    r = f - u @ (u.T @ f)
    h, s = r.T @ r, r.T @ y
    bread = np.linalg.pinv(h, rcond=1e-10)
    e = y - u @ (u.T @ y) - r @ (bread @ s)
    leverage = (u**2).sum(1) + np.einsum("ij,jk,ik->i", r, bread, r)
    return s, h, [(r * (e[:, t : t + 1] / (1 - leverage[:, None])) ** 2).T @ r for t in range(y.shape[1])], leverage.max()


def table(spark, f, y, c, more=()):
    rows = [(*map(float, a), *map(float, b), *map(float, d)) for a, b, d in zip(f, y, c, strict=True)]
    return spark.createDataFrame([*rows, *more], "f1 double, f2 double, f3 double, y1 double, y2 double, c1 double, c2 double").repartition(5)


def test_robust_tests(spark):
    f, y, c = people(400, 1)
    df = table(spark, f, y, c, [(None, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0), (1.0, float("nan"), 1.0, 1.0, 1.0, 1.0, 1.0), (1.0, float("inf"), 1.0, 1.0, 1.0, 1.0, 1.0)])
    summary = robust.scores(df, ["f1", "f2", "f3"], ["y1", "y2"], ["c1", "c2"])
    out = {r["trait"]: r for r in robust.tests(summary, ["f1", "f2", "f3"], weights=[1, 2, 0.5], contrasts={"one": [1, -1, 0]}).collect()}
    s, h, v, top = direct(f, y, c)
    for t, trait in enumerate(("y1", "y2")):
        r, cov = out[trait], np.linalg.inv(h) @ v[t] @ np.linalg.inv(h)
        beta, se = np.linalg.inv(h) @ s[:, t], np.sqrt(np.diag(cov))
        assert r["n"] == 400 and r["fixed_rank"] == 3 and np.isclose(r["max_leverage"], top)
        assert np.allclose(r["beta"], beta) and np.allclose(r["se"], se)
        assert np.allclose(r["p"], [math.erfc(abs(z) / math.sqrt(2)) for z in beta / se])
        wald = s[:, t] @ np.linalg.inv(v[t]) @ s[:, t]
        assert np.isclose(r["joint_wald"], wald) and r["joint_df"] == 3
        assert np.isclose(r["joint_p"], math.erfc(math.sqrt(wald / 2)) + math.sqrt(2 * wald / math.pi) * math.exp(-wald / 2))
        w = np.sqrt([1, 2, 0.5])
        lam = np.linalg.eigvalsh(w[:, None] * v[t] * w[None, :])
        assert np.isclose(r["kernel_p"], quadratic.tails(np.array([(w**2) @ s[:, t] ** 2]), lam[None, :])[0][0]) and r["kernel_p_error"] < 1e-9
        assert np.isclose(r["burden_z"], s[:, t].sum() / math.sqrt(v[t].sum()))
        x = np.array([1, -1, 0])
        assert np.isclose(r["contrast_beta"]["one"], x @ beta) and np.isclose(r["contrast_se"]["one"], math.sqrt(x @ cov @ x))


def test_features_that_others_explain(spark):
    f, y, c = people(200, 2)
    f[:, 1], f[:, 2] = 2 * f[:, 0], c[:, 0] - 1
    r = robust.tests(robust.scores(table(spark, f, y, c), ["f1", "f2", "f3"], ["y1"], ["c1", "c2"]), ["f1", "f2", "f3"], contrasts={"sum": [1, 2, 0], "own": [1, 0, 0]}).first()
    s, h, v, _ = direct(f[:, :1], y, c)
    assert r["beta"] == [None] * 3 and r["joint_df"] == 1 and np.isclose(r["joint_wald"], s[0, 0] ** 2 / v[0][0, 0])
    assert np.isclose(r["contrast_beta"]["sum"], s[0, 0] / h[0, 0]) and r["contrast_beta"]["own"] is None


def test_no_people_and_no_variance(spark):
    f, y, c = people(50, 3)
    empty = robust.tests(robust.scores(table(spark, f, y, c).limit(0), ["f1", "f2", "f3"], ["y1"], ["c1"]), ["f1", "f2", "f3"])
    assert [r["kernel_p"] for r in empty.collect()] in ([], [None])
    flat = robust.tests(robust.scores(table(spark, 0 * f + 1, y, c), ["f1", "f2"], ["y1"], ["c1"]), ["f1", "f2"]).first()
    assert flat["kernel_p"] is None and flat["joint_df"] == 0 and flat["beta"] == [None, None] and flat["least_p"] is None
    with pytest.raises(ValueError, match="weights"):
        robust.tests(empty, ["f1"], weights=[-1.0])


def test_cohorts_add_up(spark):
    parts = [people(150, s) for s in (4, 5)]
    names = ["f1", "f2", "f3"]
    summaries = [robust.scores(table(spark, *x), names, ["y1", "y2"], ["c1", "c2"]) for x in parts]
    both = {r["trait"]: r for r in robust.combined(summaries[0].unionByName(summaries[1])).collect()}
    known = [direct(*x) for x in parts]
    for t, trait in enumerate(("y1", "y2")):
        assert both[trait]["n"] == 300 and np.allclose(both[trait]["s"], known[0][0][:, t] + known[1][0][:, t])
        assert np.allclose(np.array(both[trait]["v"]).reshape(3, 3), known[0][2][t] + known[1][2][t])
    assert robust.tests(robust.combined(summaries[0].unionByName(summaries[1])), names).count() == 2
