"""Sums of squares whose products with the number of samples pass 64 bits."""

from fractions import Fraction

import pandas as pd
import pytest

from sgspark.operators import gwas, traits, variance

Y = [400_000_000 + 1_000 * k * (-1) ** k for k in range(40)]


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(pd.DataFrame({"sid": range(40), "y": Y, "x": [y // 3 for y in Y]})).cache()


@pytest.fixture(scope="module")
def calls(spark):
    return spark.createDataFrame([(j, k, 1 + (j + k) % 2) for j in (1, 2) for k in range(0, 40, j + 1)], "idx long, sid long, g long").cache()


def _spread(a, b):
    return len(a) * sum(x * y for x, y in zip(a, b, strict=True)) - sum(a) * sum(b)


def test_ols_of_large_values(calls, people):
    got = {r["idx"]: r for r in gwas.ols(calls, people.selectExpr("'t' AS trait", "sid", "y")).collect()}
    for j in (1, 2):
        g = [1 + (j + k) % 2 if k % (j + 1) == 0 else 0 for k in range(40)]
        sxx, sxy, syy = _spread(g, g), _spread(g, Y), _spread(Y, Y)
        assert got[j]["beta"] == pytest.approx(sxy / sxx, rel=1e-12)
        assert got[j]["se"] == pytest.approx(float((syy - Fraction(sxy * sxy, sxx)) / (38 * sxx)) ** 0.5, rel=1e-9)


def test_overlap_of_large_values(people):
    x = [y // 3 for y in Y]
    want = _spread(Y, x) / (_spread(Y, Y) * _spread(x, x)) ** 0.5
    assert variance.overlap_covariance(people, "y", "x").first()["c"] == pytest.approx(want, rel=1e-12)


def test_pairs_of_large_values(spark, calls, people):
    got = traits.pair_features(calls, spark.createDataFrame([(1, 2)], "a long, b long"), people, "y").first()
    f = [(1 + (1 + k) % 2) * (1 + k % 2) if k % 6 == 0 else 0 for k in range(40)]
    assert got["score"] == pytest.approx(_spread(f, Y) / 40, rel=1e-12)
    assert got["information"] == pytest.approx(_spread(f, f) / 40 * _spread(Y, Y) / 40 / 39, rel=1e-12)
